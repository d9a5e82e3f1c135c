"""Operator 13: whitening of embeddings by a bidiagonal qd solver.

Entries become whole numbers x = floor(scale * c). The fit takes each distinct x vector once: their number n, the sums S of
each dimension, and principal components of the centred vectors, without ever forming a covariance matrix:

1. blockwise QR: each task reduces its centred rows, a block at a time, to one triangular R; these are stacked and reduced
   again, a fixed number at a time, in a tree of Spark jobs, until one R is left;
2. Householder reflections turn R into an upper bidiagonal B;
3. dqds finds all singular values of B to high relative accuracy. Its shift is the trace bound 1 / sum(1 / d) of a sweep
   without shift, so it never exceeds the smallest value that is left;
4. a singular vector is that of B'B - s^2 I from a twisted factorisation: a stationary qd sweep from the top, a progressive
   one from the bottom, joined where the twist is smallest. Vectors of values that agree to many digits are found by
   inverse iteration on such factors, and all are orthogonalised.

Vectors of different lengths live in different spaces: each length has its own fit, and all steps are keyed by it. Rows whose
vector is null, empty, or holds null or non-finite entries go. Components with a singular value under 1e-10 of the first are
rounding noise and left out, as are those of a fit with one distinct vector: such rows get fewer components, or none. Repeated
rows and rows without id are answered like others; an empty table gives an empty one. A deviation that no long can hold is
null. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, map_batches, materialise

_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Settings:
    scale: int = 256
    components: int = 4
    #: Rows of a block, triangles that are stacked at once.
    block: int = 2048
    fan_in: int = 16
    #: Singular values under this share of the first count as zero.
    noise: float = 1e-10
    #: Most numbers of all fits together, which each task holds to project rows: lengths times (components + 3).
    model_numbers: int = 1 << 24


# ---------------------------------------------------------------- the solver


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal v with r = u B v' (u isn't kept), by Householder reflections."""
    r = np.array(r, float)
    n = len(r)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if len(x) < 2 or size == 0 or not np.any(x[1:]):
            return None
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        if (w := reflector(r[k:, k].copy())) is not None:
            r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        if k + 2 < n and (w := reflector(r[k, k + 1 :].copy())) is not None:
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _sweep(q: list[float], e: list[float], lo: int, hi: int, shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds transform of rows lo to hi: new q and e, and the d that it ran through."""
    qs, es, ds = [], [], []
    d = q[lo] - shift
    for i in range(lo, hi):
        ds.append(d)
        top = d + e[i]
        qs.append(top)
        t = q[i + 1] / top if top != 0.0 else 0.0
        es.append(e[i] * t)
        d = d * t - shift if top != 0.0 else q[i + 1] - shift
    ds.append(d)
    qs.append(d)
    return qs, es, ds


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the upper bidiagonal matrix of diagonal a and superdiagonal b, falling."""
    n = len(a)
    size = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if size == 0:
        return np.zeros(n)
    q, e = [float(x) ** 2 for x in a / size], [float(x) ** 2 for x in b / size]
    found: list[float] = []
    open_blocks = [(0, n - 1, 0.0)]
    while open_blocks:
        lo, hi, moved = open_blocks.pop()
        for _ in range(100 * n + 1000):
            # values that have come off at the bottom, and splits
            while hi > lo and e[hi - 1] <= _EPS * _EPS * (moved + q[hi]):
                found.append(moved + max(q[hi], 0.0))
                hi -= 1
            if hi == lo:
                found.append(moved + max(q[lo], 0.0))
                break
            cut = next((i for i in range(hi - 2, lo - 1, -1) if e[i] <= _EPS * _EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                open_blocks.append((lo, cut, moved))
                lo = cut + 1
                continue
            q[lo : hi + 1], e[lo:hi], ds = _sweep(q, e, lo, hi, 0.0)
            bound = 1.0 / sum(1.0 / d for d in ds) if min(ds) > 1e-290 else 0.0
            for shift in (bound * (1 - 1e-10), bound / 2):
                qs, es, ds = _sweep(q, e, lo, hi, shift)
                if shift > 0 and min(ds) >= 0:
                    q[lo : hi + 1], e[lo:hi], moved = qs, es, moved + shift
                    break
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sqrt(np.sort(np.maximum(found, 0.0))[::-1]) * size


def _factors(a: np.ndarray, b: np.ndarray, value: float):
    """Stationary and progressive qd factors of B'B - value I, and the twists."""
    n = len(a)
    tiny = _EPS * _EPS * max(value, 1e-300)
    guard = lambda x: x if abs(x) > tiny else (-tiny if x < 0 else tiny)
    low, high, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    plus, minus = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n):
        plus[i] = guard(s[i] + a[i] ** 2)
        if i + 1 < n:
            low[i] = a[i] * b[i] / plus[i]
            s[i + 1] = b[i] ** 2 * (s[i] / plus[i]) - value
    p[n - 1] = a[n - 1] ** 2 - value
    minus[n - 1] = guard(p[n - 1])
    for i in range(n - 2, -1, -1):
        minus[i + 1] = guard(b[i] ** 2 + p[i + 1])
        high[i] = a[i] * b[i] / minus[i + 1]
        p[i] = p[i + 1] * (a[i] ** 2 / minus[i + 1]) - value
    minus[0] = guard(p[0])
    return low, high, plus, minus, s + p + value


def _twisted(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """The vector z with N z = e_k for the factors twisted at k."""
    z = np.zeros(len(low))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, len(z) - 1):
        z[i + 1] = -high[i] * z[i]
    return z / np.linalg.norm(z)


def _solve(low, high, plus, minus, twist, k: int, right: np.ndarray) -> np.ndarray:
    """(B'B - value I)^-1 right, by the factors twisted at k."""
    n = len(low)
    y = right.copy()
    for i in range(1, k + 1):
        y[i] -= low[i - 1] * y[i - 1]
    for i in range(n - 2, k - 1, -1):
        y[i] -= high[i] * y[i + 1] if i > k else 0.0
    if k + 1 < n:
        y[k] -= high[k] * y[k + 1]
    d = np.concatenate([plus[:k], [twist if abs(twist) > 1e-300 else 1e-300], minus[k + 1 :]])
    y = y / d
    for i in range(k - 1, -1, -1):
        y[i] -= low[i] * y[i + 1]
    for i in range(k, n - 1):
        y[i + 1] -= high[i] * y[i]
    return y


def singular_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of B for its largest values, as rows, orthonormal."""
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a, b, values = a / size, b / size, values / size
    out: list[np.ndarray] = []

    def apart(z: np.ndarray) -> tuple[np.ndarray, float]:
        before = np.linalg.norm(z)
        for _ in range(2):
            for u in out:
                z = z - (u @ z) * u
        after = np.linalg.norm(z)
        return z / (after or 1.0), after / (before or 1.0)

    for number, value in enumerate(values):
        low, high, plus, minus, twists = _factors(a, b, value**2)
        k = int(np.argmin(np.abs(twists)))
        z, left = apart(_twisted(low, high, k))
        if not left > 0.7 or not np.isfinite(z).all():  # as good as equal to a value before: another vector of its space
            draw = np.random.default_rng(number)
            z, _ = apart(draw.standard_normal(len(a)))
            for _ in range(4):
                y = _solve(low, high, plus, minus, twists[k], k, z)
                scale = np.abs(y).max()
                if not np.isfinite(scale) or scale == 0:
                    break
                z, _ = apart(y / scale)
        out.append(z)
    return np.array(out).reshape(len(out), len(a))


def principal(r: np.ndarray, n: int, most: int, noise: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of r'r / n, and its trace."""
    a, b, v = bidiagonalise(r)
    values = dqds(a, b)
    good = values[: min(most, len(values))]
    good = good[good > noise * values[0]] if len(values) and values[0] > 0 else good[:0]
    vectors = singular_vectors(a, b, good) @ v.T if len(good) else np.zeros((0, len(a)))
    for row in vectors:
        row *= np.sign(row[np.argmax(np.abs(row))]) or 1.0
    return good**2 / n, vectors, float((values**2).sum() / n)


# ---------------------------------------------------------------- Spark steps


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of a batch, by length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), int(d))


def _sums(vectors: DataFrame, hold: Scratch) -> dict[int, tuple[int, list[int]]]:
    """Of each length: number of vectors and exact sums of each dimension. Tasks add up halves of the numbers in 64 bits."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for d, rows, x in _matrices(batch.column(0)):
                high = x >> np.int64(32)
                now = total.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
                now[0] += len(rows)
                now[1] += high.sum(axis=0)
                now[2] += (x - (high << np.int64(32))).sum(axis=0)
        for d, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["d", "pos", "n", "high", "low"])

    parts = map_batches(vectors.select("x"), task, "d bigint, pos bigint, n bigint, high bigint, low bigint")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    out: dict[int, tuple[int, list[int]]] = {}
    for row in parts.groupBy("d", "pos").agg(*exact).orderBy("d", "pos").toLocalIterator():
        out.setdefault(row["d"], (int(row["n"]), []))[1].append(int(row["high"]) * 2**32 + int(row["low"]))
    return out


def _reduced(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of the rows below r, d x d."""
    d = rows.shape[1]
    r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


_TRIANGLES = "d bigint, part bigint, r array<double>"


def _triangle_rows(state: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    for d, r in state.items():
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([part]), pa.array([r.ravel()], pa.list_(pa.float64()))], ["d", "part", "r"])


def _triangles(vectors: DataFrame, means: dict[int, np.ndarray], settings: Settings, hold: Scratch) -> DataFrame:
    """d, part, r: one triangle of each length."""
    shared = vectors.sparkSession.sparkContext.broadcast(means)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                for at in range(0, len(x), settings.block):
                    state[d] = _reduced(state.get(d), x[at : at + settings.block] - shared.value[d])
        yield from _triangle_rows(state, TaskContext.get().partitionId())

    def again(table: pa.Table) -> pa.Table:
        d = table["d"][0].as_py()
        state = None
        for r in table["r"]:
            state = _reduced(state, np.asarray(r.values).reshape(d, d))
        part = table["part"][0].as_py() // settings.fan_in
        return pa.Table.from_batches(_triangle_rows({d: state}, part))

    now = hold.table(map_batches(vectors.select("x"), first, _TRIANGLES), "triangles")
    while not now.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        ranked = now.withColumn("part", F.col("part").cast("bigint"))
        now = hold.table(ranked.groupBy("d", F.expr(f"part div {settings.fan_in}")).applyInArrow(again, _TRIANGLES), "triangles")
    return now


def _fits(vectors: DataFrame, settings: Settings, hold: Scratch) -> dict[int, dict]:
    """Of each length: n, sums, mean, eigenvalues, eigenvectors and trace, solved in tasks."""
    sums = _sums(vectors, hold)
    held = sum(d for d in sums) * (settings.components + 3)
    if held > settings.model_numbers:
        raise ValueError(f"fits of all lengths of vectors hold {held} numbers; model_numbers allows {settings.model_numbers}")
    means = {d: np.array([float(Decimal(s) / n) for s in total]) for d, (n, total) in sums.items()}
    counts = {d: n for d, (n, _) in sums.items()}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, r in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                values, vectors, trace = principal(np.asarray(r.values).reshape(d, d), counts[d], settings.components, settings.noise)
                yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([values], pa.list_(pa.float64())), pa.array([vectors.ravel()], pa.list_(pa.float64())), pa.array([trace])], ["d", "e", "v", "trace"])

    solved = map_batches(_triangles(vectors, means, settings, hold), solve, "d bigint, e array<double>, v array<double>, trace double")
    out = {}
    for row in solved.toLocalIterator():
        d = row["d"]
        out[d] = {"n": counts[d], "sums": sums[d][1], "mean": means[d], "e": np.array(row["e"]), "v": np.array(row["v"]).reshape(len(row["e"]), d), "trace": row["trace"]}
    return out


def _white(fit: dict, x: np.ndarray) -> np.ndarray:
    return (x - fit["mean"]) @ fit["v"].T / np.sqrt(fit["e"])


def _errors(vectors: DataFrame, fits: dict[int, dict]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                w = _white(shared.value[d], x)
                w = np.hstack([np.ones((len(w), 1)), w])
                total[d] = total.get(d, 0) + w.T @ w
        for d, m in total.items():
            k = len(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, d)), pa.array(np.arange(k * k)), pa.array(m.ravel())], ["d", "cell", "s"])

    parts = map_batches(vectors.select("x"), task, "d bigint, cell bigint, s double")
    cells: dict[int, dict[int, float]] = {}
    for row in parts.groupBy("d", "cell").agg(F.sum("s").alias("s")).toLocalIterator():
        cells.setdefault(row["d"], {})[row["cell"]] = row["s"]
    out = {}
    for d, found in cells.items():
        m = np.array([found[i] for i in range(len(found))]).reshape(len(fits[d]["e"]) + 1, -1) / fits[d]["n"]
        out[d] = float(np.abs(m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(len(m) - 1)).max(initial=0.0))
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum over dimensions of (n*x - S)^2, exactly; None where a long can't hold it."""
    most = max(int(np.abs(x).max(initial=0)), 1) * n + max((abs(s) for s in sums), default=0)
    if most < 2**62 and most * most * len(sums) < 2**63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", settings: Settings | None = None) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    s = settings or Settings()
    raw = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(raw, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.transform(raw, lambda c: F.floor(F.lit(float(s.scale)) * c) + F.lit(0).cast("bigint")).alias("x"), (whole & (F.size(raw) > 0)).alias("good")).filter("good").select("id", "x")
    with Scratch(df.sparkSession) as hold:
        vectors = hold.table(rows.select("x").distinct(), "vectors")
        fits = _fits(vectors, s, hold)
        fits = {d: fit | {"error": 0.0} for d, fit in fits.items()}
        for d, error in _errors(vectors, fits).items():
            fits[d]["error"] = error
    shared = df.sparkSession.sparkContext.broadcast(fits)
    kind = rows.schema["id"].dataType

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            for d, at, x in _matrices(batch.column(1)):
                fit = shared.value[d]
                k = len(fit["e"])
                if not k:
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                deviation = pa.array(_deviations(x, fit["n"], fit["sums"]), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                tile = lambda v, t: pa.array(np.tile(v, len(at)), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids, tile(np.arange(1, k + 1), pa.int32()), pa.array(np.full(len(at) * k, fit["n"])), deviation, pa.array(_white(fit, x).ravel()),
                     tile(fit["e"] / fit["trace"], pa.float64()), pa.array(np.full(len(at) * k, fit["error"]))], names)

    out = map_batches(rows, project, f"id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return materialise(out.withColumnRenamed("id", id_column), "whitened")
