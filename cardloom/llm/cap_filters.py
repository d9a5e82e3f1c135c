"""Operator 11: near-duplicate embeddings by spherical-cap filters.

Two vectors are linked if their cosine, in double precision, is at least the similarity (0.9: an angle of 25.8 degrees).

1. Equal vectors collapse to one content with a number of rows.
2. A random product code splits the (once rotated, then shuffled) coordinates into a few parts and draws code words for each;
   a filter direction is one word of every part. A vector belongs to all filters whose direction it exceeds the threshold
   with: list decoding extends partial words part by part and drops those that even the best rest can't lift over it.
   Several independent codes make up for what one misses: threshold and number of codes are set from the hit rate of
   simulated pairs at exactly the similarity, so that such a pair shares no filter once in 100,000 (closer ones: less).
3. Each filter has a hub (the largest hashed rank); a vector is compared with the hub it shares most filters with. Within half
   the angle it joins the hub's ball. All vectors of a ball are linked with each other by the triangle inequality: their
   number says how often, and no pair of them is ever made. A vector in no ball is a ball of its own.
4. Balls that share a filter are compared by their centres. Sign sketches first rule out centres too far apart (256 bits,
   cut where a pair that may be linked passes all but once in 10^11). Radii then tell whether all, none or some of their
   vectors are linked; only where it is some, blocks of members are multiplied and counted, again without making pairs.
5. Components over linked balls give the smallest id.

Contents with null, zero, null or non-finite components link with nothing; nor do vectors of different lengths. Each row of
a repeated id is a vector. A component without any id has component_id null and its rows are kept. An empty table gives an empty one.
Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, map_batches, materialise, mix
from cardloom.llm.near_dedup import components

#: Longs of a sign sketch; slack of angles, far over the rounding of an arc cosine (1e-8).
_LONGS = 4
_SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.9
    #: Share of pairs at exactly the similarity that may share no filter.
    miss: float = 1e-5
    #: Filters of a vector and code, and code words of a part at most.
    filters: float = 1.25
    words: int = 256
    #: Rounds in which balls are made, and members of a block that is multiplied.
    rounds: int = 2
    block: int = 512
    seed: int = 11

    @property
    def angle(self) -> float:
        return float(np.arccos(self.similarity))


# ---------------------------------------------------------------- codes


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass(frozen=True)
class Plan:
    """What a length of vectors is filtered with."""
    length: int
    parts: int
    words: int
    codes: int
    threshold: float
    seed: int


@lru_cache(maxsize=8)
def _rotation(length: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, length]).standard_normal((length, length)))[0]


@lru_cache(maxsize=512)
def _code(length: int, parts: int, words: int, seed: int, number: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Of each part its coordinates and code words, scaled so that a filter direction has length 1."""
    draw = np.random.default_rng([seed, length, parts, words, number])
    out = []
    for at in np.array_split(draw.permutation(length), parts):
        out.append((at, (unit(draw.standard_normal((words, len(at)))) * np.sqrt(len(at) / length)).astype(np.float32)))
    return tuple(out)


def decode(x: np.ndarray, plan: Plan, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of a code that rotated unit vectors exceed the threshold with."""
    scores = [x[:, at] @ words.T for at, words in _code(plan.length, plan.parts, plan.words, plan.seed, number)]
    best = np.stack([s.max(axis=1) for s in scores], axis=1)
    rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]
    row = np.flatnonzero(rest[:, 0] >= plan.threshold)
    found, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.float32)
    for p, score in enumerate(scores):
        value = total[:, None] + score[row]
        least = plan.threshold - (rest[row, p + 1] if p + 1 < len(scores) else 0.0)
        r, c = np.nonzero(value >= np.reshape(least, (-1, 1)) if np.ndim(least) else value >= least)
        total, found, row = value[r, c], found[r] * plan.words + c, row[r]
    return row, found


def make_plan(length: int, vectors: int, settings: Settings) -> Plan:
    """Code sizes follow the number of vectors, so that a filter holds about one; threshold and number of codes from
    simulated vectors and pairs. Everything is drawn from the seed, so it is the same wherever it is made."""
    wanted = max(vectors, 4096)
    parts = 1
    while wanted ** (1 / parts) > settings.words and length // (parts + 1) >= 8:
        parts += 1
    words = int(min(settings.words, np.ceil(wanted ** (1 / parts))))
    draw = np.random.default_rng([settings.seed, length, 1])
    x = unit(draw.standard_normal((1000, length)))
    if length > 1:
        side = draw.standard_normal((1000, length))
        side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
        y = settings.similarity * x + np.sqrt(1 - settings.similarity**2) * side
    else:
        y = x
    x, y = x.astype(np.float32), y.astype(np.float32)
    low, high = 0.0, 1.0
    for _ in range(14):  # the largest threshold that leaves a vector enough filters
        middle = (low + high) / 2
        plan = Plan(length, parts, words, 1, middle, settings.seed)
        # far too many are told from the first few
        some = x[:50] if len(decode(x[:50], plan, 1)[0]) > 50 * 20 * settings.filters else x
        enough = np.mean([len(decode(some, plan, k)[0]) / len(some) for k in range(1, 4)]) >= settings.filters
        low, high = (middle, high) if enough else (low, middle)
    plan = Plan(length, parts, words, 1, low, settings.seed)
    met = 0.0
    for k in range(16):
        (ra, fa), (rb, fb) = decode(x, plan, k), decode(y, plan, k)
        size = words**parts
        met += len(np.unique(np.intersect1d(ra * size + fa, rb * size + fb) // size)) / len(x) / 16
    # a rate measured on 16,000 draws, less three standard errors
    met = max(met - 3 * np.sqrt(met * (1 - met) / 16_000), 1e-3)
    codes = 1 if met > 1 - settings.miss else int(np.ceil(np.log(settings.miss) / np.log1p(-met)))
    return Plan(length, parts, words, codes, low, settings.seed)


def sketch_cut(angle: Column) -> Column:
    """Most bits in which sketches of vectors at no more than this angle differ, but for a share of about 1e-11."""
    p = F.least(angle / np.pi, F.lit(0.5))
    n = 64 * _LONGS
    return F.lit(float(n)) * p + F.lit(7.5) * F.sqrt(F.lit(float(n)) * p * (F.lit(1.0) - p)) + F.lit(4.0)


@lru_cache(maxsize=8)
def _planes(length: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length, 2]).standard_normal((length, 64 * _LONGS)).astype(np.float32)


# ---------------------------------------------------------------- Spark steps


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of a batch of vectors, by length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def _filtered(reps: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """rep, filter: a row for each filter a content belongs to."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, rows, x in by_length(batch.column(1)):
                plan = plans[d]
                x = (unit(x) @ _rotation(d, plan.seed)).astype(np.float32)
                for k in range(plan.codes):
                    row, found = decode(x, plan, k)
                    if len(row):
                        key = mix(mix(found.astype(np.uint64) + np.uint64(k << 40)) + np.uint64(d)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[row]]), pa.array(key)], ["rep", "filter"])

    return map_batches(reps.select("rep", "vec"), task, "rep bigint, filter bigint")


def _sketched(reps: DataFrame, seed: int) -> DataFrame:
    """rep, b0 to b3: sides of 256 random planes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch), _LONGS), np.int64)
            for d, rows, x in by_length(batch.column(1)):
                bits = unit(x).astype(np.float32) @ _planes(d, seed) > 0
                out[rows] = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, i]) for i in range(_LONGS))], ["rep", *(f"b{i}" for i in range(_LONGS))])

    return map_batches(reps.select("rep", "vec"), task, "rep bigint, " + ", ".join(f"b{i} bigint" for i in range(_LONGS)))


def _cosines(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, cosine of pairs of contents of one length."""
    left, right = reps.select(F.col("rep").alias("a"), F.col("vec").alias("va")), reps.select(F.col("rep").alias("b"), F.col("vec").alias("vb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").filter(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, rows, x), (_, _, y) in zip(by_length(batch.column(2)), by_length(batch.column(3)), strict=True):
                some = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array((unit(x) * unit(y)).sum(axis=1))], ["a", "b", "cosine"])

    return map_batches(met, task, "a bigint, b bigint, cosine double")


def _balls(filtered: DataFrame, reps: DataFrame, s: Settings, hold: Scratch) -> DataFrame:
    """rep, ball, alpha: contents in a ball besides its centre, and their angle to it."""
    free, balls = filtered, None
    for _ in range(s.rounds):
        rank = F.struct(F.xxhash64("rep").alias("rank"), "rep")
        hubs = hold.table(free.groupBy("filter").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("filter", F.col("top.rep").alias("hub")), "hubs")
        shared = free.join(hubs, "filter").filter("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("times"))
        best = shared.groupBy("rep").agg(F.max(F.struct("times", "hub")).alias("top")).select(F.col("rep").alias("a"), F.col("top.hub").alias("b"))
        near = _cosines(hold.table(best, "pairs"), reps).withColumn("alpha", F.acos(F.least("cosine", F.lit(1.0)))).filter(F.col("alpha") <= s.angle / 2 - _SLACK)
        near = hold.table(near.select(F.col("a").alias("rep"), F.col("b").alias("ball"), "alpha"), "near")
        # a hub that itself joined another ball is no centre: its members try again
        found = hold.table(near.join(near.select(F.col("rep").alias("ball")), "ball", "left_anti").select("rep", "ball", "alpha"), "balls")
        if found.isEmpty():
            break
        balls = found if balls is None else hold.table(balls.unionByName(found), "balls")
        taken = balls.select("rep").union(balls.select("ball")).distinct()
        free = hold.table(free.join(taken, "rep", "left_anti"), "free")
    return balls if balls is not None else hold.table(reps.limit(0).select("rep", F.col("rep").alias("ball"), F.lit(0.0).alias("alpha")), "balls")


def _counted(some: DataFrame, members: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """(a, b, rep, adds) for pairs of balls (a, b) in which only some vectors are linked: how many rows of the other ball each
    member is linked with. Members are dealt to blocks; a pair of blocks is multiplied in one task."""
    sizes = members.groupBy("ball").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / F.lit(s.block))
    placed = members.join(sizes, "ball").withColumn("at", F.pmod(F.xxhash64("rep"), blocks)).join(reps.select("rep", "vec", "w"), "rep").select("ball", "rep", "at", "m", "vec", "w")
    wide = some.join(sizes.select(F.col("ball").alias("a"), F.col("m").alias("ma")), "a").join(sizes.select(F.col("ball").alias("b"), F.col("m").alias("mb")), "b")
    upto = lambda m: F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(m) / F.lit(s.block)) - 1)
    cells = wide.select("a", "b", F.explode(upto("ma")).alias("i"), "mb").select("a", "b", "i", F.explode(upto("mb")).alias("j"))
    one = cells.join(placed, (F.col("a") == F.col("ball")) & (F.col("i") == F.col("at"))).select("a", "b", "i", "j", F.lit(0).alias("side"), "rep", "vec", "w")
    two = cells.join(placed, (F.col("b") == F.col("ball")) & (F.col("j") == F.col("at"))).select("a", "b", "i", "j", F.lit(1).alias("side"), "rep", "vec", "w")
    least = s.similarity

    def multiply(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        vectors = table["vec"].combine_chunks()
        x = np.concatenate([m for _, _, m in by_length(vectors)])  # one length: they share filters
        rep, w = table["rep"].to_numpy(), table["w"].to_numpy()
        l, r = side == 0, side == 1
        near = unit(x[l]) @ unit(x[r]).T >= least
        adds = np.concatenate([near @ w[r], near.T @ w[l]])
        ids = np.concatenate([rep[l], rep[r]])
        there = adds > 0
        n = int(there.sum())
        return pa.table({"a": pa.array(np.full(n, table["a"][0].as_py())), "b": pa.array(np.full(n, table["b"][0].as_py())), "rep": ids[there], "adds": adds[there].astype(np.int64)})

    return one.unionByName(two).groupBy("a", "b", "i", "j").applyInArrow(multiply, "a bigint, b bigint, rep bigint, adds bigint")


def _crossings(filtered: DataFrame, members: DataFrame, reps: DataFrame, s: Settings, hold: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links between balls: edges (a, b), and adds (rep, adds) of links that a content has outside its ball."""
    stats = hold.table(members.join(reps.select("rep", "w"), "rep").groupBy("ball").agg(F.max("alpha").alias("r"), F.sum("w").alias("rows"), F.count(F.lit(1)).alias("m")), "stats")
    sketches = _sketched(reps.join(stats.select(F.col("ball").alias("rep")), "rep", "left_semi"), s.seed).withColumnRenamed("rep", "ball")
    traits = hold.table(stats.join(sketches, "ball"), "traits")
    of = lambda side: traits.select(F.col("ball").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("r", "rows", "m", *(f"b{i}" for i in range(_LONGS)))))
    held = filtered.join(members.select("rep", "ball"), "rep").select("filter", "ball").distinct()
    full = hold.table(held.join(traits.select("ball", "r", *(f"b{i}" for i in range(_LONGS))), "ball"), "held")
    other = full.select("filter", *(F.col(c).alias(f"o_{c}") for c in full.columns if c != "filter"))
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(_LONGS)))
    close = differ <= sketch_cut(F.lit(s.angle + 2 * _SLACK) + F.col("r") + F.col("o_r"))
    met = full.join(other, "filter").filter((F.col("ball") < F.col("o_ball")) & close).select(F.col("ball").alias("a"), F.col("o_ball").alias("b")).distinct()
    known = _cosines(hold.table(met, "pairs"), reps).join(of("a"), "a").join(of("b"), "b")
    gamma = F.acos(F.greatest(F.lit(-1.0), F.least("cosine", F.lit(1.0))))
    radii = F.col("a_r") + F.col("b_r")
    kind = (
        F.when((F.col("a_m") == 1) & (F.col("b_m") == 1), F.when(F.col("cosine") >= s.similarity, "all"))
        .when(gamma + radii <= s.angle - _SLACK, "all").when(gamma - radii <= s.angle + _SLACK, "some")
    )
    known = hold.table(known.withColumn("kind", kind).filter("kind is not null"), "known")
    whole = known.filter("kind = 'all'")
    per_ball = whole.select(F.col("a").alias("ball"), F.col("b_rows").alias("adds")).unionByName(whole.select(F.col("b").alias("ball"), F.col("a_rows").alias("adds")))
    per_ball = per_ball.groupBy("ball").agg(F.sum("adds").alias("adds"))
    counted = hold.table(_counted(known.filter("kind = 'some'").select("a", "b"), members, reps, s), "counted")
    adds = members.join(per_ball, "ball").select("rep", "adds").unionByName(counted.select("rep", "adds")).groupBy("rep").agg(F.sum("adds").alias("adds"))
    edges = whole.select("a", "b").union(counted.select("a", "b")).distinct()
    return hold.table(edges, "edges"), hold.table(adds, "adds")


def near_duplicates(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", settings: Settings | None = None) -> DataFrame:
    """One row for each row of df: id, n_links (other rows it is linked with), component_id (smallest id that links lead to,
    its own included) and kept (its id is that one)."""
    s = settings or Settings()
    vec = F.col(f"`{vector}`")
    good = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(vec, lambda c: c != 0)
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.when(F.coalesce(good, F.lit(False)), vec).alias("vec")).withColumn("row", F.monotonically_increasing_id())
    with Scratch(df.sparkSession) as hold:
        keys = [F.when(F.col("vec").isNotNull(), k) for k in (F.xxhash64("vec"), F.xxhash64(F.lit("second"), "vec"))]
        rows = hold.table(rows.withColumns({"k1": keys[0], "k2": keys[1]}), "rows")
        contents = rows.filter("vec is not null").groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("w"), F.min("id").alias("low"))
        contents = hold.table(contents, "contents")
        named = hold.table(rows.select("id", "row", "k1", "k2").join(contents.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("id", "rep"), "named")
        reps = hold.table(rows.select(F.col("row").alias("rep"), "vec").join(contents.select("rep", "w", "low"), "rep"), "reps")
        lengths = {r["d"]: r["n"] for r in reps.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        plans = {d: make_plan(d, n, s) for d, n in lengths.items()}
        filtered = hold.table(_filtered(reps, plans), "filtered")
        balls = _balls(filtered, reps, s, hold)
        members = reps.join(balls, "rep", "left").select("rep", F.coalesce("ball", "rep").alias("ball"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"))
        members = hold.table(members, "members")
        edges, adds = _crossings(filtered, members, reps, s, hold)
        roots = hold.table(components(edges, hold), "roots") if not edges.isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        inside = members.join(reps.select("rep", "w", "low"), "rep").groupBy("ball").agg(F.sum("w").alias("rows"), F.min("low").alias("low"))
        inside = hold.table(inside.join(roots.withColumnRenamed("node", "ball"), "ball", "left").select("ball", "rows", "low", F.coalesce("root", "ball").alias("root")), "inside")
        lowest = inside.groupBy("root").agg(F.min("low").alias("component"))
        each = members.join(inside.join(lowest, "root").select("ball", "rows", "component"), "ball").join(adds, "rep", "left")
        each = hold.table(each.select("rep", (F.col("rows") - 1 + F.coalesce("adds", F.lit(0))).alias("n_links"), "component"), "each")
        out = named.join(each, "rep", "left").withColumn("component", F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("component")))
        out = out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
        return materialise(out, "links")
