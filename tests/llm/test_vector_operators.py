"""Operators 11 to 13 against brute force, and what they make of awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm import cap_filters, periodic_runs, queries, whitening
from tests.llm.fixtures import awkward, clashing, frame

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, parts=3):
    return spark.createDataFrame(rows, VECTORS).repartition(parts)


# ---------------------------------------------------------------- operator 11


def linked(rows, least=0.9):
    """(id, n_links, component) by all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= least] for k in good}
    out = []
    for k, (name, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((name, len(near.get(k, [])), low, name == low))
    return out


def at_angle(draw, x, cosine):
    side = draw.standard_normal(len(x))
    side -= (side @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def told(df):
    key = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_links_equal_all_pairs(spark):
    """Pairs just over and just under the similarity, tight and wide clusters, chains, copies and scaled copies."""
    draw = np.random.default_rng(3)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(draw.standard_normal(24))
    pool = [unit() for _ in range(150)]
    for c in (0.9001, 0.8999, 0.95, 0.99):
        for x in pool[:25]:
            pool.append(at_angle(draw, x, c))
    for c in (0.999, 0.96, 0.93):  # clusters whose members are and aren't all linked with each other
        middle = unit()
        pool += [at_angle(draw, middle, c) for _ in range(60)]
    step = unit()
    for _ in range(12):
        pool.append(step)
        step = at_angle(draw, step, 0.91)
    pool += [pool[3]] * 4 + [pool[7] * 3.0, pool[7] * 1e-200, pool[200] * 1e200]
    rows = [(i * 3 % 1009, v.tolist()) for i, v in enumerate(pool)]
    assert told(cap_filters.near_duplicates(vectors(spark, rows))) == in_order(linked(rows))


@pytest.mark.parametrize("cosine", [0.9, 0.96])
def test_pairs_at_the_similarity_share_a_filter(cosine):
    """Recall of the filters alone, on pairs at exactly the similarity and closer."""
    s = cap_filters.Settings()
    plan = cap_filters.make_plan(64, 50_000, s)
    draw = np.random.default_rng(8)
    x = cap_filters.unit(draw.standard_normal((4000, 64)))
    y = np.array([at_angle(draw, v, cosine) for v in x])
    turned = [(v @ cap_filters._rotation(64, plan.seed)).astype(np.float32) for v in (x, y)]
    met = np.zeros(len(x), bool)
    for k in range(plan.codes):
        (ra, fa), (rb, fb) = (cap_filters.decode(v, plan, k) for v in turned)
        size = plan.words**plan.parts
        met[np.intersect1d(ra * size + fa, rb * size + fb) // size] = True
    assert met.mean() >= 0.9995


def test_decoding_finds_all_filters_over_the_threshold():
    plan = cap_filters.Plan(20, 3, 6, 1, 0.35, 1)
    x = cap_filters.unit(np.random.default_rng(1).standard_normal((40, 20))).astype(np.float32)
    row, found = cap_filters.decode(x, plan, 0)
    parts = cap_filters._code(20, 3, 6, 1, 0)
    want = {(i, (a * 6 + b) * 6 + c) for i in range(40) for a in range(6) for b in range(6) for c in range(6)
            if sum(x[i, at] @ words[k] for k, (at, words) in zip((a, b, c), parts, strict=True)) >= plan.threshold}
    assert set(zip(row.tolist(), found.tolist(), strict=True)) == want


def test_blocks_of_large_balls(spark):
    """Neighbouring balls of more members than a block: counted in blocks, equal to all pairs."""
    draw = np.random.default_rng(5)
    a = draw.standard_normal(16)
    a /= np.linalg.norm(a)
    b = at_angle(draw, a, 0.9)
    rows = [(i, at_angle(draw, (a, b)[i % 2], 0.98 + 0.02 * draw.random()).tolist()) for i in range(120)]
    found = cap_filters.near_duplicates(vectors(spark, rows), settings=cap_filters.Settings(block=7))
    assert told(found) == in_order(linked(rows))


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.01]),
            (None, None), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (None, [0.0, 1.0]), (10, [5.0]), (11, [2.0]), (12, [-2.0])]
    df = vectors(spark, rows)
    assert told(cap_filters.near_duplicates(df)) == in_order(linked(rows))
    assert told(cap_filters.near_duplicates(clashing(df))) == in_order(linked(rows))
    assert cap_filters.near_duplicates(df.limit(0)).collect() == []


# ---------------------------------------------------------------- operator 12


def brute_runs(words, least=6, exponent=4):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def brute_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rng = random.Random(4)
    out = []
    for _ in range(120):
        n, letters = rng.choice([1, 6, 30, 90, 250]), rng.choice([1, 2, 3, 20])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:letters]) * rng.randint(1, 2) for _ in range(n)]
        if rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 6))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        out.append(rng.choice(["", "\n", "\t "]) + rng.choice([" ", " \n"]).join(words) + rng.choice(["", " "]))
    return out


@pytest.mark.parametrize("settings", [periodic_runs.Settings(), periodic_runs.Settings(2, 2, 300, 40), periodic_runs.Settings(9, 3, 1 << 20, 5)])
def test_runs_equal_brute_force(spark, settings):
    texts = periodic_texts()
    found = periodic_runs.find_runs(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), settings=settings).collect()
    for r in found:
        words = texts[r["doc_id"]].split()
        want = brute_runs(words, settings.min_length, settings.min_exponent)
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), want, brute_collapsed(words, want))


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(2)
    for letters in (1, 2, 4):
        s = rng.integers(0, letters, 300)
        s[100:220] = np.resize(s[100:107], 120)
        s = np.concatenate([[-1], s, [-2], s[40:200], [-3]])
        g = periodic_runs.Grammar(s)
        inner = np.flatnonzero(s >= 0)
        i, j = rng.choice(inner, 2000), rng.choice(inner, 2000)
        i, j = i[i != j], j[i != j]
        for back in (False, True):
            step = -1 if back else 1
            for a, b, n in zip(i.tolist(), j.tolist(), g.extend(i, j, back).tolist(), strict=True):
                assert all(s[a + step * k] == s[b + step * k] for k in range(n)) and s[a + step * n] != s[b + step * n]


def test_a_long_text_of_one_word_takes_one_step():
    words = "tie " * 200_000
    data = np.frombuffer(words.encode(), np.uint8)
    n, runs, collapsed = periodic_runs._slice_runs(data, np.array([0, len(data)]), periodic_runs.Settings())
    assert runs.to_pylist() == [[{"start": 0, "length": 200_000, "period": 1}]] and collapsed.to_pylist() == ["tie"]


def test_runs_of_awkward_rows(spark):
    df = frame(spark, awkward())
    text = {}
    for doc, t, _, _ in awkward():
        text.setdefault(doc, []).append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    found = [tuple(r) for r in periodic_runs.find_runs(df).collect()]
    want = [(d, len(w), brute_runs(w), brute_collapsed(w, brute_runs(w))) for d, all_ in text.items() for w in all_ if len(w) < 500 or d == 8]
    got = [(d, n, [tuple(x) for x in runs], c) for d, n, runs, c in found if n < 500]
    assert in_order(map(repr, want)) == in_order(map(repr, got)) and len(found) == len(awkward())
    assert periodic_runs.find_runs(clashing(df)).count() == len(awkward())
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_op12_query_equals_brute_force(spark, tmp_path):
    """The registered query on texts with and without the rewritten tail."""
    texts = [*periodic_texts(), *(" ".join(f"w{i % 97}x{i % 89}" for i in range(n)) for n in (1, 40, 300, 1000)), "", " \n", None]
    rows = [(17 * i + 1, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, rewritten = [], 0
    for doc, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            rewritten += 1
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc, len(runs), *four, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(brute_collapsed(words, runs))))
    assert rewritten > 3
    assert sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect())) == sorted(want)


# ---------------------------------------------------------------- operator 13


def brute_white(rows, most=4):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in good], float)
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return [i for i, _ in good], x, fit, (x - fit.mean(axis=0)) @ v / np.sqrt(e), e / np.trace(centred.T @ centred / len(fit))


def test_whitening_equals_eigenvectors(spark):
    draw = np.random.default_rng(6)
    base = draw.standard_normal((400, 12)) * np.linspace(0.2, 2, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[5].tolist()) for i in range(200)]  # a third of all rows is one vector
    rows += [(5000, None), (5001, []), (5002, [NAN] * 12), (5003, [None] + [1.0] * 11), (None, base[3].tolist())]
    ids, x, fit, white, share = brute_white(rows)
    found = whitening.whiten(vectors(spark, rows, 5), settings=whitening.Settings(block=30, fan_in=2)).orderBy("vec_id", "component").collect()
    assert len(found) == 4 * len(ids)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    got = np.array([r["whitened"] for r in found]).reshape(-1, 4)
    want = white[order]
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-9
    sums = fit.sum(axis=0).astype(int).tolist()
    exact = [sum((len(fit) * int(c) - s) ** 2 for c, s in zip(x[k], sums, strict=True)) for k in order]
    assert [r["deviation"] for r in found[::4]] == exact
    assert {r["n"] for r in found} == {len(fit)} and max(r["identity_error"] for r in found) < 1e-9
    assert np.allclose([r["explained"] for r in found[:4]], share, rtol=1e-10)


@pytest.mark.parametrize("kind", ["plain", "constant", "repeated", "isotropic", "graded", "clustered"])
def test_solver(kind):
    draw = np.random.default_rng(9)
    for d in (1, 2, 3, 7, 40):
        x = draw.integers(-300, 300, (60, d)).astype(float)
        x = {"plain": x, "constant": np.where(np.arange(d) >= d // 2, 7.0, x), "repeated": x[:, np.arange(d) // 2 * 2 % d], "isotropic": np.vstack([np.eye(d), -np.eye(d)]) * 50,
             "graded": x * np.logspace(0, -9, d), "clustered": np.sign(x + 0.5) * np.where(np.arange(d) < 3, 10, 10 + 1e-9)}[kind]
        centred = x - x.mean(axis=0)
        r = whitening._reduced(None, centred)
        a, b, v = whitening.bidiagonalise(r)
        bidiagonal = np.diag(a) + np.diag(b, 1)
        assert np.allclose(v @ v.T, np.eye(d), atol=1e-12) and np.allclose(v @ bidiagonal.T @ bidiagonal @ v.T, r.T @ r, rtol=1e-11, atol=1e-11 * np.abs(r).max() ** 2)
        values = whitening.dqds(a, b)
        exact = np.linalg.svd(centred, compute_uv=False)
        assert np.allclose(values, exact[:d], rtol=1e-9, atol=1e-13 * (exact[0] or 1))
        e, w, trace = whitening.principal(r, len(x), 4, 1e-10)
        covariance = centred.T @ centred / len(x)
        assert np.isclose(trace, np.trace(covariance)) and np.allclose(w @ w.T, np.eye(len(e)), atol=1e-12)
        assert not len(e) or np.abs(covariance @ w.T - w.T * e).max() <= 1e-12 * e[0]


def test_values_of_small_size_keep_their_digits():
    """dqds is accurate for each value, not only against the largest."""
    a, b = np.array([1.0, 1e-6, 1e-12, 1e-18]), np.array([1e-3, 1e-9, 1e-15])
    from fractions import Fraction

    got = whitening.dqds(a, b)
    product = math.prod(Fraction(v) for v in a)
    assert abs(float(math.prod(Fraction(float(v)) for v in got) / product) - 1) < 1e-12
    squares = float(sum(Fraction(v) ** 2 for v in [*a, *b]))
    assert abs((got**2).sum() / squares - 1) < 1e-14


def test_vectors_that_vary_little_or_not(spark):
    """One distinct vector has no component, a line has one, lengths are fitted apart, huge entries don't crash."""
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert one == []
    line = whitening.whiten(clashing(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.5, 1.0, 0.0]), (4, [0.5, 3.0, 0.0])]))).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], r["n"]) for r in line] == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 and abs(r["explained"] - 1) < 1e-12 for r in line)
    huge = whitening.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e10, 7.0])])).collect()
    assert all(r["deviation"] is None for r in huge)
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == [] and whitening.whiten(vectors(spark, []), settings=whitening.Settings()).collect() == []


def test_registered_vector_queries_keep_every_row(spark):
    data = "/root/testdata/sf0.001"
    pytest.importorskip("pyarrow")
    import os

    if not os.path.isdir(data):
        pytest.skip("no generated tables here")
    ids = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()]
    assert told(queries.op11_cap_filters(spark, data)) == in_order(linked(rows))
    assert queries.op13_whitening(spark, data).count() == 4 * ids.count()
