"""Operator 2: toxicity by compression distance between two zstandard dictionaries.

zstandard trains one dictionary on windows of ordinary labelled texts and one on windows of toxic labelled texts. A text's
window of twelve words is compressed with the ordinary dictionary and with the toxic one in front of it; the difference
of the two lengths is the window's gain. A text's gains are counted by size; thresholds on these counts and a
logistic calibration are fitted on labelled rows of their own.

Toxic texts are mostly ordinary text, and so would a dictionary be that is trained on all of their windows. The
trainer therefore gets windows of one word, and only those with a run of characters that is far more frequent
in toxic than in ordinary text; what goes into the dictionary is the trainer's choice. Both dictionaries are used as raw
content, so that the two compressors differ in content alone and not in entropy tables. Windows begin with a fixed
run of spaces: short incompressible windows would otherwise be stored raw by the format, and their lengths would say nothing.

Fitting uses a bounded sample of labelled rows (Training, chosen by a hash of the id); scoring reads every whole text
once, however long, and shuffles nothing. Null and empty texts are one empty window. Rows with a null id or
label are not learnt from; several labels of one id count as toxic if one is, and of several texts of one id the
smallest counts. Equal texts score alike, so there are no ties to break. Without both classes in the sample the score is
the constant base rate. Empty tables give an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, map_batches, text_slices

WINDOW_WORDS, PADDING = 12, b" " * 64
#: Gains are counted from LOWEST (and less) to LOWEST + BINS - 1 (and more) bytes; from HIGH on they speak for toxicity.
LOWEST, BINS, HIGH = 0, 9, 4


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of what is learnt from it."""

    #: Labelled documents of each class; windows and toxic words that the trainer gets at most; their bytes at most.
    documents: int = 1500
    windows: int = 50_000
    toxic_words: int = 20_000
    window_bytes: int = 2048
    dictionary_bytes: int = 1 << 16
    toxic_bytes: int = 1 << 13
    #: A run of so many characters must stand in so many toxic texts, be so many times as frequent there, and so significant.
    run: int = 6
    min_documents: int = 5
    min_ratio: float = 6.0
    min_z: float = 9.0


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    llr: list[float] = field(default_factory=lambda: [0.0] * BINS)
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)

    def features(self, counts: np.ndarray) -> np.ndarray:
        total = counts @ np.array(self.llr)
        n = np.maximum(counts.sum(axis=1), 1)
        return np.column_stack([np.ones(len(counts)), np.arcsinh(total), total / n, np.log1p(counts[:, HIGH - LOWEST :].sum(axis=1))])

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(counts) @ np.array(self.weights), -500, 500)))


def _compressor(content: bytes):
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=17, search_log=5, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress


def windows(text: bytes) -> list[bytes]:
    words = text.split()
    return [PADDING + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)] or [PADDING]


def gain_counts(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep columns and `counts`: how many windows of column t have each gain, from LOWEST on."""
    ordinary, toxic = model.ordinary, model.toxic + model.ordinary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad = _compressor(ordinary), _compressor(toxic)
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(0)):
                rows = []
                for i in range(len(offsets) - 1):
                    counts = [0] * BINS
                    for w in windows(data[offsets[i] : offsets[i + 1]].tobytes()):
                        counts[min(max(len(plain(w)) - len(bad(w)) - LOWEST, 0), BINS - 1)] += 1
                    rows.append(counts)
                part = batch.slice(at, len(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(rows, pa.list_(pa.int64()))], [*keep, "counts"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "counts array<bigint>"])
    return map_batches(df.select("t", *keep), task, schema)


def _toxic_words(train: DataFrame, s: Training, hold: Scratch) -> list[bytes]:
    """Words of toxic texts, each between spaces, that hold a run of characters which marks toxic text.

    A word counts once for each pair of neighbours in a class, so that copies of a text don't make its words a mark.
    """
    words = F.array_remove(F.split("t", r"\s+"), "")
    near = lambda ws: F.transform(ws, lambda w, i: F.struct(F.concat(F.lit(" "), w, F.lit(" ")).alias("w"), F.xxhash64(F.get(ws, i - 1), w, F.get(ws, i + 1)).alias("c")))
    seen = train.select("id", "y", words.alias("ws")).select("id", "y", F.explode(near(F.col("ws"))).alias("x"))
    seen = hold.table(seen.groupBy("y", "x.c").agg(F.min(F.struct("id", "x.w")).alias("one")).select("y", "c", "one.id", "one.w"), "words")
    totals = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, no = totals.get(1, 0), totals.get(0, 0)
    if not nt or not no:
        return []
    long = seen.filter((F.length("w") >= s.run) & (F.octet_length("w") <= s.window_bytes))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("w") - s.run + 1), lambda k: F.substr("w", k, F.lit(s.run))))
    held = long.select("id", "y", "c", "w", F.explode(runs).alias("g"))
    of = lambda y: F.sum(F.when(F.col("y") == y, 1).otherwise(0)).cast("double")
    counted = held.groupBy("g").agg(of(1).alias("a"), of(0).alias("b"), F.count_distinct(F.when(F.col("y") == 1, F.col("id"))).alias("texts"))
    both = F.col("a") + F.col("b")
    part = lambda x, n: F.when(x > 0, x * F.log(x / (both * n / (nt + no)))).otherwise(0.0)
    z = F.sqrt(F.greatest(2 * (part(F.col("a"), nt) + part(F.col("b"), no)), F.lit(0.0)))
    ratio = (F.col("a") / nt) / ((F.col("b") + 0.5) / no)
    marks = hold.table(counted.filter((F.col("texts") >= s.min_documents) & (ratio > s.min_ratio) & (z > s.min_z)).select("g"), "marks")
    marked = held.filter("y = 1").join(marks, "g", "left_semi").select("c", "w").distinct()
    return [r["w"].encode() for r in marked.orderBy(F.xxhash64("c", "w"), "w").limit(s.toxic_words).collect()]


def _ordinary_windows(train: DataFrame, s: Training) -> list[bytes]:
    """Distinct windows of ordinary texts, drawn by a hash."""
    words = F.array_remove(F.split("t", r"\s+"), "")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("ws") / WINDOW_WORDS).cast("int")), lambda i: F.concat(F.array_join(F.slice("ws", i * WINDOW_WORDS + 1, WINDOW_WORDS), " "), F.lit(" ")))
    each = train.filter("y = 0").select(words.alias("ws")).select(F.explode(cut).alias("w")).filter((F.length("w") > 1) & (F.octet_length("w") <= s.window_bytes))
    return [r["w"].encode() for r in each.distinct().orderBy(F.xxhash64("w"), "w").limit(s.windows).collect()]


def _trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, samples)))), samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[:size]


def _calibrate(model: Model, counts: np.ndarray, y: np.ndarray) -> None:
    bad, good = counts[y == 1].sum(axis=0) + 0.5, counts[y == 0].sum(axis=0) + 0.5
    model.llr = np.maximum.accumulate(np.log(bad / bad.sum()) - np.log(good / good.sum())).tolist()  # a larger gain never counts less
    x, w = model.features(counts), np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(4), x.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()


def fit(docs: DataFrame, labels: DataFrame, use: Column, text: str = "text", id_column: str = "doc_id", label: str = "toxic", settings: Training | None = None) -> Model:
    """use: a condition on the id that admits a row to training."""
    s = settings or Training()
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull() & use).groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(s.documents) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * documents rows at most
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("t"))
    model = Model()
    with Scratch(docs.sparkSession) as hold:
        train = hold.table(texts.join(chosen, "id").groupBy("id").agg(F.first("y").alias("y"), F.min("t").alias("t")), "sample")
        sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes.get(0) or not sizes.get(1):
            rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
            model.weights[0] = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
            return model
        learn = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(3)) < 2  # two thirds make the dictionaries, the rest the calibration
        model.toxic = _trained(s.toxic_bytes, _toxic_words(train.filter(learn), s, hold), 40, 6)
        model.ordinary = _trained(s.dictionary_bytes, _ordinary_windows(train.filter(learn), s), 64, 8)
        rows = gain_counts(train.filter(~learn), model, ["y"]).collect()
        if len({r["y"] for r in rows}) < 2:  # too few rows for a part of their own
            rows = gain_counts(train, model, ["y"]).collect()
        _calibrate(model, np.array([r["counts"] for r in rows], float), np.array([r["y"] for r in rows], float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and score (0 to 1) of every row."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("t"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)))
    counted = gain_counts(rows, model, names)
    at = lambda i: F.get("counts", F.lit(i)).cast("double")
    total = sum((at(i) * v for i, v in enumerate(model.llr)), F.lit(0.0))
    n = F.greatest(sum((at(i) for i in range(BINS)), F.lit(0.0)), F.lit(1.0))
    many = sum((at(i) for i in range(HIGH - LOWEST, BINS)), F.lit(0.0))
    w = model.weights
    logit = F.lit(w[0]) + F.asinh(total) * w[1] + total / n * w[2] + F.log1p(many) * w[3]
    return counted.select(*(F.col(n_).alias(c) for c, n_ in zip(keep, names, strict=True)), (1 / (1 + F.exp(-logit))).alias("score"))
