"""Operator 6: benchmark decontamination by a prefix-filtered join with exact verification.

Words are runs of lower-cased letters and digits. A window is 10 consecutive words of an item; an item of fewer is
one window. A window's tokens are its word shingles (three words, or all if there are fewer); they are ordered
by rarity in the documents, and since a document must hold all of them to hold the window, the rarest one alone
is the necessary prefix: windows and documents are joined on it. Each candidate brings the words around it, so the
join can apply the positional bound (the window's words before the token must exist), the length bound (and the words after
it) and compare all words of the window exactly.

Documents pass Python twice, to be cut into words and shingles by array operations. The first pass counts the
benchmark's tokens; the second gives the places of prefix tokens alone, with the words around them, so tokens that
are frequent in the documents carry no context unless a window has no rarer one. Only shingles that pass a Bloom filter
sized by the benchmark leave a task. A frequent token meets a de-duplicated window table, and adaptive execution splits it.

Null and empty texts have no words. Items without words have no windows. Items of one id are one item; windows of items
without id hit words, but no such item is counted or listed. Repeated documents are rows of their own; very long texts
are scanned whole. Empty tables give empty or clean results. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, WordTable, ascii_words, bitmap_of, in_bitmap, map_batches, materialise, mix, text_key, text_slices

WINDOW, TOKEN = 10, 3


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mix(out + words[j : j + n])
    return out


def _lower(raw: bytes) -> str:
    return raw.lower().decode("utf-8", "replace")  # bytes.lower() folds A-Z only


def _windows(bench: DataFrame, window: int, token: int) -> DataFrame:
    """rows (item, t) to windows: item, words (joined by spaces), size, tokens array<bigint> in order."""
    table = WordTable(ascii_words())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0)
            for at, data, offsets in text_slices(batch.column(1), 1 << 18):
                starts, ends, codes = table.words(data, offsets[:-1])
                first = np.searchsorted(starts, offsets)
                who, joined, sizes, tokens = [], [], [], []
                for i in range(len(offsets) - 1):
                    a, b = int(first[i]), int(first[i + 1])
                    own = codes[a:b]
                    spelt = [_lower(data[starts[k] : ends[k]].tobytes()) for k in range(a, b)]
                    size = min(window, b - a)
                    grams = _shingles(own, min(token, size)).view(np.int64) if size else []
                    for k in range(b - a - size + 1 if size else 0):
                        who.append(at + i)
                        joined.append(" ".join(spelt[k : k + size]))
                        sizes.append(size)
                        tokens.append(grams[k : k + size - min(token, size) + 1].tolist())
                yield pa.RecordBatch.from_arrays(
                    [items.take(pa.array(who, pa.int64())), pa.array(joined, pa.string()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                    ["item", "words", "size", "tokens"],
                )

    return map_batches(bench, task, "item string, words string, size int, tokens array<bigint>")


def _own_shingles(codes: np.ndarray, owner: np.ndarray, size: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the shingles that pass the filter and don't run over the end of a text."""
    grams = _shingles(codes, size)
    hits = np.flatnonzero(in_bitmap(bits, grams))
    hits = hits[owner[hits] == owner[hits + size - 1]]
    return hits, grams[hits].view(np.int64)


def _token_counts(docs: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """token, n: how often shingles that pass the filter stand in the documents; counted in each batch first."""
    table = WordTable(ascii_words())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), 1 << 21):
                starts, _, codes = table.words(data, offsets[:-1])
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
                found = np.concatenate([_own_shingles(codes, owner, size, shared.value)[1] for size in sizes])
                token, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    counted = map_batches(docs.select("t"), task, "token bigint, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """One row per document: id, r1, r2, n_words and found array<struct<token, p, left, words>>, the shingles of the
    given sizes that pass the filter, at word p, with up to window - 1 words on the left and window words from p."""
    table = WordTable(ascii_words())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = pa.list_(pa.struct([("token", pa.int64()), ("p", pa.int32()), ("left", pa.int32()), ("words", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at, data, offsets in text_slices(batch.column(1), 1 << 21):
                n = len(offsets) - 1
                starts, ends, codes = table.words(data, offsets[:-1])
                first = np.searchsorted(starts, offsets)
                owner = np.repeat(np.arange(n), np.diff(first))
                found: list[list] = [[] for _ in range(n)]
                for size in sizes:
                    hits, tokens = _own_shingles(codes, owner, size, bits)
                    for h, token in zip(hits.tolist(), tokens.tolist(), strict=True):
                        i = owner[h]
                        low, high = max(int(first[i]), h - window + 1), min(int(first[i + 1]), h + window)
                        words = " ".join(_lower(data[starts[k] : ends[k]].tobytes()) for k in range(low, high))
                        found[i].append((token, h - int(first[i]), h - low, words))
                flat = [x for own in found for x in own]
                cuts = np.zeros(n + 1, np.int32)
                np.cumsum([len(x) for x in found], out=cuts[1:])
                fields = list(zip(*flat, strict=True)) or [(), (), (), ()]
                structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, kind.value_type, strict=True)], fields=list(kind.value_type))
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), structs)],
                    ["id", "r1", "r2", "n_words", "found"],
                )

    id_type = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, task, f"id {id_type}, r1 bigint, r2 bigint, n_words bigint, found array<struct<token:bigint,p:int,left:int,words:string>>")


def _covered(spans: Column) -> Column:
    """Number of words in a union of (start, size) spans sorted by start."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def scan(df: DataFrame, bench: DataFrame, text: str = "text", id_column: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, token: int = TOKEN) -> DataFrame:
    """One row per row of df: id, r1, r2 (hash of the text), n_words, n_hit, items (sorted array<string>)."""
    docs = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    items = bench.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("t"))
    with Scratch(df.sparkSession) as hold:
        out = materialise(_scan(docs, items, window, token, hold), "scanned")
    return out.withColumnRenamed("id", id_column)


def _scan(docs: DataFrame, items: DataFrame, window: int, token: int, hold: Scratch) -> DataFrame:
    windows = hold.table(
        _windows(items, window, token).groupBy("words").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.sort_array(F.collect_set("item")).alias("items")), "windows"
    )
    vocabulary = hold.table(windows.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    sizes = list(range(1, token + 1)) if not windows.filter(F.col("size") < token).isEmpty() else [token]

    # rarity: how often each token of the benchmark stands in the documents; one that never does rules a window out
    counts = hold.table(vocabulary.join(_token_counts(docs, bitmap_of(vocabulary, "token"), sizes), "token"), "rarity")
    ranked = windows.select("words", "size", "items", F.posexplode("tokens").alias("offset", "token")).join(counts, "token", "left")
    prefix = ranked.groupBy("words").agg(
        F.first("size").alias("size"), F.first("items").alias("items"),
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "token")).alias("low"),
    ).filter("low.n > 0").select(F.col("words").alias("window"), "size", "items", "low.offset", "low.token")
    prefix = hold.table(prefix, "prefixes")

    r1, r2 = text_key(F.col("t"))
    keyed = docs.select("id", "t", r1.alias("r1"), r2.alias("r2"))
    seen = _candidates(keyed, bitmap_of(prefix.select("token").distinct(), "token"), sizes, window)
    seen = hold.table(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    met = seen.select("row", F.explode("found").alias("f")).select("row", "f.*").join(prefix, "token").filter("left >= offset")
    own = F.split("words", " ")
    met = met.withColumn("own", own).filter(F.size("own") - F.col("left") >= F.col("size") - F.col("offset"))
    same = F.array_join(F.slice("own", F.col("left") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    hits = met.filter(same).select("row", (F.col("p") - F.col("offset")).alias("start"), "size", "items")
    by_doc = hits.groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).select("row", _covered(F.col("spans")).cast("bigint").alias("n_hit"), "items")
    out = seen.select("row", "id", "r1", "r2", "n_words").join(by_doc, "row", "left")
    return out.select("id", "r1", "r2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(df: DataFrame, bench: DataFrame, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of df that hold no window of the benchmark; rows of equal text share their fate."""
    names = [f"c{i}" for i in range(len(df.columns))]
    text_at = names[df.columns.index(text)]
    hit = scan(df, bench, text, id_column, **options).filter("n_hit > 0").select("r1", "r2").distinct()
    key = text_key(F.col(text_at).cast("string"))
    keyed = df.toDF(*names).withColumns({"r1": key[0], "r2": key[1]})
    return keyed.join(materialise(hit, "contaminated"), ["r1", "r2"], "left_anti").select(*names).toDF(*df.columns)
