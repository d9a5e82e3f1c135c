"""Helpers shared by the training-data operators: scratch tables, shipping code and byte-level word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.scratch import scratch_dir

_PACKAGE_ROOT = Path(__file__).resolve().parents[2]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    return _written(df, f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


#: Spark then deletes a query's shuffle files when the query has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one call, in a folder of their own that goes when the block ends; what the call returns
    must be written with materialise() before that."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{scratch_dir(spark)}/call-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def __exit__(self, *error) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package where their PYTHONPATH lacks it (once per Spark application)."""
    if str(_PACKAGE_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_cardloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="spark-cardloom-")) / "cardloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((_PACKAGE_ROOT / "cardloom").rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE_ROOT))
    context.addPyFile(str(target))
    context._cardloom_shipped = True


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with the package shipped first."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not use yet (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_key(text: Column) -> list[Column]:
    """128 bits for a whole text, JVM-side: two chained 64-bit hashes with different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """One-hash Bloom filter over a long column, built by Spark's bitmap aggregate.

    16 bits or more for each key, at least 2**20 and at most 2**30 (128 MB, the most that is ever broadcast): beyond
    67 million keys it lets more rows through, and the exact join that follows every use drops them.
    """
    bits = min(30, max(20, (16 * keys.count()).bit_length()))
    position = F.pmod(F.col(column), F.lit(1 << bits))
    parts = (
        keys.select(position.alias("p"))
        .groupBy(F.expr("p div 32768").alias("part"))
        .agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    )
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in parts.toLocalIterator():
        raw = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
        out[row["part"] * 4096 : row["part"] * 4096 + len(raw)] = raw
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys may be in the filter of bitmap_of."""
    p = keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 != 0


# ---------------------------------------------------------------- words of a batch, as arrays

#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class WordTable:
    """Splits UTF-8 bytes into words (runs of kept bytes) and hashes each, 64 bits, without a Python loop over words."""

    def __init__(self, kept: np.ndarray, fold_ascii: bool = True):
        self.kept = kept
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
        if fold_ascii:
            values[65:91] = values[97:123]
        self.values = np.where(kept, values, np.uint64(0))
        self._grown = 0

    def _tables(self, n: int) -> None:
        if n > self._grown:
            self._grown = max(n, _SPAN)
            self.up, self.down = _powers(_BASE, self._grown), _powers(_INVERSE, self._grown)

    def __getstate__(self):
        return {"kept": self.kept, "values": self.values, "_grown": 0}

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (bytes) and hashes of all words; cuts: first byte of each text, where no word runs on."""
        starts, ends, hashes = [], [], []
        at, n = 0, len(data)
        while at < n:
            to = min(n, at + _SPAN)
            while to < n:  # a span ends behind a byte that is no part of a word
                gap = np.flatnonzero(~self.kept[data[max(at, to - 4096) : to]])
                if len(gap):
                    to = max(at, to - 4096) + int(gap[-1]) + 1
                    break
                to = min(n, to + _SPAN)
            inside = cuts[(cuts >= at) & (cuts < to)] - at
            s, e, h = self._span(data[at:to], inside)
            starts.append(s + at), ends.append(e + at), hashes.append(h)
            at = to
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)

    def _span(self, part: np.ndarray, cuts: np.ndarray):
        self._tables(len(part))
        kept = self.kept[part]
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        first[cuts] = kept[cuts]
        last = kept.copy()
        last[:-1] &= ~kept[1:]
        before = cuts[cuts > 0] - 1
        last[before] = kept[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.values[part] * self.up[: len(part)], out=total[1:])
        return s, e, mix((total[e] - total[s]) * self.down[s])


def ascii_words() -> np.ndarray:
    """Kept bytes of the word `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` once A-Z is lower-cased."""
    kept = np.zeros(256, bool)
    kept[48:58] = kept[65:91] = kept[97:123] = kept[128:] = True
    return kept


def text_slices(column: pa.Array, limit: int = 1 << 22, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts, about limit bytes and at most so many rows each: first row, bytes,
    offsets from 0.

    Nulls count as empty. One text longer than the limit is a run of its own.
    """
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, at + rows, max(at + 1, to))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
