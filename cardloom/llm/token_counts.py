"""Operator 4: token counts of documents in flat, unindexed token files.

A token file is nothing but token ids (2 or 4 bytes each, little-endian) with an end-of-document id behind each
document. Files are cut into blocks of fixed size; each task reads blocks, finds the separators with one vectorised
comparison and reports what stands before the first, between them and behind the last. A prefix scan over the block
reports (a running sum that restarts behind every block with a separator) stitches documents that span blocks.
The scan's window holds counts alone, one row per block and file: at 4 MB a block, 250,000 rows for a file of a
terabyte. The lengths between separators stay with their blocks and meet the scan's result again by file and block.

Empty files have no documents. Tokens behind the last separator are a document with closed = false. A file whose
size is no multiple of the id's size is an error. Empty documents count 0 tokens; documents may be longer than blocks.
Repeated documents are documents of their own. An empty table gives files without documents. Files are read through
pyarrow's file systems (local, s3, gs, hdfs), as byte ranges. Files say nothing of other columns, so these may have
any names. write_token_files() numbers its files in the order of a column where one is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.byte_bpe import Encoder, encoded, read_ranks, warm
from cardloom.llm.common import map_batches, materialise, ship_package

BLOCK_BYTES = 4 << 20


_KINDS = {2: "<u2", 4: "<u4"}


def _id_bytes(encoder: Encoder, texts: pa.Array, width: int) -> Iterator[pa.Array]:
    """The ids of each text as bytes, for runs of texts."""
    for ids, ends in encoded(encoder, texts):
        buffers = [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(ids.astype(_KINDS[width]))]
        yield pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


def write_token_files(df: DataFrame, path: str, ranks_path: str, pattern: str, eod: int, text: str = "text", width: int = 2, order: str | None = None) -> None:
    """Encode every whole text (null: no tokens) and write flat files, one for each task.

    Spark's text writer puts raw bytes and a separator of our choice: the end-of-document id itself. As this separator
    is written as a character, it must be one: no surrogate (55296 to 57343), nothing above 0x10FFFF, no line feed or
    carriage return. With order, the documents are sorted by that column over all files.
    """
    if not 0 < eod <= 0x10FFFF or 0xD800 <= eod <= 0xDFFF or eod in (10, 13):
        raise ValueError("the end-of-document id must be the code of a character")
    ranks = read_ranks(ranks_path)
    if eod in set(ranks.values()) or eod >= 1 << 8 * width or max(ranks.values(), default=0) >= 1 << 8 * width:
        raise ValueError("the end-of-document id must be free and fit the width")
    shared = df.sparkSession.sparkContext.broadcast(Encoder(ranks, pattern))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = warm(shared.value)
        for batch in batches:
            for rows in _id_bytes(encoder, batch.column(0), width):
                yield pa.RecordBatch.from_arrays([rows], ["value"])

    texts = df.select(F.col(f"`{text}`").cast("string").alias("t"), (F.col(f"`{order}`") if order else F.lit(0)).alias("o"))
    encoded = map_batches((texts.repartitionByRange("o").sortWithinPartitions("o") if order else texts).select("t"), task, "value binary")
    encoding = {2: "UTF-16LE", 4: "UTF-32LE"}[width]
    encoded.select(F.col("value").cast("string")).write.option("encoding", encoding).option("lineSep", chr(eod)).text(path)


def _range(uri: str, offset: int, size: int) -> bytes:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        system, path = fs.LocalFileSystem(), unquote(parts.path)
    else:
        system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as source:
        return source.read_at(size, offset)


def scan_token_files(spark: SparkSession, path: str, eod: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal (from 0 in each file), first_token, n_tokens, closed: one row per document."""
    kind = _KINDS[width]
    block_bytes -= block_bytes % width
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    blocks = files.select("file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    blocks = blocks.repartition("file", "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offset = row["block"] * block_bytes
                size = min(block_bytes, row["length"] - offset)
                if size % width:
                    raise ValueError(f"{row['file']} is no whole number of ids")
                raw = _range(row["file"], offset, size)
                if len(raw) != size:
                    raise OSError(f"{row['file']} ended early")
                ids = np.frombuffer(raw, kind)
                ends = np.flatnonzero(ids == eod)
                inner = np.diff(ends) - 1
                head = int(ends[0]) if len(ends) else len(ids)
                tail = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["block"]]), pa.array([len(ids)]), pa.array([len(ends)]), pa.array([head]), pa.array([tail]), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "n", "ends", "head", "tail", "inner"],
                )

    found = map_batches(blocks, task, "file string, block bigint, n bigint, ends bigint, head bigint, tail bigint, inner array<bigint>")
    found = materialise(found, "token-blocks")
    in_order = Window.partitionBy("file").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("file", "block", "n", "ends", "head", "tail").withColumns({
        "ordinal": F.coalesce(F.sum("ends").over(before), F.lit(0)),
        "token": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "run": F.coalesce(F.sum((F.col("ends") > 0).cast("int")).over(before), F.lit(0)),
        "last": F.lead("block").over(in_order).isNull(),
        "open_tail": F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before),
    })
    # tokens open at a block's start: the tail of the last block with a separator and all of those since
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("n"))).over(since), F.lit(0)) + F.coalesce("open_tail", F.lit(0))
    scanned = scanned.withColumn("carry", carry).join(found.select("file", "block", "inner"), ["file", "block"])
    lengths = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("n"))
    lengths = F.transform(lengths, lambda x: F.struct(x.alias("n"), F.lit(True).alias("closed")))
    none = F.array().cast("array<struct<n:bigint,closed:boolean>>")
    open_end = F.when(F.col("last") & (rest > 0), F.array(F.struct(rest.alias("n"), F.lit(False).alias("closed")))).otherwise(none)
    docs = scanned.select("file", "block", "ordinal", (F.col("token") - F.col("carry")).alias("at"), F.posexplode(F.concat(lengths, open_end)).alias("k", "d"))
    own = Window.partitionBy("file", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("at") + F.coalesce(F.sum(F.col("d.n") + 1).over(own), F.lit(0))
    return docs.select(
        "file", (F.col("ordinal") + F.col("k")).alias("ordinal"), first.alias("first_token"), F.col("d.n").alias("n_tokens"), F.col("d.closed").alias("closed")
    )
