"""Operator 3: drop lines that many documents share.

Lines are exploded as 128-bit hashes of their keys, once per document, counted by hash with a map-side partial
sum, and joined back by hash: an inner join between the exploded lines and the frequent hashes, which adaptive
execution splits where one line is in a large share of all documents. Line text never travels; each document gets
the list of its dropped positions and is put together again from the stretches between them.

With groups of texts, a group counts as one document: a line then needs min_documents groups that hold it. Rows
are counted first, since no line has more groups than rows; groups are looked up for the lines that this leaves.

Each row is a document. Null text counts as one empty line and comes back empty; rows that repeat both id and
text count as documents of their own and get the same result. An empty table gives an empty one. Texts are read whole,
however long. Columns besides text are passed through; where one has the name of a count, the count gets an underscore
behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import Scratch, free_name, materialise, text_key

#: Characters stripped at both ends of a line to make its key; A-Z are lower-cased, nothing else.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.translate(F.trim(x, F.lit(STRIPPED)), UPPER, LOWER))


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def _in_groups(placed: DataFrame, groups: DataFrame, min_documents: int, hold: Scratch) -> DataFrame:
    """The rows of placed (d1, d2, p, a, b), once for each text, whose lines stand in min_documents groups."""
    placed = hold.table(placed.distinct(), "placed-lines")
    of = groups.select("d1", "d2", F.col("group").cast("string").alias("g")).groupBy("d1", "d2").agg(F.min("g").alias("g"))
    voter = F.coalesce(F.concat(F.lit("g"), "g"), F.concat_ws(" ", F.col("d1").cast("string"), F.col("d2").cast("string")))
    votes = placed.select("d1", "d2", "a", "b").distinct().join(of, ["d1", "d2"], "left").select("a", "b", voter.alias("v")).distinct()
    shared = votes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).select("a", "b")
    return placed.join(hold.table(shared, "shared-lines"), ["a", "b"])


def drop_shared_lines(df: DataFrame, text: str = "text", min_key_chars: int = 1, min_documents: int = 10, groups: DataFrame | None = None) -> DataFrame:
    """The rows of df with text replaced, and n_lines, n_dropped (bigint) added at the end.

    A key of at least min_key_chars code points that at least min_documents documents hold loses all its lines.
    groups (d1, d2: text_key of a text, group): texts that count as one document; equal texts then always do.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    at = names[df.columns.index(text)]
    docs = df.toDF(*names)
    whole = F.coalesce(F.col(at).cast("string"), F.lit(""))
    key = [k.alias(n) for k, n in zip(text_key(whole), ("d1", "d2"), strict=True)]
    marked = docs.select(whole.alias("t"), *key).withColumn("keys", line_keys(F.split("t", "\n", -1)))
    hashed = F.transform("keys", lambda k: F.when(F.length(k) >= min_key_chars, _hashed(k)))
    lines = marked.select("d1", "d2", hashed.alias("h"))
    counted = (
        lines.select(F.explode(F.array_distinct(F.array_compact("h"))).alias("h"))
        .groupBy("h.a", "h.b").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_documents).select("a", "b")
    )
    with Scratch(df.sparkSession) as hold:
        frequent = hold.table(counted, "frequent-lines")
        placed = lines.select("d1", "d2", F.posexplode("h").alias("p", "h")).filter("h is not null").select("d1", "d2", "p", "h.a", "h.b")
        placed = placed.join(frequent, ["a", "b"])
        if groups is not None:
            placed = _in_groups(placed, groups, min_documents, hold)
        drops = placed.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("p")).alias("gone"))
        drops = materialise(drops, "dropped-lines")
    joined = docs.withColumns({"w": whole, "d1": key[0], "d2": key[1]}).join(drops, ["d1", "d2"], "left")
    parts = F.split("w", "\n", -1)
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("parts")))
    stretches = F.transform(
        F.slice("edges", 1, F.size("edges") - 1),
        lambda e, i: F.slice("parts", e + 2, F.get("edges", i + 1) - e - 1),
    )
    out = (
        joined.withColumn("parts", parts).withColumn("edges", edges)
        .withColumns({
            "kept": F.when(F.col("gone").isNull(), F.col("w")).otherwise(F.array_join(F.flatten(stretches), "\n")),
            "nl": F.size("parts").cast("bigint"),
            "nd": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint"),
        })
    )
    return out.select(*(F.col("kept" if n == at else n).alias(c) for n, c in zip(names, df.columns, strict=True)), F.col("nl").alias(free_name(df, "n_lines")), F.col("nd").alias(free_name(df, "n_dropped")))
