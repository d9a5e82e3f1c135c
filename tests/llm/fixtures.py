"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
SYLLABLES = "ar be ci do el fu ga ho in ju ka lo mi nu or pe qui ra so tu va wé xi yo zü".split()


def prose(seed, words=60, line=10):
    rng = random.Random(seed)
    out = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, words, line))


def awkward():
    """(doc_id, text, lang, source): null id, null text, empty, blank, no words, very long, repeated rows."""
    rows = [
        (None, "a row without id", None, None), (1, None, "en", "s"), (2, "", "en", "s"), (3, " \t\n ", None, "s"), (4, "!!! ???", "en", None),
        (5, "word", "en", "s"), (6, "\U0001f600 漢字 naïve x\r\n", "en", "s"), (7, "tie " * 30, "en", "s"), (8, "x" * 50_000, "en", "s"),
        (9, prose(9, 20_000), "en", "s"),
    ]
    return rows + [rows[0], rows[2], rows[7], (1, None, "en", "s"), (2, "same id, other text", "en", "s")]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The table with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "n_words kept n_lines gone id rep t row k1 r1 d1 ids decoded shard slot score counts found words class _verdict c0 w parts"
    return df.withColumns({n: F.lit(1) for n in names.split()})
