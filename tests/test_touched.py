"""Changes of tables in buckets: what they read and write, and that they equal the change of the whole table."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from cardloom.operators import mutations, touched

CARDS = "id string, user_id string, name string, story string, updated_at string"


def files(path):
    """Digest of every data file below a folder."""
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{folder}/{n}", "rb") as f:
                    found[f"{folder}/{n}"] = hashlib.sha256(f.read()).hexdigest()
    return found


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def cards(spark):
    return spark.range(500, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("user_id"),
                                   F.lit("old").alias("name"), F.lit(None).cast("string").alias("story"), F.lit("then").alias("updated_at"))


def test_patch_leaves_other_buckets(spark, cards, tmp_path):
    table = touched.bucketed(cards, str(tmp_path / "t"), ["id"], 32)
    before = files(tmp_path)
    patches = spark.createDataFrame([("1", "hot", "new", 1), ("1", "hot", "newer", 2), ("2", "stranger", "no", 1), ("9999", "hot", "none", 1), (None, "hot", "null", 1)], "id string, user_id string, name string, seq int")
    wanted = rows(mutations.patch_cards(cards, patches, "now", ["seq"]))
    numbers = touched.patch_cards(table, patches, "now", ["seq"])
    assert rows(table.read(spark)) == wanted
    after = files(tmp_path)
    hit = tuple(f"/bucket={n}/" for n in numbers)
    assert 1 <= len(numbers) <= 4
    kept = {p: d for p, d in before.items() if not any(h in p for h in hit)}
    assert kept and kept == {p: d for p, d in after.items() if not any(h in p for h in hit)}
    assert touched.patch_cards(table, patches, "now", ["seq"]) == numbers and rows(table.read(spark)) == wanted


def test_scan_is_pruned_by_folder(spark, cards, tmp_path):
    table = touched.bucketed(cards, str(tmp_path / "t"), ["id"], 32)
    seen = []

    def change(part):
        part.collect()
        plan = part._jdf.queryExecution().executedPlan()
        seen.append((plan.collectLeaves().head().metrics().apply("numPartitions").value(), plan.toString()))
        return part

    numbers = touched.change_touched(table, cards.filter("id in ('3', '4')").select("id"), ["id"], change)
    read, plan = seen[0]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan), plan
    assert read == len(numbers) <= 2
    assert rows(table.read(spark)) == rows(cards)


def test_buckets_that_become_empty(spark, cards, tmp_path):
    table = touched.bucketed(cards, str(tmp_path / "t"), ["id"], 8)
    touched.delete_cards(table, cards.select("id", "user_id"))
    assert table.read(spark).count() == 0 and not files(tmp_path)
    assert touched.delete_cards(table, cards.select("id", "user_id")) and table.read(spark).count() == 0
    one = touched.bucketed(cards.limit(3), str(tmp_path / "one"), ["id"], 64)
    touched.delete_cards(one, cards.filter("id = '1'").select("id", "user_id"))
    assert one.read(spark).count() == 2


def test_awkward_rows(spark, cards, tmp_path):
    assert touched.patch_cards(touched.bucketed(cards, str(tmp_path / "a"), ["id"], 4), cards.limit(0), "now") == []
    empty = touched.bucketed(cards.limit(0), str(tmp_path / "b"), ["id"], 4)
    assert touched.delete_cards(empty, cards.limit(5).select("id", "user_id")) and empty.read(spark).count() == 0
    with pytest.raises(ValueError):
        touched.bucketed(cards.withColumn("Bucket", F.lit(1)), str(tmp_path / "c"), ["id"], 4)
    # keys of another type meet the same bucket; repeated rows and extra columns stay
    twice = cards.unionByName(cards).withColumn("a.b", F.lit(1))
    table = touched.bucketed(twice, str(tmp_path / "d"), ["id"], 4)
    touched.change_touched(table, spark.range(2), ["id"], lambda part: part.filter("id not in ('0', '1')"))
    assert rows(table.read(spark)) == rows(twice.filter("id not in ('0', '1')"))
    with pytest.raises(ValueError):
        touched.change_touched(table, spark.range(1), ["id"], lambda part: part.withColumn("id", F.concat("id", F.lit("x"))))
    assert rows(table.read(spark)) == rows(twice.filter("id not in ('0', '1')"))
