"""Indexed searches give what the scan gives, from fewer rows."""

import random

import pytest
from pyspark.sql import functions as F

from cardloom.operators import postings as post
from cardloom.operators.predicates import search_name, search_users

NAMES = ["Palla di Fuoco", "PALLA DI NEVE", "Fulmine Arcano", "Èlarion", "palla", "aXXb", "abb", "axb", "", "ab", "ſpell Kelvin", "DİSK ışık", "a.b|c", "漢字漢字", "fire  ball", None]


@pytest.fixture(scope="module")
def cards(spark):
    rng = random.Random(7)
    rows = [(str(i), n) for i, n in enumerate(NAMES)] + [(f"r{i}", "".join(rng.choice("abAB xyé") for _ in range(rng.randint(0, 14)))) for i in range(400)]
    rows += [("0", "shared key, other name"), (None, "palla without key")]
    return spark.createDataFrame(rows, "id string, name string").repartition(3)


@pytest.fixture(scope="module")
def names(cards, tmp_path_factory):
    return post.build_postings(cards, "id", F.col("name"), f"file://{tmp_path_factory.mktemp('postings')}/names")


def rows(df):
    return sorted((r["id"] or "", r["name"]) for r in df.collect())


def patterns():
    rng = random.Random(8)
    made = ["".join(rng.choice(["a", "b", "B", " ", "x", "yab", "abx", ".", "|", "^", "$", "?", "*", "+"]) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    fixed = ["palla", "PALLA|fulmine", "èlarion", "élarion", "disk", "ISIK", "spell k", "kelvin", "ab+", "pall?a", "di .*e", "(palla|x)", "[p]alla", r"\bdi", "a{1,2}b", "", " ", "palla|", "abb*|zzz"]
    return fixed + made


def test_indexed_searches_equal_the_scan(cards, names):
    used = 0
    for pattern in patterns():
        try:
            want = rows(search_name(cards, pattern))
        except ValueError:
            with pytest.raises(ValueError):
                post.search_name_indexed(cards, names, pattern)
            continue
        assert rows(post.search_name_indexed(cards, names, pattern)) == want, pattern
        used += post.candidates(names, post.literals(pattern.strip())) is not None
    assert used >= 10


def test_texts_that_a_pattern_needs():
    assert post.literals("abc") == [["abc"]] and post.literals("Abcd?ef+g|^x.yz$") == [["abc", "ef", "g"], ["x", "yz"]]
    assert post.literals("a(b)") is None and post.literals(r"a\d") is None and post.literals("a*?bc") == [["bc"]]
    assert post.grams_of(["abcd", "xé1"]) == {"abc", "bcd"}


def test_few_rows_are_read(cards, names):
    """The filter on grams reaches the scan of the postings, and few rows are left to verify."""
    found = post.candidates(names, post.literals("palla di"))
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(gram), ", "")
    assert found.count() == 2 and cards.count() > 400
    plan = post.search_name_indexed(cards, names, "palla di")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "RLIKE" in plan.upper()


def test_users(spark, tmp_path):
    users = spark.createDataFrame([("u1", "Anna", "anna@x.test"), ("u2", "Bo", "BO@y.test"), ("u3", None, "z@z"), ("u4", "Dİ", "i@x.test")], "user_id string, name string, email string")
    table = post.build_postings(users, "user_id", F.concat("name", F.lit(" "), "email"), f"file://{tmp_path}/users")
    for text in ("anna", "A ANNA@", "bo bo", "x.test", "o", "nobody", "i i@x"):
        want = sorted(r["user_id"] for r in search_users(users, text).collect())
        assert sorted(r["user_id"] for r in post.search_users_indexed(users, table, text).collect()) == want, text


def test_no_pairs_are_held_to_be_told_apart(spark, tmp_path, monkeypatch):
    """Postings are sorted in as many tasks as there are rows for, without an aggregate; repeated ones change no search."""
    monkeypatch.setattr(post, "TASK_ROWS", 500)
    plans = []
    monkeypatch.setattr(post, "written", lambda df, path: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.write.parquet(path) or spark.read.parquet(path))
    long = "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(90))
    many = spark.createDataFrame([(str(i % 50), f"Palla {i}") for i in range(400)] + [("long", long)] * 3, "id string, name string")
    table = post.build_postings(many, "id", F.col("name"), f"file://{tmp_path}/names")
    assert "Aggregate" not in plans[0] and len(list((tmp_path / "names").glob("part-*"))) > 1
    for pattern in ("palla", "palla 39", "^palla 1|palla 7", long, long[::-1]):
        assert rows(post.search_name_indexed(many, table, pattern)) == rows(search_name(many, pattern)), pattern


def test_candidates_are_grouped_in_as_many_tasks_as_rows_need(spark, names, monkeypatch):
    monkeypatch.setattr(post, "TASK_ROWS", 2)
    found = post.candidates(names, post.literals("palla"))
    assert found.count() == 3 and found.rdd.getNumPartitions() >= 5
