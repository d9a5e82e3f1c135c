"""Groups of any length: ordered folds, gaps, numbers, and what repeated keys lead to."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cardloom.functions.rows import number_rows, ordered_fold, with_next
from cardloom.functions.scratch import scope, scratch_dir
from cardloom.operators import attributes as att
from cardloom.operators import joins, layout, listing, mutations, projections, rollups
from cardloom.sources import readers, schemas


def folders(spark):
    path = scratch_dir(spark).removeprefix("file://")
    return {(d, f) for d, names, _ in os.walk(path) for f in names}


def test_fold_in_order(spark):
    """Joining texts is associative but not commutative; group sizes around the fan-in, a hot group, null keys."""
    rng = random.Random(1)
    rows = [(g, i, chr(97 + rng.randrange(26))) for g, n in (("hot", 700), ("a", 1), ("b", 4), ("c", 5), ("d", 16), ("e", 17), (None, 3)) for i in range(n)]
    want = {}
    for g, _, c in rows:
        want[g] = want.get(g, "") + c
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, c string").repartition(6)
    got = ordered_fold(df, ["g"], ["i"], F.col("c"), lambda a, b: F.concat(a, b), "all", fan_in=4)
    assert {r["g"]: r["all"] for r in got.collect()} == want
    assert ordered_fold(df.limit(0), ["g"], ["i"], F.col("c"), lambda a, b: F.concat(a, b), "all").collect() == []


def test_next_row_and_numbers_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.95 else f"u{rng.randrange(5)}", rng.randrange(400), i) for i in range(900)] + [(None, 1, 9001), (None, 2, 9002)]
    df = spark.createDataFrame(rows, "u string, t int, i int").repartition(5)
    want, numbers = {}, {}
    for u in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == u) if u is not None else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])
        for k, r in enumerate(mine):
            want[r[2]], numbers[r[2]] = (mine[k + 1][1] if k + 1 < len(mine) else None), k
    assert {r["i"]: r["after"] for r in with_next(df, ["u"], ["t", "i"], "t", "after").collect()} == want
    assert {r["i"]: r["n"] for r in number_rows(df, ["u"], ["t", "i"], "n").collect()} == numbers


def test_debounce_of_one_user_with_nearly_all_rows(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [("hot" if rng.random() < 0.95 else "other", i, start + dt.timedelta(milliseconds=rng.randrange(200_000))) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id string, event_id long, ts timestamp").repartition(7)
    kept = set()
    for u in ("hot", "other"):
        mine = sorted((t, i) for v, i, t in rows if v == u)
        kept |= {i for k, (t, i) in enumerate(mine) if k + 1 == len(mine) or mine[k + 1][0] - t > dt.timedelta(milliseconds=250)}
    found = layout.debounce(df, 250)
    assert {r["event_id"] for r in found.collect()} == kept and found.columns == df.columns


def test_scratch_tables_go_with_their_scope(spark):
    before = folders(spark)
    with scope(spark):
        n = number_rows(spark.range(50).withColumn("g", F.col("id") % 3), ["g"], ["id"], "n").agg(F.sum("n")).first()[0]
    assert n == 2 * sum(range(17)) + sum(range(16)) and folders(spark) == before


def card(spark, attributes, id="1"):
    return spark.createDataFrame([(id, "n", "character", json.dumps(attributes))], "id string, name string, type string, attributes string")


def test_spending_follows_the_sequential_fold(spark):
    """Random logs of thousands of clicks on one slot equal clamping click by click."""
    rng = random.Random(4)
    totals = [0, 3, 50, -2]
    log = [(i, rng.randrange(5), float(rng.randint(-9, 9))) for i in range(6000)]
    used = [1.0, 2.0, 7.0, 0.0]
    slots = [{"livello": k + 1, "totale": t, "usati": int(u)} for k, (t, u) in enumerate(zip(totals, used, strict=True))]
    for _, item, delta in log:
        if item < 4:
            used[item] = max(0.0, min(float(totals[item]), used[item] + delta))
    actions = spark.createDataFrame([("1", *x) for x in log] + [("2", 1, 0, 1.0), (None, 1, 0, 1.0)], "id string, seq int, item int, delta double").repartition(4)
    now = att.spend_slots(card(spark, {"slot_incantesimi": slots}), actions, ["seq"])
    assert [s["usati"] for s in json.loads(now.first()["attributes"])["slot_incantesimi"]] == used
    plan = now._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # that of a card's few slots


def edited(attributes, log):
    """The log edit by edit."""
    m = dict(attributes)
    for action, key, value in log:
        if action == "add":
            m[next(f"campo_{i}" for i in range(1, len(m) + 2) if f"campo_{i}" not in m)] = ""
        elif action == "remove":
            m.pop(key, None)
        elif action == "set" and key is not None:
            m[key] = value
    return list(m.items())


@pytest.mark.parametrize("longest", [30])
def test_editing_follows_the_sequential_fold(spark, longest):
    """Random logs with named and unnamed numbers, one of them with most edits; both ways, alone and beside each other."""
    rng = random.Random(5 + longest)
    keys = ["a", "b", "campo_2", "campo_3", "campo_7", "campo_07", "campo_x", None]
    given = {"hot": {"b": "1", "campo_3": "2", "campo_4": "3"}, "c1": {}, "c2": {"campo_1": "x"}, "c3": {"a": None}, "quiet": {"z": "1", "a": "2"}}
    logs = {c: [] for c in given} | {"nowhere": [], None: []}
    for c, n in (("hot", 1200), ("c1", 40), ("c2", 70), ("c3", 9), ("nowhere", 90), (None, 90)):
        weights = {"hot": (2, 5, 3), "c1": (1, 0, 0), "c2": (0, 1, 1)}.get(c, (1, 1, 1))
        for _ in range(n):
            action = rng.choices(["add", "remove", "set"], weights)[0] if rng.random() < 0.98 else "other"
            logs[c].append((action, rng.choice(keys), rng.choice(["v", "w", None])))
    rows = [(c, i, *e) for c, log in logs.items() for i, e in enumerate(log)]
    rng.shuffle(rows)
    edits = spark.createDataFrame(rows, "id string, at int, action string, key string, value string").repartition(5)
    cards = spark.createDataFrame([(c, json.dumps(m)) for c, m in given.items()], "id string, attributes string")
    found = att.edit_attributes(cards, edits, ["at"], longest=longest)
    got = {r["id"]: [tuple(e) for e in r["entries"]] for r in found.select("id", F.map_entries("attributes").alias("entries")).collect()}
    assert got == {c: edited(m, logs[c]) for c, m in given.items()}


def test_sets_that_are_everything(spark):
    start = dt.datetime(2024, 1, 1)
    cards = spark.createDataFrame([(u, f"{u}{i}") for u in ("a", "b", "c", "d", "e") for i in range(4)], "user_id string, id string")
    steps = [("a", "all", None), ("b", "toggle", "b1"), ("b", "all", None), ("b", "toggle", "b2"), ("c", "all", None), ("c", "clear", None), ("c", "toggle", "c3"), ("c", "toggle", "c0"), ("c", "toggle", "c0"),
             ("d", "toggle", "a1"), ("d", "toggle", "d1"), ("x", "all", None), ("a", "toggle", "nowhere")]
    log = spark.createDataFrame([(u, i, start, a, c) for i, (u, a, c) in enumerate(steps)], "user_id string, event_id long, ts timestamp, action string, card_id string")
    chosen = sorted(r["id"] for r in mutations.apply_toggles(log, cards).collect())
    assert chosen == ["a0", "a1", "a2", "a3", "b0", "b1", "b3", "c3", "d1"]
    everything, listed = mutations.selection_sets(log)
    assert sorted(r["user_id"] for r in everything.collect()) == ["a", "b", "x"] and listed.count() == 5  # `all` isn't spread over cards
    assert sorted(r["id"] for r in joins.chosen_cards(cards, mutations.apply_toggles(log, cards)).collect()) == chosen


def test_lookups_return_one_row(spark):
    make = spark.createDataFrame
    requests = make([(1, "t"), (2, None), (3, None), (4, "late")], "request_id int, token string")
    sessions = make([("t", "u", "2025-01-01T00:00:00"), ("t", "v", "2025-01-01T00:00:00"), ("late", "u", "2024-01-01T00:00:00"), (None, "u", "2025-01-01T00:00:00")], "session_token string, user_id string, expires_at string")
    claims = make([(None, "u", "2025-01-01T00:00:00"), ("late", "u", "2025-01-01T00:00:00"), ("late", "v", "2025-01-01T00:00:00")], "token string, user_id string, expires_at string")
    users = make([("u",), ("u",), ("v",)], "user_id string")
    found = joins.resolve_identity(requests, sessions, claims, users, "2024-06-01 00:00:00")
    assert sorted((r["request_id"], r["how"], r["identity"]) for r in found.collect()) == [(1, "session", "u"), (2, "invalid", None), (3, "invalid", None), (4, "expired", None)]
    subs = make([("s", "u", 86400), ("s", "v", 172800), ("s", "u", None)], "sub_id string, user_id string, current_period_end long")
    checkouts = make([("c1", "u", "s", "cus"), ("c2", "v", None, None), ("c3", None, "s", None), ("c4", "nobody", "s", None)], "session_id string, user_id string, subscription string, customer string")
    active = {r["session_id"]: (r["user_id"], str(r["premium_until"]), r["subscription"], r["customer"]) for r in joins.activations(checkouts, subs, users, "2024-01-01 00:00:00").collect()}
    assert active == {"c1": ("u", "1970-01-02 00:00:00", "s", "cus"), "c2": ("v", "2024-02-01 00:00:00", None, None)}
    assert [(r["event_id"], r["user_id"]) for r in joins.renewals(make([(7, "s")], "event_id int, subscription string"), subs, users).collect()] == [(7, "u")]
    table = make([("1", "b"), ("1", "a")], "id string, name string")
    assert sorted((r["id"] or "", r["name"], r["status"]) for r in joins.lookup_or_missing(make([("1",), ("2",), (None,)], "id string"), table, "id").collect()) == [("", None, 404), ("1", "a", 200), ("2", None, 404)]
    counts = rollups.mutation_counts(table.withColumn("_hit", F.lit(1)), make([("1", 5), ("1", 6), ("3", 7)], "id string, _hit int"), ["id"])
    assert sorted(tuple(r) for r in counts.collect()) == [("1", 2, 200), ("3", 0, 404)]


def test_replies_that_are_no_objects(spark):
    replies = ["42", "[1,2]", '"hi"', "null", "true", '{"name":"x"}', '{"name":"x","attributes":[1]}', '{"attributes":null}', '{"attributes":{"a":1}}', "```json\n{}\n```", "", None]
    rows = att.parse_generated(spark.createDataFrame(list(enumerate(replies)), "i int, reply string")).orderBy("i").collect()
    assert [r["ok"] for r in rows] == [False] * 5 + [True, False, True, True, True, False, False]
    assert rows[5]["name"] == "x" and rows[0]["name"] is None and json.loads(rows[8]["attributes"]) == {"a": 1}


def test_appends_can_be_repeated(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    for _ in range(2):
        readers.append_rows(rows, out, "t", batch="monday")
    first = sorted(r["id"] for r in readers.read_appended(spark, out).collect())
    assert len(set(first)) == 3
    os.remove(f"{out}/batch=monday/_SUCCESS")  # as if the job had been killed: nothing of it counts, and it is written again
    with pytest.raises(FileNotFoundError):
        readers.read_appended(spark, out)
    readers.append_rows(rows.repartition(3), out, "t", batch="monday")
    assert sorted(r["id"] for r in readers.read_appended(spark, out).collect()) == first
    readers.append_rows(rows, out, "t", batch="tuesday")
    assert readers.read_appended(spark, out).count() == 6 and readers.read_appended(spark, out).select("id").distinct().count() == 6
    with pytest.raises(ValueError):
        readers.append_rows(rows, out, "t", batch="../x")


def test_owners_of_uploads(spark, tmp_path):
    for path in ("up/user_id=a%20b/x.png", "up/user_id=007/y.PNG", "up/loose/z.webp", "up/loose/nobody.png"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"123")
    manifest = spark.createDataFrame([("loose/z.webp", "m"), ("user_id=007/y.PNG", "other"), ("loose/nobody.png", "p"), ("loose/nobody.png", "q")], "path string, user_id string")
    found = readers.ingest_uploads(spark, str(tmp_path / "up"), "user_id", manifest).collect()
    assert sorted((r["original_filename"], r["user_id"], r["content_type"], r["length"]) for r in found) == [
        ("nobody.png", None, "image/png", 3), ("x.png", "a b", "image/png", 3), ("y.PNG", "007", "image/png", 3), ("z.webp", "m", "image/webp", 3)]


def test_nested_fields_and_unreadable_lines(spark, tmp_path):
    from pyspark.sql import types as T

    slot = T.StructType([T.StructField("level", T.LongType()), T.StructField("used", T.LongType())])
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("slots", T.ArrayType(slot)), T.StructField("by", T.MapType(T.StringType(), slot))])
    given = spark.createDataFrame([("1", [(5, "x"), None], {"k": (6, "y")}), ("2", None, None)], "id string, slots array<struct<level:int,extra:string>>, by map<string,struct<level:int,extra:string>>")
    rows = projections.conform(given, schema, {"slots": {"used": 0}}).orderBy("id").collect()
    assert rows[0]["slots"] == [(5, 0), None] and rows[0]["by"] == {"k": (6, None)} and rows[1]["slots"] is None
    (tmp_path / "a.json").write_text('{"id":"1","name":"ok"}\n{"id":"2","na\n\n{"id":"3","back":4}\n[1]\n{"id":"4","unknown":1}\n')
    good, bad = readers.read_json_checked(spark, str(tmp_path / "a.json"), schemas.CARD)
    assert sorted(r["id"] for r in good.collect()) == ["1", "4"]
    assert {r["line"] for r in bad.collect()} == {'{"id":"2","na', '{"id":"3","back":4}', "[1]"} and all(r["file"].endswith("a.json") for r in bad.collect())


def test_newest_of_each_is_limited_before_rows_move(spark):
    cards = spark.range(3000).select(F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("user_id"), F.col("id").cast("string").alias("id"), F.lit("2024-01-01T00:00:00").alias("created_at"))
    found = listing.newest_of_each(cards, n=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    assert found.count() == 21 and {r["n"] for r in found.groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {3}


def test_settling_and_activating_go_together(spark):
    """Both tables equal the handler that takes one session after another."""
    make = spark.createDataFrame
    sessions = [("s1", "pending"), ("s2", "paid"), ("s3", "pending"), ("s4", None), ("s5", "pending"), ("s6", "pending")]
    states = [("s1", 1, "paid", "open", "u", "sub", "c1"), ("s2", 2, "paid", "complete", "u", None, "c2"), ("s3", 3, "unpaid", "complete", "u", None, "c3"), ("s4", 4, "paid", None, None, "sub", "c4"),
              ("s5", 5, "unpaid", "open", "v", None, "c5"), ("s6", 6, "paid", "open", "w", None, "c6"), ("s3", 2, "paid", None, "v", None, "c0")]
    people = {"u": None, "v": "old"}
    status, granted = dict(sessions), {}
    for s, _, pay, state, user, sub, customer in sorted(states, key=lambda x: x[1]):
        if status[s] != "paid" and (pay == "paid" or state == "complete") and not any(x[0] == s and x[1] > _ and (x[2] == "paid" or x[3] == "complete") for x in states):
            status[s] = "paid"
            if user in people:
                granted[user] = ("1970-01-02T00:00:00" if sub else "2024-02-01T00:00:00", sub, customer)
    transactions = make([(s, "open", p, None) for s, p in sessions], "session_id string, status string, payment_status string, updated_at string")
    provider = make(states, "session_id string, seq int, payment_status string, status string, user_id string, subscription string, customer string")
    users = make(list(people.items()), "user_id string, premium_until string")
    done, now = mutations.settle_and_activate(transactions, provider, make([("sub", "u", 86400)], "sub_id string, user_id string, current_period_end long"), users, "2024-01-01 00:00:00", ["seq"])
    assert {r["session_id"]: r["payment_status"] for r in done.collect()} == status
    want = {u: granted.get(u, (old, None, None)) for u, old in people.items()}
    assert {r["user_id"]: (r["premium_until"], r["stripe_subscription_id"], r["stripe_customer_id"]) for r in now.collect()} == want
