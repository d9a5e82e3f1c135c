"""Golden values of the operators, edge rows included."""

import json

import pytest
from pyspark.sql import functions as F

from cardloom.operators import attributes as att
from cardloom.operators import compose, joins, layout, listing, mutations, predicates, projections, rollups
from cardloom.sources import readers, schemas


def card(spark, attributes, **fields):
    row = {"id": "1", "user_id": "u", "type": "spell", "custom_type": "", "name": "", "story": "", "attributes": json.dumps(attributes, ensure_ascii=False)} | fields
    return spark.createDataFrame([row])


def composed(spark, attributes, **fields):
    return compose.compose_description(card(spark, attributes, **fields)).first()["description_new"]


def test_compose_spell(spark):
    full = {"livello": "3", "scuola": "Evocazione", "azione": "Azione", "gittata": "36 m", "concentrazione": "No", "danno": "8d6 fulmine"}
    assert composed(spark, full, name="Fulmine Arcano") == (
        "Fulmine Arcano è una magia di evocazione di livello 3. Si lancia come azione, gittata 36 m. Infligge 8d6 fulmine.")
    assert composed(spark, {"livello": "3"}, name="Fulmine Arcano") == "Fulmine Arcano è una magia di livello 3."
    assert composed(spark, {"livello": "", "danno": "-"}, name=" ") is None
    assert composed(spark, {"livello": "-"}, name="Solo", type="character") is None


@pytest.mark.parametrize(("kind", "attributes", "text"), [
    ("weapon", {"categoria": "Marziale", "danno": "1d8", "tipo_danno": "Tagliente", "peso": "2 kg"}, "X è un'arma marziale che infligge 1d8 danni tagliente. Peso 2 kg."),
    ("monster", {"grado_sfida": "5", "classe_armatura": 15, "punti_ferita": "60", "immunita": "veleno"}, "X è una temibile creatura di grado sfida 5. Possiede CA 15, 60 punti ferita. Ha immunità a veleno."),
    ("character", {"razza": "Elfo", "classe": "Mago", "livello": 3, "classe_armatura": "12"}, "X, elfo mago di livello 3. CA 12."),
    ("race", {"taglia": "Media", "velocita": "9 m", "linguaggi": "Comune"}, "I X hanno taglia media e velocità 9 m. Parlano: Comune."),
    ("race", {}, "I X sono un popolo dalle antiche origini."),
    ("class", {"abilita_primaria": "Forza", "dado_vita": "d10"}, "X è una classe incentrata su Forza. Dado vita: d10."),
    ("feat", {"prerequisito": "Des 13"}, "X è un talento che conferisce vantaggi unici. Prerequisito: Des 13."),
    ("custom", {"zona_x": "Nord", "b": "", "costo": "3"}, "X. zona x: Nord · Costo: 3."),
])
def test_compose_branches(spark, kind, attributes, text):
    assert composed(spark, attributes, name="X", type=kind) == text


def test_story_and_content(spark):
    filled = compose.fill_story(card(spark, {}, name="Fulmine Arcano")).first()["story"]
    assert filled == "Le origini di Fulmine Arcano si perdono tra le pagine ingiallite di antichi tomi, tramandate da generazioni di avventurieri."
    has = lambda a: compose.has_content(card(spark, a)).first()["has_content"]
    assert not has({"a": " ", "b": "-"}) and has({"a": ["-"]}) and not has({"a": ["", " "]}) and has({"a": None}) and has({"a": [{"n": "x"}]}) and not has({"a": [{"n": ""}]})


def test_quick_stats(spark):
    attributes = {"livello": "1", "azione": "Azione", "gittata": "36 m", "area": "-", "concentrazione": "No", "danno": "3d4+3 forza"}
    row = att.quick_stats(card(spark, attributes)).first()
    assert [(x["key"], x["value"]) for x in row["quick"]] == list(attributes.items()) and not row["show_abilities"]
    zeta = att.quick_stats(card(spark, {"z": "1", "a": "2", "m": [], "k": "3", "b": "4", "c": "5"}, type="custom")).first()
    assert [x["key"] for x in zeta["quick"]] == ["z", "a", "k", "b"]  # the order of the keys, not of the alphabet


def test_slots(spark):
    slots = [{"livello": 1, "totale": 4}, {"livello": 2, "totale": "3"}, {"livello": 3, "totale": " 2 "}, {"livello": "", "totale": 0}, {"livello": "0", "totale": "2x"}]
    table = att.slot_table(card(spark, {"slot_incantesimi": slots}))
    assert [(r["level"], r["total"]) for r in table.orderBy("item").collect()] == [("1", 4.0), ("2", 3.0), ("3", 2.0), ("0", 0.0)]
    with_slots = card(spark, {"razza": "Elfo", "slot_incantesimi": slots, "z": ["a"]}, type="character")

    def left(*moves, rest=False):
        """Remaining of the first slot after clicks (item, delta), read back from the card."""
        log = spark.createDataFrame([("1", i, item, delta) for i, (item, delta) in enumerate(moves)], "id string, seq int, item int, delta double")
        now = att.spend_slots(with_slots, log, ["seq"])
        return att.slot_table(att.long_rest(now) if rest else now).filter("item = 0").first()["remaining"]

    assert left((0, 1.0), (0, 1.0)) == 2 and left((0, 2.0), (0, -1.0)) == 3 and left((0, 3.0), rest=True) == 4 and left((0, 99.0)) == 0
    assert left((0, 99.0), (0, -1.0)) == 1 and left((0, -1.0), (0, 99.0)) == 0 and left((3, 1.0), (9, 1.0)) == 4  # each click is held between 0 and the total
    spent = json.loads(att.spend_slots(with_slots, spark.createDataFrame([("1", 1, 2.0)], "id string, item int, delta double")).first()["attributes"])
    assert list(spent) == ["razza", "slot_incantesimi", "z"] and spent["z"] == ["a"]
    assert [(s["livello"], s["usati"]) for s in spent["slot_incantesimi"]] == [(1, 0), (2, 2), (3, 0), ("0", 0)]
    plain = card(spark, {"a": "1"})
    assert att.long_rest(plain).first()["attributes"] == plain.first()["attributes"]


def test_edit_log(spark):
    edits = [("1", 1, "add", None, None), ("1", 2, "add", None, None), ("1", 3, "set", "campo_1", "x"), ("1", 4, "remove", "b", None), ("1", 5, "set", "b", "new"), ("1", 6, "set", None, "lost"), ("2", 1, "add", None, None)]
    log = spark.createDataFrame(edits, "id string, seq int, action string, key string, value string")
    got = att.edit_attributes(card(spark, {"b": "1", "a": "2"}), log, ["seq"])
    got = got.select(F.map_entries("attributes").alias("pairs")).collect()  # a row's own dictionary has lost the order
    assert len(got) == 1 and [tuple(p) for p in got[0]["pairs"]] == [("a", "2"), ("campo_1", "x"), ("campo_2", ""), ("b", "new")]


def test_several_requests_make_one_row(spark):
    cards = spark.createDataFrame([("1", "u", "n", "s", "", "{}", None)], "id string, user_id string, name string, story string, description string, attributes string, updated_at string")
    patches = spark.createDataFrame([("1", "u", 1, "a", None), ("1", "u", 2, None, "z"), ("1", "u", 3, "b", None)], "id string, user_id string, seq int, name string, story string")
    assert [(r["name"], r["story"]) for r in mutations.patch_cards(cards, patches, "t", ["seq"]).collect()] == [("b", "z")]
    made = spark.createDataFrame([("1", 2, "", "", "", '{"a":1}'), ("1", 1, "x", "y", "", "{}")], "id string, seq int, name string, description string, story string, attributes string")
    assert [(r["name"], r["description"], r["story"], r["attributes"]) for r in mutations.merge_generated(cards, made, ["seq"]).collect()] == [("x", "y", "s", '{"a":1}')]
    users = spark.createDataFrame([("u", "A@x", False, False)], "user_id string, email string, is_admin boolean, premium_manual boolean")
    switches = spark.createDataFrame([("u", 1, True), ("u", 2, None)], "user_id string, seq int, enabled boolean")
    assert [r["premium_manual"] for r in mutations.set_premium(users, switches, ["seq"]).collect()] == [True]
    seeds = spark.createDataFrame([("a@x", "n1"), ("A@X", "n2"), ("b@x", "n4"), ("B@x", "n3"), (None, "n5")], "email string, new_id string")
    assert sorted(tuple(r) for r in mutations.ensure_admins(users, seeds).collect()) == [("n3", "b@x", True, True), ("u", "a@x", True, True)]
    paid = spark.createDataFrame([("s", "open", "pending", None)], "session_id string, status string, payment_status string, updated_at string")
    states = spark.createDataFrame([("s", "open", "unpaid"), ("s", "complete", None), ("s", None, None)], "session_id string, status string, payment_status string")
    assert [tuple(r) for r in mutations.settle(paid, states, "t").collect()] == [("s", "completed", "paid", "t")]
    prices = spark.createDataFrame([("p2", "k", 5, "eur"), ("p1", "k", 4, "eur")], "id string, lookup_key string, amount int, currency string")
    want = spark.createDataFrame([("k", 4, "eur"), ("new", 1, "eur")], "lookup_key string, amount int, currency string")
    assert sorted(tuple(r) for r in mutations.reconcile_prices(want, prices).collect()) == [("k", 4, "eur", "keep"), ("new", 1, "eur", "create")]
    files = spark.createDataFrame([("f2", "p", "b", False), ("f1", "p", "a", False), ("f0", "p", "c", True)], "id string, storage_path string, original_filename string, is_deleted boolean")
    art = joins.cards_with_artwork(cards.withColumn("artwork_path", F.lit("p")), files).collect()
    assert [(r["file_id"], r["original_filename"]) for r in art] == [("f1", "a")]


def test_columns_of_any_name_pass_through(spark):
    names = "_n _there _map _met met now new there n salt part start row last shown parsed bare"
    odd = lambda df: df.withColumns({n: F.lit(7) for n in names.split()})
    keys = spark.createDataFrame([("1",), ("2",)], "id string")
    found = joins.lookup_or_missing(keys, odd(spark.createDataFrame([("1",)], "id string")), "id")
    assert found.columns[1:-1] == names.split() and {r["status"] for r in found.collect()} == {200, 404}
    cards = odd(spark.createDataFrame([("u", "1", "2024-01-01"), ("u", "2", "2024-01-02"), (None, "3", None)], "user_id string, id string, created_at string"))
    placed = layout.impose(cards)
    assert placed.columns[: len(cards.columns)] == cards.columns and placed.filter("n = 7 and salt = 7 and row is not null").count() == 3
    assert layout.render_steps(layout.impose_backs(placed)).count() == 6


def test_kinds(spark):
    rows = att.explode_attributes(card(spark, {"z": "a", "n": 3, "s": ["x", {"a": 1}], "o": [{"a": 1}], "e": [], "b": True, "q": {"a": 1}})).collect()
    assert [(r["key"], r["kind"]) for r in rows] == [("z", "scalar"), ("n", "scalar"), ("s", "string-list"), ("o", "object-list"), ("e", "other"), ("b", "other"), ("q", "other")]


def test_search(spark):
    cards = spark.createDataFrame([("1", "TEST_Palla di Fuoco"), ("2", "ÈLARION"), ("3", "altro")], "id string, name string")
    assert [r["id"] for r in predicates.search_name(cards, "TEST_Palla").collect()] == ["1"]
    assert [r["id"] for r in predicates.search_name(cards, "èlarion").collect()] == ["2"]
    assert predicates.search_name(cards, "  ").count() == 3
    assert predicates.search_name(cards, r"^\p{L}+$").count() == 2  # the engine that runs the pattern decides
    for bad in ("(", "(?P<name>a)"):
        with pytest.raises(ValueError, match="regular expression"):
            predicates.search_name(cards, bad)


def test_premium_edges(spark):
    rows = [("a", None, "2024-01-31T00:00:00"), ("b", None, "2024-01-31T02:00:01+02:00"), ("c", None, "boh"), ("d", True, None), ("e", None, "2024-02-01T00:00:00Z"), ("f", False, "")]
    users = spark.createDataFrame(rows, "user_id string, premium_manual boolean, premium_until string")
    got = {r["user_id"]: r["is_premium"] for r in projections.with_premium(users, "2024-01-31 00:00:00").collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": True, "f": False}
    sessions = users.select(F.col("user_id").alias("session_token"), F.col("premium_until").alias("expires_at"))
    assert {r["session_token"] for r in predicates.valid_sessions(sessions, "2024-01-31 00:00:00").collect()} == {"a", "b", "e"}


def test_patch_and_redact(spark):
    cards = spark.createDataFrame([("1", "u", "vecchio", "s", None), ("2", "u", "b", "s", None)], "id string, user_id string, name string, story string, updated_at string")
    patches = spark.createDataFrame([("1", "u", "nuovo", None), ("2", "altri", "rubato", None)], "id string, user_id string, name string, story string")
    got = {r["id"]: (r["name"], r["story"], r["updated_at"]) for r in mutations.patch_cards(cards, patches, "ora").collect()}
    assert got == {"1": ("nuovo", "s", "ora"), "2": ("b", "s", None)}
    assert projections.redact(cards, ["user_id"]).columns == ["id", "name", "story", "updated_at"]
    assert {r["status"] for r in rollups.mutation_counts(cards, patches.select("id", "user_id"), ["id", "user_id"]).collect()} == {200, 404}


def test_generated_replies(spark):
    replies = ['```json\n{"name":"A","attributes":{"b":1}}\n```', 'ecco: {"name":"B"} fine', '{"name":', "", '```\n{"story":"S"}\n```']
    rows = att.parse_generated(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, reply string")).orderBy("id").collect()
    assert [(r["ok"], r["name"], r["story"]) for r in rows] == [(True, "A", ""), (True, "B", ""), (False, None, None), (False, None, None), (True, "", "S")]
    assert rows[0]["attributes"] == '{"b":1}'


def test_readers_and_append(spark, tmp_path):
    (tmp_path / "cards.json").write_text(json.dumps({"id": "1", "user_id": "u", "type": "spell", "name": "N", "x": 1, "back": {"style": "runic"}, "attributes": {"z": 1, "a": 2}}) + "\n")
    row = readers.read_cards(spark, str(tmp_path / "cards.json")).first()
    assert row["language"] == "it" and row["back"]["style"] == "runic" and row["back"]["emblem"] == "flame" and list(json.loads(row["attributes"])) == ["z", "a"]
    (tmp_path / "art").mkdir()
    (tmp_path / "art" / "a.b.WEBP").write_bytes(b"x")
    (tmp_path / "art" / "noext").write_bytes(b"xy")
    files = {r["original_filename"]: (r["content_type"], r["length"]) for r in readers.ingest_uploads(spark, str(tmp_path / "art"), "u").collect()}
    assert files == {"a.b.WEBP": ("image/webp", 1), "noext": ("image/png", 2)}
    out = str(tmp_path / "out")
    for _ in range(2):
        readers.append_rows(spark.createDataFrame([("n",)], "name string"), out, "t")
    assert spark.read.parquet(out).select("id").distinct().count() == 2
    products = spark.createDataFrame([("P", "t", [("k", 999, "eur", "month"), ("k2", 1, "eur", "year")])], "name string, tax_code string, prices array<struct<lookup_key:string,amount:bigint,currency:string,interval:string>>")
    assert readers.read_price_catalogue(products).count() == 2


def test_events_reader(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id":"evt_1","created":1704067200,"type":"invoice.paid","data":{"object":{"id":"i","subscription":"s","metadata":{"user_id":"u"}}}}\n')
    row = readers.read_payment_events(spark, str(tmp_path)).first()
    assert (row["event_id"], str(row["ts"]), row["session_id"], row["user_id"], row["payment_status"]) == ("evt_1", "2024-01-01 00:00:00", "i", "u", None)


def test_print_layout(spark):
    cards = spark.createDataFrame([("u", str(i), f"2024-01-{i + 1:02d}") for i in range(10)], "user_id string, id string, created_at string")
    placed = layout.impose(cards)
    first = placed.filter("page = 0 and slot = 0").first()
    assert first["id"] == "9" and first["x"] == pytest.approx(7.5) and first["y"] == pytest.approx(13.2)
    backs = layout.impose_backs(placed)
    assert backs.filter("side = 'back' and page = 0 and slot = 0").first()["col"] == 2
    steps = [r["side"] for r in layout.render_steps(backs).orderBy("step").collect()]
    assert steps == ["front"] * 9 + ["back"] * 9 + ["front", "back"]
    assert layout.crop_marks(placed).count() == 80


def test_identity_order(spark):
    requests = spark.createDataFrame([(i, t) for i, t in enumerate(["late", "gone", "ok", "claim", None])], "request_id int, token string")
    sessions = spark.createDataFrame([("late", "u", "2024-01-01T00:00:00"), ("gone", "x", "2025-01-01T00:00:00"), ("ok", "u", "2025-01-01T00:00:00")], "session_token string, user_id string, expires_at string")
    claims = spark.createDataFrame([("late", "u", "2025-01-01T00:00:00"), ("gone", "u", "2025-01-01T00:00:00"), ("claim", "u", "2025-01-01T00:00:00")], "token string, user_id string, expires_at string")
    users = spark.createDataFrame([("u",)], "user_id string")
    got = {r["request_id"]: (r["how"], r["identity"]) for r in joins.resolve_identity(requests, sessions, claims, users, "2024-06-01 00:00:00").collect()}
    assert got == {0: ("expired", None), 1: ("claims", "u"), 2: ("session", "u"), 3: ("claims", "u"), 4: ("invalid", None)}


def test_list_is_one_top_k(spark):
    cards = spark.createDataFrame([], schemas.CARD)
    plan = listing.list_cards(cards, "u", "spell", "x")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
