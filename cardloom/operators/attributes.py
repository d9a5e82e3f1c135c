"""Free-form attributes: JSON text whose key order matters, exploded and reshaped without user functions.

Attributes are parsed as a map of variants, which keeps the order of keys (a top-level variant would sort them).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.rows import free_name, ordered_fold
from cardloom.functions.scratch import new_path, scope, written
from cardloom.functions.text import filled, plain_number, strip
from cardloom.operators.edits import fold_long_logs
from cardloom.operators.projections import attribute_label

# The six abilities in their order, and the fields on the front of a card by type.
ABILITIES = ("for", "des", "cos", "int", "sag", "car")
QUICK_FIELDS = {
    "spell": ("livello", "azione", "gittata", "area", "concentrazione", "danno"),
    "weapon": ("danno", "tipo_danno", "proprieta", "categoria"),
    "feat": ("prerequisito",),
    "class": ("dado_vita", "abilita_primaria"),
    "race": ("velocita", "taglia"),
    "monster": ("classe_armatura", "punti_ferita", "grado_sfida", "velocita"),
    "character": ("classe", "livello", "classe_armatura", "punti_ferita"),
}
SLOTS = "slot_incantesimi"


def parsed(attributes: Column) -> Column:
    """map<string, variant>; an empty map for null or unreadable text."""
    return F.coalesce(F.from_json(attributes, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))


def kind_of(value: Column) -> Column:
    """scalar, string-list, object-list or other: a list is what its first element is; an empty one is other."""
    whole, first = F.schema_of_variant(value), F.schema_of_variant(F.try_variant_get(value, "$[0]", "variant"))
    return (
        F.when(whole.rlike("^(STRING|BIGINT|DOUBLE|FLOAT|DECIMAL)"), "scalar")
        .when(whole.startswith("ARRAY") & (first == "STRING"), "string-list")
        .when(whole.startswith("ARRAY") & first.startswith("OBJECT"), "object-list")
        .otherwise("other")
    )


def text_of(value: Column) -> Column:
    """What a client prints for a value: lists of strings joined by commas, null as the word."""
    whole = F.schema_of_variant(value)
    listed = F.array_join(F.try_variant_get(value, "$", "array<string>"), ",")
    return F.when(whole.startswith("ARRAY"), F.coalesce(listed, F.try_variant_get(value, "$", "string"))).when(whole == "VOID", "null").otherwise(
        F.try_variant_get(value, "$", "string"))


def explode_attributes(cards: DataFrame) -> DataFrame:
    """id, pos, key, kind, value (variant): one row per attribute, in key order."""
    entries = cards.select("id", F.posexplode(F.map_entries(parsed(F.col("attributes")))).alias("pos", "e"))
    return entries.select("id", "pos", F.col("e.key").alias("key"), kind_of(F.col("e.value")).alias("kind"), F.col("e.value").alias("value"))


def ability_block(cards: DataFrame, public: bool = False) -> DataFrame:
    """Adds abilities, array<struct<key, value>>: present and not empty (public view: not blank)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), text_of(F.try_element_at(parsed(F.col("attributes")), F.lit(k))).alias("value")) for k in ABILITIES))
    seen = (lambda x: strip(x["value"]) != "") if public else (lambda x: x["value"] != "")
    return cards.withColumn("abilities", F.filter(pairs, seen))


def _entry(section: str, pos: Column, key: Column, item: Column, text: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), pos.cast("int").alias("pos"), key.alias("key"), item.cast("int").alias("item"), text.alias("text"))


def _object_text(o: Column, public: bool) -> Column:
    """What is printed for an object of a list: name and description; the public view knows spell slots too."""
    of = lambda *names: F.coalesce(*(filled(F.try_element_at(o, F.lit(n))) for n in names))
    name, body = of("nome", "name"), of("descrizione", "description")
    if not public:
        return F.concat(F.coalesce(name, F.lit("")), F.lit(". "), F.coalesce(body, F.lit("")))
    head = F.when(name.isNotNull(), F.concat(name, F.lit(". "))).otherwise(F.concat(F.lit("Liv. "), F.coalesce(F.try_element_at(o, F.lit("livello")), F.lit("undefined")), F.lit(": ")))
    slots = filled(F.try_element_at(o, F.lit("totale")))
    return F.concat(head, F.coalesce(body, F.concat(F.when(slots != "0", slots), F.lit(" slot")), F.lit("")))


def _block_entries(attributes: Column, public: bool) -> Column:
    """array<struct<section, pos, key, item, text>> of a stat block: scalars, list items and objects, in one pass over the map."""
    empty = F.filter(F.array(_entry("scalar", F.lit(0), F.lit(""), F.lit(0), F.lit(""))), lambda _: F.lit(False))

    def of(e: Column, pos: Column) -> Column:
        key, value = e["key"], e["value"]
        kind, text = kind_of(value), text_of(value)
        shown = (strip(text) != "" if public else text != "") & ~key.isin(*ABILITIES)
        items = F.filter(F.try_variant_get(value, "$", "array<string>"), lambda x: strip(x) != "")
        objects = F.try_variant_get(value, "$", "array<map<string,string>>")
        told = kind == "object-list" if public else (kind == "object-list") & (key != SLOTS)
        return (
            F.when((kind == "scalar") & shown, F.array(_entry("scalar", pos, key, F.lit(0), text)))
            .when(kind == "string-list", F.transform(items, lambda x, i: _entry("list", pos, key, i, x)))
            .when(told, F.transform(objects, lambda o, i: _entry("object", pos, key, i, _object_text(o, public))))
        )

    return F.flatten(F.transform(F.map_entries(parsed(attributes)), lambda e, i: F.coalesce(of(e, i), empty)))


def _sections(cards: DataFrame, public: bool) -> DataFrame:
    """id, section, pos, key, item, text, label of a stat block."""
    return cards.select("id", F.inline(_block_entries(F.col("attributes"), public))).withColumn("label", attribute_label(F.col("key")))


def stat_block(cards: DataFrame) -> DataFrame:
    """The owner's view; spell slots are shown elsewhere."""
    return _sections(cards, public=False)


def public_stat_block(cards: DataFrame) -> DataFrame:
    return _sections(cards, public=True)


def quick_stats(cards: DataFrame) -> DataFrame:
    """Adds show_abilities and quick, array<struct<key, value>> of at most six fields."""
    texts = F.transform(F.map_entries(parsed(F.col("attributes"))), lambda e: F.struct(e["key"].alias("key"), F.when(kind_of(e["value"]) == "scalar", text_of(e["value"])).alias("value")))
    shown = free_name(cards, "shown")
    cards = cards.withColumn(shown, F.filter(texts, lambda e: strip(e["value"]) != ""))
    table = F.create_map(*(x for t, names in QUICK_FIELDS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))))
    wanted = F.coalesce(F.try_element_at(table, F.col("type")), F.array().cast("array<string>"))
    named = F.flatten(F.transform(wanted, lambda k: F.filter(shown, lambda e: e["key"] == k)))
    abilities = F.col("type").isin("monster", "character") & F.exists(shown, lambda e: e["key"].isin(*ABILITIES))
    others = F.slice(F.filter(shown, lambda e: ~e["key"].isin(*ABILITIES)), 1, 4)
    quick = F.when((F.size(named) == 0) & ~abilities, others).otherwise(F.slice(named, 1, 6))
    return cards.withColumns({"show_abilities": abilities, "quick": quick}).drop(shown)


def sheet_header(cards: DataFrame) -> DataFrame:
    """Adds header: race, class and level, where they are set (a numeric 0 is not)."""
    get = lambda k: F.try_element_at(parsed(F.col("attributes")), F.lit(k))
    number = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)") & (text_of(v).try_cast("double") == 0)
    value = lambda k: F.when(~F.coalesce(number(get(k)), F.lit(False)), filled(text_of(get(k))))
    return cards.withColumn("header", F.concat_ws(" · ", value("razza"), value("classe"), F.concat(F.lit("Livello "), value("livello"))))


def character_sheet(cards: DataFrame) -> DataFrame:
    """id, section, key, item, text of a printable sheet: abilities with a dash for missing ones, scalars, list items, slots."""
    attributes, none = F.col("attributes"), F.lit(0)
    value = lambda k: filled(text_of(F.try_element_at(parsed(attributes), F.lit(k))))
    abilities = F.array(*(_entry("ability", none, F.lit(k), F.lit(i), F.coalesce(value(k), F.lit("—"))) for i, k in enumerate(ABILITIES)))
    rest = F.filter(_block_entries(attributes, public=False), lambda e: e["section"] != "object")

    def slot(v: Column, i: Column) -> Column:
        total = F.try_variant_get(F.try_element_at(v, F.lit("totale")), "$", "string")
        level = F.coalesce(_truthy(v, "livello"), (i + 1).cast("string"))
        return _entry("slot", none, F.lit(SLOTS), i, F.concat(F.lit("Livello "), level, F.lit(": "), F.coalesce(total, F.lit("undefined")), F.lit(" slot")))

    rows = cards.select("id", F.inline(F.concat(abilities, rest, F.transform(_slot_list(attributes), slot))))
    return rows.select("id", "section", "key", "item", "text")


def _truthy(o: Column, name: str) -> Column:
    """The text of a slot's field unless it is missing, empty or the number 0 (the text "0" counts)."""
    value = F.try_element_at(o, F.lit(name))
    text = F.try_variant_get(value, "$", "string")
    zero = (F.schema_of_variant(value) != "STRING") & (text.try_cast("double") == 0)
    return F.when(~F.coalesce(zero, F.lit(False)), filled(text))


def _slot_list(attributes: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_element_at(parsed(attributes), F.lit(SLOTS)), "$", "array<map<string,variant>>"), F.array().cast("array<map<string,variant>>"))


def _set_slots(attributes: Column) -> Column:
    """The slots that have a level or a total, as array<map<string, variant>>; positions count after that filter."""
    return F.filter(_slot_list(attributes), lambda s: _truthy(s, "livello").isNotNull() | _truthy(s, "totale").isNotNull())


def _slot_number(slot: Column, name: str) -> Column:
    return plain_number(F.coalesce(F.try_variant_get(F.try_element_at(slot, F.lit(name)), "$", "string"), F.lit("")))


def slot_table(cards: DataFrame) -> DataFrame:
    """id, item, level, total, used, remaining of slots that have a level or a total; positions count after that filter."""
    rows = cards.select("id", F.posexplode(_set_slots(F.col("attributes"))).alias("item", "v"))
    level = F.coalesce(_truthy(F.col("v"), "livello"), (F.col("item") + 1).cast("string"))
    out = rows.select("id", "item", level.alias("level"), _slot_number(F.col("v"), "totale").alias("total"), _slot_number(F.col("v"), "usati").alias("used"))
    return out.withColumn("remaining", F.col("total") - F.col("used"))


def _with_used(attributes: Column, used: Callable[[Column, Column], Column]) -> Column:
    """Attributes as JSON text once each set slot has used(slot, position); text without such slots stays as it is.

    Slots without level and total go, as a client that writes its list back leaves them out.
    """
    def spent(slot: Column, i: Column) -> Column:
        number = used(slot, i)
        value = F.when(number == F.floor(number), number.cast("bigint").cast("variant")).otherwise(number.cast("variant"))
        return F.map_concat(F.map_filter(slot, lambda k, _: k != "usati"), F.create_map(F.lit("usati"), value))

    slots = _set_slots(attributes)
    changed = F.transform_values(parsed(attributes), lambda k, v: F.when(k == SLOTS, F.to_variant_object(F.transform(slots, spent))).otherwise(v))
    return F.when(F.size(slots) > 0, F.to_json(changed)).otherwise(attributes)


def spend_slots(cards: DataFrame, actions: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Cards after actions (id, item, delta), one after another in the given order: a slot's `usati` stays between 0 and
    its total. Actions on slots that are not there change nothing.

    An action is a shift held between two bounds, and so are several in a row: (shift, low, high) of a slot's whole log is
    folded without gathering it, so a slot may have any number of actions. Actions that `order` does not tell apart are
    taken by size.
    """
    slots = cards.select("id", F.posexplode(_set_slots(F.col("attributes"))).alias("item", "slot"))
    slots = slots.select("id", "item", _slot_number(F.col("slot"), "totale").alias("total")).distinct()
    moves = actions.filter("item is not null and delta is not null").select("id", "item", *order, F.col("delta").cast("double").alias("delta"))
    step = F.struct(F.col("delta").alias("shift"), F.lit(0.0).alias("low"), F.greatest(F.lit(0.0), "total").alias("high"))

    def then(a: Column, b: Column) -> Column:
        held = lambda u: F.least(b["high"], F.greatest(b["low"], u + b["shift"]))
        return F.struct((a["shift"] + b["shift"]).alias("shift"), held(a["low"]).alias("low"), held(a["high"]).alias("high"))

    runs = ordered_fold(moves.join(slots, ["id", "item"]), ["id", "item", "total"], [*order, "delta"], step, then, "run")
    by_card = runs.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("item", "total", "run")).alias("runs"))  # one for each slot
    now = cards.alias("now").join(by_card.alias("log"), F.col("now.id") == F.col("log.of"), "left")

    def used(slot: Column, i: Column) -> Column:
        own = F.get(F.filter("log.runs", lambda m: (m["item"] == i) & (m["total"] == _slot_number(slot, "totale"))), F.lit(0))["run"]
        start = _slot_number(slot, "usati")
        return F.when(own.isNull(), start).otherwise(F.least(own["high"], F.greatest(own["low"], start + own["shift"])))

    spent = F.when(F.col("log.runs").isNull(), F.col("now.attributes")).otherwise(_with_used(F.col("now.attributes"), used))
    return now.select(*((spent if c == "attributes" else F.col(f"now.`{c}`")).alias(c) for c in cards.columns))


def long_rest(cards: DataFrame) -> DataFrame:
    """Cards whose slots are all unused again."""
    return cards.withColumn("attributes", _with_used(F.col("attributes"), lambda _, __: F.lit(0.0)))


def edit_attributes(cards: DataFrame, edits: DataFrame, order: Sequence[str] = (), longest: int = 10_000) -> DataFrame:
    """id, attributes (map<string, string>, key order kept) after a log of edits (id, action, key, value): set, remove
    or add, one after another in the given order; edits that it does not tell apart are taken by action, key and value.

    `add` takes the first free campo_1, campo_2, ...; set and remove without key, and other actions, change nothing. Logs of up
    to `longest` edits are folded as one list a card, longer ones by fold_long_logs(), whose result is the same; it wants
    unique card ids.
    """
    maps = cards.select("id", F.coalesce(F.from_json("attributes", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")).alias("now"))
    log = edits.filter("action = 'add' or action in ('set', 'remove') and key is not null").select("id", *order, "action", "key", "value")
    path = new_path(cards.sparkSession, "edits")
    with scope(cards.sparkSession):
        counts = log.groupBy("id").count().filter(F.col("count") > longest).select("id")
        long = written(counts.join(cards.select("id").distinct(), "id", "left_semi"), new_path(cards.sparkSession, "long"))
        if long.isEmpty():
            return _edited_by_list(maps, log, order)
        rest = _edited_by_list(maps.join(long, "id", "left_anti"), log.join(long, "id", "left_anti"), order)
        return written(rest.union(fold_long_logs(maps.join(long, "id", "left_semi"), log.join(long, "id", "left_semi"), order)), path)


def _edited_by_list(maps: DataFrame, log: DataFrame, order: Sequence[str]) -> DataFrame:
    steps = F.sort_array(F.collect_list(F.struct(*order, "action", "key", "value")))

    def apply(m: Column, e: Column) -> Column:
        names = F.transform(F.sequence(F.lit(1), F.size(m) + 1), lambda i: F.concat(F.lit("campo_"), i.cast("string")))
        free = F.get(F.filter(names, lambda k: ~F.map_contains_key(m, k)), F.lit(0))
        put = F.when(F.map_contains_key(m, e["key"]), F.transform_values(m, lambda k, v: F.when(k == e["key"], e["value"]).otherwise(v))).otherwise(
            F.map_concat(m, F.create_map(e["key"], e["value"])))
        return F.when(e["action"] == "add", F.map_concat(m, F.create_map(free, F.lit("")))).when(e["action"] == "remove", F.map_filter(m, lambda k, _: k != e["key"])).when(
            e["action"] == "set", put).otherwise(m)

    met = maps.join(log.groupBy("id").agg(steps.alias("steps")), "id", "left")
    return met.select("id", F.when(F.col("steps").isNull(), F.col("now")).otherwise(F.aggregate("steps", F.col("now"), apply)).alias("attributes"))


def lines_to_list(text: Column) -> Column:
    return F.split(text, "\n", -1)


def list_to_lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def parse_generated(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Generator replies to name, description, story, attributes (JSON) and ok; ok = false is the quarantine.

    A code fence and its json tag are cut off, then everything outside the first { and the last }. A reply that is JSON but
    no object (a number, text, list, null) has no fields to pick from and is quarantined; so is one whose attributes are
    neither left out, null nor an object.
    """
    text = strip(F.col(reply))
    fenced = F.split_part(text, F.lit("```"), F.lit(2))
    fenced = F.when(fenced.startswith("json"), F.substr(fenced, F.lit(5))).otherwise(fenced)
    t, v = free_name(df, "bare"), free_name(df, "parsed")
    df = df.withColumn(t, strip(F.when(text.startswith("```"), fenced).otherwise(text)))
    start, back = F.locate("{", F.col(t)), F.locate("}", F.reverse(t))
    cut = F.when((start > 0) & (back > 0), F.substr(t, start, F.length(t) - back - start + 2)).otherwise(F.col(t))
    df = df.withColumn(v, F.try_parse_json(cut))
    given = F.schema_of_variant(F.try_variant_get(v, "$.attributes", "variant"))
    fine = F.schema_of_variant(v).startswith("OBJECT") & (given.isNull() | given.startswith("OBJECT") | (given == "VOID"))
    df = df.withColumn("ok", F.coalesce(fine, F.lit(False)))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    out = {k: F.when(F.col("ok"), F.coalesce(get(k), F.lit(""))) for k in ("name", "description", "story")}
    out["attributes"] = F.when(F.col("ok"), F.coalesce(get("attributes"), F.lit("{}")))
    return df.withColumns(out).drop(t, v)
