"""Queries over cards: listing, labels, attributes, composition, generator texts and print sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions.scratch import new_path
from cardloom.operators import postings, attributes as att
from cardloom.operators import compose, layout, listing, mutations, predicates, projections, rollups, touched
from cardloom.plans.common import Book
from cardloom.sources import schemas
from cardloom.sources.adapters import AS_OF

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
add = BOOK.add

_LIST = ("id", "user_id", "type", "name", "created_at")
add("srt_2_list_cards", "cards", lambda c: listing.list_cards(c, "user_7", "all", " ring|GIZMO ").select(*_LIST),
    "SELECT id, user_id, type, name, created_at FROM cards WHERE user_id = 'user_7' AND regexp_matches(name, 'ring|gizmo', 'i') ORDER BY created_at DESC, id LIMIT 1000")
add("srt_1_newest", "cards", lambda c: listing.newest(c, 1000).select(*_LIST),
    "SELECT id, user_id, type, name, created_at FROM cards ORDER BY created_at DESC, id LIMIT 1000")
add("srt_1_newest_of_each", "cards", lambda c: listing.newest_of_each(c, n=5).select(*_LIST),
    "SELECT id, user_id, type, name, created_at FROM cards QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) <= 5")
add("flt_1_owned_by", "cards", lambda c: predicates.owned_by(c, "user_3").select(*_LIST), "SELECT id, user_id, type, name, created_at FROM cards WHERE user_id = 'user_3'")
add("flt_2_of_type", "cards", lambda c: predicates.of_type(c, "weapon").select(*_LIST), "SELECT id, user_id, type, name, created_at FROM cards WHERE type = 'weapon'")
add("flt_3_search_name", "cards", lambda c: predicates.search_name(c, " ^SMALL|bolt ").select(*_LIST),
    "SELECT id, user_id, type, name, created_at FROM cards WHERE regexp_matches(name, '^SMALL|bolt', 'i')")
def _indexed(cards):
    """The search over a posting table of the names, built in the shared scratch folder."""
    table = postings.build_postings(cards, "id", F.col("name"), new_path(cards.sparkSession, "postings"))
    return postings.search_name_indexed(cards, table, "small.*bolt|gizmo").select(*_LIST)


add("flt_3_search_name_indexed", "cards", _indexed, "SELECT id, user_id, type, name, created_at FROM cards WHERE regexp_matches(name, 'small.*bolt|gizmo', 'i')")
add("flt_4_lookup", "cards", lambda c: predicates.lookup_row(c, id="42", user_id="user_42").select(*_LIST), "SELECT id, user_id, type, name, created_at FROM cards WHERE id = '42' AND user_id = 'user_42' LIMIT 1")
add("prj_1_conform", "cards", lambda c: projections.conform(c.drop("language").withColumn("extra", F.lit(1)), schemas.CARD, schemas.CARD_DEFAULTS).select("id", "language", "custom_type", "back.*"),
    "SELECT id, 'it' AS language, custom_type, 'classic' AS style, '#7f1d1d' AS color, 'flame' AS emblem, '' AS motto FROM cards")
add("prj_2_redact", "cards", lambda c: projections.redact(c, ["user_id"]).drop("attributes"),
    "SELECT id, type, custom_type, name, description, story, language, artwork_path, created_at, updated_at FROM cards")


def _case(table: dict[str, str], column: str, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items()) + f" ELSE {other} END"


def _label_sql(table: dict[str, str]) -> str:
    return f"CASE WHEN type = 'custom' AND custom_type <> '' THEN custom_type ELSE {_case(table, 'type', 'type')} END"


add("prj_3_type_label", "cards", lambda c: projections.with_type_label(projections.with_type_label(c, "prompt").withColumnRenamed("type_label", "prompt_label")).select("id", "type_label", "prompt_label"),
    f"SELECT id, {_label_sql(projections.TYPE_LABELS)} AS type_label, {_label_sql(projections.PROMPT_LABELS)} AS prompt_label FROM cards")
_KEYS = "SELECT id, unnest(json_keys(attributes)) AS key, generate_subscripts(json_keys(attributes), 1) - 1 AS pos, attributes FROM cards"
_LABEL = _case(projections.ATTRIBUTE_LABELS, "key", "replace(key, '_', ' ')")
add("prj_4_attr_label", "cards", lambda c: projections.with_attr_label(att.explode_attributes(c), "key").select("id", "key", "label"), f"WITH k AS ({_KEYS}) SELECT id, key, {_LABEL} AS label FROM k")
add("prj_7_links", "cards", lambda c: projections.with_links(c.withColumn("token", F.concat(F.lit("a b&"), "id")), "https://cards.example").select("id", "private_url", "public_url", "card_url"),
    """SELECT id, 'https://cards.example/api/files/' || artwork_path || '?auth=' || url_encode('a b&' || id) AS private_url,
       'https://cards.example/api/public/artwork/' || artwork_path AS public_url, 'https://cards.example/card/' || id AS card_url FROM cards""")


def _prompt_sql() -> tuple[str, str]:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    schema = "CASE type " + " ".join(f"WHEN '{t}' THEN {quote(projections.prompt_schema(t))}" for t in projections.TEMPLATES) + f" ELSE {quote(projections.prompt_schema('custom'))} END"
    user = (f"'Crea una carta di tipo ''' || ({_label_sql(projections.PROMPT_LABELS)}) || ''' per D&D basata su questa richiesta: \"' || name || '\".' || chr(10) || 'Restituisci un JSON con questa struttura esatta (in italiano):' || chr(10) || "
            f"'{{\"name\": \"nome della carta\", \"description\": \"descrizione evocativa (max 3 frasi)\", \"story\": \"breve storia/lore (max 4 frasi)\", ' || ({schema}) || '}}' || chr(10) || "
            "'Compila tutti i campi con valori realistici e coerenti con le regole D&D 5e. Le liste devono contenere elementi pertinenti.'")
    system = "'Sei un maestro creatore di contenuti per Dungeons & Dragons 5e. Genera contenuti coerenti, bilanciati e in lingua italiano. Rispondi SEMPRE ed ESCLUSIVAMENTE con un oggetto JSON valido, senza testo aggiuntivo, senza markdown, senza ```.'"
    return system, user


add("prj_11_text_prompts", "cards", lambda c: projections.build_text_prompts(c.withColumn("prompt", F.col("name"))).select("id", "system_prompt", "user_prompt"),
    "SELECT id, {} AS system_prompt, {} AS user_prompt FROM cards".format(*_prompt_sql()))
add("prj_12_image_prompts", "cards", lambda c: projections.build_image_prompts(c.withColumns({"prompt": F.lit("  "), "name": F.when(F.col("id").cast("bigint") % 5 != 0, F.col("name")).otherwise(" ")})).select("id", "image_prompt"),
    f"""SELECT id, 'Epic dark fantasy trading card artwork, Dungeons and Dragons style, for: ' || trim(name) || '. Subject category: ' || {_case(projections.PROMPT_LABELS, 'type', "''")} ||
        '. Highly detailed digital painting, dramatic lighting, obsidian and antique gold and crimson palette, ornate, cinematic, no text, no borders, no watermark, portrait orientation.' AS image_prompt
        FROM cards WHERE id::BIGINT % 5 <> 0""")
_TEMPLATE = _case({t: projections.template_json(t) for t in projections.TEMPLATES}, "type", "'{}'")
add("prj_13_default_attributes", "cards", lambda c: projections.with_default_attributes(c.withColumn("attributes", F.when(F.col("id").cast("bigint") % 2 == 0, ""))).select("id", "attributes"),
    f"SELECT id, {_TEMPLATE} AS attributes FROM (SELECT id, type FROM cards)")

# ---------------------------------------------------------------- attributes

_KIND = """CASE WHEN json_type(v) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'scalar' WHEN json_type(v) = 'ARRAY' AND json_type(v, '$[0]') = 'VARCHAR' THEN 'string-list'
           WHEN json_type(v) = 'ARRAY' AND json_type(v, '$[0]') = 'OBJECT' THEN 'object-list' ELSE 'other' END"""
_ROWS = f"WITH k AS ({_KEYS}), e AS (SELECT id, key, pos, json_extract(attributes, '$.' || key) AS v FROM k), r AS (SELECT id, key, pos, v, {_KIND} AS kind, json_extract_string(v, '$') AS text FROM e)"
add("att_1_explode_attributes", "cards", lambda c: att.explode_attributes(c).select("id", "pos", "key", "kind", F.when(F.col("kind") == "scalar", att.text_of(F.col("value"))).alias("text")),
    f"{_ROWS} SELECT id, pos::INT AS pos, key, kind, CASE WHEN kind = 'scalar' THEN text END AS text FROM r")
_ABIL = "'for', 'des', 'cos', 'int', 'sag', 'car'"
add("att_2_ability_block", "cards", lambda c: att.ability_block(c).select("id", F.array_join(F.transform("abilities", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("abilities")),
    f"""SELECT id, array_to_string(list_filter([CASE WHEN json_extract_string(attributes, '$.' || a) <> '' THEN a || '=' || json_extract_string(attributes, '$.' || a) END FOR a IN [{_ABIL}]], lambda x: x IS NOT NULL), ',') AS abilities FROM cards""")


def _stat_sql(public: bool) -> str:
    shown = "trim(text) <> ''" if public else "text <> ''"
    o = lambda k: f"nullif(json_extract_string(o, '$.{k}'), '')"
    name, body = f"coalesce({o('nome')}, {o('name')})", f"coalesce({o('descrizione')}, {o('description')})"
    if public:
        text = f"""CASE WHEN {name} IS NOT NULL THEN {name} || '. ' ELSE 'Liv. ' || coalesce(json_extract_string(o, '$.livello'), 'undefined') || ': ' END ||
                   coalesce({body}, CASE WHEN {o('totale')} <> '0' THEN {o('totale')} || ' slot' END, '')"""
    else:
        text = f"coalesce({name}, '') || '. ' || coalesce({body}, '')"
    return f"""{_ROWS}, s AS (SELECT id, 'scalar' AS section, key, 0 AS item, text FROM r WHERE kind = 'scalar' AND {shown} AND key NOT IN ({_ABIL})),
        li AS (SELECT id, key, list_filter(from_json(v, '["VARCHAR"]'), lambda x: trim(x) <> '') AS items FROM r WHERE kind = 'string-list'),
        l AS (SELECT id, 'list' AS section, key, generate_subscripts(items, 1) - 1 AS item, unnest(items) AS text FROM li),
        oi AS (SELECT id, key, from_json(v, '["JSON"]') AS items FROM r WHERE kind = 'object-list' {"" if public else "AND key <> 'slot_incantesimi'"}),
        oo AS (SELECT id, key, generate_subscripts(items, 1) - 1 AS item, unnest(items) AS o FROM oi),
        ob AS (SELECT id, 'object' AS section, key, item, {text} AS text FROM oo), a AS (SELECT * FROM s UNION ALL SELECT * FROM l UNION ALL SELECT * FROM ob)
        SELECT id, section, key, item::INT AS item, text, {_LABEL} AS label FROM a"""


_STAT = ("id", "section", "key", "item", "text", "label")
add("att_3_stat_block", "cards", lambda c: att.stat_block(c).select(*_STAT), _stat_sql(False))
add("att_4_public_stat_block", "cards", lambda c: att.public_stat_block(c).select(*_STAT), _stat_sql(True))
_QUICK = "CASE type " + " ".join(f"WHEN '{t}' THEN [{', '.join(repr(k) for k in ks)}]" for t, ks in att.QUICK_FIELDS.items()) + " ELSE []::VARCHAR[] END"
add("att_5_quick_stats", "cards", lambda c: att.quick_stats(c).select("id", "show_abilities", F.array_join(F.transform("quick", lambda x: F.concat(x["key"], F.lit("="), x["value"])), "|").alias("quick")),
    f"""{_ROWS}, h AS (SELECT id, list(key ORDER BY pos) AS ks, list(key || '=' || text ORDER BY pos) AS kv FROM r WHERE kind = 'scalar' AND trim(text) <> '' GROUP BY id),
        q AS (SELECT c.id, coalesce(h.ks, []) AS ks, coalesce(h.kv, []) AS kv, [x FOR x IN {_QUICK} IF list_contains(coalesce(h.ks, []), x)] AS named,
              type IN ('monster', 'character') AND len([x FOR x IN coalesce(h.ks, []) IF x IN ({_ABIL})]) > 0 AS show_abilities FROM cards c LEFT JOIN h ON h.id = c.id)
        SELECT id, show_abilities, array_to_string(CASE WHEN len(named) = 0 AND NOT show_abilities THEN [kv[list_position(ks, x)] FOR x IN ks IF x NOT IN ({_ABIL})][1:4] ELSE [kv[list_position(ks, x)] FOR x IN named][1:6] END, '|') AS quick FROM q""")
_J = lambda k: f"json_extract_string(attributes, '$.{k}')"
add("att_6_sheet_header", "cards", lambda c: att.sheet_header(c).select("id", "header"),
    f"""SELECT id, concat_ws(' · ', nullif({_J('razza')}, ''), nullif({_J('classe')}, ''), 'Livello ' || CASE WHEN json_type(attributes, '$.livello') = 'VARCHAR' THEN nullif({_J('livello')}, '') ELSE nullif({_J('livello')}, '0') END) AS header FROM cards""")
_SLOT = "s AS (SELECT id, from_json(json_extract(attributes, '$.slot_incantesimi'), '[\"JSON\"]') AS items FROM cards WHERE json_type(attributes, '$.slot_incantesimi') = 'ARRAY'), x AS (SELECT id, generate_subscripts(items, 1) - 1 AS item, unnest(items) AS o FROM s)"
_SET = lambda k: f"CASE WHEN json_type(o, '$.{k}') = 'VARCHAR' THEN nullif(json_extract_string(o, '$.{k}'), '') ELSE nullif(json_extract_string(o, '$.{k}'), '0') END"
add("att_7_character_sheet", "cards", lambda c: att.character_sheet(predicates.of_type(c, "character")),
    f"""WITH b AS ({_stat_sql(False)}), {_SLOT}, y AS (SELECT id FROM cards WHERE type = 'character'),
        ab AS (SELECT c.id, 'ability' AS section, a.k AS key, (a.i - 1)::INT AS item, coalesce(nullif(json_extract_string(c.attributes, '$.' || a.k), ''), '—') AS text FROM cards c, (SELECT unnest([{_ABIL}]) AS k, unnest([1, 2, 3, 4, 5, 6]) AS i) a)
        SELECT t.* FROM (SELECT * FROM ab UNION ALL SELECT id, section, key, item, text FROM b WHERE section <> 'object'
        UNION ALL SELECT id, 'slot', 'slot_incantesimi', item::INT, 'Livello ' || coalesce({_SET('livello')}, (item + 1)::VARCHAR) || ': ' || coalesce(json_extract_string(o, '$.totale'), 'undefined') || ' slot' FROM x) t JOIN y ON y.id = t.id""")
_NUM = lambda k: f"coalesce(try_cast(json_extract_string(o, '$.{k}') AS DOUBLE), 0)"
_TABLE = f"""{_SLOT}, f AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY item) - 1 AS item, o FROM x WHERE {_SET('livello')} IS NOT NULL OR {_SET('totale')} IS NOT NULL),
        t AS (SELECT id, item, coalesce({_SET('livello')}, (item + 1)::VARCHAR) AS level, {_NUM('totale')} AS total, {_NUM('usati')} AS used FROM f)"""
add("att_8_slot_table", "cards", att.slot_table, f"WITH {_TABLE} SELECT id, item::INT AS item, level, total, used, total - used AS remaining FROM t")


def _actions(c):
    """Three clicks on the second slot of each card: 2 more, 5 fewer, 1 more; and one on a slot that isn't there."""
    log = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(item).alias("item"), F.lit(delta).alias("delta")) for i, (item, delta) in enumerate(((1, 2.0), (1, -5.0), (1, 1.0), (7, 1.0)))))
    return c.select("id", F.inline(log))


_SLOTS_NOW = ("id", "item", "level", "total", "used", "remaining")
_WRITTEN = "id, item::INT AS item, level, total, used, total - used AS remaining FROM u"
_CLICKED = "greatest(0, least(total, greatest(0, least(total, greatest(0, least(total, used + 2)) - 5)) + 1))"
add("att_9_spend_slots", "cards", lambda c: att.slot_table(att.spend_slots(c, _actions(c), ["seq"])).select(*_SLOTS_NOW),
    f"WITH {_TABLE}, u AS (SELECT id, item, level, total, CASE WHEN item = 1 THEN {_CLICKED} ELSE used END AS used FROM t) SELECT {_WRITTEN}")
add("att_10_long_rest", "cards", lambda c: att.slot_table(att.long_rest(c)).select(*_SLOTS_NOW),
    f"WITH {_TABLE}, u AS (SELECT id, item, level, total, 0.0::DOUBLE AS used FROM t) SELECT {_WRITTEN}")


def _edits(c):
    """A log of up to three edits a card, in the order of seq."""
    n = F.col("id").cast("bigint")
    one = lambda rows, seq, action, key, value: rows.select("id", F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.lit(key).alias("key"), F.lit(value).alias("value"))
    edits = one(c.filter(n % 4 == 0), 1, "set", "danno", "9d9").unionByName(one(c.filter(n % 4 == 1), 1, "remove", "danno", None)).unionByName(one(c.filter(n % 4 == 2), 1, "add", None, None))
    edits = edits.unionByName(one(c.filter(n % 4 == 2), 2, "add", None, None)).unionByName(one(c.filter(n % 8 == 1), 2, "set", "danno", "1d1")).unionByName(one(c.filter(n % 4 == 2), 3, "remove", "campo_1", None))
    return att.edit_attributes(c, edits, ["seq"]).select("id", F.array_join(F.map_keys("attributes"), ",").alias("keys"), F.try_element_at("attributes", F.lit("danno")).alias("danno"))


add("att_11_edit_attributes", "cards", _edits,
    f"""WITH k AS (SELECT id, id::BIGINT % 8 AS m, json_keys(attributes) AS ks, {_J('danno')} AS danno FROM cards), r AS (SELECT *, list_filter(ks, lambda x: x <> 'danno') AS without FROM k)
        SELECT id, array_to_string(CASE WHEN m % 4 = 0 AND NOT list_contains(ks, 'danno') THEN list_append(ks, 'danno') WHEN m = 1 THEN list_append(without, 'danno') WHEN m = 5 THEN without
            WHEN m % 4 = 2 THEN list_append(ks, 'campo_2') ELSE ks END, ',') AS keys,
        CASE WHEN m % 4 = 0 THEN '9d9' WHEN m = 1 THEN '1d1' WHEN m = 5 THEN NULL ELSE danno END AS danno FROM r""")
add("att_12_lines", "cards", lambda c: c.select("id", F.concat("name", F.lit("\n"), "type", F.lit("\n")).alias("t")).select("id", F.size(att.lines_to_list(F.col("t"))).cast("bigint").alias("n_items"), att.list_to_lines(att.lines_to_list(F.col("t"))).alias("lines")),
    "SELECT id, len(string_split(name || chr(10) || type || chr(10), chr(10)))::BIGINT AS n_items, name || chr(10) || type || chr(10) AS lines FROM cards")
_nameless = lambda c: c.withColumn("name", F.when(F.col("id").cast("bigint") % 3 == 0, " ").otherwise(F.col("name")))
add("att_13_has_content", "cards", lambda c: compose.has_content(_nameless(c)).select("id", "has_content"),
    f"""{_ROWS}, h AS (SELECT id, bool_or(CASE WHEN json_type(v) = 'ARRAY' THEN regexp_matches(v::VARCHAR, '[A-Za-z0-9]') AND kind <> 'other' ELSE trim(text) NOT IN ('', '-') END) AS filled FROM r GROUP BY id)
        SELECT c.id, c.id::BIGINT % 3 <> 0 OR coalesce(h.filled, false) AS has_content FROM cards c LEFT JOIN h ON h.id = c.id""")


def _compose_sql() -> str:
    g = lambda k: f"nullif(nullif(trim({_J(k)}), ''), '-')"
    put = lambda before, k, after="": f"('{before}' || {g(k)} || '{after}')"
    low = lambda before, k: f"('{before}' || lower({g(k)}))"
    say = lambda *parts: "(" + " || ".join(f"coalesce({p}, '')" for p in parts) + ")"
    some = lambda sep, *parts: f"nullif(concat_ws('{sep}', {', '.join(parts)}), '')"
    cast = some(", ", low("si lancia come ", "azione"), f"CASE WHEN {g('azione')} IS NULL THEN {put('tempo di lancio ', 'tempo_lancio')} END", put("gittata ", "gittata"), put("area ", "area"), put("durata ", "durata"))
    spell = some(" ", say("n", "' è una magia'", low(" di ", "scuola"), put(" di livello ", "livello"), "'.'"), f"(upper(left({cast}, 1)) || substring({cast}, 2) || '.')",
                 f"CASE WHEN regexp_matches({g('concentrazione')}, 's[ìi]', 'i') THEN 'Richiede concentrazione.' END", put("Infligge ", "danno", "."), g("effetto"))
    weapon = some(" ", say("n", "' è un''arma'", low(" ", "categoria"), put(" che infligge ", "danno"), low(" danni ", "tipo_danno"), "'.'"), put("Proprietà: ", "proprieta", "."), f"({some(', ', put('Peso ', 'peso'), put('costo ', 'costo'))} || '.')")
    stats = some(", ", put("CA ", "classe_armatura"), put("", "punti_ferita", " punti ferita"), put("velocità ", "velocita"))
    monster = some(" ", say("n", "' è una temibile creatura'", put(" di grado sfida ", "grado_sfida"), "'.'"), f"('Possiede ' || {stats} || '.')")
    bio = f"lower({some(' ', g('razza'), g('classe'))})"
    character = some(" ", say("n", f"(', ' || {bio})", put(" di livello ", "livello"), "'.'"), f"({some(', ', put('CA ', 'classe_armatura'), put('', 'punti_ferita', ' PF'))} || '.')")
    feat = "n || ' è un talento che conferisce vantaggi unici.'"
    text = f"""CASE type WHEN 'spell' THEN {spell} WHEN 'weapon' THEN {weapon} WHEN 'monster' THEN {monster} WHEN 'character' THEN {character}
        WHEN 'race' THEN 'I ' || n || ' sono un popolo dalle antiche origini.' WHEN 'class' THEN n || ' è una classe.' WHEN 'feat' THEN {feat}
        ELSE n || '. ' || coalesce(x.extra || '.', '') END"""
    return f"""WITH k AS ({_KEYS}), e AS (SELECT id, key, pos, CASE WHEN key = 'tratti' THEN 'Alfa,, Beta' ELSE nullif(nullif(trim(json_extract_string(attributes, '$.' || key)), ''), '-') END AS g FROM k),
        x AS (SELECT id, string_agg({_LABEL} || ': ' || g, ' · ' ORDER BY pos) FILTER (WHERE g IS NOT NULL) AS extra FROM e GROUP BY id),
        c AS (SELECT *, coalesce(nullif(trim(CASE WHEN id::BIGINT % 3 = 0 THEN ' ' ELSE name END), ''), 'Questa carta') AS n FROM cards),
        t AS (SELECT c.id, n, CASE WHEN c.id::BIGINT % 3 <> 0 OR x.extra IS NOT NULL THEN trim(regexp_replace({text}, '\\s+', ' ', 'g')) END AS d FROM c JOIN x ON x.id = c.id)
        SELECT id, CASE WHEN d <> n || '.' THEN d END AS description_new FROM t"""


add("att_14_compose_description", "cards", lambda c: compose.compose_description(_nameless(c)).select("id", "description_new"), _compose_sql())
add("att_15_fill_story", "cards", lambda c: compose.fill_story(c).select("id", "story"),
    "SELECT id, CASE WHEN trim(story) = '' THEN 'Le origini di ' || name || ' si perdono tra le pagine ingiallite di antichi tomi, tramandate da generazioni di avventurieri.' ELSE story END AS story FROM cards")
add("att_16_parse_generated", "replies", lambda r: att.parse_generated(r).select("id", "ok", "name", "description", "story", F.get_json_object("attributes", "$.livello").alias("livello")),
    """WITH j AS (SELECT id, regexp_extract(reply, '\\{.*\\}', 0, 's') AS j FROM replies), v AS (SELECT id, json_valid(j) AND j <> '' AS ok, CASE WHEN json_valid(j) AND j <> '' THEN j::JSON END AS j FROM j)
       SELECT id, ok, CASE WHEN ok THEN json_extract_string(j, '$.name') END AS name, CASE WHEN ok THEN json_extract_string(j, '$.description') END AS description, CASE WHEN ok THEN '' END AS story, json_extract_string(j, '$.attributes.livello') AS livello FROM v""")
_PRESENT = " + ".join(f"(coalesce({_J(k)}, '') <> '')::INT" for k in ("for", "des", "classe_armatura", "punti_ferita", "azioni"))
add("agg_3_field_coverage", "cards", lambda c: rollups.field_coverage(predicates.of_type(c, "monster"), ["for", "des", "classe_armatura", "punti_ferita", "azioni"], 3).select("id", "present", "covered"),
    f"SELECT id, ({_PRESENT})::INT AS present, ({_PRESENT}) >= 3 AS covered FROM cards WHERE type = 'monster'")


def _generated(c):
    """Two replies for some cards; the second one wins where it says something."""
    n = F.col("id").cast("bigint")
    first = c.filter(n % 3 == 0).select("id", F.lit(1).alias("seq"), F.when(n % 2 == 0, F.concat(F.lit("Nuova "), "id")).otherwise("").alias("name"), F.lit("descritta").alias("description"), F.lit("").alias("story"), F.when(n % 2 == 0, '{"a":"1"}').otherwise("{}").alias("attributes"))
    second = c.filter(n % 9 == 0).select("id", F.lit(2).alias("seq"), F.lit(" ").alias("name"), F.lit("riscritta").alias("description"), F.lit("").alias("story"), F.lit("").alias("attributes"))
    return first.unionByName(second)


add("mut_10_merge_generated", "cards", lambda c: mutations.merge_generated(c, _generated(c), ["seq"]).select("id", "name", "description", "story", F.get_json_object("attributes", "$.a").alias("a")),
    """SELECT id, CASE WHEN id::BIGINT % 9 = 0 THEN ' ' WHEN id::BIGINT % 6 = 0 THEN 'Nuova ' || id ELSE name END AS name, CASE WHEN id::BIGINT % 9 = 0 THEN 'riscritta' WHEN id::BIGINT % 3 = 0 THEN 'descritta' ELSE description END AS description, story, CASE WHEN id::BIGINT % 6 = 0 THEN '1' END AS a FROM cards""")

# ---------------------------------------------------------------- print sheets

_CHOSEN = "c AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) - 1 AS n FROM cards)"
_chosen = lambda c: c.select("user_id", "id", "created_at")  # noqa: E731  every card is printed
_PLACED = f"""{_CHOSEN}, p AS (SELECT user_id, id, (n // 9)::INT AS page, (n % 9)::INT AS slot FROM c),
    f AS (SELECT *, (slot % 3)::INT AS col, (slot // 3)::INT AS row, 'front' AS side FROM p), b AS (SELECT *, (2 - slot % 3)::INT AS col, (slot // 3)::INT AS row, 'back' AS side FROM p),
    u AS (SELECT *, page * 2 AS sheet FROM f UNION ALL SELECT *, page * 2 + 1 AS sheet FROM b),
    q AS (SELECT *, round((210 - (3 * 63.0 + 6)) / 2 + col * 66.0, 4)::DOUBLE AS x, round((297 - (3 * 88.2 + 6)) / 2 + row * 91.2, 4)::DOUBLE AS y FROM u)"""
add("win_1_impose", "cards", lambda c: layout.impose(_chosen(c)).select("user_id", "id", "page", "slot", "row", "col", "x", "y"), f"WITH {_PLACED} SELECT user_id, id, page, slot, row, col, x, y FROM q WHERE side = 'front'")
add("win_2_impose_backs", "cards", lambda c: layout.impose_backs(layout.impose(_chosen(c))).select("user_id", "id", "sheet", "side", "col", "x", "y"), f"WITH {_PLACED} SELECT user_id, id, sheet, side, col, x, y FROM q")
add("win_3_render_steps", "cards", lambda c: layout.render_steps(layout.impose_backs(layout.impose(_chosen(c)))).select("user_id", "id", "side", "step"),
    f"WITH {_PLACED} SELECT user_id, id, side, row_number() OVER (PARTITION BY user_id ORDER BY sheet, slot)::INT AS step FROM q")


def _marks_sql() -> str:
    w, h, o, l_ = 63.0, 88.2, 0.6, 3.0
    rows = []
    for corner, (dx, dy) in enumerate(((0, 0), (w, 0), (0, h), (w, h))):
        xs = (f"x + {dx} - {o + l_}", f"x + {dx} - {o}") if dx == 0 else (f"x + {dx} + {o}", f"x + {dx} + {o + l_}")
        ys = (f"y + {dy} - {o + l_}", f"y + {dy} - {o}") if dy == 0 else (f"y + {dy} + {o}", f"y + {dy} + {o + l_}")
        rows.append(f"SELECT user_id, id, {2 * corner} AS mark, {xs[0]} AS x1, y + {dy} AS y1, {xs[1]} AS x2, y + {dy} AS y2 FROM q WHERE side = 'front'")
        rows.append(f"SELECT user_id, id, {2 * corner + 1} AS mark, x + {dx} AS x1, {ys[0]} AS y1, x + {dx} AS x2, {ys[1]} AS y2 FROM q WHERE side = 'front'")
    return f"WITH {_PLACED}, m AS ({' UNION ALL '.join(rows)}) SELECT user_id, id, mark, round(x1, 4)::DOUBLE AS x1, round(y1, 4)::DOUBLE AS y1, round(x2, 4)::DOUBLE AS x2, round(y2, 4)::DOUBLE AS y2 FROM m"


add("win_4_crop_marks", "cards", lambda c: layout.crop_marks(layout.impose(_chosen(c))), _marks_sql())
add("agg_2_print_job_totals", "cards", lambda c: rollups.print_job_totals(_chosen(c)), "SELECT user_id, count(*) AS cards, ceil(count(*) / 9.0)::BIGINT AS pages, count(*) * 2 AS steps FROM cards GROUP BY user_id")

# ---------------------------------------------------------------- mutations of cards


def _patches(c):
    """Up to three patches of a card, applied in the order of seq."""
    n = F.col("id").cast("bigint")
    owner = F.when(n % 4 == 0, "stranger").otherwise(F.col("user_id"))
    one = lambda step, of, name, story: c.filter(n % step == 0).select("id", owner.alias("user_id"), F.lit(of).alias("seq"), name.alias("name"), story.alias("story"))
    none = F.lit(None).cast("string")
    return one(2, 1, F.when(n % 3 == 0, "Rinominata"), none).unionByName(one(10, 2, none, F.lit("Seconda"))).unionByName(one(18, 3, F.lit("Ultima"), none))


_MINE = "id::BIGINT % 4 = 2"
add("mut_1_patch_cards", "cards", lambda c: mutations.patch_cards(c, _patches(c), AS_OF, ["seq"]).select("id", "name", "story", "updated_at"),
    f"""SELECT id, CASE WHEN {_MINE} AND id::BIGINT % 18 = 0 THEN 'Ultima' WHEN {_MINE} AND id::BIGINT % 3 = 0 THEN 'Rinominata' ELSE name END AS name,
        CASE WHEN {_MINE} AND id::BIGINT % 10 = 0 THEN 'Seconda' ELSE story END AS story, CASE WHEN {_MINE} THEN '{AS_OF}' END AS updated_at FROM cards""")


def _touched(c, keys, change):
    """The whole table after a change of the buckets that it touches."""
    table = touched.bucketed(c, new_path(c.sparkSession, "buckets"), keys, 64)
    change(table)
    return table.read(c.sparkSession)


add("mut_1_patch_touched", "cards", lambda c: _touched(c, ["id"], lambda t: touched.patch_cards(t, _patches(c).filter("user_id = 'user_3'"), AS_OF, ["seq"])).select("id", "name", "story", "updated_at"),
    f"""SELECT id, CASE WHEN {_MINE} AND user_id = 'user_3' AND id::BIGINT % 18 = 0 THEN 'Ultima' WHEN {_MINE} AND user_id = 'user_3' AND id::BIGINT % 3 = 0 THEN 'Rinominata' ELSE name END AS name,
        CASE WHEN {_MINE} AND user_id = 'user_3' AND id::BIGINT % 10 = 0 THEN 'Seconda' ELSE story END AS story, CASE WHEN {_MINE} AND user_id = 'user_3' THEN '{AS_OF}' END AS updated_at FROM cards""")
_doomed = lambda c: c.filter(F.col("id").cast("bigint") % 5 == 0).select("id", F.when(F.col("id").cast("bigint") % 2 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"))
add("mut_2_delete_cards", "cards", lambda c: mutations.delete_cards(c, _doomed(c)).select("id", "user_id"), "SELECT id, user_id FROM cards WHERE id::BIGINT % 10 <> 0")
add("mut_2_delete_touched", "cards", lambda c: _touched(c, ["id"], lambda t: touched.delete_cards(t, _doomed(c).filter("user_id = 'user_3'"))).select("id", "user_id"),
    "SELECT id, user_id FROM cards WHERE id::BIGINT % 10 <> 0 OR user_id <> 'user_3'")
add("agg_1_mutation_counts", "cards", lambda c: rollups.mutation_counts(c, _doomed(c).unionByName(_doomed(c)), ["id", "user_id"]),
    "SELECT id, CASE WHEN id::BIGINT % 2 = 0 THEN user_id ELSE 'stranger' END AS user_id, CASE WHEN id::BIGINT % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS matched, CASE WHEN id::BIGINT % 2 = 0 THEN 200 ELSE 404 END AS status FROM cards WHERE id::BIGINT % 5 = 0")
add("mut_3_create_cards", "cards", lambda c: mutations.create_cards(c.select("id", "user_id", "type", "name"), AS_OF).select("id", "user_id", "type", "name", "description", "language", "back.emblem", "created_at"),
    f"SELECT id, user_id, type, name, '' AS description, 'it' AS language, 'flame' AS emblem, '{AS_OF}' AS created_at FROM cards")
