"""The generated star-schema tables as this library's collections.

Each collection is one SELECT in the dialect that Spark and DuckDB share; the few differing functions are filled in by
a dialect object, so that queries and their DuckDB twins start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
#: 2024-01-01 and 2023-01-01 as seconds.
_JAN24, _JAN23 = 1704067200, 1672531200


class SparkDialect:
    iso = staticmethod(lambda s: f"date_format(timestamp_seconds({s}), \"yyyy-MM-dd'T'HH:mm:ss\")")
    micros = staticmethod(lambda c: f"unix_micros(cast({c} as timestamp))")
    at = staticmethod(lambda us: f"timestamp_micros({us})")
    k = "cast(get_json_object(props, '$.k') as bigint)"
    table = staticmethod(lambda name: f"@{name}@")
    null_text = "cast(null as string)"


class DuckDialect:
    iso = staticmethod(lambda s: f"strftime(make_timestamp(cast(({s}) * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%S')")
    micros = staticmethod(lambda c: f"epoch_us({c})")
    at = staticmethod(lambda us: f"make_timestamp(cast({us} as bigint))")
    k = "cast(json_extract_string(props, '$.k') as bigint)"
    table = staticmethod(lambda name: name)
    null_text = "cast(null as varchar)"


def _attributes() -> str:
    v = lambda x: f"case when p_partkey % 7 = 0 then '' when p_partkey % 11 = 0 then '-' else {x} end"
    size = "cast(p_size as string)"

    def obj(*pairs: tuple[str, str, bool]) -> str:
        parts = []
        for i, (key, value, quoted) in enumerate(pairs):
            parts.append(f"'{',' if i else ''}\"{key}\":{chr(34) if quoted else ''}'")
            parts.append(f"({value})")
            if quoted:
                parts.append("'\"'")
        return " || ".join(["'{'", *parts, "'}'"])

    abilities = [(a, f"cast((p_partkey + {i}) % 20 as string)", True) for i, a in enumerate(("for", "des", "cos", "int", "sag", "car"))]
    body = [("classe_armatura", size, False), ("punti_ferita", v(f"{size} || 'd8'"), True)]
    bites = "'[{\"nome\":\"Morso\",\"descrizione\":\"' || p_brand || '\"},{\"name\":\"Coda\",\"description\":\"\"}]'"
    slots = "'[{\"livello\":1,\"totale\":' || cast(p_size % 5 as string) || ',\"usati\":1},{\"livello\":\"\",\"totale\":0},{\"livello\":2,\"totale\":\"3\"}]'"
    return f"""case
        when p_type like 'SMALL%' then {obj(("livello", "cast(p_size % 10 as string)", True), ("scuola", v("p_brand"), True), ("gittata", v(f"{size} || ' m'"), True), ("danno", v(f"{size} || 'd6'"), True), ("concentrazione", "case when p_partkey % 2 = 0 then 'Sì' else 'No' end", True))}
        when p_type like 'MEDIUM%' then {obj(("danno", v(f"{size} || 'd4'"), True), ("tipo_danno", v("p_brand"), True), ("peso", v(f"{size} || ' kg'"), True), ("costo", v("cast(cast(round(p_retailprice) as bigint) as string) || ' mo'"), True))}
        when p_type like 'LARGE%' then {obj(*abilities, *body, ("azioni", bites, False))}
        when p_type like 'ECONOMY%' then {obj(("razza", v("'Elfo'"), True), ("classe", v("p_brand"), True), ("livello", "cast(p_size % 20 as string)", False), *abilities, *body, ("slot_incantesimi", slots, False))}
        else {obj(("zona_x", v("p_brand"), True), ("nota", v("p_name"), True), ("tratti", "'[\"Alfa\",\"\",\" Beta \"]'", False))} end"""


def _user_columns(d) -> str:
    until = d.iso(f"{_JAN24} + (c_custkey % 61) * 86400")
    return f"""select 'user_' || cast(c_custkey as string) as user_id, lower(c_name) || '@example.test' as email, c_name as name, {d.null_text} as picture,
        case when c_nationkey % 2 = 1 then 'google' else 'email' end as auth_provider, c_custkey % 100 = 0 as is_admin, c_mktsegment = 'MACHINERY' as premium_manual,
        case c_custkey % 5 when 0 then {d.null_text} when 1 then 'garbage' when 4 then {until} else {until} || '+00:00' end as premium_until,
        'x' as password_hash, {d.iso(f'{_JAN23} + c_custkey * 60')} as created_at from {d.table('customer')}"""


def _card_columns(d) -> str:
    return f"""select cast(p_partkey as string) as id, 'user_' || cast(p_partkey % 150 as string) as user_id,
        case when p_type like 'SMALL%' then 'spell' when p_type like 'MEDIUM%' then 'weapon' when p_type like 'LARGE%' then 'monster' when p_type like 'ECONOMY%' then 'character'
             when p_type like 'STANDARD%' then 'custom' when p_partkey % 3 = 0 then 'class' when p_partkey % 3 = 1 then 'race' else 'feat' end as type,
        case when p_type like 'STANDARD%' and p_size > 25 then p_brand else '' end as custom_type, p_name as name, '' as description,
        case when p_size % 2 = 0 then '' else p_name end as story, 'it' as language, {_attributes()} as attributes,
        case when p_partkey % 4 <> 0 then 'uploads/' || cast(p_partkey % 300 as string) || '.png' end as artwork_path,
        {d.iso(f'{_JAN24} + (p_partkey * 37 % 5000) * 60')} as created_at, {d.null_text} as updated_at from {d.table('part')}"""


_EVENT = "case event_type when 'signup' then 'checkout.session.completed' when 'purchase' then 'invoice.paid' when 'error' then 'customer.subscription.deleted' else event_type end"
_BUILD = "case event_type when 'signup' then 'start' when 'view' then 'ok' when 'click' then 'warnings' when 'error' then 'failed' else 'invalidated' end"
_REPLY = """case conv_id % 4 when 0 then '```json' || chr(10) || J || chr(10) || '```' when 1 then J when 2 then 'Ecco la carta: ' || J || ' Buon gioco!' else substring(J, 1, 40) end"""
_REPLY_JSON = """('{"name":"Carta ' || cast(conv_id as string) || '","description":"Turno ' || cast(turn as string) || '","attributes":{"livello":"' || cast(conv_id % 9 as string) || '"}}')"""

#: Collection name to SELECT, as functions of the dialect.
COLLECTIONS = {
    "users": _user_columns,
    "cards": _card_columns,
    "files": lambda d: f"""select 'file_' || cast(page_id as string) as id, 'uploads/' || cast(page_id as string) || '.png' as storage_path, 'user_' || cast(page_id % 150 as string) as user_id,
        case page_id % 4 when 0 then 'a.PNG' when 1 then 'b.tar.gz' when 2 then 'noext' else 'c.webp' end as original_filename,
        case when page_id % 8 < 4 then 'image/x-raw' else '' end as declared_type, page_id % 10 = 0 as is_deleted from {d.table('pages')}""",
    "transactions": lambda d: f"""select 'cs_' || cast(o_orderkey as string) as session_id, 'user_' || cast(o_custkey as string) as user_id, cast(round(o_totalprice * 100) as bigint) as amount, 'eur' as currency,
        case o_orderstatus when 'O' then 'initiated' else 'completed' end as status, case o_orderstatus when 'O' then 'pending' when 'P' then 'unpaid' else 'paid' end as payment_status,
        {d.null_text} as updated_at from {d.table('orders')}""",
    "payments": lambda d: f"""select event_id, {d.at(d.micros('ts'))} as ts, {_EVENT} as type, 'cs_' || cast(event_id % 3000 as string) as session_id, 'user_' || cast(user_id as string) as user_id,
        case {d.k} % 3 when 0 then 'paid' when 2 then 'unpaid' end as payment_status, case when {d.k} % 2 = 0 then 'sub_' || cast({d.k} as string) end as subscription from {d.table('events')}""",
    "subscriptions": lambda d: f"""select 'sub_' || cast(s_suppkey as string) as sub_id, 'user_' || cast(s_suppkey as string) as user_id,
        case when s_suppkey % 7 <> 0 then {_JAN24} + (s_suppkey % 61) * 86400 end as current_period_end from {d.table('supplier')}""",
    "sessions": lambda d: f"""select 'user_' || cast(case when event_id % 9 = 0 then user_id + 1000000 else user_id end as string) as user_id, 'tok_' || cast(event_id as string) as session_token,
        {d.iso(f"({d.micros('ts')} - {d.micros('ts')} % 1000000) / 1000000 + 604800") if d is DuckDialect else d.iso(f"({d.micros('ts')} div 1000000) + 604800")} as expires_at from {d.table('events')} where event_type = 'signup'""",
    "claims": lambda d: f"""select 'tok_' || cast(event_id as string) as token, 'user_' || cast(user_id as string) as user_id,
        case when event_id % 2 = 0 then '2024-02-05T00:00:00' else '2024-01-30T00:00:00' end as expires_at from {d.table('events')} where event_id % 3 <> 1""",
    "requests": lambda d: f"""select event_id as request_id, case when {d.k} % 10 <> 0 and {d.k} % 2 = 0 then 'tok_' || cast(event_id as string) end as cookie,
        case when {d.k} % 10 <> 0 and {d.k} % 2 = 1 then 'Bearer tok_' || cast(event_id as string) end as "authorization",
        case event_type when 'signup' then 'card' when 'purchase' then 'generate' when 'error' then 'admin' when 'view' then 'public_card' else 'file' end as route,
        cast({d.k} as string) as card_id, 'uploads/' || cast({d.k} as string) || '.png' as storage_path from {d.table('events')}""",
    "polls": lambda d: f"""select event_id as poll_id, {d.at(d.micros('ts'))} as ts, case when event_id % 50 = 0 then {d.null_text} else 'cs_' || cast(user_id as string) end as session_id, value > 60 as paid
        from {d.table('events')} where event_type = 'click'""",
    "keystrokes": lambda d: f"""select event_id, {d.at(d.micros('ts'))} as ts, 'user_' || cast(user_id as string) as user_id from {d.table('events')} where event_type = 'view'""",
    "selections": lambda d: f"""select event_id, {d.at(d.micros('ts'))} as ts, 'user_' || cast(user_id % 150 as string) as user_id,
        case event_type when 'click' then 'toggle' when 'purchase' then 'clear' else 'all' end as action, cast({d.k} * 150 + user_id % 150 as string) as card_id
        from {d.table('events')} where event_type in ('click', 'purchase', 'signup')""",
    "builds": lambda d: f"""select event_id, {d.at(d.micros('ts'))} as ts, 'src_' || cast(user_id as string) as source, {_BUILD} as kind from {d.table('events')}""",
    "replies": lambda d: f"""select cast(conv_id as string) || '_' || cast(turn as string) as id, {_REPLY.replace('J', _REPLY_JSON)} as reply from {d.table('conversations')} where role = 'assistant'""",
    "failures": lambda d: f"""select conv_id, turn, coalesce(text, '') || case when conv_id % 3 = 0 then ' Quota reached' else '' end as message from {d.table('conversations')} where role = 'user'""",
    "desired_prices": lambda d: f"""select cast(p_partkey as string) as lookup_key, cast(round(p_retailprice * 100) as bigint) as amount, 'eur' as currency from {d.table('part')}""",
    "prices": lambda d: f"""select 'price_' || cast(p_partkey as string) as id, cast(p_partkey as string) as lookup_key, cast(round(p_retailprice * 100) as bigint) + case when p_size % 5 = 0 then 1 else 0 end as amount, 'eur' as currency,
        p_partkey % 13 <> 0 as active from {d.table('part')} where p_partkey % 3 <> 0""",
}
#: Which generated table each collection reads.
SOURCES = {
    "users": "customer", "cards": "part", "files": "pages", "transactions": "orders", "payments": "events", "subscriptions": "supplier", "sessions": "events",
    "claims": "events", "requests": "events", "polls": "events", "keystrokes": "events", "selections": "events", "builds": "events", "replies": "conversations",
    "failures": "conversations", "desired_prices": "part", "prices": "part",
}


def collection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCES[name]
    text = COLLECTIONS[name](SparkDialect).replace('"authorization"', "authorization")
    text = text.replace("{", "{{").replace("}", "}}").replace(f"@{source}@", "{" + source + "}")
    return spark.sql(text, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def twin(sql: str) -> str:
    """DuckDB SQL with the collections that it names put in front."""
    used = [n for n in COLLECTIONS if re.search(rf"\b{n}\b", sql)]
    tables = ", ".join(f"{n} AS ({COLLECTIONS[n](DuckDialect)})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {tables}, {body[5:]}"
    return f"WITH {tables} {body}"
