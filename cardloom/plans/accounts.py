"""Queries over users, sessions, files, requests and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions.text import instant
from cardloom.functions.scratch import new_path
from cardloom.operators import joins, listing, mutations, postings, predicates, projections
from cardloom.operators import touched as buckets
from cardloom.plans.cards import _case, _touched
from cardloom.plans.common import Book, iso, iso_sql
from cardloom.sources.adapters import AS_OF

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
add = BOOK.add

_UNTIL = "try_cast(replace(premium_until, '+00:00', '') AS TIMESTAMP)"
_PREMIUM = f"(premium_manual OR coalesce({_UNTIL} > TIMESTAMP '{AS_OF}', false))"
add("prj_8_premium", "users", lambda u: projections.with_premium(u, AS_OF).select("user_id", "is_premium"), f"SELECT user_id, {_PREMIUM} AS is_premium FROM users")
_ENTITLED = f"CASE WHEN premium_manual THEN 'manual' WHEN {_PREMIUM} THEN 'subscribed' ELSE 'none' END"
add("prj_9_entitlement_label", "users", lambda u: projections.with_entitlement_label(projections.with_premium(u, AS_OF)).select("user_id", "entitlement"), f"SELECT user_id, {_ENTITLED} AS entitlement FROM users")
add("prj_10_expiry", "payments", lambda e: projections.with_expiry(e.filter("type = 'checkout.session.completed'"), "ts").select("event_id", iso("expires_at").alias("expires_at")),
    f"SELECT event_id, {iso_sql('ts + INTERVAL 7 DAY')} AS expires_at FROM payments WHERE type = 'checkout.session.completed'")
add("prj_5_content_type", "files", lambda f: projections.with_content_type(f).select("id", "extension", "content_type"),
    f"""WITH e AS (SELECT id, declared_type, CASE WHEN contains(original_filename, '.') THEN lower(regexp_extract(original_filename, '[^.]*$')) ELSE 'png' END AS extension FROM files)
        SELECT id, extension, {_case(projections.MIME_TYPES, 'extension', "coalesce(nullif(declared_type, ''), 'application/octet-stream')")} AS content_type FROM e""")
add("prj_6_storage_path", "files", lambda f: projections.with_storage_path(projections.with_content_type(f), "uploads").select("id", "storage_path"),
    "SELECT id, 'cards/uploads/' || user_id || '/' || id || '.' || CASE WHEN contains(original_filename, '.') THEN lower(regexp_extract(original_filename, '[^.]*$')) ELSE 'png' END AS storage_path FROM files")
_TOKEN = "coalesce(nullif(cookie, ''), CASE WHEN starts_with(\"authorization\", 'Bearer ') THEN substring(\"authorization\", 8) END)"
add("prj_14_token", "requests", lambda r: projections.with_token(r).select("request_id", "token"), f"SELECT request_id, {_TOKEN} AS token FROM requests")
add("flt_5_live_files", "files", lambda f: predicates.live_files(f).select("id", "storage_path"), "SELECT id, storage_path FROM files WHERE NOT is_deleted")
add("flt_6_search_users", "users", lambda u: predicates.search_users(u, "00012 C").select("user_id", "email"), "SELECT user_id, email FROM users WHERE contains(lower(name || ' ' || email), lower('00012 C'))")
def _indexed(users):
    table = postings.build_postings(users, "user_id", F.concat("name", F.lit(" "), "email"), new_path(users.sparkSession, "postings"))
    return postings.search_users_indexed(users, table, "00012 C").select("user_id", "email")


add("flt_6_search_users_indexed", "users", _indexed, "SELECT user_id, email FROM users WHERE contains(lower(name || ' ' || email), lower('00012 C'))")
add("flt_7_valid_sessions", "sessions", lambda s: predicates.valid_sessions(s, AS_OF).select("session_token", "user_id"), f"SELECT session_token, user_id FROM sessions WHERE try_cast(expires_at AS TIMESTAMP) >= TIMESTAMP '{AS_OF}'")
add("flt_8_not_paid", "transactions", lambda t: predicates.not_paid(t).select("session_id", "payment_status"), "SELECT session_id, payment_status FROM transactions WHERE payment_status IS DISTINCT FROM 'paid'")
add("flt_9_active_price", "prices", lambda p: predicates.active_price(p.withColumn("lookup_key", (F.col("lookup_key").cast("bigint") % 100).cast("string"))).select("lookup_key", "id"),
    "SELECT (lookup_key::BIGINT % 100)::VARCHAR AS lookup_key, min(id) AS id FROM prices WHERE active GROUP BY 1")
_WORDS = "|".join(predicates.CREDIT_WORDS)
add("flt_10_classify_failures", "failures", lambda f: predicates.classify_failures(f, "message").select("conv_id", "turn", "status"), f"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(message), '{_WORDS}') THEN 402 ELSE 502 END AS status FROM failures")
_ADMIN = ("user_id", "email", "created_at", "is_premium", "entitlement")
add("srt_3_admin_list", "users", lambda u: listing.admin_list(u, AS_OF, "customer").select(*_ADMIN),
    f"SELECT user_id, email, created_at, {_PREMIUM} AS is_premium, {_ENTITLED} AS entitlement FROM (SELECT * FROM users ORDER BY created_at DESC, user_id LIMIT 1000) WHERE contains(lower(name || ' ' || email), 'customer')")

add("jn_1_sessions_with_user", "sessions users", lambda s, u: joins.sessions_with_user(s, u).select("session_token", "user_id", "email"), "SELECT session_token, s.user_id, email FROM sessions s JOIN users u ON u.user_id = s.user_id")
_IDENTITY = f"""r AS (SELECT request_id, route, card_id, storage_path, {_TOKEN} AS token FROM requests),
    s AS (SELECT session_token, try_cast(expires_at AS TIMESTAMP) < TIMESTAMP '{AS_OF}' AS late, u.user_id AS s_user FROM sessions LEFT JOIN users u ON u.user_id = sessions.user_id),
    c AS (SELECT token, users.user_id AS c_user FROM claims JOIN users ON users.user_id = claims.user_id WHERE try_cast(expires_at AS TIMESTAMP) >= TIMESTAMP '{AS_OF}'),
    i AS (SELECT r.*, CASE WHEN late THEN 'expired' WHEN s_user IS NOT NULL THEN 'session' WHEN c_user IS NOT NULL THEN 'claims' ELSE 'invalid' END AS how, s_user, c_user
          FROM r LEFT JOIN s ON s.session_token = r.token LEFT JOIN c ON c.token = r.token),
    d AS (SELECT request_id, route, card_id, storage_path, token, how, CASE how WHEN 'session' THEN s_user WHEN 'claims' THEN c_user END AS identity FROM i)"""
def _resolve(r, s, c, u):
    """Every session, claim and user a second time (of another owner, who comes later): the first one counts."""
    again = lambda df: df.unionByName(df.withColumn("user_id", F.concat(F.lit("z"), "user_id")))
    return joins.resolve_identity(projections.with_token(r), again(s), again(c), u.unionByName(u), AS_OF)


add("jn_2_resolve_identity", "requests sessions claims users", lambda *t: _resolve(*t).select("request_id", "how", "identity"), f"WITH {_IDENTITY} SELECT request_id, how, identity FROM d")
add("jn_3_access_decision", "requests sessions claims users cards files",
    lambda r, s, c, u, k, f: joins.access_decision(_resolve(r, s, c, u), projections.with_premium(u.unionByName(u), AS_OF), k.unionByName(k), f).select("request_id", "route", "status"),
    f"""WITH {_IDENTITY}, p AS (SELECT DISTINCT storage_path FROM files WHERE NOT is_deleted)
        SELECT request_id, route, CASE route WHEN 'public_card' THEN CASE WHEN k.id IS NULL THEN 404 ELSE 200 END
            WHEN 'file' THEN CASE WHEN coalesce(token, '') = '' THEN 401 WHEN p.storage_path IS NULL THEN 404 ELSE 200 END
            ELSE CASE WHEN identity IS NULL THEN 401 WHEN route = 'generate' AND NOT {_PREMIUM} THEN 402 WHEN route = 'admin' AND NOT is_admin THEN 403
                      WHEN route = 'card' AND k.user_id IS DISTINCT FROM identity THEN 404 ELSE 200 END END AS status
        FROM d LEFT JOIN users u ON u.user_id = d.identity LEFT JOIN cards k ON k.id = d.card_id LEFT JOIN p ON p.storage_path = d.storage_path""")
_twice = lambda f: f.unionByName(f.withColumn("id", F.concat(F.lit("copy_"), "id")))  # noqa: E731  two live files share each path
add("jn_4_cards_with_artwork", "cards files", lambda c, f: joins.cards_with_artwork(c, _twice(f)).select("id", "artwork_path", "file_id", "original_filename"),
    "SELECT c.id, artwork_path, 'copy_' || f.id AS file_id, original_filename FROM cards c LEFT JOIN (SELECT * FROM files WHERE NOT is_deleted) f ON f.storage_path = c.artwork_path")


def _applicants(users):
    n = F.substring_index("user_id", "_", -1).cast("bigint")
    address = F.when(n % 2 == 0, F.upper("email")).otherwise(F.concat(F.lit("New"), (n % 50).cast("string"), F.lit("@example.test")))
    return users.select(n.alias("request_id"), address.alias("email"))


add("jn_5_new_registrations", "users", lambda u: joins.new_registrations(_applicants(u), u).select("request_id", "email"),
    "WITH n AS (SELECT split_part(user_id, '_', 2)::BIGINT AS n FROM users) SELECT min(n) AS request_id, 'new' || (n % 50)::VARCHAR || '@example.test' AS email FROM n WHERE n % 2 = 1 GROUP BY n % 50")
add("jn_9_lookup_or_missing", "requests cards", lambda r, c: joins.lookup_or_missing(r.select("request_id", F.col("card_id").alias("id")).withColumn("id", F.concat("id", F.when(F.col("request_id") % 3 == 0, "x").otherwise(""))), c.select("id", "name").unionByName(c.select("id", F.concat("name", F.lit("~")).alias("name"))), "id"),
    "SELECT r.id, request_id, name, CASE WHEN c.id IS NULL THEN 404 ELSE 200 END AS status FROM (SELECT request_id, card_id || CASE WHEN request_id % 3 = 0 THEN 'x' ELSE '' END AS id FROM requests) r LEFT JOIN cards c ON c.id = r.id")

_N = "split_part(user_id, '_', 2)::BIGINT"


def _n():
    return F.substring_index("user_id", "_", -1).cast("bigint")


def _switches(users):
    one = lambda step, seq, on: users.filter(_n() % step == 0).select("user_id", F.lit(seq).alias("seq"), on.alias("enabled"))
    return one(3, 1, _n() % 2 == 0).unionByName(one(6, 2, _n() % 4 == 0))


add("mut_4_set_premium", "users", lambda u: mutations.set_premium(u, _switches(u), ["seq"]).select("user_id", "premium_manual"),
    f"SELECT user_id, CASE WHEN {_N} % 6 = 0 THEN {_N} % 4 = 0 WHEN {_N} % 3 = 0 THEN {_N} % 2 = 0 ELSE premium_manual END AS premium_manual FROM users")
_sevens = lambda u: _switches(u).filter("user_id like '%7'")
add("mut_4_premium_touched", "users", lambda u: _touched(u, ["user_id"], lambda t: buckets.set_premium(t, _sevens(u), ["seq"])).select("user_id", "premium_manual"),
    f"SELECT user_id, CASE WHEN {_N} % 3 = 0 AND user_id LIKE '%7' THEN {_N} % 2 = 0 ELSE premium_manual END AS premium_manual FROM users")


def _profiles(users):
    known = users.filter(_n() % 4 == 0).select(F.upper("email").alias("email"), F.lit("Rinominato").alias("name"), F.when(_n() % 8 == 0, "pic").alias("picture"), F.concat(F.lit("new_"), "user_id").alias("new_id"))
    fresh = users.filter(_n() % 4 == 1).select(F.concat(F.lit("x"), "email").alias("email"), "name", F.lit("pic").alias("picture"), F.concat(F.lit("new_"), "user_id").alias("new_id"))
    return known.unionByName(fresh)


add("mut_5_upsert_profiles", "users", lambda u: mutations.upsert_profiles(u, _profiles(u)),
    f"""SELECT user_id, email, CASE WHEN {_N} % 4 = 0 THEN 'Rinominato' ELSE name END AS name, CASE WHEN {_N} % 8 = 0 THEN 'pic' END AS picture, auth_provider FROM users
        UNION ALL SELECT 'new_' || user_id, 'x' || email, name, 'pic', 'google' FROM users WHERE {_N} % 4 = 1""")
def _seeds(users):
    """Each address twice, in upper and lower case."""
    address = F.when(_n() % 50 == 0, F.col("email")).otherwise(F.concat(F.lit("x"), "email"))
    seeds = users.filter(_n() % 50 < 2).select(address.alias("email"), F.concat(F.lit("new_"), "user_id").alias("new_id"))
    return seeds.unionByName(seeds.select(F.upper("email").alias("email"), F.concat(F.lit("other_"), "new_id").alias("new_id")))


add("mut_6_ensure_admins", "users", lambda u: mutations.ensure_admins(u, _seeds(u)),
    f"""SELECT user_id, email, is_admin OR {_N} % 50 = 0 AS is_admin, premium_manual OR {_N} % 50 = 0 AS premium_manual FROM users
        UNION ALL SELECT 'new_' || user_id, 'x' || email, true, true FROM users WHERE {_N} % 50 = 1""")
add("mut_7_revoke_sessions", "sessions", lambda s: mutations.revoke_sessions(s, s.filter("session_token like '%7'").select(F.col("session_token").alias("token"))).select("session_token", "user_id"),
    "SELECT session_token, user_id FROM sessions WHERE session_token NOT LIKE '%7'")
add("mut_7_revoke_touched", "sessions", lambda s: _touched(s, ["session_token"], lambda t: buckets.revoke_sessions(t, s.filter("session_token like '%77'").select(F.col("session_token").alias("token")))).select("session_token", "user_id"),
    "SELECT session_token, user_id FROM sessions WHERE session_token NOT LIKE '%77'")
add("mut_9_reconcile_prices", "desired_prices prices", lambda d, p: mutations.reconcile_prices(d, p.filter("active")),
    """SELECT d.lookup_key, d.amount, d.currency, CASE WHEN p.id IS NULL THEN 'create' WHEN p.amount = d.amount AND p.currency = d.currency THEN 'keep' ELSE 'replace' END AS action
       FROM desired_prices d LEFT JOIN (SELECT * FROM prices WHERE active) p ON p.lookup_key = d.lookup_key""")
