"""Queries over payments, polls, typing, selections and builds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.scratch import new_path
from cardloom.operators import joins, layout, mutations, rollups
from cardloom.plans.common import Book, iso, iso_sql
from cardloom.sources import readers
from cardloom.sources.adapters import AS_OF
from cardloom.streaming import latest, streams

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
add = BOOK.add



def _doubled(subscriptions):
    """Each subscription a second time, with an end a day later: the first one counts."""
    return subscriptions.unionByName(subscriptions.withColumn("current_period_end", F.col("current_period_end") + 86400))


_PERIOD = "make_timestamp((current_period_end * 1000000)::BIGINT)"
add("jn_7_activations", "payments subscriptions users",
    lambda e, s, u: joins.activations(e.filter("type = 'checkout.session.completed'").select("event_id", "user_id", "session_id", "subscription"), _doubled(s), u.unionByName(u), AS_OF).select("user_id", "session_id", "subscription", iso("premium_until").alias("premium_until")),
    f"""SELECT e.user_id, session_id, subscription, {iso_sql(f"coalesce({_PERIOD}, TIMESTAMP '{AS_OF}' + INTERVAL 31 DAY)")} AS premium_until
        FROM payments e LEFT JOIN subscriptions s ON s.sub_id = e.subscription WHERE type = 'checkout.session.completed' AND EXISTS (SELECT 1 FROM users u WHERE u.user_id = e.user_id)""")
add("jn_8_renewals", "payments subscriptions users",
    lambda e, s, u: joins.renewals(e.filter("type = 'invoice.paid'"), _doubled(s), u.unionByName(u)).select("event_id", "user_id", iso("premium_until").alias("premium_until")),
    f"""SELECT event_id, s.user_id, {iso_sql(_PERIOD)} AS premium_until FROM payments e JOIN subscriptions s ON s.sub_id = e.subscription
        WHERE type = 'invoice.paid' AND current_period_end IS NOT NULL AND EXISTS (SELECT 1 FROM users u WHERE u.user_id = s.user_id)""")
_ROUTE = "CASE type WHEN 'checkout.session.completed' THEN 'checkout' WHEN 'invoice.paid' THEN 'invoice' WHEN 'customer.subscription.deleted' THEN 'cancelled' END"
add("str_1_route_events", "payments", lambda e: streams.route_events(e).select("event_id", "route"), f"SELECT event_id, {_ROUTE} AS route FROM payments WHERE {_ROUTE} IS NOT NULL")
_TXN = ("session_id", "status", "payment_status")
add("str_2_fold_transactions", "payments transactions", lambda e, t: streams.fold_transactions(e, t).select(*_TXN),
    """WITH d AS (SELECT session_id, arg_max(coalesce(payment_status, 'paid'), ts) AS last, bool_or(coalesce(payment_status, 'paid') = 'paid') AS paid FROM payments WHERE type = 'checkout.session.completed' GROUP BY session_id)
       SELECT t.session_id, CASE WHEN d.last IS NOT NULL AND t.payment_status <> 'paid' THEN 'completed' ELSE t.status END AS status,
              CASE WHEN d.last IS NOT NULL AND t.payment_status <> 'paid' THEN CASE WHEN d.paid THEN 'paid' ELSE d.last END ELSE t.payment_status END AS payment_status
       FROM transactions t LEFT JOIN d ON d.session_id = t.session_id""")
add("str_3_fold_entitlements", "payments subscriptions users", lambda e, s, u: streams.fold_entitlements(e, s, u).select("user_id", iso("premium_until").alias("premium_until")),
    f"""WITH e AS (SELECT event_id, ts, CASE {_ROUTE} WHEN 'invoice' THEN s.user_id ELSE p.user_id END AS user_id,
            CASE {_ROUTE} WHEN 'checkout' THEN coalesce({_PERIOD}, ts + INTERVAL 31 DAY) WHEN 'invoice' THEN {_PERIOD} WHEN 'cancelled' THEN ts END AS until
            FROM payments p LEFT JOIN subscriptions s ON s.sub_id = p.subscription)
        SELECT user_id, {iso_sql('arg_max(until, ts)')} AS premium_until FROM e WHERE until IS NOT NULL AND user_id IN (SELECT user_id FROM users) GROUP BY user_id""")
#: Events as readers see them: whole seconds, then the id as text.
_SEQ = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'evt_' || event_id::VARCHAR"


def envelopes(payments):
    """The payments as provider events."""
    inner = F.struct(F.col("session_id").alias("id"), "payment_status", F.struct("user_id").alias("metadata"), "subscription")
    return payments.select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"), F.unix_seconds("ts").alias("created"), "type", F.struct(inner.alias("object")).alias("data"))


def _streamed(payments, key, events):
    """The newest events of a stream over files of provider events, one file in a micro-batch."""
    spark = payments.sparkSession
    source, table, checkpoint = (new_path(spark, name) for name in ("events", "newest", "progress"))
    envelopes(payments).repartition(3).write.json(source)
    rows = latest.newest_events(events(readers.read_payment_events(spark, source, streaming=True, files_per_trigger=1)), key, "400 days", "400 days")
    query = latest.write_newest(rows, table, checkpoint, key, compact_every=2)
    query.awaitTermination()
    return latest.read_newest(spark, table, key, T.StringType())


add("str_2_stream_transactions", "payments transactions",
    lambda e, t: streams.apply_checkouts(t, latest.checkout_table(_streamed(e, "session_id", latest.checkout_events))).select(*_TXN), f"""WITH d AS (SELECT session_id, arg_max(coalesce(payment_status, 'paid'), {_SEQ}) AS last, bool_or(coalesce(payment_status, 'paid') = 'paid') AS paid FROM payments WHERE type = 'checkout.session.completed' GROUP BY session_id)
       SELECT t.session_id, CASE WHEN d.last IS NOT NULL AND t.payment_status <> 'paid' THEN 'completed' ELSE t.status END AS status,
              CASE WHEN d.last IS NOT NULL AND t.payment_status <> 'paid' THEN CASE WHEN d.paid THEN 'paid' ELSE d.last END ELSE t.payment_status END AS payment_status
       FROM transactions t LEFT JOIN d ON d.session_id = t.session_id""")
add("str_3_stream_entitlements", "payments subscriptions users",
    lambda e, s, u: latest.entitlement_table(_streamed(e, "user_id", lambda x: latest.entitlement_events(x, s, u))).select("user_id", iso("premium_until").alias("premium_until")), f"""WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, CASE {_ROUTE} WHEN 'invoice' THEN s.user_id ELSE p.user_id END AS user_id,
            CASE {_ROUTE} WHEN 'checkout' THEN coalesce({_PERIOD}, date_trunc('second', ts) + INTERVAL 31 DAY) WHEN 'invoice' THEN {_PERIOD} WHEN 'cancelled' THEN date_trunc('second', ts) END AS until
            FROM payments p LEFT JOIN subscriptions s ON s.sub_id = p.subscription)
        SELECT user_id, {iso_sql(f'arg_max(until, {_SEQ})')} AS premium_until FROM e WHERE until IS NOT NULL AND user_id IN (SELECT user_id FROM users) GROUP BY user_id""")
_STATE = "CASE kind WHEN 'start' THEN 'compiling' WHEN 'invalidated' THEN 'compiling' WHEN 'failed' THEN 'failed' ELSE 'success' END"
add("str_4_build_state", "builds", streams.build_state, f"SELECT source, arg_max({_STATE}, ts) AS state FROM builds GROUP BY source")
_SIX_HOURS = 6 * 3600 * 1000
_BOUNCED = """WITH n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM keystrokes)
    SELECT user_id, event_id, {ts} AS ts FROM n WHERE after IS NULL OR after - ts > INTERVAL 6 HOUR""".replace("{ts}", iso_sql("ts"))
_typed = lambda d: d.select("user_id", "event_id", iso("ts").alias("ts"))
add("str_5_debounce_stream", "keystrokes", lambda k: _typed(streams.debounce_stream(k, _SIX_HOURS)), _BOUNCED)
add("win_6_debounce", "keystrokes", lambda k: _typed(layout.debounce(k, _SIX_HOURS)), _BOUNCED)
add("win_5_poll_outcome", "polls", layout.poll_outcome,
    """WITH n AS (SELECT session_id, paid, row_number() OVER (PARTITION BY session_id ORDER BY ts, poll_id) AS n FROM polls WHERE session_id IS NOT NULL),
       a AS (SELECT session_id, min(n) FILTER (WHERE paid) AS paid_at, max(n) AS n FROM n WHERE n <= 15 GROUP BY session_id)
       SELECT session_id, CASE WHEN paid_at IS NOT NULL THEN 'done' WHEN n >= 15 THEN 'timeout' ELSE 'checking' END AS outcome, coalesce(paid_at, n)::INT AS attempts FROM a
       UNION ALL SELECT NULL, 'error', 0 FROM polls WHERE session_id IS NULL GROUP BY session_id""")
add("agg_4_build_rollup", "builds", lambda b: rollups.build_rollup(b, AS_OF).withColumn("last_success", iso("last_success")),
    f"""WITH a AS (SELECT source, count(*) FILTER (WHERE kind IN ('ok', 'warnings', 'failed')) AS runs, arg_max({_STATE}, ts) AS state, max(ts) FILTER (WHERE kind IN ('ok', 'warnings')) AS last_success,
            max(ts) FILTER (WHERE kind = 'start') AS s, max(ts) FILTER (WHERE kind IN ('ok', 'warnings', 'failed')) AS e, min(ts) AS since, arg_max(kind, ts) FILTER (WHERE kind IN ('ok', 'warnings', 'failed')) AS last_run FROM builds GROUP BY source)
        SELECT source, runs, state, {iso_sql('last_success')} AS last_success, CASE WHEN e >= s THEN (epoch_us(e) - epoch_us(s)) // 1000 END AS last_duration_ms,
            CASE WHEN last_run = 'failed' THEN 1 ELSE 0 END AS errors, CASE WHEN last_run = 'warnings' THEN 1 ELSE 0 END AS warnings,
            CASE WHEN runs > 0 THEN round(((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(since)) // 1000) / runs)::BIGINT END AS uptime_ms_per_run FROM a""")
#: The twin expands every set: all cards of a user stand in it or not.
_CHOSEN = """r AS (SELECT user_id, max(ts) AS at, arg_max(action, ts) AS action FROM selections WHERE action <> 'toggle' GROUP BY user_id),
       o AS (SELECT s.user_id, card_id AS id FROM selections s LEFT JOIN r ON r.user_id = s.user_id
             WHERE s.action = 'toggle' AND (r.at IS NULL OR s.ts > r.at) GROUP BY s.user_id, card_id HAVING count(*) % 2 = 1),
       chosen AS (SELECT c.user_id, c.id, c.name, c.created_at FROM cards c LEFT JOIN r ON r.user_id = c.user_id LEFT JOIN o ON o.user_id = c.user_id AND o.id = c.id
             WHERE (coalesce(r.action, '') = 'all') <> (o.id IS NOT NULL))"""
add("set_1_apply_toggles", "selections cards", mutations.apply_toggles, f"WITH {_CHOSEN} SELECT user_id, id FROM chosen")
add("jn_6_chosen_cards", "cards selections", lambda c, s: joins.chosen_cards(c, mutations.apply_toggles(s, c)).select("user_id", "id", "name", "created_at"),
    f"WITH {_CHOSEN} SELECT user_id, id, name, created_at FROM chosen")


def _provider(t):
    """Some sessions have two states; one that is paid or complete is enough."""
    n = F.substring_index("session_id", "_", -1).cast("bigint")
    first = t.filter(n % 2 == 0).select("session_id", F.when(n % 4 == 0, "paid").otherwise("unpaid").alias("payment_status"), F.when(n % 6 == 0, "complete").otherwise("open").alias("status"))
    return first.unionByName(t.filter(n % 5 == 0).select("session_id", F.when(n % 15 == 0, "paid").alias("payment_status"), F.lit("open").alias("status")))


_S = "split_part(session_id, '_', 2)::BIGINT"
_GO = f"({_S} % 4 = 0 OR {_S} % 6 = 0 OR {_S} % 15 = 0) AND payment_status <> 'paid'"
add("mut_8_settle", "transactions", lambda t: mutations.settle(t, _provider(t), AS_OF).select(*_TXN, "updated_at"),
    f"SELECT session_id, CASE WHEN {_GO} THEN 'completed' ELSE status END AS status, CASE WHEN {_GO} THEN 'paid' ELSE payment_status END AS payment_status, CASE WHEN {_GO} THEN '{AS_OF}' END AS updated_at FROM transactions")


def _paid_sessions(t):
    """_provider() with the user, subscription and customer that a paid session carries; every fourth has no user."""
    n = F.substring_index("session_id", "_", -1).cast("bigint")
    user = F.when(n % 16 != 0, F.concat(F.lit("user_"), (n % 40).cast("string")))
    return _provider(t).withColumns({"user_id": user, "subscription": F.when(n % 3 != 0, F.concat(F.lit("sub_"), (n % 20).cast("string"))), "customer": F.concat(F.lit("cus_"), n.cast("string")), "seq": n})


_ENDS = f"strftime(coalesce({_PERIOD}, TIMESTAMP '{AS_OF}' + INTERVAL 31 DAY), '%Y-%m-%dT%H:%M:%S')"
add("mut_8_settle_and_activate", "transactions subscriptions users", lambda t, s, u: mutations.settle_and_activate(t, _paid_sessions(t), s, u, AS_OF, ["seq"])[1].select("user_id", "premium_until", "stripe_subscription_id", "stripe_customer_id"),
    f"""WITH g AS (SELECT {_S} AS n, 'user_' || ({_S} % 40)::VARCHAR AS user_id, CASE WHEN {_S} % 3 <> 0 THEN 'sub_' || ({_S} % 20)::VARCHAR END AS sub_id FROM transactions WHERE {_GO} AND {_S} % 16 <> 0),
        l AS (SELECT user_id, max(n) AS n, arg_max(coalesce(sub_id, '-'), n) AS sub_id FROM g GROUP BY user_id),
        e AS (SELECT l.user_id, l.n, nullif(l.sub_id, '-') AS sub_id, {_ENDS} AS until FROM l LEFT JOIN subscriptions s ON s.sub_id = l.sub_id)
        SELECT u.user_id, CASE WHEN e.n IS NULL THEN premium_until ELSE until END AS premium_until, e.sub_id AS stripe_subscription_id, 'cus_' || e.n::VARCHAR AS stripe_customer_id
        FROM users u LEFT JOIN e ON e.user_id = u.user_id""")
