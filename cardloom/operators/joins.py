"""Equi-joins between collections. Sides are left to adaptive execution: no broadcast is forced on a table that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.rows import first_of, free_name
from cardloom.functions.text import filled, instant
from cardloom.operators.predicates import live_files


def sessions_with_user(sessions: DataFrame, users: DataFrame) -> DataFrame:
    return sessions.join(users, "user_id")


def resolve_identity(requests: DataFrame, sessions: DataFrame, claims: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """requests (request_id, token, ...) get identity (a user id or null) and how: session, expired, claims or invalid.

    An expired session fails at once. A session whose user is gone, and a token without session, fall through to the
    decoded claims (token, user_id, expires_at). Of several sessions or claims of a token one counts (smallest user, then
    expiry), so a request stays one row; requests without token meet nothing.
    """
    now = F.lit(as_of).cast("timestamp")
    people = users.select(F.col("user_id").alias("person")).distinct()
    by_session = sessions.select(F.col("session_token").alias("s_token"), F.col("user_id").alias("s_user"), instant(F.col("expires_at")).alias("until"))
    by_session = first_of(by_session.filter("s_token is not null"), ["s_token"], ["s_user", "until"]).select("s_token", "s_user", (F.col("until") < now).alias("late"))
    by_session = by_session.join(people.withColumnRenamed("person", "s_known"), F.col("s_user") == F.col("s_known"), "left")
    by_claim = claims.select(F.col("token").alias("c_token"), F.col("user_id").alias("c_user"), instant(F.col("expires_at")).alias("c_until"))
    by_claim = by_claim.filter(F.col("c_until") >= now).join(people, F.col("c_user") == F.col("person"))
    by_claim = first_of(by_claim.filter("c_token is not null"), ["c_token"], ["c_user"]).select("c_token", "c_user")
    found = _looked_up(requests, by_session, F.col("token"), "s_token", "request_id")
    found = _looked_up(found, by_claim, F.col("token"), "c_token", "request_id")
    how = F.when(F.col("late"), "expired").when(F.col("s_known").isNotNull(), "session").when(F.col("c_user").isNotNull(), "claims").otherwise("invalid")
    identity = F.when(how == "session", F.col("s_known")).when(how == "claims", F.col("c_user"))
    return found.withColumns({"how": how, "identity": identity}).drop("s_user", "late", "s_known", "c_user")


def _looked_up(df: DataFrame, table: DataFrame, key: Column, table_key: str, salt: str) -> DataFrame:
    """Left join on a text key. Rows without a key can't match: each gets a key of its own that no row has (a control
    character and a hash), so that they don't all meet in one partition."""
    ask, met = free_name(df, "ask"), free_name(table, "met")
    own = F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(salt).cast("string")))
    return df.withColumn(ask, own).join(table.withColumnRenamed(table_key, met), F.col(ask) == F.col(met), "left").drop(ask, met)


def access_decision(requests: DataFrame, users: DataFrame, cards: DataFrame, files: DataFrame) -> DataFrame:
    """HTTP status of each resolved request (route, card_id, storage_path, token, identity).

    Order: 401, then the gate (402 for premium, 403 for admin), then 404. The file route only wants a token that
    isn't empty; public routes want none. Of several rows of one user or card one counts (the smallest flags or owner).
    """
    flags = first_of(users.select(F.col("user_id").alias("identity"), "is_admin", "is_premium"), ["identity"], ["is_admin", "is_premium"])
    owned = first_of(cards.select(F.col("id").alias("card_id"), F.col("user_id").alias("card_owner")), ["card_id"], ["card_owner"])
    paths = live_files(files).select("storage_path", F.lit(True).alias("file_there")).distinct()
    # only the routes that ask for a row look it up
    asks = lambda name, *routes: F.when(F.col("route").isin(*routes), F.col(name))
    met = _looked_up(requests, flags, F.col("identity"), "identity", "request_id")
    met = _looked_up(met, owned, asks("card_id", "card", "public_card"), "card_id", "request_id")
    met = _looked_up(met, paths, asks("storage_path", "file"), "storage_path", "request_id")
    route = F.col("route")
    status = (
        F.when((route == "public_card") & F.col("card_owner").isNull(), 404)
        .when(route == "public_card", 200)
        .when((route == "file") & filled(F.col("token")).isNull(), 401)
        .when((route == "file") & F.col("file_there").isNull(), 404)
        .when(route == "file", 200)
        .when(F.col("identity").isNull(), 401)
        .when((route == "generate") & ~F.coalesce("is_premium", F.lit(False)), 402)
        .when((route == "admin") & ~F.coalesce("is_admin", F.lit(False)), 403)
        .when((route == "card") & ~F.coalesce(F.col("card_owner") == F.col("identity"), F.lit(False)), 404)
        .otherwise(200)
    )
    return met.withColumn("status", status).drop("is_admin", "is_premium", "card_owner", "file_there")


def cards_with_artwork(cards: DataFrame, files: DataFrame) -> DataFrame:
    """Left join with the live file of the artwork: one file, that of the smallest id, where several share the path."""
    art = live_files(files).select(F.col("storage_path").alias("artwork_path"), F.col("id").alias("file_id"), "original_filename")
    return cards.join(first_of(art.filter("artwork_path is not null"), ["artwork_path"], ["file_id", "original_filename"]), "artwork_path", "left")


def new_registrations(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (request_id, email, ...) whose address is not registered; the first request of each address."""
    address = requests.withColumn("email", F.lower("email"))
    return first_of(address.join(users.select(F.lower("email").alias("email")), "email", "left_anti"), ["email"], ["request_id"])


def chosen_cards(cards: DataFrame, selection: DataFrame) -> DataFrame:
    """Cards whose (user_id, id) is selected; their order is that of the list, not of the selection."""
    return cards.join(selection.select("user_id", "id"), ["user_id", "id"], "left_semi")


def activations(sessions: DataFrame, subscriptions: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """user_id, session_id, premium_until, subscription and customer (null where sessions have none) of completed checkouts.

    premium_until is the subscription's period end, else 31 days on; of several rows of a subscription that with the
    smallest period end counts."""
    periods = subscriptions.select(F.col("sub_id").alias("subscription"), "current_period_end").filter("subscription is not null and current_period_end is not null")
    periods = first_of(periods, ["subscription"], ["current_period_end"])
    customer = F.col("customer") if "customer" in sessions.columns else F.lit(None).cast("string").alias("customer")
    met = sessions.filter(filled(F.col("user_id")).isNotNull()).join(periods, "subscription", "left").join(users.select("user_id"), "user_id", "left_semi")
    later = F.lit(as_of).cast("timestamp") + F.make_dt_interval(F.lit(31))
    return met.select("user_id", "session_id", F.coalesce(F.timestamp_seconds("current_period_end"), later).alias("premium_until"), "subscription", customer)


def renewals(invoices: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """event_id, user_id, premium_until of paid invoices whose subscription, user and period end are known."""
    known = subscriptions.filter("user_id is not null and current_period_end is not null").select(F.col("sub_id").alias("subscription"), "user_id", "current_period_end")
    known = first_of(known, ["subscription"], ["user_id", "current_period_end"])  # of several complete rows the first
    met = invoices.select("event_id", "subscription").join(known, "subscription").join(users.select("user_id"), "user_id", "left_semi")
    return met.select("event_id", "user_id", F.timestamp_seconds("current_period_end").alias("premium_until"))


def lookup_or_missing(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Every key comes back once, with status 200 or 404. Of several rows of a key one counts: the first by all columns that can be ordered."""
    there = free_name(keys.join(df, key), "there")
    fixed = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, (T.AtomicType, T.NullType)) and not isinstance(f.dataType, T.VariantType)]
    one = first_of(df.filter(F.col(f"`{key}`").isNotNull()), [key], fixed or [key])
    met = keys.join(one.withColumn(there, F.lit(True)), key, "left")
    return met.withColumn("status", F.when(F.col(there), 200).otherwise(404)).drop(there)
