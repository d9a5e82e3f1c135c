"""Inserts, partial updates, deletes and reconciliations as joins: each returns the new table or the actions to take.

Requests are folded to one row for each row that they change before they are joined, so several requests for a card or
user never multiply it: they are applied in the order of the columns that `order` names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.rows import first_of, last_set
from cardloom.functions.scratch import new_path, written
from cardloom.functions.text import filled
from cardloom.operators.joins import activations
from cardloom.operators.predicates import unpaid
from cardloom.operators.projections import conform
from cardloom.sources import schemas

PATCHABLE = ("name", "description", "story", "language", "type", "custom_type", "artwork_path", "attributes", "back")


def selection_sets(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log (user_id, event_id, ts, action, card_id) of toggle, clear and all as one signed set for each user.

    Two tables: users (user_id) whose set is everything but what is listed, and the listed (user_id, id); the set of any
    other user is what is listed. Only what follows a user's last reset counts, an odd number of toggles lists a card, and
    `all` stays one row: it is never spread over cards.
    """
    seq = F.struct("ts", "event_id")
    log = log.select("user_id", "event_id", "ts", "action", "card_id")
    resets = log.filter("action <> 'toggle'").groupBy("user_id").agg(F.max(seq).alias("at"), F.max_by("action", seq).alias("reset"))
    met = log.filter("action = 'toggle'").join(resets, "user_id", "left").filter("at is null or struct(ts, event_id) > at")
    odd = met.groupBy("user_id", F.col("card_id").alias("id")).agg((F.count(F.lit(1)) % 2).alias("odd")).filter("odd = 1")
    return resets.filter("reset = 'all'").select("user_id"), odd.select("user_id", "id")


def apply_toggles(log: DataFrame, cards: DataFrame) -> DataFrame:
    """(user_id, id) of the chosen cards: each user's signed set, resolved against the user's own cards.

    Cards of users whose set is everything lose the listed ones; of all others only the listed ones stay. Listed cards that
    a user doesn't have are not chosen.
    """
    everything, listed = selection_sets(log)
    mine, keys = cards.select("user_id", "id"), ["user_id", "id"]
    rest = mine.join(everything, "user_id", "left_semi").join(listed, keys, "left_anti")
    return rest.unionByName(mine.join(everything, "user_id", "left_anti").join(listed, keys, "left_semi"))


def patch_cards(cards: DataFrame, patches: DataFrame, as_of: str, order: Sequence[str] = ()) -> DataFrame:
    """Cards after patches (id, user_id and any patchable fields): only the owner's row, only fields that are not null;
    attributes and back are replaced whole."""
    fields = [f for f in PATCHABLE if f in patches.columns and f in cards.columns]
    new = last_set(patches, ["id", "user_id"], fields, order).select("id", "user_id", F.struct(F.lit(True).alias("met"), *fields).alias("new"))
    now, mine = cards.alias("now"), new.alias("mine")
    met = now.join(mine, (F.col("now.id") == F.col("mine.id")) & (F.col("now.user_id") == F.col("mine.user_id")), "left")
    changed = {f: F.coalesce(f"mine.new.{f}", f"now.{f}") for f in fields} | {"updated_at": F.when(F.col("mine.new.met"), F.lit(as_of)).otherwise(F.col("now.updated_at"))}
    return met.select(*(changed.get(c, F.col(f"now.`{c}`")).alias(c) for c in cards.columns))


def delete_cards(cards: DataFrame, requests: DataFrame) -> DataFrame:
    return cards.join(requests.select("id", "user_id"), ["id", "user_id"], "left_anti")


def create_cards(requests: DataFrame, as_of: str) -> DataFrame:
    stamped = requests.withColumns({"created_at": F.lit(as_of), "updated_at": F.lit(as_of)})
    return conform(stamped, schemas.CARD, schemas.CARD_DEFAULTS)


def set_premium(users: DataFrame, changes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Users after changes (user_id, enabled): the last one that is not null counts."""
    now, new = users.alias("now"), last_set(changes, ["user_id"], ["enabled"], order).alias("new")
    met = now.join(new, F.col("now.user_id") == F.col("new.user_id"), "left")
    on = F.coalesce("new.enabled", "now.premium_manual")
    return met.select(*((on if c == "premium_manual" else F.col(f"now.`{c}`")).alias(c) for c in users.columns))


def upsert_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """user_id, email, name, picture, auth_provider after external profiles (email, name, picture, new_id).

    A known address gets name and picture, to null too; an unknown one becomes a user of provider google. The last of
    several profiles of one address (largest new_id) counts.
    """
    fresh = profiles.select(F.lower("email").alias("email"), F.col("name").alias("new_name"), F.col("picture").alias("new_picture"), "new_id")
    fresh = first_of(fresh.filter("email is not null"), ["email"], ["new_id", "new_name", "new_picture"], last=True)
    met = users.select("user_id", F.lower("email").alias("email"), "name", "picture", "auth_provider").join(fresh, "email", "full")
    given, known = F.col("new_id").isNotNull(), F.col("user_id").isNotNull()
    return met.select(
        F.coalesce("user_id", "new_id").alias("user_id"), "email", F.when(given, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(given, F.col("new_picture")).otherwise(F.col("picture")).alias("picture"), F.when(known, F.col("auth_provider")).otherwise("google").alias("auth_provider"),
    )


def ensure_admins(users: DataFrame, seeds: DataFrame) -> DataFrame:
    """user_id, email, is_admin, premium_manual once every seed (email, new_id) is an admin; running it again changes nothing.

    Repeated seeds of one address make one user, with the smallest new_id.
    """
    wanted = seeds.filter("email is not null").groupBy(F.lower("email").alias("email")).agg(F.min("new_id").alias("new_id"), F.lit(True).alias("seeded"))
    met = users.select("user_id", F.lower("email").alias("email"), "is_admin", "premium_manual").join(wanted, "email", "full")
    seeded = F.coalesce("seeded", F.lit(False))
    return met.select(F.coalesce("user_id", "new_id").alias("user_id"), "email", (seeded | F.coalesce("is_admin", F.lit(False))).alias("is_admin"),
                      (seeded | F.coalesce("premium_manual", F.lit(False))).alias("premium_manual"))


def revoke_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    return sessions.join(tokens.select(F.col("token").alias("session_token")), "session_token", "left_anti")


def settle(transactions: DataFrame, provider: DataFrame, as_of: str) -> DataFrame:
    """Transactions that the provider calls paid or complete, in any of its states, and that are not paid yet become
    completed and paid."""
    paid = (F.col("payment_status") == "paid") | (F.col("status") == "complete")
    states = provider.groupBy("session_id").agg(F.coalesce(F.bool_or(paid), F.lit(False)).alias("paid")).alias("state")
    now = transactions.alias("now")
    met = now.join(states, F.col("now.session_id") == F.col("state.session_id"), "left")
    go = F.coalesce("state.paid", F.lit(False)) & unpaid(F.col("now.payment_status"))
    changed = {k: F.when(go, F.lit(v)).otherwise(F.col(f"now.{k}")) for k, v in (("status", "completed"), ("payment_status", "paid"), ("updated_at", as_of))}
    return met.select(*(changed.get(c, F.col(f"now.`{c}`")).alias(c) for c in transactions.columns))


def settle_and_activate(transactions: DataFrame, provider: DataFrame, subscriptions: DataFrame, users: DataFrame, as_of: str, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Transactions after settle(), and users after the activations that follow, from one change set: what is settled is
    activated, and nothing else is.

    provider: session_id, payment_status, status, and of paid sessions user_id, subscription and customer. The change set is
    written before either table is made from it. A session without user, or of an unknown one, is settled only. Of several
    sessions of one user that settle together the last in `order` (columns of provider; then session_id) counts.
    """
    paid = (F.col("payment_status") == "paid") | (F.col("status") == "complete")
    last = first_of(provider.filter(F.coalesce(paid, F.lit(False))), ["session_id"], [*order, "user_id", "subscription", "customer"], last=True)
    open_ = transactions.filter(unpaid(F.col("payment_status"))).select("session_id")
    change = last.join(open_, "session_id", "left_semi").select("session_id", "user_id", "subscription", "customer", *order)
    change = written(change, new_path(transactions.sparkSession, "change"))
    settled = settle(transactions, change.select("session_id", F.lit("paid").alias("payment_status"), F.lit(None).cast("string").alias("status")), as_of)
    active = activations(change, subscriptions, users, as_of).join(change.select("session_id", *order), "session_id")
    active = first_of(active, ["user_id"], [*order, "session_id"], last=True)
    until = F.date_format("premium_until", "yyyy-MM-dd'T'HH:mm:ss")
    new = active.select("user_id", F.struct(until.alias("premium_until"), F.col("subscription").alias("stripe_subscription_id"), F.col("customer").alias("stripe_customer_id")).alias("given")).alias("new")
    met = users.alias("now").join(new, F.col("now.user_id") == F.col("new.user_id"), "left")
    set_ = lambda c: F.when(F.col("new.given").isNotNull(), F.col(f"new.given.{c}")).otherwise(F.col(f"now.{c}") if c in users.columns else F.lit(None).cast("string")).alias(c)
    three = ("premium_until", "stripe_subscription_id", "stripe_customer_id")
    return settled, met.select(*(F.col(f"now.`{c}`") for c in users.columns if c not in three), *map(set_, three))


def reconcile_prices(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """desired (lookup_key, amount, currency) with action: keep, create, or replace if amount or currency differ.

    Of several existing prices of a key the one of the smallest id counts.
    """
    one = first_of(existing, ["lookup_key"], ["id", "amount", "currency"]).select("lookup_key", F.struct("amount", "currency").alias("old")).alias("there")
    met = desired.alias("want").join(one, F.col("want.lookup_key") == F.col("there.lookup_key"), "left")
    same = F.col("there.old.amount").eqNullSafe(F.col("want.amount")) & F.col("there.old.currency").eqNullSafe(F.col("want.currency"))
    action = F.when(F.col("there.old").isNull(), "create").when(same, "keep").otherwise("replace")
    return met.select("want.*", action.alias("action"))


def merge_generated(cards: DataFrame, generated: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Cards with generated (id, name, description, story, attributes): what was generated wins where it is not empty."""
    fields = ("name", "description", "story", "attributes")
    given = generated.withColumns({f: filled(F.col(f)) for f in fields[:3]} | {"attributes": F.when(~F.col("attributes").isin("", "{}"), F.col("attributes"))})
    now, new = cards.alias("now"), last_set(given, ["id"], fields, order).alias("new")
    met = now.join(new, F.col("now.id") == F.col("new.id"), "left")
    return met.select(*((F.coalesce(f"new.{c}", f"now.{c}") if c in fields else F.col(f"now.`{c}`")).alias(c) for c in cards.columns))
