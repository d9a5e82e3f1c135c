"""Queries that write a collection in the form that a reader expects to the shared scratch folder, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.scratch import new_path
from cardloom.plans.common import Book, iso, iso_sql
from cardloom.plans.events import envelopes
from cardloom.sources import readers, schemas
from cardloom.sources.adapters import AS_OF

BOOK = Book()
QUERIES, ORACLES = BOOK.queries, BOOK.oracles
add = BOOK.add


def _as_json(df: DataFrame, name: str) -> str:
    """Nulls are left out of the lines, as document stores do."""
    path = new_path(df.sparkSession, name)
    df.write.json(path)
    return path


def _cards(cards: DataFrame) -> DataFrame:
    """Fields that a writer may leave out are, for some cards; an unknown one is there."""
    sparse = cards.withColumns({"language": F.when(F.col("id").cast("bigint") % 2 == 0, F.col("language")), "unknown": F.lit("x"),
                                "back": F.when(F.col("id").cast("bigint") % 5 == 0, F.struct(F.lit("plain").alias("style")))})
    found = readers.read_cards(cards.sparkSession, _as_json(sparse, "cards"))
    return found.select("id", "user_id", "type", "custom_type", "name", "story", "language", "attributes", "artwork_path", "created_at", "back.style", "back.emblem")


add("src_1_read_cards", "cards", _cards,
    """SELECT id, user_id, type, custom_type, name, story, 'it' AS language, attributes, artwork_path, created_at, CASE WHEN id::BIGINT % 5 = 0 THEN 'plain' ELSE 'classic' END AS style, 'flame' AS emblem FROM cards""")
def _quarantined(cards: DataFrame) -> DataFrame:
    """Lines of cards, some cut off and some with a wrong type: what is read, and what is kept apart."""
    path = new_path(cards.sparkSession, "lines")
    n = F.col("id").cast("bigint")
    line = F.to_json(F.struct("id", "user_id", "name"))
    cards.select(F.when(n % 7 == 0, F.substring(line, 1, 12)).when(n % 11 == 0, F.concat(F.lit('{"id":"'), "id", F.lit('","back":3}'))).otherwise(line).alias("line")).write.text(path)
    good, bad = readers.read_json_checked(cards.sparkSession, path, schemas.CARD)
    return good.select("id", F.lit("read").alias("fate")).unionByName(bad.select(F.regexp_extract("line", '"id":"([0-9]+)', 1).alias("id"), F.when(F.length("file") > 0, "kept apart").alias("fate")))


add("src_1_quarantine", "cards", _quarantined,
    """SELECT CASE WHEN id::BIGINT % 7 = 0 THEN regexp_extract(substring('{"id":"' || id || '","user_id"', 1, 12), '"id":"([0-9]+)', 1) ELSE id END AS id,
        CASE WHEN id::BIGINT % 7 = 0 OR id::BIGINT % 11 = 0 THEN 'kept apart' ELSE 'read' END AS fate FROM cards""")
add("src_2_read_users", "users", lambda u: readers.read_users(u.sparkSession, _as_json(u.withColumn("is_admin", F.when(F.col("is_admin"), True)), "users")).select("user_id", "email", "auth_provider", "is_admin", "premium_manual", "premium_until"),
    "SELECT user_id, email, auth_provider, is_admin, premium_manual, premium_until FROM users")
add("src_3_read_sessions", "sessions", lambda s: readers.read_sessions(s.sparkSession, _as_json(s.withColumn("expires_at", F.when(F.col("session_token").endswith("3"), "soon").otherwise(F.concat("expires_at", F.lit("Z")))), "sessions")).select("user_id", "session_token", iso("expires_at").alias("expires_at")),
    f"SELECT user_id, session_token, CASE WHEN session_token NOT LIKE '%3' THEN {iso_sql('expires_at::TIMESTAMP')} END AS expires_at FROM sessions")
add("src_4_read_files", "files", lambda f: readers.read_files(f.sparkSession, _as_json(f, "files")).select("id", "storage_path", "user_id", "original_filename", "is_deleted"),
    "SELECT id, storage_path, user_id, original_filename, is_deleted FROM files")
add("src_5_read_transactions", "transactions", lambda t: readers.read_transactions(t.sparkSession, _as_json(t, "transactions")).select("session_id", "user_id", "amount", "currency", "status", "payment_status", "updated_at"),
    "SELECT session_id, user_id, amount, currency, status, payment_status, updated_at FROM transactions")


def _events(payments: DataFrame) -> DataFrame:
    return readers.read_payment_events(payments.sparkSession, _as_json(envelopes(payments), "events")).withColumn("ts", iso("ts"))


add("src_6_read_payment_events", "payments", _events,
    f"""SELECT 'evt_' || event_id::VARCHAR AS event_id, {iso_sql("date_trunc('second', ts)")} AS ts, type, session_id, payment_status, user_id, subscription, NULL::VARCHAR AS customer FROM payments""")


def _catalogue(desired: DataFrame) -> DataFrame:
    price = lambda interval, times: F.struct(F.concat("lookup_key", F.lit(f"_{interval}")).alias("lookup_key"), (F.col("amount") * times).alias("amount"), "currency", F.lit(interval).alias("interval"))
    products = desired.select(F.concat(F.lit("Card "), "lookup_key").alias("name"), F.lit("txcd").alias("tax_code"), F.array(price("month", 1), price("year", 10)).alias("prices"))
    path = _as_json(products, "products")
    return readers.read_price_catalogue(desired.sparkSession.read.schema(products.schema).json(path))


_PRICE = "SELECT 'Card ' || lookup_key AS name, 'txcd' AS tax_code, lookup_key || '_{0}' AS lookup_key, amount * {1} AS amount, currency, '{0}' AS interval FROM desired_prices"
add("src_7_read_price_catalogue", "desired_prices", _catalogue, f"{_PRICE.format('month', 1)} UNION ALL {_PRICE.format('year', 10)}")


def _uploads(files: DataFrame) -> DataFrame:
    """A file for each record, in the folder of its owner: its storage path as a line. The number of tasks is named, or the
    few bytes would be coalesced to one task that opens all files one after another."""
    spark = files.sparkSession
    path = new_path(spark, "uploads")
    dealt = files.select("user_id", "storage_path").repartition(8 * spark.sparkContext.defaultParallelism, "user_id")
    dealt.write.partitionBy("user_id").option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    found = readers.ingest_uploads(spark, path, "user_id")
    named = F.col("original_filename").startswith("part-") & F.col("storage_path").startswith(F.concat(F.lit("cards/uploads/"), "user_id", F.lit("/")))
    return found.select("user_id", "content_type", "is_deleted", "length", named.alias("named"))


add("src_8_ingest_uploads", "files", _uploads,
    """SELECT user_id, 'application/octet-stream' AS content_type, false AS is_deleted, (length(storage_path) + 1)::BIGINT AS length, true AS named FROM files""")


def _appended(cards: DataFrame) -> DataFrame:
    """Two appends to one table, each of them run twice."""
    path = new_path(cards.sparkSession, "appended")
    rows = cards.select("id", "user_id", "name")
    for batch in ("one", "one", "two", "two"):
        readers.append_rows(rows if batch == "one" else rows.withColumn("id", F.concat(F.lit("again_"), "id")), path, AS_OF, batch=batch)
    return readers.read_appended(cards.sparkSession, path)


add("snk_1_append_rows", "cards", _appended,
    f"SELECT id, user_id, name, '{AS_OF}' AS created_at, '{AS_OF}' AS updated_at FROM cards UNION ALL SELECT 'again_' || id, user_id, name, '{AS_OF}', '{AS_OF}' FROM cards")
