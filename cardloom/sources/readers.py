"""Reading the collections, ingesting files and events, and appending rows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.rows import free_name, number_rows
from cardloom.functions.text import instant
from cardloom.operators.projections import conform, with_content_type, with_storage_path
from cardloom.sources import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType, kind: str) -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def read_cards(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Declared fields only, defaults filled; attributes stay JSON text, in the order they were written."""
    return conform(_read(spark, path, schemas.CARD, kind), schemas.CARD, schemas.CARD_DEFAULTS)


def read_json_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The readable lines of JSON files as the declared schema, and a quarantine of all others: line and file.

    A line is unreadable if it is no JSON object or one of its values doesn't fit its declared type."""
    bad = "_unreadable"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", wide, {"columnNameOfCorruptRecord": bad}))
    return parsed.filter(f"row.{bad} is null").select("row.*").drop(bad), parsed.filter(f"row.{bad} is not null").select(F.col("value").alias("line"), "file")


def read_users(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return conform(_read(spark, path, schemas.USER, kind), schemas.USER, schemas.USER_DEFAULTS)


def read_sessions(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """expires_at becomes a timestamp, null where it can't be read."""
    return _read(spark, path, schemas.SESSION, kind).withColumn("expires_at", instant(F.col("expires_at")))


def read_files(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return _read(spark, path, schemas.FILE, kind)


def read_transactions(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return _read(spark, path, schemas.TRANSACTION, kind)


def flatten_events(raw: DataFrame) -> DataFrame:
    """Envelope {id, created, type, data: {object: ...}} to flat columns; (ts, event_id) is the order that folds keep."""
    of = lambda name: F.col(f"data.object.{name}")
    return raw.select(
        F.col("id").alias("event_id"), F.timestamp_seconds("created").alias("ts"), "type", of("id").alias("session_id"), of("payment_status").alias("payment_status"),
        of("metadata.user_id").alias("user_id"), of("subscription").alias("subscription"), of("customer").alias("customer"),
    )


def read_payment_events(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """Events of JSON files; as a stream, at most so many new files in a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if streaming else spark.read
    return flatten_events(reader.schema(schemas.EVENT).json(path))


def read_price_catalogue(products: DataFrame) -> DataFrame:
    """Products with nested prices to one row per price."""
    return products.select("name", "tax_code", F.explode("prices").alias("p")).select("name", "tax_code", "p.lookup_key", "p.amount", "p.currency", "p.interval")


def ingest_uploads(spark: SparkSession, directory: str, owner_col: str = "user_id", manifest: DataFrame | None = None) -> DataFrame:
    """File records of a folder of images, one for each file: metadata only, contents are not read.

    A file's owner is the value of the folder `owner_col=value` that it lies in. Files elsewhere take theirs from the manifest
    (path: the file's path below the directory; owner_col), and have none where that names none, or several.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", "length")
    below = F.regexp_replace(F.substring_index("path", directory.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "^/+", "")
    found = found.withColumns({"below": below, "folder": F.url_decode(F.regexp_extract("path", rf"/{owner_col}=([^/]+)/", 1))})
    owner = F.nullif("folder", F.lit(""))
    if manifest is not None:
        named = manifest.groupBy(F.col("path").alias("below")).agg(F.min(owner_col).alias("first"), F.max(owner_col).alias("last"))
        found = found.join(named, "below", "left")
        owner = F.coalesce(owner, F.when(F.col("first") == F.col("last"), F.col("first").cast("string")))
    named = found.select(
        F.sha2("path", 256).alias("id"), owner.alias("user_id"), F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        "length", F.lit(None).cast("string").alias("declared_type"), F.lit(False).alias("is_deleted"),
    )
    return with_storage_path(with_content_type(named), "uploads")


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of batches that were written to their end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    ended = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS"))
    return [str(x.getPath().getParent().getName()) for x in ended]


def append_rows(df: DataFrame, path: str, as_of: str, id_column: str = "id", batch: str | None = None) -> None:
    """Adds ids where there are none and both times, and appends the rows as one batch of Parquet files.

    A batch that is appended again, after it ended or after it was stopped, leaves one copy: it has a folder of its own,
    which counts once it is complete. Ids are digests of the batch's name, the row and its number among equal rows, so
    they are the same in each attempt of a task or a job. A batch without name is a new one.
    """
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"no name of a batch: {batch}")
    if f"batch={batch}" in _batches(df.sparkSession, path):
        return
    made = df
    if id_column not in df.columns:
        names, n, digest = list(df.columns), free_name(df, "n"), free_name(df, "digest")
        row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"})
        keyed = df.withColumn(digest, F.sha2(F.concat_ws("\x00", F.lit(batch), row), 256))
        made = number_rows(keyed, [digest], [], n)
        made = made.select(*(F.col(f"`{c}`") for c in names), F.sha2(F.concat_ws("\x00", F.col(digest), F.col(n).cast("string")), 256).alias(id_column))
    made.withColumns({"created_at": F.lit(as_of), "updated_at": F.lit(as_of)}).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that append_rows() has completed."""
    names = _batches(spark, path)
    if not names:
        raise FileNotFoundError(f"no complete batch in {path}")
    return spark.read.parquet(*(f"{path}/{x}" for x in names))
