"""Incremental ingest: scans of a folder as a stream, unchanged files passed over, a keyed merge for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.grouping import first_per_group
from folioscope.sources import listing
from folioscope.sources.files import base_name, extension
from folioscope.streaming.jobs import incremental_upsert

LISTED = "path string, length long, modified_us long, scanned_at timestamp"
_LOCATIONS = "path string, file_hash string, length long, modified_us long, first_seen_at timestamp, last_seen_at timestamp, newest boolean"
_FILES = "file_hash string, filename string, extension string, size_bytes long, first_seen_at timestamp, last_seen_at timestamp"


def announce(spark: SparkSession, directory: str, inbox: str, scanned_at: object) -> None:
    """Add the listing of a folder to the inbox: every name, also hidden ones; nothing is read yet."""
    found = listing.list_files(spark, directory).withColumn("scanned_at", F.lit(scanned_at).cast("timestamp"))
    found.write.mode("append").parquet(inbox)


def _slot(store: str, table: str, batch_id: int) -> str:
    """Versions of a table take turns in two folders, so a repeated batch still finds the one before it."""
    return f"{store}/{table}/slot={batch_id % 2}"


def _known(spark: SparkSession, store: str, table: str, batch_id: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(_slot(store, table, batch_id - 1)) if batch_id else spark.createDataFrame([], schema)


def _merge(store: str, batch: DataFrame, batch_id: int) -> None:
    spark = batch.sparkSession
    locations, files = _known(spark, store, "locations", batch_id, _LOCATIONS), _known(spark, store, "files", batch_id, _FILES)
    listed = first_per_group(batch, ["path"], [F.desc("scanned_at"), F.desc("modified_us"), F.desc("length")])
    before = locations.filter("newest").select("path", F.col("file_hash").alias("_hash"), F.col("length").alias("_length"), F.col("modified_us").alias("_modified"))
    met = listed.join(before, "path", "left").withColumn("read", ~((F.col("length") == F.col("_length")) & (F.col("modified_us") == F.col("_modified"))))
    met = met.withColumn("read", F.coalesce("read", F.lit(True)))
    hashed = listing.with_hash(met.filter("read"), "path", "file_hash").unionByName(met.filter("not read").withColumn("file_hash", F.col("_hash")))
    contents = files.select("file_hash", F.lit(True).alias("_stored"))
    status = F.when(F.col("_hash") == F.col("file_hash"), "unchanged").when(F.col("_hash").isNotNull(), "changed").when(F.col("_stored"), "moved").otherwise("new")
    log = f"{store}/log/batch_id={batch_id}"
    judged = hashed.join(contents, "file_hash", "left").select("path", "file_hash", "length", "modified_us", "scanned_at", "read", status.alias("status"))
    judged.write.mode("overwrite").parquet(log)
    seen = spark.read.parquet(log)

    fresh = seen.select("path", "file_hash", "length", "modified_us", F.col("scanned_at").alias("first_seen_at"), F.col("scanned_at").alias("last_seen_at"), F.lit(True).alias("newest"))
    now = seen.select("path", F.col("file_hash").alias("_now"))
    kept = locations.join(now, "path", "left").withColumn("newest", F.col("newest") & F.col("_now").isNull()).drop("_now")
    latest = F.struct("last_seen_at", "newest", "modified_us")
    places = kept.unionByName(fresh).groupBy("path", "file_hash").agg(
        F.max_by("length", latest).alias("length"), F.max_by("modified_us", latest).alias("modified_us"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.max("newest").alias("newest"),
    )
    places.write.mode("overwrite").parquet(_slot(store, "locations", batch_id))

    name = base_name(F.col("path"))
    shown = seen.select(
        "file_hash", name.alias("filename"), extension(name).alias("extension"), F.col("length").alias("size_bytes"),
        F.col("scanned_at").alias("first_seen_at"), F.col("scanned_at").alias("last_seen_at"),
    )
    newest = F.struct("last_seen_at", "filename")
    merged = files.unionByName(shown).groupBy("file_hash").agg(
        F.max_by("filename", newest).alias("filename"), F.max_by("extension", newest).alias("extension"), F.max("size_bytes").alias("size_bytes"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    merged.write.mode("overwrite").parquet(_slot(store, "files", batch_id))
    spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("append").parquet(f"{store}/done")


def ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> None:
    """Work off the scans that came in since the last call.

    A file whose path, length and time of change are those of the last scan is
    not read.  Others are hashed by tasks, block by block, and are ``unchanged``
    (the content is the path's last one), ``changed`` (it is another),
    ``moved`` (a new path with a known content) or ``new``.  ``files`` is merged
    by content, ``locations`` by path and content; each batch also leaves its
    rows in ``log``.  A batch that is repeated overwrites what it wrote.
    """
    scans = spark.readStream.schema(LISTED).parquet(inbox)
    incremental_upsert(scans, lambda batch, batch_id: _merge(store, batch, batch_id), checkpoint)


def _latest(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    last = spark.read.parquet(f"{store}/done").agg(F.max("batch_id")).first()[0]
    return spark.read.schema(schema).parquet(_slot(store, table, last))


def stored_files(spark: SparkSession, store: str) -> DataFrame:
    return _latest(spark, store, "files", _FILES)


def stored_locations(spark: SparkSession, store: str) -> DataFrame:
    """Every content a path has had; ``newest`` marks the last one."""
    return _latest(spark, store, "locations", _LOCATIONS)


def ingest_log(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/log").parquet(f"{store}/log")
