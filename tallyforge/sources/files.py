"""Scans, manifests, logs and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators.reshape import schema_for


def read_games(spark: SparkSession, path: str, k: int, columns: list[str] | None = None) -> DataFrame:
    """Projected scan of the wide rows of k seats; path may be a glob of shards."""
    df = spark.read.schema(schema_for(k)).parquet(path)
    return df.select(*columns) if columns else df


def write_by_k(df: DataFrame, path: str) -> None:
    """One dataset, a folder for each k. The rows are written where they lie and not shuffled: a task writes a file for each k it has."""
    df.write.mode("overwrite").partitionBy("k").parquet(path)


def read_all_k(spark: SparkSession, path: str, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """All k of the dataset; in the order of k, root and game only when asked for."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.orderBy("k", "root", "game") if ordered else df


def curate(df: DataFrame, path: str) -> DataFrame:
    """Publish the rows by k and return the row counts that were written."""
    write_by_k(df, path)
    return df.sparkSession.read.parquet(path).groupBy("k").agg(F.count("*").alias("rows"))


def materialize(df: DataFrame, path: str, files: int | None = 1) -> None:
    """The rows as one table of so many files at most, each written by one task; None: by as many tasks as read the rows."""
    (df if files is None else df.coalesce(files)).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_counter_csv(df: DataFrame, path: str, key: str = "strategy", count: str = "wins") -> None:
    """A counter as CSV with the header key,count: repeated keys are added up, the largest count first, ties by key."""
    g = df.groupBy(key).agg(F.sum(count).cast("long").alias(count))
    g.orderBy(F.desc(count), key).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("root", "k", "shard", "rows")])


def manifest_scan(spark: SparkSession, path: str) -> DataFrame:
    """Shard records of newline-delimited JSON; fields that are no whole numbers become NULL."""
    raw = spark.read.schema(MANIFEST).json(path)
    return raw.select(*[F.col(c).try_cast("bigint").alias(c) for c in MANIFEST.fieldNames()])


def manifest_reconcile(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Issues of declared shards against data (both with root, k, shard): missing, extra, repeated in the manifest, row count."""
    key = ["root", "k", "shard"]
    m = manifest.groupBy(*key).agg(F.count("*").alias("records"), F.sum("rows").alias("declared"))
    d = rows.groupBy(*key).agg(F.count("*").alias("found"))
    x = m.join(d, key, "full")
    issue = F.when(F.col("found").isNull(), "missing").when(F.col("records").isNull(), "extra").when(F.col("records") > 1, "repeated").when(F.col("declared") != F.col("found"), "row_count")
    return x.select(*key, "declared", "found", issue.alias("issue")).where("issue is not null")


def event_log_health(spark: SparkSession, path: str) -> DataFrame:
    """Per log file of newline-delimited JSON (event, status, level): events, run ends, failed steps, errors."""
    log = spark.read.schema("event string, status string, level string").json(path).withColumn("log", F.input_file_name())
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    g = log.groupBy("log").agg(F.count("*").alias("events"), n(F.col("event") == "run_end").alias("run_ends"), n((F.col("event") == "step") & (F.col("status") == "failed")).alias("failed_steps"), n(F.col("level") == "error").alias("errors"))
    return g.withColumn("healthy", (F.col("run_ends") > 0) & (F.col("failed_steps") == 0) & (F.col("errors") == 0))
