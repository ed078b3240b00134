"""Checks from the statistics in Parquet footers: minima, maxima and row counts without reading a column.

Spark pushes such aggregates into its second data source for Parquet only. That is switched on in a session of its own, which
shares everything else with the caller's; the caller's settings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = ("tinyint", "smallint", "int", "bigint")


def pushed(spark: SparkSession, path: str) -> DataFrame:
    """The files as a frame whose plain min, max and count (over all rows, or by a folder's column) come from footers."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    kept = [s for s in spark.conf.get("spark.sql.sources.useV1SourceList", "").split(",") if s.strip().lower() != "parquet"]
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(kept))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def column_ranges(spark: SparkSession, path: str, exempt: tuple[str, ...] = ("loss_margin",)) -> DataFrame:
    """column, minimum, maximum, rows of the whole-number columns of the files, from footers. A column without values has NULLs."""
    df = pushed(spark, path)
    whole = [n for n, t in df.dtypes if t in WHOLE and n not in exempt]
    if not whole:
        return spark.createDataFrame([], "column string, minimum long, maximum long, rows long")
    row = df.agg(F.count("*").alias("_rows"), *[f(c).alias(f"{p}{i}") for i, c in enumerate(whole) for p, f in (("low", F.min), ("high", F.max))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"low{i}").cast("long").alias("minimum"), F.col(f"high{i}").cast("long").alias("maximum"), F.col("_rows").alias("rows")) for i, c in enumerate(whole)])))


def negative_columns(spark: SparkSession, path: str, exempt: tuple[str, ...] = ("loss_margin",)) -> DataFrame:
    """column, minimum of the whole-number columns of the files that have a negative value."""
    return column_ranges(spark, path, exempt).where("minimum < 0").select("column", "minimum")


def shard_rows(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """parts (columns of the folders' names), rows: what each shard holds, from footers."""
    return pushed(spark, path).groupBy(*parts).agg(F.count("*").alias("rows"))


def reconcile_combined(spark: SparkSession, by_k: str, combined: str, part: str = "k") -> DataFrame:
    """One row: rows by k summed, rows of the combined table, and the columns that only one of them has (all sorted); from
    footers. `agrees` when counts and columns are equal; the folders' column counts as one of by_k."""
    a, b = pushed(spark, by_k), pushed(spark, combined)
    only = [sorted(set(x.columns) - set(y.columns) - {part}) for x, y in ((a, b), (b, a))]
    counts = shard_rows(spark, by_k, [part]).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_by_k")).crossJoin(F.broadcast(b.agg(F.count("*").alias("rows_combined"))))
    texts = [F.array(*map(F.lit, names)).cast("array<string>").alias(name) for names, name in zip(only, ("only_by_k", "only_combined"))]
    return counts.select("rows_by_k", "rows_combined", *texts, ((F.col("rows_by_k") == F.col("rows_combined")) & F.lit(only == [[], []])).alias("agrees"))


def reconcile_shards(spark: SparkSession, manifest: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Issues of declared shards (key, rows) against the files of a dataset with a folder for each key: missing, extra, repeated in the manifest,
    row count. The files' counts come from footers."""
    m = manifest.groupBy(*key).agg(F.count("*").alias("records"), F.sum("rows").alias("declared"))
    x = m.join(shard_rows(spark, path, key).withColumnRenamed("rows", "found"), key, "full")
    issue = F.when(F.col("found").isNull(), "missing").when(F.col("records").isNull(), "extra").when(F.col("records") > 1, "repeated").when(F.col("declared") != F.col("found"), "row_count")
    return x.select(*key, "declared", "found", issue.alias("issue")).where("issue is not null")
