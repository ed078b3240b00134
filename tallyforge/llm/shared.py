"""Helpers that the corpus operators share: shared scratch space, bounded samples, Arrow map tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.folders import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a statement go when it ends, instead of when the driver's JVM next collects.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of an Arrow batch, and its value where the caller has not set it. A batch is held by the executor and
#: again by its Python worker, for each core; by itself Spark sends 64 MB or 10,000 rows, often all texts of a split at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Spark's setting for the size up to which a side of a join goes whole through the driver, and its value for written tables where the
#: caller has not set it. Spark takes the size of a table from its compressed files; its rows in the driver take many times that,
#: and a plan of several joins holds several such sides at once.
BROADCAST, BROADCAST_BYTES = "spark.sql.autoBroadcastJoinThreshold", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about BATCH_BYTES. Spark reads the setting when rows are asked for, so it stays."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors. The write's shuffle files go once
    the table stands, as nothing reads them again. What its plan broadcasts by itself is held to BROADCAST_BYTES a table."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    small_batches(spark)
    before, bound = spark.conf.get(CLEANUP, "false"), BROADCAST not in spark.conf.getAll
    spark.conf.set(CLEANUP, "true")
    if bound:
        spark.conf.set(BROADCAST, str(BROADCAST_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
        if bound:
            spark.conf.unset(BROADCAST)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(col: Column, seed: int) -> Column:
    """A number in [0, 1) that is fixed for a value and a seed."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 30)) / F.lit(float(1 << 30))


def id_bucket(col: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """fn over the partitions' rows, at most `rows` at a time, so that a task holds few texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := fn(batch.slice(at, rows))) is not None:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]], rows: int = 512) -> DataFrame:
    """The rows, with all their columns, whose text `keep` says yes to."""
    at = df.columns.index(text_col)
    return arrow_map(df, lambda b: b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_())), df.schema, rows)
