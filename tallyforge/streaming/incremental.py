"""Sums that are kept up to date as new files land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches whose deltas are kept apart before they are added to the snapshot.
COMPACT = 16


class SumLog:
    """Sums per key in a folder: a delta for each batch (`delta-<epoch>`, as large as the batch has keys), and a snapshot of all
    batches so far after every `every` of them (`snapshot-<epoch>`).

    A batch that is repeated writes the same delta again, and a snapshot is made from the one before and the deltas since, which
    are kept until the next one stands. So the folder holds two snapshots and 2 x every deltas at most, and a crash
    between any two steps loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], sums: list[str], every: int = COMPACT):
        self.spark, self.folder, self.keys, self.sums, self.every = spark, folder, keys, sums, every
        self.base = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.base.getFileSystem(spark._jsc.hadoopConfiguration())

    def whole(self, kind: str) -> list[int]:
        """Epochs of the deltas or snapshots that were written to their end, in order."""
        found = self.fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName().removeprefix(f"{kind}-")) for f in found or [])

    def _total(self, snapshot: int | None, deltas: list[int]) -> DataFrame:
        paths = [f"{self.folder}/delta-{e}" for e in deltas] + ([] if snapshot is None else [f"{self.folder}/snapshot-{snapshot}"])
        return self.spark.read.parquet(*paths).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("rows", *self.sums)])

    def add(self, batch: DataFrame, epoch: int) -> None:
        self.counted(batch).write.mode("overwrite").parquet(f"{self.folder}/delta-{epoch}")
        if epoch % self.every == self.every - 1:
            snapshot = max((e for e in self.whole("snapshot") if e < epoch), default=None)
            deltas = [e for e in self.whole("delta") if e <= epoch and (snapshot is None or e > snapshot)]
            self._total(snapshot, deltas).write.mode("overwrite").parquet(f"{self.folder}/snapshot-{epoch}")
            for kind, last in (("snapshot", snapshot), ("delta", snapshot)):
                for e in self.whole(kind) if last is not None else []:
                    if e < last or (kind == "delta" and e == last):
                        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}-{e}"), True)

    def counted(self, batch: DataFrame) -> DataFrame:
        return batch.groupBy(*self.keys).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in self.sums])

    def read(self) -> DataFrame | None:
        """The sums so far; None before the first batch."""
        snapshot = max(self.whole("snapshot"), default=None)
        deltas = [e for e in self.whole("delta") if snapshot is None or e > snapshot]
        return self._total(snapshot, deltas) if deltas or snapshot is not None else None


def incremental_sums(stream: DataFrame, folder: str, keys: list[str], sums: list[str], coordinates: list[str], time: str | None = None, late: str = "1 day", every: int = COMPACT) -> DataFrame:
    """Drain the stream and return the sums of `sums` and the row count per key, each coordinate counted once.

    A batch writes its own sums only; they are compacted now and then (see SumLog). A later call with the same folder goes on where
    this one stopped, and without new files gives the sums that are kept. With `time`, coordinates are remembered as long as rows
    may come `late`: then they expire from the state, and rows that come later than that are not counted. Without it all are
    remembered, which is exact and grows with the stream. No rows yet: no sums.
    """
    log = SumLog(stream.sparkSession, folder, keys, sums, every)
    if time is not None:
        # Rows behind the watermark are dropped before they are told apart, so an expired coordinate cannot count again.
        stream = stream.withWatermark(time, late)
    once = stream.dropDuplicates(coordinates) if time is None else stream.dropDuplicatesWithinWatermark(coordinates)
    query = once.writeStream.foreachBatch(log.add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = log.read()
    return log.counted(stream.sparkSession.createDataFrame([], stream.schema)) if kept is None else kept


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and key with a watermark; a streaming frame."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, folder: str, schema, names: str = "*.parquet", files: int = 16) -> DataFrame:
    """The Parquet files of a folder whose names fit, as a stream, at most `files` of them a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder)
