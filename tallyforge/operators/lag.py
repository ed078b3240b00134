"""Lag autocorrelation of keyed sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_eligibility(rows: DataFrame, keys: list[str], lags: tuple[int, ...] = (1,)) -> DataFrame:
    """Observations per group, and whether there are at least min(lags) + 2."""
    return rows.groupBy(*keys).agg(F.count("*").alias("observations")).withColumn("eligible", F.col("observations") >= min(lags) + 2)


def eligible_rows(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the groups, matched on the full key."""
    return rows.join(groups.select(*keys), keys, "left_semi")


def priority_cap(groups: DataFrame, key: str, cap: int) -> DataFrame:
    """The cap groups with the smallest md5 of their key, then key; status says whether some were left out."""
    total = groups.agg(F.count("*").alias("total"))
    chosen = groups.orderBy(F.md5(F.col(key).cast("string")), key).limit(cap)
    return chosen.crossJoin(F.broadcast(total)).withColumn("status", F.when(F.col("total") > cap, "blocked_by_cap").otherwise("complete"))


def cap_status(groups: DataFrame, cap: int) -> DataFrame:
    """One row: eligible groups, those that a cap of this size keeps, and the status: blocked_by_cap where some are left out,
    not_estimable without any eligible group, else complete."""
    n = groups.agg(F.sum(F.col("eligible").cast("long")).alias("n")).select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.select(F.col("n").alias("eligible"), F.least("n", F.lit(cap)).alias("kept"), F.when(F.col("n") > cap, "blocked_by_cap").when(F.col("n") == 0, "not_estimable").otherwise("complete").alias("status"))


SUMS = ("n", "sx", "sy", "xx", "yy", "xy")


def _pair_sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """The six sums of the pairs (x, y) that belong to each of `groups` groups, exact: groups x SUMS. `at` tells the group, in order."""
    ends = np.searchsorted(at, np.arange(groups + 1))
    return np.stack([np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (np.ones_like(x), x, y, x * x, y * y, x * y)], axis=1)


def _stitched(borders: list[dict], lags: tuple[int, ...]) -> np.ndarray:
    """lags x SUMS of the pairs of one group that reach over the borders of its ranges. A range shows its first and last rows, as
    many as the longest lag; the last rows of several short ranges together are the halo of the next."""
    out, halo = np.zeros((len(lags), len(SUMS)), np.int64), np.zeros((2, 0), np.int64)
    for part in sorted(borders, key=lambda b: b["part"]):
        head, tail = (np.array([part[end], part[f"{end}_known"]], np.int64) for end in ("head", "tail"))
        for i, lag in enumerate(lags):
            j = np.arange(max(0, lag - halo.shape[1]), min(lag, head.shape[1]))  # rows whose partner stands in the halo
            there = halo.shape[1] + j - lag
            both = (head[1, j] & halo[1, there]) > 0
            out[i] += _pair_sums(head[0, j[both]], halo[0, there[both]], np.zeros(both.sum(), np.int64), 1)[0]
        halo = np.concatenate([halo, tail], axis=1)[:, -max(lags) :]
    return out


def range_sums(rows: DataFrame, keys: list[str], order: list[str], value: Column, lags: tuple[int, ...]) -> DataFrame:
    """keys, observations, sums (an array for each lag, as SUMS) and border (part, head, tail), a row for each group that a batch
    of a range has. Ranges are cut by keys and order, so a long group lies in several; of the first and the last group of a
    range one row, without sums, has the border. NULL values count as observations, but are in no pair."""
    most, seq = max(lags), rows.select(*keys, *order, value.cast("long").alias("_x"))
    seq = seq.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "_x")
    kinds = "".join(f"`{k}` {seq.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{kinds}observations long, sums array<array<long>>, border struct<part: int, head: array<long>, head_known: array<long>, tail: array<long>, tail_known: array<long>>"
    sums_type, border_type = pa.list_(pa.list_(pa.int64())), pa.struct([("part", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("head", "head_known", "tail", "tail_known")]])
    names = [*keys, "observations", "sums", "border"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, opened, who = TaskContext.get().partitionId(), None, 0, []
        gone = np.zeros((3, 0), np.int64)  # the last rows: value, whether it is known, number of the group in the range
        head = gone  # the first rows of the group that is open

        def border(tail: np.ndarray) -> pa.RecordBatch:
            row = {"part": part, "head": head[0], "head_known": head[1], "tail": tail[0, -most:], "tail_known": tail[1, -most:]}
            return pa.RecordBatch.from_arrays([*who, pa.array([0], pa.int64()), pa.array([None], sums_type), pa.array([row], border_type)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols, now = batch.columns[: len(keys)], batch.column(len(keys))
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                codes = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            first = [c.slice(0, 1).to_pylist() for c in cols]
            change[0] = before is not None and before != first
            before = [c.slice(batch.num_rows - 1, 1).to_pylist() for c in cols]
            here = np.stack([pc.fill_null(now, 0).to_numpy(), pc.is_valid(now).to_numpy(zero_copy_only=False), np.cumsum(change) + opened]).astype(np.int64)
            every, halo, base = np.concatenate([gone, here], axis=1), gone.shape[1], int(here[2, 0])
            starts = np.flatnonzero(np.concatenate([[True], change[1:]]))
            sums = np.zeros((len(starts), len(lags), len(SUMS)), np.int64)
            for i, lag in enumerate(lags):
                j = np.arange(max(halo, lag), every.shape[1])
                j = j[(every[2, j] == every[2, j - lag]) & (every[1, j] & every[1, j - lag] > 0)]
                sums[:, i] = _pair_sums(every[0, j], every[0, j - lag], every[2, j] - base, len(starts))
            sizes = np.diff(np.concatenate([starts, [batch.num_rows]]))
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(starts)) for c in cols], pa.array(sizes), pa.array(sums.tolist(), sums_type), pa.nulls(len(starts), border_type)], names=names)
            who = who or [c.slice(0, 1) for c in cols]
            head = np.concatenate([head, here[:, here[2] == opened]], axis=1)[:, :most]
            if here[2, -1] > opened:
                if opened == 0:  # the range's first group ends here
                    yield border(every[:, every[2] == 0])
                opened, who = int(here[2, -1]), [c.slice(int(starts[-1]), 1) for c in cols]
                head = here[:, here[2] == opened][:, :most]
            gone = every[:, -most:]
        if who:
            yield border(gone[:, gone[2] == opened])

    return seq.mapInArrow(run, schema)


def lag_autocorrelation(rows: DataFrame, keys: list[str], order: list[str], value: Column, lags: tuple[int, ...] = (1,), z: float = 1.96) -> DataFrame:
    """Per group and lag: observations, pairs, Pearson correlation of the sequence with itself lag rows before, status
    (insufficient_pairs below two, zero_variance, estimated) and the band of +-z / sqrt(pairs).

    One shuffle cuts the rows into ranges of group and order, so that a long group is many tasks; each adds up its pairs,
    and the few that reach over a border are added from the rows beside it. Values are whole numbers, so the five sums are
    exact. The order must tell the rows of a group apart.
    """
    parts = range_sums(rows, keys, order, value, lags)
    sums = [[F.coalesce(F.sum(F.get(F.get("sums", i), j)), F.lit(0)).alias(f"{c}{lag}") for j, c in enumerate(SUMS)] for i, lag in enumerate(lags)]
    wide = parts.groupBy(*keys).agg(F.sum("observations").alias("observations"), F.collect_list("border").alias("borders"), *[c for of in sums for c in of])

    @F.pandas_udf("array<array<long>>")
    def over(borders: pd.Series) -> pd.Series:
        return borders.map(lambda b: _stitched(list(b), lags).tolist())

    wide = wide.withColumn("over", F.when(F.size("borders") > 1, over(F.when(F.size("borders") > 1, F.col("borders")).otherwise(F.array()))))
    more = lambda i, j: F.coalesce(F.get(F.get("over", i), j), F.lit(0))
    long = wide.select(*keys, "observations", F.inline(F.array(*[F.struct(F.lit(lag).alias("lag"), *[(F.col(f"{c}{lag}") + more(i, j)).alias(c) for j, c in enumerate(SUMS)]) for i, lag in enumerate(lags)])))
    d = lambda c: F.col(c).cast("decimal(38,0)")
    vx, vy, c = d("n") * d("xx") - d("sx") * d("sx"), d("n") * d("yy") - d("sy") * d("sy"), d("n") * d("xy") - d("sx") * d("sy")
    long = long.select(*keys, "observations", "lag", F.col("n").alias("pairs"), vx.cast("double").alias("vx"), vy.cast("double").alias("vy"), c.cast("double").alias("c"))
    status = F.when(F.col("pairs") < 2, "insufficient_pairs").when((F.col("vx") <= 0) | (F.col("vy") <= 0), "zero_variance").otherwise("estimated")
    long = long.withColumn("status", status)
    return long.select(*keys, "observations", "lag", "pairs", F.when(F.col("status") == "estimated", F.col("c") / (F.sqrt("vx") * F.sqrt("vy"))).alias("autocorr"), "status", F.when(F.col("pairs") > 0, z / F.sqrt("pairs")).alias("band"))


def estimability(stats: DataFrame, keys: tuple[str, ...] = ("lag",)) -> DataFrame:
    """Groups per lag and status."""
    return stats.groupBy(*keys, "status").count()


def observation_histogram(groups: DataFrame, edges: tuple[int, ...] = (2, 10, 100, 1000)) -> DataFrame:
    """Groups per size class; a class is the number of edges that the size reaches."""
    return groups.groupBy(sum((F.col("observations") >= e).cast("int") for e in edges).alias("size_class")).agg(F.count("*").alias("groups"), F.sum("observations").alias("observations"))
