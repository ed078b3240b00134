"""Exact quantiles of large groups by distributed rank selection.

A group's values are cells (value, count). The ranks that are sought lie in an interval of values; it is cut into buckets, the
buckets are counted with map-side combining, and each rank goes on in the bucket that holds it, whose smallest and largest
values are the next interval. Once the buckets hold few different values, those are added up in order. So no task ever holds more
than the buckets of a group, or the few values of a bucket, however many values a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled

#: Buckets of an interval; different values that are added up in order.
BUCKETS, FEW = 1024, 4096


def counted_values(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, v, c: how often each value that is not NULL occurs; settled."""
    cells = rows.select(*keys, value.alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    return settled(cells)


def at_ranks(cells: DataFrame, keys: list[str], ranks: Column, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """keys, n, r, v: the value of rank r (from 0) in the group's order, for each of `ranks`, an array of whole numbers as an expression
    of the group's size n. cells: keys (not NULL), v (a number), c; settled."""
    groups = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    held = [*keys, "n", "low", "high", "before"]
    now = settled(groups.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("before"), F.explode(F.array_distinct(ranks)).alias("r")))
    while True:
        sought = now.groupBy(*held).agg(F.collect_list("r").alias("ranks"))  # a few ranks each
        inside = cells.join(sought, keys).where(F.col("v").between(F.col("low"), F.col("high")))
        span = (F.col("high") - F.col("low")).cast("double")
        bucket = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("low")) / span * buckets), F.lit(buckets - 1))).otherwise(0)
        counts = inside.groupBy(*held, "ranks", bucket.alias("bucket")).agg(F.sum("c").alias("c"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("values"))
        upto = F.col("before") + F.sum("c").over(Window.partitionBy(*held).orderBy("bucket"))
        picked = counts.withColumn("upto", upto).select(*keys, "n", "v0", "v1", (F.col("upto") - F.col("c")).alias("first"), "upto", "values", F.explode("ranks").alias("r"))
        picked = picked.where("r >= first and r < upto").select(*keys, "n", F.col("v0").alias("low"), F.col("v1").alias("high"), F.col("first").alias("before"), "r", "values")
        now = settled(picked)
        most = now.agg(F.max("values")).first()[0] or 0
        if most <= 1:
            return now.select(*keys, "n", "r", F.col("low").alias("v"))
        now = now.drop("values")
        if most <= few:
            sought = now.groupBy(*held).agg(F.collect_list("r").alias("ranks"))
            inside = cells.join(sought, keys).where(F.col("v").between(F.col("low"), F.col("high")))
            upto = F.col("before") + F.sum("c").over(Window.partitionBy(*held).orderBy("v"))
            ends = inside.withColumn("upto", upto).select(*keys, "n", "v", (F.col("upto") - F.col("c")).alias("first"), "upto", F.explode("ranks").alias("r"))
            return ends.where("r >= first and r < upto").select(*keys, "n", "r", "v")


def linear_quantiles(cells: DataFrame, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """keys, n and an array p of the quantiles, interpolated linearly between the two ranks beside (n - 1) q."""
    place = [(F.col("n") - 1) * F.lit(float(q)) for q in quantiles]
    ranks = F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)])
    found = at_ranks(cells, keys, ranks).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("_of"))
    value = lambda p, f: F.element_at("_of", f(p).cast("long")).cast("double")
    between = [value(p, F.floor) + (value(p, F.ceil) - value(p, F.floor)) * (p - F.floor(p)) for p in place]
    return found.select(*keys, "n", F.array(*between).alias("p"))


def moments(cells: DataFrame, keys: list[str], shares: dict[str, Column]) -> DataFrame:
    """keys, n, mean, sd (population), and for each of shares (a condition on v) the share of the rows that it holds for. Values are
    whole numbers, so the sums are exact."""
    c, v = F.col("c"), F.col("v")
    exact = lambda x: x.cast("decimal(19,0)")
    g = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(c * v).alias("s"), F.sum(exact(v) * exact(c * v)).alias("ss"), *[F.sum(F.when(x, c).otherwise(0)).alias(f"_{name}") for name, x in shares.items()])
    n, mean = F.col("n"), F.col("s") / F.col("n")
    spread = F.col("ss") * n.cast("decimal(19,0)") - exact(F.col("s")).cast("decimal(19,0)") * exact(F.col("s"))
    sd = F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / n
    return g.select(*keys, "n", mean.alias("mean"), sd.alias("sd"), *[(F.col(f"_{name}") / n).alias(name) for name in shares])
