"""Win rates with batch-based errors, per k and across k, and comparisons built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled
from tallyforge.functions.stats import average_rank, log_odds_over_chance, normal_quantile, ratio, t_critical, wilson

RESOLUTION = PRACTICAL = 0.03


def performance_by_k(metrics: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """Per root, k and strategy: totals, rates, distance from chance, Wilson interval, batch MCSE and its t interval.

    A declared batch without exposures counts as declared only; with fewer than two batches the MCSE is NULL. Strategies
    without any exposure have no row."""
    c = F.col
    rate_of = F.when(c("exposures") > 0, c("wins") / c("exposures"))
    g = metrics.groupBy("root", "k", "strategy").agg(*[F.sum(x).cast("long").alias(x) for x in ("wins", "exposures", "completed", "safety_exposures", "losses")], F.countDistinct("batch").alias("declared_batches"), F.count(F.when(c("exposures") > 0, 1)).alias("batches"), F.stddev_samp(rate_of).alias("sd")).where("exposures > 0")
    rate, chance = ratio(c("wins"), c("exposures")), F.lit(1.0) / c("k")
    low, high = wilson(c("wins"), c("exposures"))
    mcse = F.when(c("batches") >= 2, c("sd") / F.sqrt("batches"))
    half = t_critical(c("batches") - 1) * mcse
    return g.select(
        "root", "k", "strategy", "wins", "exposures", "completed", "safety_exposures", "losses", "declared_batches", "batches", (c("declared_batches") - c("batches")).alias("excluded_cells"), rate.alias("win_rate"), ratio(c("wins"), c("completed")).alias("win_rate_completed"), (rate - chance).alias("delta"),
        low.alias("wilson_low"), high.alias("wilson_high"), ((high - low) <= resolution).alias("resolved"), mcse.alias("mcse"), F.when(half.isNotNull(), F.greatest(rate - half, F.lit(0.0))).alias("batch_low"), F.when(half.isNotNull(), F.least(rate + half, F.lit(1.0))).alias("batch_high"),
    )


def performance_across_k(by_k: DataFrame) -> DataFrame:
    """Equal-weight mean over all k of the distances from chance; score NULL for a strategy that misses a k of its root.
    The worst k is the smallest one with the least distance."""
    ks = by_k.groupBy("root").agg(F.countDistinct("k").alias("all_k"))
    g = by_k.groupBy("root", "strategy").agg(F.countDistinct("k").alias("n_k"), F.sum("delta").alias("d"), F.sum(F.col("mcse") * F.col("mcse")).alias("v"), F.count("mcse").alias("n_mcse"), F.min(F.struct("delta", "k")).alias("worst"), F.sum("wins").alias("wins"), F.sum("exposures").alias("exposures"))
    g = g.join(F.broadcast(ks), "root").withColumn("complete", F.col("n_k") == F.col("all_k"))
    score = F.when(F.col("complete"), F.col("d") / F.col("all_k"))
    mcse = F.when(F.col("complete") & (F.col("n_mcse") == F.col("all_k")), F.sqrt("v") / F.col("all_k"))
    z = normal_quantile(0.975)
    return g.select("root", "strategy", "n_k", "complete", "wins", "exposures", score.alias("score"), mcse.alias("mcse"), (score - z * mcse).alias("low"), (score + z * mcse).alias("high"), F.col("worst.delta").alias("min_delta"), F.col("worst.k").alias("worst_k"))


def weighted_across_k(by_k: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Mean of the distances by declared weights of k (they are scaled to sum 1), for strategies with every weighted k. A k of
    the rows without a positive weight, or weights that are not positive numbers, are an error: no k is left out silently."""
    if bad := sorted(k for k, v in weights.items() if not 0 < v < float("inf")):
        raise ValueError(f"weights of k = {bad} are not positive")
    if missing := sorted(r["k"] for r in by_k.select("k").distinct().where(~F.col("k").isin(list(weights))).collect()):
        raise ValueError(f"no weight for k = {missing}")
    total = sum(weights.values())
    w = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v / total))])[F.col("k")]
    g = by_k.withColumn("w", w).where("w is not null").groupBy("root", "strategy").agg(F.countDistinct("k").alias("n"), F.sum(F.col("w") * F.col("delta")).alias("score"), F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("mcse") * F.col("mcse"))).alias("mcse"))
    return g.where(F.col("n") == len(weights)).drop("n")


def log_odds_effects(by_k: DataFrame) -> DataFrame:
    """ln odds relative to chance, with the reason where there is none."""
    r = F.col("win_rate")
    return by_k.select("root", "k", "strategy", log_odds_over_chance(r, 1 / F.col("k")).alias("log_odds"), F.when(r <= 0, "rate_0").when(r >= 1, "rate_1").alias("reason"))


def log_odds_spread(effects: DataFrame) -> DataFrame:
    """Within root and k: count, sd, interquartile range, maximum less median of the effects."""
    x = "log_odds"
    return effects.groupBy("root", "k").agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr"), (F.max(x) - F.percentile(x, 0.5)).alias("top_gap"))


def k_pair_contrast(effects: DataFrame) -> DataFrame:
    """Per strategy and pair of k: difference of the effects."""
    a = effects.select("root", "strategy", F.col("k").alias("k_a"), F.col("log_odds").alias("x"))
    b = effects.select("root", "strategy", F.col("k").alias("k_b"), F.col("log_odds").alias("y"))
    return a.join(b, ["root", "strategy"]).where("k_a < k_b").select("root", "strategy", "k_a", "k_b", (F.col("y") - F.col("x")).alias("contrast"))


def score_rank(scores: DataFrame, score: str = "score", scope: tuple[str, ...] = ("root",), id_col: str = "strategy") -> DataFrame:
    """Rows with a score, with `rank` from 1 in each scope: by score, the larger first, then by id."""
    return scores.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(score), id_col)))


def maximin(across: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """Per root the complete strategy whose least distance is largest; ties go to the smallest id."""
    best = across.where("complete").withColumn("top", F.max("min_delta").over(Window.partitionBy("root")))
    return best.where(F.col("min_delta") >= F.col("top") - tolerance).groupBy("root").agg(F.min_by(F.struct("strategy", "min_delta"), F.col("strategy")).alias("x")).select("root", "x.*")


#: Parts that local skylines are made in, and how many of them are merged at once.
PARTS, FAN = 64, 8


def skyline(x: np.ndarray, block: int = 256) -> np.ndarray:
    """Indices of the rows that no other row matches everywhere and beats somewhere. Rows go by falling sum, so only rows that
    stand can take out a later one; equal sums (of rounded numbers) go by falling coordinates."""
    order = np.lexsort((*-x.T[::-1], -x.sum(1)))
    kept = np.zeros(0, np.int64)
    beaten = lambda by, rows: ((by[None] >= rows[:, None]).all(2) & (by[None] > rows[:, None]).any(2)).any(1)
    for at in range(0, len(order), block):
        some = order[at : at + block]
        for k in range(0, len(kept), block):
            some = some[~beaten(x[kept[k : k + block]], x[some])]
        kept = np.concatenate([kept, some[~beaten(x[some], x[some])]])
    return kept


def pareto_front(by_k: DataFrame) -> DataFrame:
    """root, strategy of complete strategies whose distances no other one matches in every k and beats in one.

    The vectors are one row per strategy. Parts of a root's strategies make skylines of their own; these are merged in a tree, a
    few at a time, so a task compares the rows of a part or of some skylines, and no strategies are joined.
    """
    ks = by_k.groupBy("root").agg(F.countDistinct("k").alias("all_k"))
    vectors = by_k.groupBy("root", "strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "delta"))), lambda x: x["delta"]).alias("v")).join(ks, "root").where("size(v) = all_k").select("root", "strategy", "v")
    few, parts = vectors.withColumn("part", F.pmod(F.xxhash64("strategy"), F.lit(PARTS)).cast("int")), PARTS

    def stands(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[np.sort(skyline(np.stack(rows["v"].to_numpy())))]

    while True:
        few = few.groupBy("root", "part").applyInPandas(stands, few.schema)
        if parts == 1:
            return few.select("root", "strategy")
        few, parts = few.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), -(-parts // FAN)


def screening_frame(across: DataFrame, by_k: DataFrame, delta: float = 0.03, top: int = 10, controls: tuple[int, ...] = ()) -> DataFrame:
    """Complete strategies with rank, membership of the top, of the band within delta of the leader, and of that band in
    every k; control flags."""
    ranked = score_rank(across.where("complete")).withColumn("band", F.col("score") >= F.max("score").over(Window.partitionBy("root")) - delta)
    in_k = by_k.withColumn("near", F.col("delta") >= F.max("delta").over(Window.partitionBy("root", "k")) - delta).groupBy("root", "strategy").agg(F.bool_and("near").alias("band_every_k"), F.sum(F.col("near").cast("int")).alias("band_count"))
    return ranked.join(in_k, ["root", "strategy"]).select("root", "strategy", "score", "rank", (F.col("rank") <= top).alias("top"), "band", "band_every_k", "band_count", F.col("strategy").isin(list(controls) or [-1]).alias("control"))


def inversions(x: np.ndarray, weight: np.ndarray) -> int:
    """Sum of weight[i] * weight[j] over i < j with x[i] > x[j]: sorted runs are merged in pairs, and a merge counts by binary search."""
    n, total = len(x), 0
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < n:
        # Sort runs of this width, all at once: their number leads the key.
        run = np.arange(n) // width
        key = run * (n + 1) + rank
        order = np.argsort(key, kind="stable")
        key, w = key[order], weight[order]
        upto = np.concatenate([[0], np.cumsum(w)])
        right = np.flatnonzero(run[order] % 2 == 1)
        left = key[right] - (n + 1)  # the same rank in the run before
        end = (run[order][right]) * width  # of the run before
        total += int((w[right] * (upto[end] - upto[np.searchsorted(key, left, "right")])).sum())
        width *= 2
    return total


def discordant(known: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope the number of pairs of rows (x, y) that x and y order differently.

    Rows are cut into ranges of x and counted there by merging; what is left of each range is how often it has each y. Those counts are
    cut into ranges of y: pairs of rows in different ranges of both are counted from the table of ranges by ranges, those in one
    range of y by merging, the ranges of x in order. So no two rows are joined, and a value that repeats is one row a range.
    """
    kinds = "".join(f"`{s}` {known.schema[s].dataType.simpleString()}, " for s in scope)
    part = F.spark_partition_id()
    ranges = known.select(*scope, "x", "y").repartitionByRange(*scope, "x", "y").sortWithinPartitions(*scope, "x", "y")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (held := list(batches)):
            return
        for key, mine in pd.concat(held, ignore_index=True).groupby(scope, sort=False, dropna=False):
            y = mine["y"].to_numpy()
            values, n = np.unique(y, return_counts=True)
            inside = np.zeros(len(values), np.int64)
            inside[0] = inversions(y, np.ones(len(y), np.int64))
            yield pd.DataFrame({**{s: [k] * len(values) for s, k in zip(scope, key)}, "px": mine["px"].iloc[0], "y": values, "n": n, "inside": inside})

    kind_y = known.schema["y"].dataType.simpleString()
    cells = settled(ranges.withColumn("px", part).mapInPandas(first, f"{kinds}px int, y {kind_y}, n long, inside long"))
    in_y = settled(cells.repartitionByRange(*scope, "y").withColumn("py", F.spark_partition_id()))

    def second(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["px", "y"])
        return pd.DataFrame({**{s: [rows[s].iloc[0]] for s in scope}, "d": [inversions(rows["y"].to_numpy(), rows["n"].to_numpy())]})

    near = in_y.groupBy(*scope, "py").applyInPandas(second, f"{kinds}d long")
    table = in_y.groupBy(*scope, "px", "py").agg(F.sum("n").alias("n"))
    # As many rows as ranges: for each row of the table, how many rows lie in earlier ranges of x and later ones of y.
    by = Window.partitionBy(*scope, "px").orderBy("py").rowsBetween(1, Window.unboundedFollowing)
    grid = table.select(*scope, "px").distinct().join(table.select(*scope, "py").distinct(), scope).join(table, [*scope, "px", "py"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    later = grid.withColumn("above", F.coalesce(F.sum("n").over(by), F.lit(0)))
    before = Window.partitionBy(*scope, "py").orderBy("px").rowsBetween(Window.unboundedPreceding, -1)
    far = later.withColumn("d", F.col("n") * F.coalesce(F.sum("above").over(before), F.lit(0)))
    parts = [cells.select(*scope, F.col("inside").alias("d")), near.select(*scope, "d"), far.select(*scope, "d")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy(*scope).agg(F.sum("d").alias("discordant"))


def rank_correlation(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Per scope over rows (id, x, y) with both values: n, Spearman (ties averaged), Kendall tau-b and the Pearson correlation of
    ordinal ranks (ties by id); NULL below two rows or, but for the last, without variance.

    Kendall's discordant pairs are inversions, counted without joining rows (see discordant)."""
    known = pairs.where("x is not null and y is not null")
    pearson = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    ordinal = lambda c: F.row_number().over(Window.partitionBy(*scope).orderBy(c, "id"))
    ranks = known.withColumn("rx", average_rank(F.col("x"), *scope)).withColumn("ry", average_rank(F.col("y"), *scope)).withColumn("ox", ordinal("x")).withColumn("oy", ordinal("y"))
    spearman = ranks.groupBy(*scope).agg(F.count("*").alias("n"), pearson("rx", "ry").alias("spearman"), pearson("ox", "oy").alias("ordinal"))
    tied = lambda name, *c: known.groupBy(*scope, *c).agg(F.count("*").alias("m")).groupBy(*scope).agg(F.sum((F.col("m") * (F.col("m") - 1) / 2).cast("long")).alias(name))
    tau = tied("tx", "x").join(tied("ty", "y"), scope).join(tied("txy", "x", "y"), scope).join(discordant(known, scope), scope)
    out = spearman.join(tau, scope)
    every = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    nx, ny = every - F.col("tx"), every - F.col("ty")
    kendall = F.when((nx > 0) & (ny > 0), (every - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("discordant")) / (F.sqrt(nx.cast("double")) * F.sqrt(ny.cast("double"))))
    return out.select(*scope, "n", F.col("spearman"), kendall.alias("kendall"), F.col("ordinal"))
