"""Seat effects, self-play and mirrored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.stats import ratio


def seat_counts(exposures: DataFrame) -> DataFrame:
    won = F.coalesce(F.col("winner_seat") == F.col("seat"), F.lit(False)).cast("int")
    return exposures.groupBy("root", "k", "batch", "strategy", "seat").agg(F.sum(won).alias("wins"), F.count("*").alias("attempted"), F.sum((~F.col("safety")).cast("int")).alias("completed"), F.sum(F.col("safety").cast("int")).alias("safety_exposures"))


def seat_effects(counts: DataFrame) -> DataFrame:
    """Per k, strategy and seat, and per k and seat (strategy NULL): rates, losses, effect against 1 / k."""
    g = counts.groupingSets([["k", "strategy", "seat"], ["k", "seat"]], "k", "strategy", "seat").agg(*[F.sum(c).alias(c) for c in ("wins", "attempted", "completed")])
    rate = ratio(F.col("wins"), F.col("attempted"))
    return g.select("*", (F.col("attempted") - F.col("wins")).alias("losses"), rate.alias("win_rate"), ratio(F.col("wins"), F.col("completed")).alias("win_rate_completed"), (rate - 1 / F.col("k")).alias("effect"))


def seat_standardized(effects: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Seats that every weighted k has: weighted effect over k for strategies (NULL: all) that have the seat in each of them."""
    total = sum(weights.values())
    w = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v / total))])[F.col("k")]
    g = effects.where(F.col("seat") <= min(weights)).withColumn("w", w).where("w is not null").groupBy("strategy", "seat").agg(F.countDistinct("k").alias("n"), F.sum(F.col("w") * F.col("effect")).alias("effect"))
    return g.where(F.col("n") == len(weights)).drop("n")


def seat_mixture(counts: DataFrame) -> DataFrame:
    """Per strategy and seat over all k: rate, exposure-weighted chance, effect."""
    g = counts.groupBy("strategy", "seat").agg(F.sum("wins").alias("wins"), F.sum("attempted").alias("attempted"), F.sum(F.col("attempted") / F.col("k")).alias("chance_sum"))
    return g.select("strategy", "seat", "wins", "attempted", ratio(F.col("wins"), F.col("attempted")).alias("win_rate"), (F.col("chance_sum") / F.col("attempted")).alias("baseline"), (ratio(F.col("wins"), F.col("attempted")) - F.col("chance_sum") / F.col("attempted")).alias("effect"))


def selfplay(games: DataFrame) -> DataFrame:
    """Games whose seats all hold one strategy: first-seat wins, rates, effect against 1 / k."""
    own = games.where(F.size(F.array_distinct("strategies")) == 1).withColumn("strategy", F.get("strategies", 0))
    g = own.groupBy("root", "k", "strategy").agg(F.sum(F.coalesce((F.col("winner_seat") == 1).cast("int"), F.lit(0))).alias("first_wins"), F.count("*").alias("attempted"), F.sum((~F.col("safety")).cast("int")).alias("completed"))
    rate = ratio(F.col("first_wins"), F.col("attempted"))
    return g.select("*", rate.alias("first_rate"), ratio(F.col("first_wins"), F.col("completed")).alias("first_rate_completed"), (rate - 1 / F.col("k")).alias("effect"))


def mirrored_pairs(games: DataFrame) -> DataFrame:
    """Two-seat games per root, batch and unordered pair of different strategies: the i-th completed game of one order is matched
    with the i-th of the other; matches, the summed difference of first-seat wins, its mean (NULL without matches), unmatched
    and safety-limit games. Only the first min(forward, reverse) games of either order count, so no rows are joined."""
    a, b = F.get("strategies", 0), F.get("strategies", 1)
    two = games.where("k = 2").withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b)).withColumn("forward", a < b).where("low != high")
    key = ["root", "batch", "low", "high"]
    done = two.where("not safety").withColumn("rn", F.row_number().over(Window.partitionBy(*key, "forward").orderBy("game")))
    by = Window.partitionBy(*key)
    done = done.withColumn("nf", F.sum(F.col("forward").cast("int")).over(by)).withColumn("nr", F.sum((~F.col("forward")).cast("int")).over(by)).withColumn("m", F.least("nf", "nr"))
    first = (F.col("winner_seat") == 1).cast("int")
    signed = F.when(F.col("forward"), first).otherwise(-first)
    g = done.groupBy(*key).agg(F.max("m").alias("matches"), F.sum(F.when(F.col("rn") <= F.col("m"), signed).otherwise(0)).alias("difference"), (F.max("nf") + F.max("nr") - 2 * F.max("m")).alias("unmatched"))
    out = two.groupBy(*key).agg(F.sum(F.col("safety").cast("int")).alias("safety_games"))
    g = out.join(g, key, "left").na.fill(0, ["matches", "difference", "unmatched"])
    return g.withColumn("mean_difference", ratio(F.col("difference"), F.col("matches")))


def mirrored_totals(pairs: DataFrame) -> DataFrame:
    """The same summed over batches."""
    g = pairs.groupBy("root", "low", "high").agg(*[F.sum(c).alias(c) for c in ("matches", "difference", "unmatched", "safety_games")])
    return g.withColumn("mean_difference", ratio(F.col("difference"), F.col("matches")))
