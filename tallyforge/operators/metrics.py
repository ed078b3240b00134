"""Sufficient statistics of exposures (one row per game and seat) and what follows from them.

Exposures have root, k, batch, game, seat, strategy, score, n_turns, n_rounds, safety (boolean), winner_seat and rank (NULL in
safety-limit games) and loss_margin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.stats import ratio

CELL = ["root", "k", "batch", "strategy"]
BEHAVIOURS = ("rank", "loss_margin")


def _n(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def batch_metrics(exposures: DataFrame, keys: list[str] = CELL, behaviours: tuple[str, ...] = BEHAVIOURS) -> DataFrame:
    """Counts, sums and sums of squares per cell; additive, so cells can be summed over any key."""
    won = F.col("winner_seat") == F.col("seat")
    gap = F.col("n_turns") - F.col("n_rounds")
    per_turn = F.coalesce(ratio(F.col("score"), F.col("n_turns")), F.lit(0.0))
    per_round = F.coalesce(ratio(F.col("score"), F.col("n_rounds")), F.lit(0.0))
    sums = [a for name, x in (("score", F.col("score")), ("turns", F.col("n_turns")), ("gap", gap)) for a in (F.sum(x.cast("long")).alias(f"{name}_sum"), F.sum((x * x).cast("long")).alias(f"{name}_square_sum"))]
    rates = [a for name, x in (("per_turn", per_turn), ("per_round", per_round)) for a in (F.sum(x).alias(f"{name}_sum"), F.sum(x * x).alias(f"{name}_square_sum"))]
    extra = [a for b in behaviours for a in (F.count(b).alias(f"{b}_observations"), F.sum(F.col(b).cast("long")).alias(f"{b}_sum"), F.sum((F.col(b) * F.col(b)).cast("long")).alias(f"{b}_square_sum"))]
    return exposures.groupBy(*keys).agg(
        F.count("*").alias("exposures"), _n(~F.col("safety")).alias("completed"), _n(F.col("safety")).alias("safety_exposures"),
        _n(won).alias("wins"), _n(~F.coalesce(won, F.lit(False))).alias("losses"), _n(gap != 0).alias("mismatches"), *sums, *rates, *extra,
    )


def turn_returns(metrics: DataFrame) -> DataFrame:
    """Returns by turn, by game and by round, their gap, and rates; NULL where a denominator is 0."""
    c = F.col
    turn, game, proxy = ratio(c("score_sum"), c("turns_sum")), ratio(c("per_turn_sum"), c("exposures")), ratio(c("per_round_sum"), c("exposures"))
    return metrics.select(
        "*", turn.alias("turn_return"), game.alias("game_return"), proxy.alias("round_return"), (proxy - game).alias("return_gap"), ratio(proxy - game, game).alias("relative_gap"),
        ratio(c("mismatches"), c("exposures")).alias("mismatch_rate"), ratio(c("wins"), c("exposures")).alias("win_rate"), ratio(c("wins"), c("completed")).alias("win_rate_completed"), ratio(c("safety_exposures"), c("exposures")).alias("safety_rate"),
    )


def winner_metrics(exposures: DataFrame, columns: tuple[str, ...] = ("score", "n_turns", "n_rounds")) -> DataFrame:
    """Per k and strategy over its won games: sum, sum of squares, mean, population variance; zeros without wins."""
    won = F.coalesce(F.col("winner_seat") == F.col("seat"), F.lit(False))
    aggs = [a for c in columns for a in (F.coalesce(F.sum(F.when(won, F.col(c).cast("long"))), F.lit(0)).alias(f"{c}_sum"), F.coalesce(F.sum(F.when(won, (F.col(c).cast("long") * F.col(c)))), F.lit(0)).alias(f"{c}_square_sum"))]
    g = exposures.groupBy("k", "strategy").agg(F.count("*").alias("attempted"), _n(won).alias("wins"), *aggs)
    mean = lambda c: F.coalesce(ratio(F.col(f"{c}_sum"), F.col("wins")), F.lit(0.0))
    var = lambda c: F.greatest(F.coalesce(ratio(F.col(f"{c}_square_sum"), F.col("wins")), F.lit(0.0)) - mean(c) * mean(c), F.lit(0.0))
    return g.select("*", *[x for c in columns for x in (mean(c).alias(f"{c}_mean"), var(c).alias(f"{c}_variance"))], ratio(F.col(f"{columns[0]}_sum"), F.col("attempted")).alias("expected_score"))


def game_summary(games: DataFrame) -> DataFrame:
    """Games and mean rounds per k and winning seat (NULL: none), with the seat's share of the k's games."""
    from pyspark.sql import Window

    return games.groupBy("k", "winner_seat").agg(F.count("*").alias("games"), F.avg("n_rounds").alias("mean_rounds")).withColumn("share", F.col("games") / F.sum("games").over(Window.partitionBy("k")))


def exposure_conservation(metrics: DataFrame) -> DataFrame:
    """Cells that break attempted = completed + safety, wins <= completed or losses = attempted - wins."""
    c = F.col
    broken = {"attempted": c("exposures") != c("completed") + c("safety_exposures"), "wins": c("wins") > c("completed"), "losses": c("losses") != c("exposures") - c("wins")}
    flags = F.filter(F.array(*[F.when(v, k) for k, v in broken.items()]), lambda x: x.isNotNull())
    return metrics.withColumn("rule", F.explode_outer(flags)).where("rule is not null")


def safety_by_cell(metrics: DataFrame) -> DataFrame:
    """Games per root and k from exposure counts; whole says whether these divide by k."""
    g = metrics.groupBy("root", "k").agg(*[F.sum(x).alias(x) for x in ("exposures", "completed", "safety_exposures")])
    games = [(F.col(x) / F.col("k")).cast("long").alias(f"{y}_games") for x, y in (("exposures", "attempted"), ("completed", "completed"), ("safety_exposures", "safety"))]
    return g.select("root", "k", *games, ((F.col("exposures") % F.col("k") == 0) & (F.col("completed") % F.col("k") == 0)).alias("whole"), ratio(F.col("safety_exposures"), F.col("exposures")).alias("safety_rate"))
