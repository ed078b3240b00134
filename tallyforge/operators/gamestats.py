"""Game length, margins and rare events. Exposures carry the game's `margin` and `spread` (NULL in safety-limit games)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled
from tallyforge.functions.stats import margin, ratio, second_best, spread
from tallyforge.operators.quantiles import at_ranks, counted_values, linear_quantiles, moments

QUANTILES = (0.1, 0.5, 0.9)


def with_margins(exposures: DataFrame, coordinates: tuple[str, ...] = ("root", "k", "game")) -> DataFrame:
    """Adds margin (best less second-best score of the game), spread (best less worst) and second (second-best); a game is
    told by those of the coordinates that are there. Margin and spread only for completed games. One shuffle by game."""
    game = Window.partitionBy(*[c for c in coordinates if c in exposures.columns])
    done, scores = ~F.col("safety"), F.col("_scores")
    held = exposures.withColumn("_scores", F.collect_list("score").over(game))
    return held.select(*exposures.columns, F.when(done, margin(scores)).alias("margin"), F.when(done, spread(scores)).alias("spread"), second_best(scores).alias("second"))


def _percents(quantiles: tuple[float, ...]) -> list[Column]:
    return [F.get("p", i).alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)]


def length_stats(exposures: DataFrame) -> DataFrame:
    """Per k and strategy over exposures, and per k (strategy NULL) over games: n, mean, population sd, exact quantiles
    (linear), shares of at most 5 and 10 and at least 20 rounds. All from one table of counts by length."""
    v = F.col("v")
    shares = {"le_5": v <= 5, "le_10": v <= 10, "ge_20": v >= 20}
    cells = exposures.groupBy("k", "strategy", F.col("n_rounds").alias("v")).agg(F.count("*").alias("c"), F.sum((F.col("seat") == 1).cast("long")).alias("games"))
    cells = settled(cells.where("v is not null"))
    whole = settled(cells.groupBy("k", "v").agg(F.sum("games").alias("c")).where("c > 0"))
    levels = [moments(x, keys, shares).join(linear_quantiles(x, keys, QUANTILES).drop("n"), keys) for x, keys in ((cells, ["k", "strategy"]), (whole, ["k"]))]
    both = levels[0].unionByName(levels[1].withColumn("strategy", F.lit(None).cast("int")))
    return both.select("k", "strategy", "n", "mean", "sd", *_percents(QUANTILES), *shares)


def global_length_stats(games: DataFrame) -> DataFrame:
    """The same over games by the number of seats that were ranked (the declared k where none was)."""
    k = F.when(F.size("seat_ranks") > 0, F.size("seat_ranks")).otherwise(F.col("k"))
    cells = counted_values(games.withColumn("players", k), ["players"], F.col("n_rounds"))
    return moments(cells, ["players"], {}).join(linear_quantiles(cells, ["players"], (0.5,)).drop("n"), "players").select("players", "n", "mean", "sd", *_percents((0.5,)))


def margin_stats(exposures: DataFrame, thresholds: tuple[int, ...] = (500, 1000)) -> DataFrame:
    """Per k and strategy over completed games: mean, median, population sd of margin and spread, and the shares at most t."""
    kinds, keys = ("margin", "spread"), ["k", "strategy"]
    rows = exposures.where("not safety").select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("x")) for c in kinds])))
    cells = counted_values(rows, [*keys, "of"], F.col("x"))
    g = moments(cells, [*keys, "of"], {f"le_{t}": F.col("v") <= t for t in thresholds}).join(linear_quantiles(cells, [*keys, "of"], (0.5,)).drop("n"), [*keys, "of"])
    pick = lambda c, name: F.max(F.when(F.col("of") == c, F.col(name)))
    out = g.withColumn("median", F.get("p", 0)).groupBy(*keys).agg(pick("margin", "n").alias("n"), *[pick(c, name).alias(f"{c}_{name}") for c in kinds for name in ("mean", "median", "sd", *[f"le_{t}" for t in thresholds])])
    return out


def margin_stats_binned(exposures: DataFrame, keys: tuple[str, ...] = ("k", "strategy"), width: int = 25, q: float = 0.5, threshold: int = 500) -> DataFrame:
    """Bounded variant: the quantile is the centre of the bin that holds rank ceil(n q); the share at most t counts the
    whole bin of t."""
    bins = exposures.where("not safety and margin is not null").groupBy(*keys, F.floor(F.col("margin") / width).alias("bin")).count()
    by = Window.partitionBy(*keys)
    run = bins.withColumn("cum", F.sum("count").over(by.orderBy("bin"))).withColumn("n", F.sum("count").over(by))
    return run.groupBy(*keys).agg(F.max("n").alias("n"), ((F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * q), F.col("bin"))) + 0.5) * width).alias("quantile"), (F.sum(F.when(F.col("bin") <= threshold // width, F.col("count")).otherwise(0)) / F.max("n")).alias("share_le"))


def rare_event_flags(games: DataFrame, target: int, margins: tuple[int, ...]) -> DataFrame:
    """Seated strategies of games where two seats or more reach the target, or whose margin is at most a threshold.
    games has scores and strategies as arrays, safety, and margin (NULL unless completed)."""
    flags = {"multi_target": F.size(F.filter("scores", lambda x: x >= target)) >= 2} | {f"margin_le_{t}": F.coalesce(F.col("margin") <= t, F.lit(False)) for t in margins}
    some = games.select("game", "k", "strategies", *[v.alias(k) for k, v in flags.items()]).where(reduce(Column.__or__, [F.col(k) for k in flags]))
    return some.select("game", "k", F.explode("strategies").alias("strategy"), *flags)


def rare_event_rates(exposures: DataFrame, target: int, margins: tuple[int, ...]) -> DataFrame:
    """Per k and strategy, and per k over exposures (strategy NULL): target rate over attempted, margin rates over completed.
    A game reaches the target with its second-best score."""
    hit = (F.col("second") >= target).cast("int")
    aggs = [F.count("*").alias("attempted"), F.sum((~F.col("safety")).cast("int")).alias("completed"), F.sum(hit).alias("target_count"), *[F.sum(F.coalesce((F.col("margin") <= t).cast("int"), F.lit(0))).alias(f"le_{t}_count") for t in margins]]
    x = exposures.groupingSets([["k", "strategy"], ["k"]], "k", "strategy").agg(*aggs)
    return x.select("*", ratio(F.col("target_count"), F.col("attempted")).alias("target_rate"), *[ratio(F.col(f"le_{t}_count"), F.col("completed")).alias(f"le_{t}_rate") for t in margins])


def smallest_with_share(values: DataFrame, col: str, q: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The smallest value whose cumulative count reaches ceil(N q), per key."""
    of = list(keys) or ["_all"]
    cells = counted_values(values if keys else values.withColumn("_all", F.lit(0)), of, F.rint(col).cast("long"))
    rank = F.greatest(F.ceil(F.col("n") * q) - 1, F.lit(0)).cast("long")
    return at_ranks(cells, of, F.array(rank)).select(*keys, F.col("v").alias("threshold"), "n")


def rare_thresholds(games: DataFrame, margin_q: float = 0.05, target_q: float = 0.95) -> DataFrame:
    """Per k: the margin threshold over completed games and the target over second-best scores of all games."""
    a = smallest_with_share(games.where("not safety"), "margin", margin_q, ("k",)).select("k", F.col("threshold").alias("margin_threshold"))
    b = smallest_with_share(games, "second", target_q, ("k",)).select("k", F.col("threshold").alias("target"))
    return a.join(b, "k", "full")


def equal_k_mean(stats: DataFrame, columns: list[str], count: str = "n") -> DataFrame:
    """Strategies present in every k: the summed count and the plain mean over k of each statistic."""
    ks = stats.select("k").distinct().agg(F.count("*").alias("all_k"))
    g = stats.where("strategy is not null").groupBy("strategy").agg(F.countDistinct("k").alias("n_k"), F.sum(count).alias(count), *[F.avg(c).alias(c) for c in columns])
    return g.crossJoin(F.broadcast(ks)).where("n_k = all_k").select("strategy", count, *columns)
