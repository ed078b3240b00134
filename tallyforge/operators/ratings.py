"""Order-free strengths (Plackett-Luce by minorization-maximization), percentiles of ratings, held-out calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled, stored
from tallyforge.functions.stats import average_rank
from tallyforge.operators.quantiles import at_ranks


#: Strengths that are shipped to all tasks, at most (16 MB); more are joined.
LOOKUP = 1_000_000


def ranked_games(exposures: DataFrame) -> DataFrame:
    """root, k, game, ids: the strategies of each completed game in order of rank, a row for each game."""
    done = exposures.where("not safety and rank is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "strategy"))), lambda x: x["strategy"])
    return done.groupBy("root", "k", "game").agg(ids.alias("ids"))


def stage_loads(strengths: np.ndarray) -> np.ndarray:
    """For games as rows of strengths in order of rank: for each seat the sum of 1 / stage over the stages in which it was still to be
    placed. A stage is the sum of the strengths not placed yet; the last one is no choice."""
    stages = np.cumsum(strengths[:, ::-1], axis=1)[:, ::-1]
    inverse = 1 / stages
    inverse[:, -1] = 0
    return np.cumsum(inverse, axis=1)


def _loads_by_lookup(games: DataFrame, gamma: DataFrame) -> DataFrame:
    """root, k, strategy, load: a task reads its games' strengths from a table and adds their loads up, so only a sum for each strategy and task
    is shuffled."""
    table = gamma.select("root", "k", "strategy", "g").toPandas().sort_values(["root", "k", "strategy"]).reset_index(drop=True)
    cells = {key: (part.index[0], part["strategy"].to_numpy()) for key, part in table.groupby(["root", "k"])}
    shared = games.sparkSession.sparkContext.broadcast((cells, table["g"].to_numpy(), table[["root", "k", "strategy"]]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, g, keys = shared.value
        load = np.zeros(len(g))
        for rows in batches:
            for key, mine in rows.groupby(["root", "k"]):
                first, names = cells[key]
                for _, some in mine.groupby(mine["ids"].map(len)):
                    at = first + np.searchsorted(names, np.stack(some["ids"].to_numpy()))
                    np.add.at(load, at, stage_loads(g[at]) * some["n"].to_numpy()[:, None])
        seen = load > 0
        yield keys[seen].assign(load=load[seen])

    kinds = ", ".join(f"{c} {gamma.schema[c].dataType.simpleString()}" for c in ("root", "k", "strategy"))
    parts = games.select("root", "k", "ids", "n").mapInPandas(run, f"{kinds}, load double")
    return parts.groupBy("root", "k", "strategy").agg(F.sum("load").alias("load"))


def _loads_by_join(games: DataFrame, gamma: DataFrame) -> DataFrame:
    """The same where the strengths are too many to ship."""
    key, game = ["root", "k", "strategy"], Window.partitionBy("root", "k", "ids")
    x = games.select("root", "k", "ids", "n", F.posexplode("ids").alias("at", "strategy")).join(gamma.select(*key, "g"), key)
    x = x.withColumn("inv", F.sum("g").over(game.orderBy(F.desc("at")))).withColumn("last", F.max("at").over(game))
    x = x.withColumn("load", F.sum(F.when(F.col("at") < F.col("last"), 1 / F.col("inv")).otherwise(0.0)).over(game.orderBy("at")))
    return x.groupBy(*key).agg(F.sum(F.col("load") * F.col("n")).alias("load"))


def strengths(games: DataFrame, rounds: int = 20, tolerance: float = 1e-6, prior: float = 0.5, lookup: int = LOOKUP) -> DataFrame:
    """root, k, strategy, mu (ln of the Plackett-Luce strength) and updates (stages in which it was compared) from ranked games: root, k and ids (in
    order of rank). A draw of `prior` against a player of strength 1 keeps strengths finite. Games of equal ids are counted once for all
    rounds; a round reads the counts where they lie and shuffles a sum for each strategy and task."""
    key = ["root", "k", "strategy"]
    games = stored(games.groupBy("root", "k", "ids").agg(F.count("*").alias("n")), "rankings")
    seats = games.select("root", "k", "n", F.size("ids").alias("seats"), F.posexplode("ids").alias("at", "strategy"))
    wins = seats.groupBy(*key).agg(F.sum(F.col("n") * (F.col("at") < F.col("seats") - 1).cast("int")).alias("w"), F.sum(F.col("n") * F.least(F.col("at") + 1, F.col("seats") - 1)).alias("updates"))
    gamma = settled(wins.select(*key, "w", "updates", F.lit(1.0).alias("g")))
    loads = _loads_by_lookup if gamma.count() <= lookup else _loads_by_join
    for _ in range(rounds):
        new = (F.col("w") + prior) / (F.col("load") + 2 * prior / (F.col("g") + 1))
        step = settled(gamma.join(loads(games, gamma), key).select(*key, "w", "updates", F.col("g").alias("was"), new.alias("g")))
        gamma = step.drop("was")
        if (step.agg(F.max(F.abs(F.log(F.col("g") / F.col("was"))))).first()[0] or 0.0) < tolerance:
            break
    return gamma.select(*key, F.log("g").alias("mu"), "updates")


def ratings_batch(exposures: DataFrame, rounds: int = 20, tolerance: float = 1e-6, prior: float = 0.5, lookup: int = LOOKUP) -> DataFrame:
    """Per root, k and strategy: mu and updates (see strengths), attempted, completed and excluded exposures and status. All ranks of
    completed games count, in no order. A game is one row, its strategies in order of rank."""
    key = ["root", "k", "strategy"]
    support = exposures.groupBy(*key).agg(F.count("*").alias("attempted"), F.sum((~F.col("safety")).cast("int")).alias("completed"))
    out = support.join(strengths(ranked_games(exposures), rounds, tolerance, prior, lookup), key, "left")
    out = out.withColumn("updates", F.coalesce("updates", F.lit(0))).withColumn("cell_updates", F.sum("updates").over(Window.partitionBy("root", "k")))
    return out.select(*key, "mu", "attempted", "completed", (F.col("attempted") - F.col("completed")).alias("excluded"), "updates", "cell_updates", F.when(F.col("updates") > 0, "rated").otherwise("prior").alias("status"))


def rating_percentile(ratings: DataFrame, value: str = "mu") -> DataFrame:
    """Within root and k, over rows with evidence: average-tie rank over the count."""
    x = ratings.where("status = 'rated'")
    return x.withColumn("percentile", average_rank(F.col(value), "root", "k") / F.count("*").over(Window.partitionBy("root", "k")))


def percentile_contribution(percentiles: DataFrame) -> DataFrame:
    """Strategies with a percentile in every root and k: mean and least percentile, summed support, rank by mean, then id."""
    cells = percentiles.select("root", "k").distinct().agg(F.count("*").alias("cells"))
    g = percentiles.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("percentile").alias("mean"), F.min("percentile").alias("least"), F.sum("completed").alias("completed")).crossJoin(F.broadcast(cells)).where("n = cells")
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("mean", 9)), "strategy"))).drop("n", "cells")


def split_in_time(games: DataFrame, share: float = 0.8) -> DataFrame:
    """Games (root, k, game; a row each) in order of their number per root and k: the first share (one game at least) trains, the rest is held
    out. Adds train. The last training game is found by rank selection, so no task holds the games of a root and k."""
    by = ["root", "k"]
    cells = games.select(*by, F.col("game").alias("v"), F.lit(1).cast("long").alias("c")).where("root is not null and k is not null and v is not null")
    last = at_ranks(cells, by, F.array((F.greatest(F.lit(1), F.floor(share * F.col("n"))) - 1).cast("long"))).select(*by, F.col("v").alias("_last"))
    return games.join(F.broadcast(last), by).withColumn("train", F.col("game") <= F.col("_last")).drop("_last")


def heldout_calibration(exposures: DataFrame, rounds: int = 10, scale: float = 1.0, coordinates: tuple[str, ...] = ("root", "k", "game"), lookup: int = LOOKUP) -> DataFrame:
    """Per root and k: strengths from the training games score the held-out ones by a softmax over seats. Log loss, Brier score,
    accuracy, mean top probability, uniform references; a strategy without training has mu 0. The exposures are read once: a completed game
    is written as one row, and all else reads those. A game is told by the coordinates; root and k are few."""
    key = ["root", "k", "strategy"]
    seats = F.array_sort(F.collect_list(F.struct("rank", "seat", "strategy", (F.col("winner_seat") == F.col("seat")).cast("int").alias("won"))))
    first = [F.first(c).alias(c) for c in ("root", "k", "game") if c not in coordinates]
    games = stored(exposures.where("not safety").groupBy(*coordinates).agg(*first, seats.alias("seats")).select("root", "k", "game", "seats"), "games")
    x = split_in_time(games)
    ids = F.transform(F.filter("seats", lambda s: s["rank"].isNotNull()), lambda s: s["strategy"])
    mu = settled(strengths(x.where("train").select("root", "k", ids.alias("ids")).where(F.size("ids") > 0), rounds, lookup=lookup).select(*key, "mu"))
    mu = F.broadcast(mu) if mu.count() <= lookup else mu
    held = x.where("not train").select("root", "k", "game", F.inline("seats")).join(mu, key, "left").withColumn("e", F.exp(F.coalesce("mu", F.lit(0.0)) / scale))
    held = held.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("root", "k", "game")))
    scored = held.groupBy("root", "k", "game").agg(F.sum(F.when(F.col("won") == 1, -F.log("p"))).alias("loss"), F.sum((F.col("p") - F.col("won")) * (F.col("p") - F.col("won"))).alias("brier"), F.max_by("won", F.struct("p", -F.col("seat"))).alias("hit"), F.max("p").alias("top"))
    return scored.groupBy("root", "k").agg(F.count("*").alias("games"), F.avg("loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("hit").alias("accuracy"), F.avg("top").alias("mean_top"), F.log(F.first("k").cast("double")).alias("uniform_log_loss"), (1 - 1 / F.first("k")).alias("uniform_brier"))
