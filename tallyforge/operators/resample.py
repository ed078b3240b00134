"""Joint bootstrap over batches. Draws are md5 based, so any engine can repeat them.

A replicate draws batches once for all strategies, so its scores are a matrix product: how often it drew each batch, times the
strategies' counts. The counts are cells (root, k, batch, strategy), whose number does not grow with the games. They go to as
many tasks as there are blocks of replicates, and what comes back is a block's sums per strategy. No exchange holds rows times replicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Replicates of a block.
BLOCK = 64


def draw(root: int, k: int, replicate: int, of: int) -> np.ndarray:
    """The `of` batches that a replicate draws: of each draw the first 8 hex digits of the md5 of its coordinates, modulo `of`."""
    return np.array([int(hashlib.md5(f"{root}:{k}:{replicate}:{i}".encode()).hexdigest()[:8], 16) % of for i in range(of)], np.int64)


def usable_cells(metrics: DataFrame) -> DataFrame:
    """root, k, pos, strategy, wins, exposures of batches in which every strategy of the root and k has exposures; pos numbers
    them from 0."""
    cells = metrics.where("exposures > 0").groupBy("root", "k", "batch").agg(F.count("*").alias("n"))
    full = metrics.groupBy("root", "k").agg(F.countDistinct("strategy").alias("all_n"))
    good = cells.join(full, ["root", "k"]).where("n = all_n").select("root", "k", "batch", (F.row_number().over(Window.partitionBy("root", "k").orderBy("batch")) - 1).alias("pos"))
    return metrics.join(good, ["root", "k", "batch"]).select("root", "k", "pos", "strategy", "wins", "exposures")


def block_scores(cells: pd.DataFrame, replicates: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each root its strategies and their scores, replicates x strategies: the mean over k of the resampled win rate less 1 / k
    (over the k that the strategy has)."""
    for root, mine in cells.groupby("root", sort=True):
        names = np.unique(mine["strategy"])
        total, of = np.zeros((len(replicates), len(names))), np.zeros(len(names))
        for k, part in mine.groupby("k", sort=True):
            size, here = int(part["pos"].max()) + 1, np.unique(part["strategy"])
            times = np.stack([np.bincount(draw(root, k, r, size), minlength=size) for r in replicates])
            counts = np.zeros((2, size, len(here)), np.int64)
            counts[:, part["pos"], np.searchsorted(here, part["strategy"])] = part[["wins", "exposures"]].to_numpy().T
            at = np.searchsorted(names, here)
            total[:, at] += (times @ counts[0]) / (times @ counts[1]) - 1 / k
            of[at] += 1
        yield int(root), names, total / of


def over_blocks(cells: DataFrame, replicates: int, fn: Callable[[pd.DataFrame, range], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """fn over the cells and a block's replicates, a task for each block."""
    blocks = -(-replicates // block)
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        first = int(cells["block"].iloc[0]) * block
        return fn(cells, range(first, min(first + block, replicates)))

    return cells.groupBy("block").applyInPandas(run, schema)


def replicate_scores(metrics: DataFrame, replicates: int) -> DataFrame:
    """root, rep, strategy, score of every replicate, as they leave the blocks."""

    def rows(cells: pd.DataFrame, reps: range) -> pd.DataFrame:
        out = [pd.DataFrame({"root": root, "rep": np.repeat(reps, len(names)), "strategy": np.tile(names, len(reps)), "score": scores.ravel()}) for root, names, scores in block_scores(cells, reps)]
        return pd.concat(out)

    return over_blocks(usable_cells(metrics), replicates, rows, "root long, rep int, strategy int, score double")


def bootstrap_ranks(metrics: DataFrame, replicates: int, top: int = 10, delta: float = 0.03, digits: int = 9) -> DataFrame:
    """Per root and strategy: mean and population sd of the rank, frequency in the top and within delta of the leader. Scores
    are compared after rounding, ties go to the smaller id."""

    def sums(cells: pd.DataFrame, reps: range) -> pd.DataFrame:
        out = []
        for root, names, scores in block_scores(cells, reps):
            scores = np.round(scores, digits)
            rank = np.empty(scores.shape, np.int64)
            order = np.argsort(-scores, axis=1, kind="stable")  # names ascend, so ties keep the smaller id first
            np.put_along_axis(rank, order, np.arange(1, len(names) + 1)[None, :], axis=1)
            near = scores >= np.round(scores.max(1, keepdims=True) - delta, digits)
            out.append(pd.DataFrame({"root": root, "strategy": names, "n": len(reps), "r": rank.sum(0), "rr": (rank * rank).sum(0), "t": (rank <= top).sum(0), "s": near.sum(0)}))
        return pd.concat(out)

    parts = over_blocks(usable_cells(metrics), replicates, sums, "root long, strategy int, n long, r long, rr long, t long, s long")
    g = parts.groupBy("root", "strategy").agg(*[F.sum(c).alias(c) for c in ("n", "r", "rr", "t", "s")])
    # n * rr - r * r is whole, so the variance has no cancellation.
    spread = (F.col("n") * F.col("rr") - F.col("r") * F.col("r")).cast("double")
    return g.select("root", "strategy", (F.col("r") / F.col("n")).alias("rank_mean"), (F.sqrt(spread) / F.col("n")).alias("rank_sd"), (F.col("t") / F.col("n")).alias("top_frequency"), (F.col("s") / F.col("n")).alias("shortlist_frequency"))


def bootstrap_contrasts(metrics: DataFrame, replicates: int, observed: DataFrame, control: int) -> DataFrame:
    """Against a control: the observed contrast and the mean and population sd of the replicates'. observed: root, strategy, score."""

    def sums(cells: pd.DataFrame, reps: range) -> pd.DataFrame:
        out = []
        for root, names, scores in block_scores(cells, reps):
            if control in names:
                gap = scores - scores[:, names == control]
                mean = gap.mean(0)
                out.append(pd.DataFrame({"root": root, "strategy": names, "n": len(reps), "mean": mean, "m2": ((gap - mean) ** 2).sum(0)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["root", "strategy", "n", "mean", "m2"])

    parts = over_blocks(usable_cells(metrics), replicates, sums, "root long, strategy int, n long, mean double, m2 double")
    whole = Window.partitionBy("root", "strategy")
    parts = parts.withColumn("all", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    off = F.col("mean") - F.col("all")
    boot = parts.groupBy("root", "strategy").agg(F.first("all").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * off * off) / F.sum("n")).alias("sd"))
    mine = observed.where(F.col("strategy") == control).select("root", F.col("score").alias("base"))
    return boot.join(observed.select("root", "strategy", "score"), ["root", "strategy"]).join(mine, "root").select("root", "strategy", (F.col("score") - F.col("base")).alias("contrast"), "mean", "sd")


def joint_discrepancy(metrics: DataFrame, replicates: int, observed: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two roots: per replicate the largest centred, standardized root difference over strategies; its (1 - alpha) quantile (the
    next higher order statistic), the observed maximum and its exceedance (1 + #) / (R + 1).

    observed: strategy, raw (difference of the roots), expected (its MCSE, positive)."""
    seen = observed.where("expected > 0")

    def largest(cells: pd.DataFrame, reps: range) -> pd.DataFrame:
        of = {root: (names, scores) for root, names, scores in block_scores(cells, reps)}
        mine = cells[["strategy", "raw", "expected"]].dropna().drop_duplicates("strategy").sort_values("strategy")
        both = [s for s in mine["strategy"] if all(root in of and s in of[root][0] for root in (0, 1))]
        if not both:
            return pd.DataFrame(columns=["rep", "m"])
        mine = mine.set_index("strategy").loc[both]
        a, b = (scores[:, np.searchsorted(names, both)] for names, scores in (of[0], of[1]))
        z = np.round(np.abs(a - b - mine["raw"].to_numpy()) / mine["expected"].to_numpy(), 9)
        return pd.DataFrame({"rep": list(reps), "m": z.max(1)})

    cells = usable_cells(metrics).join(seen.select("strategy", "raw", "expected"), "strategy", "left")
    per = over_blocks(cells, replicates, largest, "rep int, m double")
    top = seen.agg(F.round(F.max(F.abs(F.col("raw")) / F.col("expected")), 9).alias("observed"))
    # As many rows as there are replicates, a parameter.
    order = per.withColumn("at", F.row_number().over(Window.orderBy("m")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    out = order.crossJoin(F.broadcast(top)).groupBy("observed").agg(F.max(F.when(F.col("at") == F.ceil((F.col("n") - 1) * (1 - alpha)), F.col("m"))).alias("critical"), F.max("n").alias("replicates"), F.sum((F.col("m") >= F.col("observed")).cast("int")).alias("over"))
    return out.select("observed", "critical", "replicates", ((1 + F.col("over")) / (F.col("replicates") + 1)).alias("exceedance"))
