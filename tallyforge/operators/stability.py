"""Agreement of two independent roots, of halves of a root, and of growing prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled
from tallyforge.functions.stats import normal_quantile, position, ratio, standardized
from tallyforge.operators.performance import rank_correlation, score_rank


def root_combined_by_k(metrics: DataFrame, threshold: float = 0.03) -> DataFrame:
    """Per root, and over all roots (root NULL), within k: raw wins and exposures, rate, cluster-ratio MCSE over cells with
    exposures, position against the practical threshold."""
    w, n = F.col("wins").cast("double"), F.col("exposures").cast("double")
    g = metrics.where("exposures > 0").groupingSets([["root", "k", "strategy"], ["k", "strategy"]], "root", "k", "strategy").agg(F.sum("wins").alias("wins"), F.sum("exposures").alias("exposures"), F.count("*").alias("batches"), F.sum(w * w).alias("ww"), F.sum(w * n).alias("wn"), F.sum(n * n).alias("nn"))
    r, b = ratio(F.col("wins"), F.col("exposures")), F.col("batches")
    square = F.greatest(F.col("ww") - 2 * r * F.col("wn") + r * r * F.col("nn"), F.lit(0.0))
    mcse = F.when(b >= 2, F.sqrt(b / (b - 1) * square) / F.col("exposures"))
    return g.select("root", "k", "strategy", "wins", "exposures", "batches", r.alias("win_rate"), (r - 1 / F.col("k")).alias("delta"), mcse.alias("mcse")).withColumn("position", position(F.col("delta"), threshold))


def across_k(by_k: DataFrame) -> DataFrame:
    """Equal-weight mean over k per root (NULL: combined), for strategies with every k; MCSE NULL where one is."""
    ks = by_k.agg(F.countDistinct("k").alias("all_k"))
    g = by_k.groupBy("root", "strategy").agg(F.countDistinct("k").alias("n"), F.avg("delta").alias("score"), F.count("mcse").alias("m"), F.sqrt(F.sum(F.col("mcse") * F.col("mcse"))).alias("e"))
    return g.crossJoin(F.broadcast(ks)).where("n = all_k").select("root", "strategy", "score", F.when(F.col("m") == F.col("n"), F.col("e") / F.col("n")).alias("mcse"))


def discrepancies(estimates: DataFrame, keys: list[str], value: str, threshold: float = 0.03) -> DataFrame:
    """Root 0 against root 1 against combined: raw difference, expected MCSE, standardized difference, share of the threshold,
    whether the position changed."""
    side = lambda root, p: estimates.where(F.col("root").isNull() if root is None else F.col("root") == root).select(*keys, F.col(value).alias(f"{p}_value"), F.col("mcse").alias(f"{p}_mcse"))
    x = side(0, "a").join(side(1, "b"), keys).join(side(None, "both"), keys)
    raw, expected = F.col("a_value") - F.col("b_value"), F.sqrt(F.col("a_mcse") * F.col("a_mcse") + F.col("b_mcse") * F.col("b_mcse"))
    return x.select(*keys, "a_value", "b_value", "both_value", raw.alias("raw"), expected.alias("expected"), standardized(raw, expected).alias("standardized"), (F.abs(raw) / threshold).alias("threshold_share"), (position(F.col("a_value"), threshold) != position(F.col("b_value"), threshold)).alias("position_changed"))


def positioned(metrics: DataFrame) -> DataFrame:
    """Adds pos (from 0) and n_batches of each batch in its root and k."""
    cells = metrics.select("root", "k", "batch").distinct()
    cells = cells.withColumn("pos", F.row_number().over(Window.partitionBy("root", "k").orderBy("batch")) - 1).withColumn("n_batches", F.count("*").over(Window.partitionBy("root", "k")))
    return metrics.join(cells, ["root", "k", "batch"])


def half_drift(metrics: DataFrame) -> DataFrame:
    """Per root, k and strategy: rate of the first and of the second half of the batches, their difference, expected MCSE (NULL
    with a half of one batch) and standardized difference."""
    halves = positioned(metrics).withColumn("half", (F.col("pos") >= F.floor(F.col("n_batches") / 2)).cast("int"))
    parts = [root_combined_by_k(halves.where(f"half = {h}")).where("root is not null").select("root", "k", "strategy", F.col("win_rate").alias(f"rate_{h}"), F.col("mcse").alias(f"m{h}")) for h in (0, 1)]
    x = parts[0].join(parts[1], ["root", "k", "strategy"])
    raw, expected = F.col("rate_1") - F.col("rate_0"), F.sqrt(F.col("m0") * F.col("m0") + F.col("m1") * F.col("m1"))
    return x.select("root", "k", "strategy", "rate_0", "rate_1", raw.alias("drift"), expected.alias("expected"), standardized(raw, expected).alias("standardized"))


def _ranks(scores: DataFrame, digits: int = 9) -> DataFrame:
    """a and b, the ranks in root 0 and 1, of strategies with a score in both."""
    s = score_rank(scores.where("root is not null").withColumn("score", F.round("score", digits)))
    return s.where("root = 0").select("strategy", F.col("rank").alias("a")).join(s.where("root = 1").select("strategy", F.col("rank").alias("b")), "strategy")


def top_n_overlap(scores: DataFrame, sizes: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """For each N: strategies in both roots' top N, in either, and their Jaccard similarity."""
    x = _ranks(scores).select("a", "b", F.explode(F.array(*map(F.lit, sizes))).alias("top_n"))
    a, b = F.col("a") <= F.col("top_n"), F.col("b") <= F.col("top_n")
    g = x.groupBy("top_n").agg(F.sum((a & b).cast("int")).alias("both"), F.sum((a | b).cast("int")).alias("either"))
    return g.withColumn("jaccard", ratio(F.col("both"), F.col("either")))


def rank_movement(scores: DataFrame, top: int = 25) -> DataFrame:
    """Median, 95th percentile and maximum of the distance of the two ranks, for all and for the better rank in the top."""
    x = _ranks(scores).withColumn("move", F.abs(F.col("a") - F.col("b"))).withColumn("scope", F.explode(F.when(F.least("a", "b") <= top, F.array(F.lit("all"), F.lit("top"))).otherwise(F.array(F.lit("all")))))
    return x.groupBy("scope").agg(F.count("*").alias("n"), F.percentile("move", 0.5).alias("median"), F.percentile("move", 0.95).alias("p95"), F.max("move").alias("largest"))


def control_movement(scores: DataFrame, controls: tuple[int, ...]) -> DataFrame:
    """Score and rank of the controls per root and combined (root NULL), side by side."""
    s = score_rank(scores.withColumn("score", F.round("score", 9))).where(F.col("strategy").isin(list(controls)))
    of = lambda root, p: s.where(F.col("root").isNull() if root is None else F.col("root") == root).select("strategy", F.col("rank").alias(f"{p}_rank"), F.col("score").alias(f"{p}_score"))
    return of(0, "a").join(of(1, "b"), "strategy", "full").join(of(None, "both"), "strategy", "full")


def shortlist_changes(scores: DataFrame, delta: float = 0.03) -> DataFrame:
    """Strategies whose membership of the shortlist (within delta of the leader) differs between the roots or from the
    combined scope."""
    s = scores.withColumn("score", F.round("score", 9)).withColumn("near", F.col("score") >= F.round(F.max("score").over(Window.partitionBy("root")) - delta, 9))
    g = s.groupBy("strategy").agg(F.max(F.when(F.col("root") == 0, F.col("near"))).alias("in_a"), F.max(F.when(F.col("root") == 1, F.col("near"))).alias("in_b"), F.max(F.when(F.col("root").isNull(), F.col("near"))).alias("in_both"))
    return g.withColumn("changed", F.col("in_a") != F.col("in_b")).withColumn("differs", (F.col("in_a") != F.col("in_both")) | (F.col("in_b") != F.col("in_both"))).where("changed or differs")


def cumulative_cells(metrics: DataFrame, fractions: tuple[float, ...]) -> DataFrame:
    """fraction, root, k, strategy and the sums of wins (w) and exposures (n), of their squares and product, and of the batches with
    exposures (b), over the first ceil(fraction x batches) batches of the root and k: running sums over the batches, read off where a
    fraction ends. No cell is repeated for a fraction."""
    w, n = F.col("wins").cast("double"), F.col("exposures").cast("double")
    by = Window.partitionBy("root", "k", "strategy").orderBy("pos")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"w": F.col("wins"), "n": F.col("exposures"), "ww": w * w, "wn": w * n, "nn": n * n, "b": (F.col("exposures") > 0).cast("long")}
    run = positioned(metrics).select("root", "k", "strategy", "pos", "n_batches", F.lead("pos").over(by).alias("next"), *[F.sum(x).over(upto).alias(c) for c, x in sums.items()])
    ends = [F.ceil(F.col("n_batches") * f) for f in fractions]
    here = F.filter(F.array(*[F.struct(F.lit(float(f)).alias("fraction"), end.alias("end")) for f, end in zip(fractions, ends)]), lambda x: (F.col("pos") < x["end"]) & (F.coalesce(F.col("next"), F.col("n_batches")) >= x["end"]))
    return run.select(F.explode(here).alias("at"), "*").select("at.fraction", "root", "k", "strategy", *sums)


def matched_convergence(metrics: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), top: int = 10, delta: float = 0.03) -> DataFrame:
    """At fractions of the batches of each root and k, on the means over k: n strategies in both roots; rank agreement of the roots, of each root and of
    both together with the final order of both together (at the largest fraction); strategies in the top of both roots and their Jaccard
    similarity; the strategies by which the shortlist of both together differs from the final one; the median half width of the
    interval of both together; the largest difference of the roots. The cells are read once."""
    cells = cumulative_cells(metrics, fractions).where("n > 0")
    g = cells.groupingSets([["fraction", "root", "k", "strategy"], ["fraction", "k", "strategy"]], "fraction", "root", "k", "strategy").agg(*[F.sum(c).alias(c) for c in ("w", "n", "ww", "wn", "nn", "b")])
    r, b = F.col("w") / F.col("n"), F.col("b")
    square = F.greatest(F.col("ww") - 2 * r * F.col("wn") + r * r * F.col("nn"), F.lit(0.0))
    g = g.select("fraction", "root", "k", "strategy", (r - 1 / F.col("k")).alias("delta"), F.when(b >= 2, F.sqrt(b / (b - 1) * square) / F.col("n")).alias("mcse"))
    ks = g.groupBy("fraction").agg(F.countDistinct("k").alias("all_k"))
    score = g.groupBy("fraction", "root", "strategy").agg(F.count("*").alias("m"), F.round(F.avg("delta"), 9).alias("score"), F.count("mcse").alias("known"), F.sqrt(F.sum(F.col("mcse") * F.col("mcse"))).alias("e"))
    score = score.join(ks, "fraction").where("m = all_k").withColumn("mcse", F.when(F.col("known") == F.col("m"), F.col("e") / F.col("m")))
    near = F.col("score") >= F.round(F.max("score").over(Window.partitionBy("fraction", "root")) - delta, 9)
    ranked = settled(score_rank(score, scope=("fraction", "root")).select("fraction", "root", "strategy", "score", "rank", "mcse", near.alias("near")))
    side = lambda root, p: ranked.where(F.col("root").isNull() if root is None else F.col("root") == root).select("fraction", "strategy", F.col("score").alias(f"{p}_score"), F.col("rank").alias(f"{p}_rank"), F.col("near").alias(f"{p}_near"), F.col("mcse").alias(f"{p}_mcse"))
    last = side(None, "final").where(F.col("fraction") == max(fractions)).select("strategy", "final_rank", "final_near")
    ends = last.crossJoin(F.broadcast(ranked.select("fraction").distinct()))
    keys = ["fraction", "strategy"]
    x = side(0, "a").join(side(1, "b"), keys, "full").join(side(None, "both"), keys, "full").join(ends, keys, "full")
    x = settled(x)
    kinds = {"roots": ("a_rank", "b_rank"), "a_final": ("a_rank", "final_rank"), "b_final": ("b_rank", "final_rank"), "both_final": ("both_rank", "final_rank")}
    pairs = x.select("fraction", F.col("strategy").alias("id"), F.inline(F.array(*[F.struct(F.lit(k).alias("of"), F.col(a).alias("x"), F.col(b).alias("y")) for k, (a, b) in kinds.items()])))
    alike = rank_correlation(pairs, ["fraction", "of"])
    pick = lambda k, c: F.max(F.when(F.col("of") == k, F.col(c))).alias(f"{k}_{c}")
    alike = alike.groupBy("fraction").agg(*[pick(k, c) for k in kinds for c in (("spearman", "kendall") if k in ("roots", "both_final") else ("spearman",))])
    in_a, in_b = F.coalesce(F.col("a_rank") <= top, F.lit(False)), F.coalesce(F.col("b_rank") <= top, F.lit(False))
    near = [F.coalesce(f"{p}_near", F.lit(False)) for p in ("both", "final")]
    out = x.groupBy("fraction").agg(F.count(F.when(F.col("a_rank").isNotNull() & F.col("b_rank").isNotNull(), 1)).alias("n"), F.sum((in_a & in_b).cast("int")).alias("top_both"), F.sum((in_a | in_b).cast("int")).alias("either"), F.sum((near[0] != near[1]).cast("int")).alias("shortlist_difference"), (normal_quantile(0.975) * F.percentile("both_mcse", 0.5)).alias("half_width"), F.max(F.abs(F.col("a_score") - F.col("b_score"))).alias("largest_difference"))
    return out.withColumn("top_jaccard", ratio(F.col("top_both"), F.col("either"))).drop("either").join(alike, "fraction", "left")
