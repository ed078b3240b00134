"""Candidate families, set overlaps and agreement of different orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.stats import ratio
from tallyforge.operators.performance import rank_correlation


def candidate_union(by_rate: DataFrame, by_rating: DataFrame, top: int = 75, controls: tuple[int, ...] = (), diagnostics: tuple[int, ...] = ()) -> DataFrame:
    """Top N of both orders (strategy, rank) with controls and diagnostics: ranks and the reasons of admission."""
    both = by_rate.select("strategy", F.col("rank").alias("rate_rank")).join(by_rating.select("strategy", F.col("rank").alias("rating_rank")), "strategy", "full")
    reasons = {"rate": F.col("rate_rank") <= top, "rating": F.col("rating_rank") <= top, "control": F.col("strategy").isin(list(controls) or [-1]), "diagnostic": F.col("strategy").isin(list(diagnostics) or [-1])}
    out = both.withColumn("reasons", F.array_compact(F.array(*[F.when(v, k) for k, v in reasons.items()])))
    return out.where(F.size("reasons") > 0)


def balanced_tail_cap(family: DataFrame, top: int, cap: int, protected: tuple[int, ...] = ()) -> DataFrame:
    """Both cutoffs are lowered together until at most `cap` remain. A strategy stays through round r if a rank of its is at most
    top - r, so its last round is the larger of its margins; the first round whose family fits is found by a window.

    Adds removal_round (the round in which it would go; NULL: protected) and kept. If no round fits, only the protected stay.
    """
    last = F.greatest(*[F.coalesce(F.lit(top) - F.col(c), F.lit(-1)) for c in ("rate_rank", "rating_rank")])
    safe = F.col("strategy").isin(list(protected) or [-1])
    x = family.withColumn("last", F.when(~safe, last))
    by_round = x.groupBy("last").agg(F.count("*").alias("n"))
    fixed = by_round.agg(F.coalesce(F.sum(F.when(F.col("last").isNull(), F.col("n"))), F.lit(0)).alias("fixed"))
    rounds = x.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("r"))
    sizes = rounds.join(by_round.where("last is not null"), F.col("last") >= F.col("r"), "left").groupBy("r").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(F.broadcast(fixed))
    first = sizes.where(F.col("n") + F.col("fixed") <= cap).agg(F.coalesce(F.min("r"), F.lit(top + 1)).alias("round"))
    return x.crossJoin(F.broadcast(first)).select("strategy", "rate_rank", "rating_rank", (F.col("last") + 1).alias("removal_round"), F.col("round").alias("applied_round"), (F.col("last").isNull() | (F.col("last") >= F.col("round"))).alias("kept"))


def with_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <column>_json, the compact JSON text of each list, map or struct column, beside the native one; NULL stays NULL."""
    return df.withColumns({f"{c}_json": F.to_json(c) for c in columns})


def from_json_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns (name to type) read from JSON text; a text of another form is an error."""
    return df.withColumns({c: F.from_json(c, kind, {"mode": "FAILFAST"}) for c, kind in columns.items()})


def set_overlap(a: DataFrame, b: DataFrame, key: str = "strategy") -> DataFrame:
    """One row: sizes, intersection, union, Jaccard, overlap coefficient."""
    x = a.select(key, F.lit(1).alias("a")).distinct().join(b.select(key, F.lit(1).alias("b")).distinct(), key, "full").na.fill(0, ["a", "b"])
    g = x.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("size_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("size_b"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("both"), F.count("*").alias("either"))
    return g.select("*", ratio(F.col("both"), F.col("either")).alias("jaccard"), ratio(F.col("both"), F.least("size_a", "size_b")).alias("overlap"))


def pair_agreement(decisions: DataFrame, ranks: DataFrame) -> DataFrame:
    """Per pair the side that the win rate, the rating and the head-to-head effect prefer (a, b or NULL), and three agreement
    flags, NULL where a side is. ranks: strategy, rate_rank, rating_rank."""
    side = lambda p: ranks.select(F.col("strategy").alias(f"strategy_{p}"), F.col("rate_rank").alias(f"rate_{p}"), F.col("rating_rank").alias(f"rating_{p}"))
    x = decisions.select("pair_id", "strategy_a", "strategy_b", "d", "decision").join(side("a"), "strategy_a", "left").join(side("b"), "strategy_b", "left")
    pick = lambda a, b: F.when(a < b, "a").when(a > b, "b")
    x = x.withColumn("by_rate", pick(F.col("rate_a"), F.col("rate_b"))).withColumn("by_rating", pick(F.col("rating_a"), F.col("rating_b"))).withColumn("by_h2h", F.when(F.col("d") > 0, "a").when(F.col("d") < 0, "b"))
    return x.select("pair_id", "strategy_a", "strategy_b", "decision", "by_rate", "by_rating", "by_h2h", (F.col("by_rate") == F.col("by_rating")).alias("rate_rating"), (F.col("by_rate") == F.col("by_h2h")).alias("rate_h2h"), (F.col("by_rating") == F.col("by_h2h")).alias("rating_h2h"))


def agreement_summary(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row: pairs, unresolved and equivalent counts, shares of agreement over the pairs where it is defined, share of pairs
    whose direction is the same in both roots."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    a = pairs.agg(F.count("*").alias("pairs"), F.sum(F.col("decision").startswith("unresolved").cast("int")).alias("unresolved"), F.sum((F.col("decision") == "equivalent").cast("int")).alias("equivalent"), *[share(c).alias(f"{c}_share") for c in ("rate_rating", "rate_h2h", "rating_h2h")])
    return a.crossJoin(roots.agg(share("direction_agrees").alias("root_direction_share"), share("practical_difference").alias("root_difference_share")))


def decision_table(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count("*").alias("pairs"), F.avg(F.abs("d")).alias("mean_effect"))


def family_summary(family: DataFrame, top: int, controls: tuple[int, ...] = (), diagnostics: tuple[int, ...] = ()) -> DataFrame:
    """One row of a family as balanced_tail_cap gives it: strategies that both orders rank, agreement of the orders, sizes and overlaps of
    the two contributions before (`initial`, ranks up to top) and after the cap (`final`), and how many members come from each side, from both,
    from controls and from diagnostics."""
    named = lambda ids: F.col("strategy").isin(list(ids) or [-1])
    left = F.greatest(F.lit(top) - F.col("applied_round"), F.lit(0))
    of = {f"{when}_{side}": F.coalesce(F.col(f"{side}_rank") <= cut, F.lit(False)) for when, cut in (("initial", F.lit(top)), ("final", left)) for side in ("rate", "rating")}
    x = family.select("*", *[v.alias(k) for k, v in of.items()], named(controls).alias("control"), named(diagnostics).alias("diagnostic"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both, either = (lambda w: F.col(f"{w}_rate") & F.col(f"{w}_rating")), (lambda w: F.col(f"{w}_rate") | F.col(f"{w}_rating"))
    member = F.col("final_rate") | F.col("final_rating") | F.col("control") | F.col("diagnostic")
    counts = [n(F.col("rate_rank").isNotNull() & F.col("rating_rank").isNotNull()).alias("scored_by_both"), *[n(f(w)).alias(f"{w}_{name}") for w in ("initial", "final") for name, f in (("shared", both), ("either", either))]]
    counts += [n(member).alias("members"), *[n(F.col(c)).alias(f"from_{c.removeprefix('final_')}") for c in ("final_rate", "final_rating", "control", "diagnostic")]]
    one = x.agg(*counts).select("*", *[ratio(F.col(f"{w}_shared"), F.col(f"{w}_either")).alias(f"{w}_jaccard") for w in ("initial", "final")])
    ranks = rank_correlation(family.select(F.lit(0).alias("scope"), F.col("strategy").alias("id"), F.col("rate_rank").alias("x"), F.col("rating_rank").alias("y")), ["scope"])
    return one.crossJoin(F.broadcast(ranks.agg(F.max("spearman").alias("spearman"), F.max("kendall").alias("kendall"))))


def decision_summary(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row: pairs, those with a direction, unresolved, not viable and equivalent ones; shares of agreement of the orders and the
    head-to-head direction over the pairs where both have one; pairs that both roots decide, and the shares of those whose Holm class,
    decision and direction agree. pairs as from pair_agreement, roots as from root_decisions."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    d = F.col("decision")
    a = pairs.agg(F.count("*").alias("pairs"), F.count("by_h2h").alias("directional"), n(d.startswith("unresolved")).alias("unresolved"), n(d == "unresolved_nonviable").alias("nonviable"), n(d == "equivalent").alias("equivalent"), *[share(c).alias(f"{c}_share") for c in ("rate_rating", "rate_h2h", "rating_h2h")])
    b = roots.agg(F.count("decision_agrees").alias("root_pairs"), *[share(f"{c}_agrees").alias(f"root_{c}_share") for c in ("holm", "decision", "direction")])
    return a.crossJoin(F.broadcast(b))


def h2h_totals(blocks: DataFrame) -> DataFrame:
    """One row: attempted, completed and safety-limit games and replacements of all blocks, and the completion rate."""
    g = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempted", "completed", "safety", "replacements")])
    return g.withColumn("completion_rate", ratio(F.col("completed"), F.col("attempted")))


def pair_intervals(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per pair its games, replacements and completion rate over all blocks, the effect with both intervals, Holm's p and the decision."""
    g = blocks.groupBy("pair_id").agg(*[F.sum(c).alias(c) for c in ("attempted", "completed", "safety", "replacements")])
    x = decisions.select("pair_id", "strategy_a", "strategy_b", "complete", "d", "o_low", "o_high", "s_low", "s_high", "holm_p", "decision").join(g, "pair_id")
    return x.withColumn("completion_rate", ratio(F.col("completed"), F.col("attempted")))


def screening_leaders(across: DataFrame, near: float = 1e-9) -> DataFrame:
    """root, strategy, score of all strategies whose score is the best of its root, give or take rounding."""
    best = F.max("score").over(Window.partitionBy("root"))
    return across.where("score is not null").withColumn("best", best).where(F.abs(F.col("score") - F.col("best")) <= near).select("root", "strategy", "score")


def score_leaders(across: DataFrame, top: int = 5) -> DataFrame:
    """The first strategies of each root by score."""
    r = across.where("score is not null").withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.desc(F.round("score", 9)), "strategy")))
    return r.where(F.col("place") <= top).select("root", "place", "strategy", "score", "worst_k", "min_delta")


def family_hash(family: DataFrame, key: str = "strategy"):
    """One row: SHA-256 of the JSON list of the sorted members. For capped families, not for games."""
    return family.agg(F.sha2(F.to_json(F.sort_array(F.collect_set(key))), 256).alias("family_hash"), F.count_distinct(key).alias("members"))
