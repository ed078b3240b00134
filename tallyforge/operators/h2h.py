"""Head-to-head schedules, blocks, tests and decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyforge.functions.stats import normal_quantile, ratio

PRACTICAL, FAMILY_ALPHA, FLOOR = 0.03, 0.02, 0.99


def pair_schedule(finalists: DataFrame, roots: DataFrame, target: int = 100) -> DataFrame:
    """All unordered pairs x roots x both seat orders with stable ids. finalists: strategy; roots: root. Finalists are few by
    design (a capped family), so their pairs are."""
    a, b = finalists.select(F.col("strategy").alias("strategy_a")), finalists.select(F.col("strategy").alias("strategy_b"))
    pairs = a.join(b, F.col("strategy_a") < F.col("strategy_b")).withColumn("pair_id", F.row_number().over(Window.orderBy("strategy_a", "strategy_b")) - 1)
    rows = pairs.crossJoin(F.broadcast(roots.select("root"))).withColumn("seat_order", F.explode(F.array(F.lit(0), F.lit(1))))
    first, second = F.when(F.col("seat_order") == 0, F.col("strategy_a")).otherwise(F.col("strategy_b")), F.when(F.col("seat_order") == 0, F.col("strategy_b")).otherwise(F.col("strategy_a"))
    block = F.substring(F.md5(F.concat_ws(":", "strategy_a", "strategy_b", "root", "seat_order")), 1, 16)
    return rows.select("pair_id", "strategy_a", "strategy_b", "root", "seat_order", first.alias("seat1"), second.alias("seat2"), block.alias("block_id"), F.lit(target).alias("target"))


BLOCK = ["pair_id", "strategy_a", "strategy_b", "root", "seat_order"]


def prefix_until_target(attempts: DataFrame, target: int, cap: int) -> DataFrame:
    """Per block over its attempts in order: stop at the target-th completed game or after cap attempts. attempts: block keys
    pair_id, strategy_a, strategy_b, root, seat_order; attempt (from 0), completed (0/1), first_won (0/1)."""
    before = F.coalesce(F.sum("completed").over(Window.partitionBy(*BLOCK).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return block_counts(attempts.withColumn("before", before).where((F.col("before") < target) & (F.col("attempt") < cap)), target)


def block_counts(attempts: DataFrame, target: int) -> DataFrame:
    """Per block the counts of all its attempts (columns as in prefix_until_target, whose order is not needed here); complete
    with target completed games at least."""
    g = attempts.groupBy(*BLOCK).agg(F.count("*").alias("attempted"), F.sum("completed").alias("completed"), F.sum(F.col("completed") * F.col("first_won")).alias("wins_seat1"))
    wins_2 = F.col("completed") - F.col("wins_seat1")
    swap = F.col("seat_order") == 1
    return g.select(*BLOCK, "attempted", "completed", (F.col("attempted") - F.col("completed")).alias("safety"), F.greatest(F.col("attempted") - target, F.lit(0)).alias("replacements"), "wins_seat1", wins_2.alias("wins_seat2"), F.when(swap, wins_2).otherwise(F.col("wins_seat1")).alias("wins_a"), F.when(swap, F.col("wins_seat1")).otherwise(wins_2).alias("wins_b"), F.when(F.col("completed") >= target, "complete").otherwise("short").alias("status"))


def order_combine(blocks: DataFrame, by_root: bool = False) -> DataFrame:
    """Per pair (and root) one row with the counts of both seat orders over roots, completion rates and whether all is complete."""
    key = ["pair_id", "strategy_a", "strategy_b", *(["root"] if by_root else [])]
    pick = lambda c, o: F.sum(F.when(F.col("seat_order") == o, F.col(c)).otherwise(0)).alias(f"{c}_{o}")
    g = blocks.groupBy(*key).agg(*[pick(c, o) for c in ("attempted", "completed", "wins_a") for o in (0, 1)], F.bool_and(F.col("status") == "complete").alias("complete"), F.countDistinct("seat_order").alias("orders"))
    return g.select(*key, *[f"{c}_{o}" for c in ("attempted", "completed", "wins_a") for o in (0, 1)], *[ratio(F.col(f"completed_{o}"), F.col(f"attempted_{o}")).alias(f"completion_{o}") for o in (0, 1)], (F.col("complete") & (F.col("orders") == 2)).alias("complete"))


def viability(blocks: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Per candidate over its pairs: attempted, completed, rate, operational (rate at least floor), inferential (all complete)."""
    sides = blocks.select("*", F.explode(F.array("strategy_a", "strategy_b")).alias("strategy"))
    g = sides.groupBy("strategy").agg(F.sum("attempted").alias("attempted"), F.sum("completed").alias("completed"), F.bool_and(F.col("status") == "complete").alias("inferential"))
    return g.select("*", ratio(F.col("completed"), F.col("attempted")).alias("rate"), (ratio(F.col("completed"), F.col("attempted")) >= floor).alias("operational"))


def schedule_coverage(schedule: DataFrame, blocks: DataFrame) -> DataFrame:
    """Scheduled blocks without counts, counts that are not scheduled, counts that do not add up."""
    key = ["pair_id", "root", "seat_order"]
    x = schedule.select(*key, F.lit(True).alias("planned")).join(blocks.select(*key, "attempted", "completed", "safety", "wins_a", "wins_b", F.lit(True).alias("counted")), key, "full")
    issue = F.when(F.col("counted").isNull(), "missing").when(F.col("planned").isNull(), "unplanned").when((F.col("attempted") != F.col("completed") + F.col("safety")) | (F.col("completed") != F.col("wins_a") + F.col("wins_b")), "inconsistent")
    return x.select(*key, issue.alias("issue")).where("issue is not null")


def block_issues(schedule: DataFrame, blocks: DataFrame, cap: int, statuses: tuple[str, ...] = ("complete", "short")) -> DataFrame:
    """pair_id, root, seat_order, issue of a finished schedule, a row for each fault of a block: strategies that are not the scheduled
    ones, seats that do not follow from the order, an unknown status, a complete block that is not at its target, a short one that
    reached the target or stopped before the cap. schedule as from pair_schedule, blocks as from prefix_until_target."""
    key = ["pair_id", "root", "seat_order"]
    x = schedule.select(*key, F.col("strategy_a").alias("sa"), F.col("strategy_b").alias("sb"), "seat1", "seat2", "target").join(blocks, key)
    flip = F.col("seat_order") == 1
    faults = {
        "other_strategies": ~(F.col("sa").eqNullSafe(F.col("strategy_a")) & F.col("sb").eqNullSafe(F.col("strategy_b"))),
        "seats": (F.col("seat1") != F.when(flip, F.col("sb")).otherwise(F.col("sa"))) | (F.col("seat2") != F.when(flip, F.col("sa")).otherwise(F.col("sb"))),
        "status": ~F.col("status").isin(*statuses),
        "complete_off_target": (F.col("status") == "complete") & (F.col("completed") != F.col("target")),
        "short_at_target": (F.col("status") == "short") & (F.col("completed") >= F.col("target")),
        "short_before_cap": (F.col("status") == "short") & (F.col("attempted") != cap),
    }
    named = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in faults.items()]), lambda c: c.isNotNull())
    return x.select(*key, F.explode(named).alias("issue"))


@pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    from math import erfc, sqrt

    flat = np.abs(z.to_numpy(float)) / sqrt(2)
    return pd.Series(np.frompyfunc(erfc, 1, 1)(flat).astype(float)).where(z.notna().to_numpy())


def score_test(pairs: DataFrame) -> DataFrame:
    """Adds z and p of the pooled two-proportion score test of wins_1 of n_1 against wins_2 of n_2. Without variance z is 0 and p 1;
    without games both are NULL."""
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    pool = (F.col("wins_1") + F.col("wins_2")) / (n1 + n2)
    var = pool * (1 - pool) * (1 / n1 + 1 / n2)
    z = F.when((n1 <= 0) | (n2 <= 0), None).when(var <= 0, 0.0).otherwise((F.col("wins_1") / n1 - F.col("wins_2") / n2) / F.sqrt(var))
    return pairs.withColumn("z", z).withColumn("p", _two_sided("z"))


def _constrained(x1, n1, x2, n2, d):
    """Rate of the second sample that is likeliest when the first one's is larger by d: the root of a cubic by trigonometry."""
    n = n1 + n2
    a3, a2 = n, (n1 + 2 * n2) * d - n - x1 - x2
    a1, a0 = (n2 * d - n - 2 * x2) * d + x1 + x2, x2 * d * (1 - d)
    c = a2**3 / (3 * a3) ** 3 - a1 * a2 / (6 * a3**2) + a0 / (2 * a3)
    b = np.where(c >= 0, 1.0, -1.0) * np.sqrt(np.maximum(a2**2 / (3 * a3) ** 2 - a1 / (3 * a3), 0))
    safe = np.where(b == 0, 1.0, b)
    angle = (np.pi + np.arccos(np.clip(np.where(b == 0, 0.0, c / safe**3), -1, 1))) / 3
    return np.clip(2 * b * np.cos(angle) - a2 / (3 * a3), np.maximum(0.0, -d), np.minimum(1.0, 1.0 - d))


def interval_bounds(x1, n1, x2, n2, z: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of p1 - p2 by inversion of the score statistic, whole columns at a time."""
    x1, n1, x2, n2 = (np.asarray(v, float) for v in (x1, n1, x2, n2))
    seen = x1 / n1 - x2 / n2

    def far(d):
        p2 = _constrained(x1, n1, x2, n2, d)
        p1 = np.clip(p2 + d, 0, 1)
        var = p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2
        gap = seen - d
        return np.where(var > 0, gap**2 > z * z * np.maximum(var, 1e-300), np.abs(gap) > 1e-12)

    out = []
    for edge in (-1.0, 1.0):
        inside, outside = seen.copy(), np.full_like(seen, edge)
        for _ in range(steps):
            mid = (inside + outside) / 2
            hit = far(mid)
            inside, outside = np.where(hit, inside, mid), np.where(hit, mid, outside)
        out.append(np.where(far(np.full_like(seen, edge)), inside, edge))
    return out[0], out[1]


def score_interval(pairs: DataFrame, z: float | Column, prefix: str) -> DataFrame:
    """Adds <prefix>_low and <prefix>_high, bounds of wins_1 / n_1 - wins_2 / n_2 by z, the normal quantile of the level (a number, or a
    column where levels differ); NULL without games."""

    @pandas_udf("low double, high double")
    def bounds(x1: pd.Series, n1: pd.Series, x2: pd.Series, n2: pd.Series, z: pd.Series) -> pd.DataFrame:
        ok = ((n1 > 0) & (n2 > 0)).to_numpy()
        low, high = interval_bounds(x1, np.where(ok, n1, 1), x2, np.where(ok, n2, 1), z.to_numpy(float))
        return pd.DataFrame({"low": np.where(ok, low, np.nan), "high": np.where(ok, high, np.nan)})

    x = pairs.withColumn("_b", bounds(*[F.col(c).cast("double") for c in ("wins_1", "n_1", "wins_2", "n_2")], z if isinstance(z, Column) else F.lit(float(z))))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return x.withColumn(f"{prefix}_low", clean("_b.low")).withColumn(f"{prefix}_high", clean("_b.high")).drop("_b")


def holm(pairs: DataFrame, alpha: float = FAMILY_ALPHA, family: tuple[str, ...] = ()) -> DataFrame:
    """Adds holm_p and holm_reject; pairs without a p keep the family's size with p = 1. Rows are pairs of finalists."""
    p = F.coalesce("p", F.lit(1.0))
    by = Window.partitionBy(*family).orderBy(p, "pair_id")
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(p * (m - F.row_number().over(by) + 1), F.lit(1.0))
    return pairs.withColumn("_s", step).withColumn("holm_p", F.max("_s").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("holm_reject", F.col("holm_p") <= alpha).drop("_s")


def decision(low, high, viable, rejected, effect, delta: float = PRACTICAL, margin: float | None = None):
    """The first class that holds."""
    out = F.when(~viable, "unresolved_nonviable").when(low > delta, "practical_dominance_a").when(high < -delta, "practical_dominance_b")
    out = out.when(rejected & (effect > 0), "statistical_only_advantage_a").when(rejected & (effect < 0), "statistical_only_advantage_b")
    if margin is not None:
        out = out.when((low >= -margin) & (high <= margin), "equivalent")
    return out.otherwise("unresolved")


def h2h_inference(combined: DataFrame, alpha: float = FAMILY_ALPHA, delta: float = PRACTICAL, margin: float | None = None, family: tuple[str, ...] = ()) -> DataFrame:
    """From order_combine: q_ab and q_ba (a's and b's win rate when seated first), d = (q_ab - q_ba) / 2 with ordinary (alpha
    0.05) and Bonferroni bounds, a's balanced win rate, test, Holm and decision. Pairs with equal `family` columns (say, of one root) are a
    family of their own for Holm and Bonferroni; there are few families."""
    x = combined.withColumn("wins_1", F.col("wins_a_0")).withColumn("n_1", F.col("completed_0")).withColumn("wins_2", F.col("completed_1") - F.col("wins_a_1")).withColumn("n_2", F.col("completed_1"))
    x = holm(score_test(x), alpha, family)
    sizes = sorted({r["n"] for r in combined.groupBy(*family).agg(F.count("*").alias("n")).collect()} - {0}) or [1]
    level = F.create_map(*[F.lit(v) for n in sizes for v in (n, normal_quantile(1 - alpha / n / 2))])
    x = x.withColumn("_z", level[F.count("*").over(Window.partitionBy(*family)).cast("int")])
    x = score_interval(score_interval(x, normal_quantile(0.975), "o"), F.col("_z"), "s")
    qa, qb = ratio(F.col("wins_1"), F.col("n_1")), ratio(F.col("wins_2"), F.col("n_2"))
    x = x.select("pair_id", "strategy_a", "strategy_b", *family, "complete", qa.alias("q_ab"), qb.alias("q_ba"), ((qa - qb) / 2).alias("d"), *[(F.col(c) / 2).alias(c) for c in ("o_low", "o_high", "s_low", "s_high")], "z", "p", "holm_p", "holm_reject", (F.lit(0.5) + (qa - qb) / 2).alias("balanced_rate"))
    return x.withColumn("decision", decision(F.col("s_low"), F.col("s_high"), F.col("complete"), F.col("holm_reject"), F.col("d"), delta, margin))


def root_decisions(blocks: DataFrame, alpha: float = FAMILY_ALPHA, delta: float = PRACTICAL, margin: float | None = None, roots: tuple[int, int] = (0, 1)) -> DataFrame:
    """Per pair the inference of each of two roots on its own, all roots in one pass: effect, Holm class (advantage_a, advantage_b,
    no_rejection; not_viable where blocks are short) and decision of both, the difference of the effects, whether classes, decisions and
    directions agree (NULL where a root has no effect)."""
    x = h2h_inference(order_combine(blocks, by_root=True), alpha, delta, margin, ("root",))
    tested = F.when(~F.col("complete"), "not_viable").when(F.col("holm_reject") & (F.col("d") > 0), "advantage_a").when(F.col("holm_reject") & (F.col("d") < 0), "advantage_b").otherwise("no_rejection")
    x = x.withColumn("holm", tested)
    of = [F.max(F.when(F.col("root") == r, F.col(c))).alias(f"{c}_{i}") for i, r in enumerate(roots) for c in ("d", "holm", "decision")]
    g = x.groupBy("pair_id", "strategy_a", "strategy_b").agg(*of)
    both = F.col("d_0").isNotNull() & F.col("d_1").isNotNull()
    same = lambda c: F.when(both, F.col(f"{c}_0") == F.col(f"{c}_1"))
    return g.select("*", (F.col("d_0") - F.col("d_1")).alias("discrepancy"), same("holm").alias("holm_agrees"), same("decision").alias("decision_agrees"), F.when(both, F.signum("d_0") == F.signum("d_1")).alias("direction_agrees"))


def root_agreement(blocks: DataFrame, delta: float = PRACTICAL) -> DataFrame:
    """Per pair the effect of each root and of their difference; direction agrees where both have one."""
    x = order_combine(blocks, by_root=True)
    d = (ratio(F.col("wins_a_0"), F.col("completed_0")) - ratio(F.col("completed_1") - F.col("wins_a_1"), F.col("completed_1"))) / 2
    x = x.withColumn("d", d)
    g = x.groupBy("pair_id").agg(*[F.max(F.when(F.col("root") == r, F.col("d"))).alias(f"d_{r}") for r in (0, 1)])
    same = F.signum("d_0") == F.signum("d_1")
    return g.select("pair_id", "d_0", "d_1", (F.col("d_0") - F.col("d_1")).alias("discrepancy"), same.alias("direction_agrees"), (F.abs(F.col("d_0") - F.col("d_1")) > delta).alias("practical_difference"))
