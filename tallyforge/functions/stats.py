"""Column-level statistics: intervals, odds, ranks, quantiles of the normal and t distributions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Degrees of freedom with a tabled t quantile; beyond, a series in 1/df is exact to nine digits.
TABLED = 60


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _t_upper(x: float, df: int) -> float:
    """P(T > x) for x >= 0: the closed sums for whole degrees of freedom (angle theta = atan(x / sqrt(df)))."""
    theta = math.atan2(x, math.sqrt(df))
    c, term, total = math.cos(theta) ** 2, 1.0, 0.0
    if df % 2:
        term = math.cos(theta)
        for j in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * 2 * j / (2 * j + 1)
        return 0.5 - (theta + math.sin(theta) * total) / math.pi
    for j in range(df // 2):
        total += term
        term *= c * (2 * j + 1) / (2 * j + 2)
    return 0.5 - 0.5 * math.sin(theta) * total


def t_quantile(p: float, df: int) -> float:
    """The p quantile, p over one half, by bisection."""
    low, high = 0.0, 1.0
    while _t_upper(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_upper(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


def t_critical(df: Column, p: float = 0.975) -> Column:
    """The t quantile for a column of degrees of freedom; NULL below 1."""
    z = normal_quantile(p)
    n = df.cast("double")
    series = F.lit(z) + (z**3 + z) / 4 / n + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / n**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / n**3 + (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160 / n**4
    table = F.array(*[F.lit(t_quantile(p, d)) for d in range(1, TABLED + 1)])
    return F.when(df > TABLED, series).when(df >= 1, F.get(table, df.cast("int") - 1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def wilson(wins: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Lower and upper Wilson bound, clipped to [0, 1]; NULL where n is 0."""
    z2 = normal_quantile(1 - alpha / 2) ** 2
    n, p = F.when(n > 0, n.cast("double")), ratio(wins, n)
    half = F.sqrt(F.lit(z2)) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    mid, scale = p + z2 / (2 * n), 1 + z2 / n
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clip((mid - half) / scale), clip((mid + half) / scale)


def log_odds_over_chance(rate: Column, chance: Column) -> Column:
    """ln odds less ln odds of chance; NULL at rates of 0 and 1."""
    return F.when((rate > 0) & (rate < 1), F.log(rate / (1 - rate)) - F.log(chance / (1 - chance)))


def standardized(raw: Column, expected: Column) -> Column:
    """raw / expected with 0 / 0 = 0 and x / 0 = signed infinity."""
    return F.when(expected != 0, raw / expected).when(raw == 0, 0.0).when(raw > 0, float("inf")).when(raw < 0, float("-inf"))


def position(delta: Column, threshold: float) -> Column:
    return F.when(delta >= threshold, "above").when(delta <= -threshold, "below").when(delta.isNotNull(), "between")


def average_rank(value: Column, *partition: str) -> Column:
    """Rank from 1 with ties averaged."""
    by = Window.partitionBy(*partition)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(by.partitionBy(*partition, value)) - 1) / 2


def margin(scores: Column) -> Column:
    """Best less second-best of an array of scores; NULL with fewer than two."""
    known = F.sort_array(F.filter(scores, lambda x: x.isNotNull()), asc=False)
    return F.when(F.size(known) >= 2, F.get(known, 0) - F.get(known, 1))


def second_best(scores: Column) -> Column:
    return F.get(F.sort_array(F.filter(scores, lambda x: x.isNotNull()), asc=False), 1)


def spread(scores: Column) -> Column:
    """Best less worst of an array of scores; NULL with fewer than two."""
    known = F.filter(scores, lambda x: x.isNotNull())
    return F.when(F.size(known) >= 2, F.array_max(known) - F.array_min(known))


def softmax(values: Column, scale: float) -> Column:
    """Win probabilities of an array of strengths, shifted by the largest."""
    raw = F.transform(values, lambda x: F.exp((x - F.array_max(values)) / scale))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def participants(ids: Column) -> tuple[Column, Column]:
    """The sorted participants of a game and their label."""
    key = F.array_sort(ids)
    return key, F.array_join(F.transform(key, lambda x: x.cast("string")), " | ")


def strict_id(col: Column) -> Column:
    """A whole number within int32 and at least 0, else NULL."""
    number = col.try_cast("bigint")
    return F.when(number.between(0, 2**31 - 1), number.cast("int"))
