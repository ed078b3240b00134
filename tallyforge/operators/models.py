"""Held-out tree regression of a strategy's result on its features, by MLlib."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled


def feature_table(manifest: DataFrame, ids: DataFrame, features: list[str]) -> DataFrame:
    """ids (strategy) with numeric features from the manifest; an id that the manifest lacks has found = false."""
    m = manifest.select("strategy", *[F.col(c).cast("double").alias(c) for c in features], F.lit(True).alias("found"))
    return ids.select("strategy").distinct().join(m, "strategy", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Whole strategies go to folds in order of the md5 of their id."""
    order = Window.orderBy(F.md5(F.col("strategy").cast("string")))
    fold = rows.select("strategy").distinct().withColumn("fold", (F.row_number().over(order) - 1) % folds)
    return rows.join(fold, "strategy")


def _model(rows: DataFrame, features: list[str], target: str, trees: int, depth: int):
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=trees, maxDepth=depth, seed=1).fit(rows)


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def kfold_predictions(rows: DataFrame, features: list[str], target: str, folds: int = 3, trees: int = 10, depth: int = 3) -> DataFrame:
    """strategy, fold, target and held-out prediction, each fold predicted by a model of the others."""
    x, out = settled(_assembled(with_folds(rows, folds), features)), None
    for f in range(folds):
        part = _model(x.where(F.col("fold") != f), features, target, trees, depth).transform(x.where(F.col("fold") == f)).select("strategy", "fold", target, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def regression_scores(predictions: DataFrame, target: str) -> DataFrame:
    """Per fold: n, mean absolute error, R2 (0 without variance)."""
    e = F.col(target) - F.col("prediction")
    g = predictions.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("sse"), F.var_pop(target).alias("v"))
    return g.select("fold", "n", "mae", F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("n") * F.col("v"))).otherwise(0.0).alias("r2"))


def permutation_importance(rows: DataFrame, features: list[str], target: str, folds: int = 2, repeats: int = 2, trees: int = 5, depth: int = 3) -> DataFrame:
    """Per feature: mean over folds and repeats of the rise in held-out absolute error when the feature's values change places
    (by md5 order), the sd over folds and the mean sd over repeats. All shuffled copies are scored in one pass a fold."""
    x, out = settled(with_folds(rows, folds)), None
    for f in range(folds):
        model = _model(_assembled(x.where(F.col("fold") != f), features), features, target, trees, depth)
        held = x.where(F.col("fold") == f).withColumn("at", F.row_number().over(Window.orderBy("strategy")))
        plans = held.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(r).alias("repeat")) for c in features for r in range(repeats)])).alias("p")).select(*held.columns, "p.feature", "p.repeat")
        key = F.md5(F.concat_ws(":", "feature", F.col("repeat").cast("string"), F.col("strategy").cast("string")))
        places = plans.withColumn("take", F.row_number().over(Window.partitionBy("feature", "repeat").orderBy(key)))
        given = held.select(F.col("at").alias("take"), *[F.col(c).alias(f"{c}_other") for c in features])
        swapped = places.join(given, "take").select("strategy", target, "feature", "repeat", *[F.when(F.col("feature") == c, F.col(f"{c}_other")).otherwise(F.col(c)).alias(c) for c in features])
        base = model.transform(_assembled(held, features)).agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("base"))
        part = model.transform(_assembled(swapped, features)).groupBy("feature", "repeat").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae")).crossJoin(F.broadcast(base)).select("feature", F.lit(f).alias("fold"), (F.col("mae") - F.col("base")).alias("rise"))
        out = part if out is None else out.unionByName(part)
    per = out.groupBy("feature", "fold").agg(F.avg("rise").alias("rise"), F.stddev_samp("rise").alias("sd"))
    return per.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_samp("rise").alias("fold_sd"), F.avg("sd").alias("repeat_sd"))


def importance_across_k(importances: DataFrame) -> DataFrame:
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance"), F.count("*").alias("n_k"))


def novel_configs(observed: DataFrame, levels: dict[str, list[float]]) -> DataFrame:
    """All combinations of the declared levels that no observed row has."""
    tables = [observed.sparkSession.createDataFrame([(float(v),) for v in values], f"`{c}` double") for c, values in levels.items()]
    rows = reduce(DataFrame.crossJoin, tables)
    return rows.join(observed.select(*[F.col(c).cast("double").alias(c) for c in levels]).distinct(), list(levels), "left_anti")


def future_proposals(rows: DataFrame, features: list[str], target: str, levels: dict[str, list[float]], best: int = 20, limit: int = 10, trees: int = 5, depth: int = 3) -> DataFrame:
    """One-feature changes of the best fitted rows, not observed yet, scored by the model; the best first."""
    model = _model(_assembled(rows, features), features, target, trees, depth)
    top = model.transform(_assembled(rows, features)).orderBy(F.desc("prediction"), "strategy").limit(best).select(*features)
    changed = [top.select(*[F.explode(F.array(*[F.lit(float(v)) for v in levels[c]])).alias(c) if n == c else F.col(n) for n in features]) for c in features]
    new = changed[0]
    for c in changed[1:]:
        new = new.unionByName(c)
    new = new.distinct().join(rows.select(*features).distinct(), features, "left_anti")
    return model.transform(_assembled(new, features)).select(*features, "prediction").orderBy(F.desc("prediction"), *features).limit(limit)
