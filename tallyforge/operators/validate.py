"""Validation: each check gives the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_contract_violations(games: DataFrame) -> DataFrame:
    """rule, rows: how many games break each rule of the row contract. games has k, strategies, scores and ranks (arrays by seat),
    seat_ranks (seats in finishing order), winner_seat, winning_score, margin, safety, n_rounds."""
    c, size = F.col, F.size
    ranked = F.transform(F.array_sort(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), (i + 1).alias("seat")))), lambda x: x["seat"])
    done = ~c("safety")
    rules = {
        "k_mismatch": size("strategies") != c("k"), "null_strategy": F.exists("strategies", lambda x: x.isNull()), "null_score": F.exists("scores", lambda x: x.isNull()), "id_range": F.exists("strategies", lambda x: (x < 0) | (x > 2**31 - 1)),
        "repeated_strategy": size(F.array_distinct("strategies")) != c("k"), "no_rounds": c("n_rounds").isNull() | (c("n_rounds") < 0),
        "winner_missing": done & c("winner_seat").isNull(), "winner_not_first": done & (c("winner_seat") != F.get("seat_ranks", 0)), "rank_permutation": done & (F.array_sort("ranks") != F.sequence(F.lit(1), c("k").cast("int"))),
        "rank_order": done & (F.transform("seat_ranks", lambda s: s.cast("int")) != F.transform(ranked, lambda s: s.cast("int"))), "winning_score": done & (c("winning_score") != F.array_max("scores")),
        "margin": done & (c("margin") != F.array_max("scores") - F.get(F.sort_array("scores", False), 1)), "safety_has_winner": c("safety") & c("winner_seat").isNotNull(), "safety_has_margin": c("safety") & c("margin").isNotNull(), "safety_has_ranks": c("safety") & (size("seat_ranks") > 0),
    }
    flags = games.agg(*[F.sum(F.coalesce(v, F.lit(False)).cast("long")).alias(k) for k, v in rules.items()])
    return flags.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(k, F.lit(0)).alias("rows")) for k in rules])))


def negative_columns(df: DataFrame, exempt: tuple[str, ...] = ("loss_margin",)) -> DataFrame:
    """column, minimum of whole-number columns with a negative value."""
    whole = [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint") and n not in exempt]
    if not whole:
        return df.sparkSession.createDataFrame([], "column string, minimum long")
    low = df.agg(*[F.min(c).cast("long").alias(c) for c in whole])
    return low.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("minimum")) for c in whole]))).where("minimum < 0")


def rowcount_reconcile(games: DataFrame) -> DataFrame:
    """Rows per k with the total over all k, from one grouping pass."""
    return games.groupingSets([["k"], []], "k").agg(F.count("*").alias("rows"))


def rectangular_support(metrics: DataFrame) -> DataFrame:
    """Per root and k: declared cells of the strategy x batch grid, those with and without exposures, repeated and missing ones."""
    cells = metrics.groupBy("root", "k", "batch", "strategy").agg(F.count("*").alias("copies"), F.sum("exposures").alias("exposures"))
    grid = cells.select("root", "k", "batch").distinct().join(cells.select("root", "k", "strategy").distinct(), ["root", "k"])
    x = grid.join(cells, ["root", "k", "batch", "strategy"], "left")
    return x.groupBy("root", "k").agg(F.count("*").alias("cells"), F.count("copies").alias("declared"), F.sum(F.when(F.col("exposures") > 0, 1).otherwise(0)).alias("positive"), F.sum(F.when(F.col("exposures") <= 0, 1).otherwise(0)).alias("zero"), F.sum(F.when(F.col("copies") > 1, 1).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("copies").isNull(), 1).otherwise(0)).alias("missing"))


def zero_filled(metrics: DataFrame, columns: tuple[str, ...] = ("wins", "exposures", "completed", "safety_exposures", "losses")) -> DataFrame:
    """The full strategy x batch grid of each root and k; missing cells are declared with zeros."""
    grid = metrics.select("root", "k", "batch").distinct().join(metrics.select("root", "k", "strategy").distinct(), ["root", "k"])
    x = grid.join(metrics.select("root", "k", "batch", "strategy", *columns), ["root", "k", "batch", "strategy"], "left")
    return x.na.fill(0, list(columns))


def rank_row_classify(games: DataFrame) -> DataFrame:
    """game, class: completed with valid ranks 1..k is rated, a safety-limit game without ranks is excluded, the rest is an error."""
    valid = F.array_sort("ranks") == F.sequence(F.lit(1), F.col("k").cast("int"))
    return games.select("game", F.when(~F.col("safety") & valid, "rated").when(F.col("safety") & (F.size("seat_ranks") == 0), "excluded").otherwise("error").alias("class"))


def rating_support_issues(ratings: DataFrame) -> DataFrame:
    """Rows of a rating table whose counts do not add up, whose status and updates disagree, or whose cell total is off."""
    cell = F.sum("updates").over(Window.partitionBy("root", "k"))
    x = ratings.withColumn("cell_sum", cell)
    issue = F.when(F.col("attempted") != F.col("completed") + F.col("excluded"), "counts").when((F.col("status") == "rated") != (F.col("updates") > 0), "status").when(F.col("cell_sum") != F.col("cell_updates"), "cell_total")
    return x.select("root", "k", "strategy", issue.alias("issue")).where("issue is not null")


def wide_contract_violations(wide: DataFrame, seats: int) -> DataFrame:
    """rule, rows: how many wide rows (see reshape.schema_for) break each rule on their coordinates, seats, winner, ranks and margins.
    Coordinates are root, k and game. One pass and one shuffle: rows are counted by the set of rules they break, and by coordinates."""
    c, at = F.col, range(1, seats + 1)
    seat = lambda name: F.array(*[F.col(f"P{i}_{name}") for i in at])
    used = lambda name: F.slice(seat(name), 1, F.greatest(F.least(c("k").cast("int"), F.lit(seats)), F.lit(0)))
    rest = lambda name: F.slice(seat(name), F.greatest(c("k").cast("int"), F.lit(0)) + 1, F.lit(seats))
    some, every = (lambda a: F.exists(a, lambda x: x.isNotNull())), (lambda a: F.forall(a, lambda x: x.isNotNull()))
    number, done = F.nullif(F.regexp_extract("winner_seat", r"^P(\d+)$", 1), F.lit("")).cast("int"), ~c("safety")
    best = F.array_max(used("score"))
    rules = {
        **{f"null_{name}": c(name).isNull() for name in ("root", "k", "batch", "game", "n_rounds", "safety")},
        "k_range": ~c("k").between(2, seats), "no_rounds": c("n_rounds") < 0, "seat_without_strategy": ~every(used("strategy")), "seat_without_score": ~every(used("score")),
        "seat_beyond_k": some(rest("strategy")) | some(rest("score")) | some(rest("rank")), "id_range": F.exists(seat("strategy"), lambda x: x < 0), "no_turns": F.exists(seat("n_turns"), lambda x: x < 0),
        "winner_form": c("winner_seat").isNotNull() & number.isNull(), "winner_range": ~number.between(1, c("k")), "winner_rank": done & (F.get(seat("rank"), number - 1) != 1), "winner_missing": done & c("winner_seat").isNull(),
        "rank_missing": done & ~every(used("rank")), "rank_permutation": done & (F.array_sort(F.transform(used("rank"), lambda x: x.cast("int"))) != F.sequence(F.lit(1), c("k").cast("int"))),
        "loss_margin": done & F.exists(F.zip_with(used("loss_margin"), used("score"), lambda m, s: ~m.eqNullSafe(best - s)), lambda x: x),
        "safety_has_winner": c("safety") & c("winner_seat").isNotNull(), "safety_has_ranks": c("safety") & some(seat("rank")), "safety_has_margins": c("safety") & some(seat("loss_margin")),
    }
    bits = {name: F.lit(1 << i) for i, name in enumerate(rules)}
    broken = reduce(Column.bitwiseOR, [F.when(v, bits[name]).otherwise(0).cast("long") for name, v in rules.items()])
    g = wide.select("root", "k", "game", broken.alias("broken")).groupingSets([["broken"], ["root", "k", "game"]], "broken", "root", "k", "game").agg(F.count("*").alias("n"), F.grouping("broken").alias("by_coordinates"))
    hits = {name: (F.col("by_coordinates") == 0) & (F.col("broken").bitwiseAND(bit) != 0) for name, bit in bits.items()} | {"repeated_coordinates": (F.col("by_coordinates") == 1) & (F.col("n") > 1)}
    totals = g.agg(*[F.sum(F.when(v, F.col("n")).otherwise(0)).alias(name) for name, v in hits.items()])
    return totals.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(name, F.lit(0)).alias("rows")) for name in hits])))


#: Identifiers are whole numbers of any width from 0 to this.
LARGEST_ID = 2**31 - 1


def id_issues(df: DataFrame, columns: list[str], nullable: tuple[str, ...] = ()) -> DataFrame:
    """column, issue, rows: identifier columns that are no whole-number columns (text, floats and flags are never parsed; rows NULL), and rows
    with a NULL, negative or too large identifier. One pass for all columns."""
    kinds = dict(df.dtypes)
    whole = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint")]
    spark = df.sparkSession
    wrong = spark.createDataFrame([(c, "wrong_type", None) for c in columns if c not in whole], "column string, issue string, rows long")
    if not whole:
        return wrong
    of = {"null": lambda c: F.col(c).isNull(), "negative": lambda c: F.col(c) < 0, "too_large": lambda c: F.col(c) > LARGEST_ID}
    checks = [(c, issue, test(c)) for c in whole for issue, test in of.items() if not (issue == "null" and c in nullable)]
    counts = df.agg(*[F.sum(F.coalesce(test, F.lit(False)).cast("long")).alias(f"n{i}") for i, (*_, test) in enumerate(checks)])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(issue).alias("issue"), F.col(f"n{i}").alias("rows")) for i, (c, issue, _) in enumerate(checks)])))
    return wrong.unionByName(rows.where("rows > 0"))


def canonical_ids(df: DataFrame, columns: list[str], nullable: tuple[str, ...] = ()) -> DataFrame:
    """The rows with these columns as int; an issue of id_issues is an error."""
    if found := [tuple(r) for r in id_issues(df, columns, nullable).collect()]:
        raise ValueError(f"identifiers are not canonical: {found}")
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def smallest_integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with these whole-number columns in the smallest signed type that holds all their values; columns without a value
    become tinyint. One pass for the ranges."""
    ends = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("low", F.min), ("high", F.max))]).first()
    types = {}
    for i, c in enumerate(columns):
        low, high = ends[f"low{i}"] or 0, ends[f"high{i}"] or 0
        types[c] = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**bits) <= low and high < 2**bits)
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
