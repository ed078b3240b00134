"""Wide game rows and the long exposure table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEAT_COLUMNS = {"score": T.IntegerType(), "strategy": T.IntegerType(), "rank": T.ByteType(), "loss_margin": T.IntegerType(), "n_turns": T.ShortType()}
GAME_COLUMNS = {"root": T.LongType(), "k": T.ShortType(), "batch": T.IntegerType(), "game": T.LongType(), "n_rounds": T.ShortType(), "safety": T.BooleanType(), "winner_seat": T.StringType()}


def schema_for(k: int) -> T.StructType:
    """Wide rows of k seats: game columns, then P<i>_<column> by seat; all may be NULL."""
    seats = [T.StructField(f"P{i}_{c}", t) for i in range(1, k + 1) for c, t in SEAT_COLUMNS.items()]
    return T.StructType([T.StructField(c, t) for c, t in GAME_COLUMNS.items()] + seats)


def curated(df: DataFrame, k: int) -> DataFrame:
    """The rows cast to the schema of k seats; an absent column is an error, others are dropped."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema_for(k)])


def combine_k(parts: dict[int, DataFrame], seats: int | None = None) -> DataFrame:
    """All rows of all k, later seats padded with NULL."""
    full = schema_for(seats or max(parts))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df for _, df in sorted(parts.items())))
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in full])


def exposures(wide: DataFrame, k: int) -> DataFrame:
    """One row per game and occupied seat; winner_seat as a number."""
    seats = F.array(*[F.struct(F.lit(i).alias("seat"), *[F.col(f"P{i}_{c}").alias(c) for c in SEAT_COLUMNS]) for i in range(1, k + 1)])
    games = [c for c in GAME_COLUMNS if c != "winner_seat"]
    return wide.select(*games, winner_number("winner_seat").alias("winner_seat"), F.inline(seats)).where("strategy is not null")


def widened(exposed: DataFrame, k: int) -> DataFrame:
    """The wide rows of k seats from exposures."""
    x = exposed.where(F.col("k") == k)
    first = [F.first(c).alias(c) for c in GAME_COLUMNS if c not in ("game", "winner_seat")]
    cells = [F.max(F.when(F.col("seat") == i, F.col(c))).alias(f"P{i}_{c}") for i in range(1, k + 1) for c in SEAT_COLUMNS]
    g = x.groupBy("game").agg(*first, F.concat(F.lit("P"), F.first("winner_seat").cast("string")).alias("winner_seat"), *cells)
    return curated(g, k)


def gathered(exposed: DataFrame, seats: int, coordinates: tuple[str, ...] = ("root", "k", "game")) -> DataFrame:
    """The wide rows of all games of at most `seats` seats, in one grouping: what combine_k makes of the widened rows of each k. A game is
    told by the coordinates; where its rows lie together by these already, nothing is shuffled."""
    plain = [c for c in GAME_COLUMNS if c != "winner_seat"]
    first = [F.first(c).alias(c) for c in plain if c not in coordinates]
    cells = [F.max(F.when(F.col("seat") == i, F.col(c).cast(t))).alias(f"P{i}_{c}") for i in range(1, seats + 1) for c, t in SEAT_COLUMNS.items()]
    g = exposed.where(F.col("k") <= seats).groupBy(*coordinates).agg(*first, F.first("winner_seat").alias("winner_seat"), *cells)
    return curated(g.withColumn("winner_seat", F.concat(F.lit("P"), F.col("winner_seat").cast("string"))), seats)


def winner_number(col: str):
    """P3 -> 3; anything else is NULL."""
    return F.nullif(F.regexp_extract(col, r"^P(\d+)$", 1), F.lit("")).cast("int")


def winner_decode(wide: DataFrame, k: int) -> DataFrame:
    """game, winner_seat (number) and the winner's strategy."""
    seat = winner_number("winner_seat")
    return wide.select("game", seat.alias("winner_seat"), F.get(F.array(*[F.col(f"P{i}_strategy") for i in range(1, k + 1)]), seat - 1).alias("winner_strategy"))


def parse_strategy_text(df: DataFrame, col: str) -> DataFrame:
    """Columns of a strategy's literal form, Strat(300,2)[SD][FO][AND][H-]: two thresholds and four bracketed groups; parsed is false
    for a text of another form."""
    form = r"^Strat\((\d+),(\d+)\)\[([^\]]*)\]\[([^\]]*)\]\[([^\]]*)\]\[([^\]]*)\]$"
    ok = F.coalesce(F.rlike(col, F.lit(form)), F.lit(False))
    part = lambda i: F.when(ok, F.regexp_extract(col, form, i))
    return df.select("*", ok.alias("parsed"), part(1).cast("int").alias("score_threshold"), part(2).cast("int").alias("dice_threshold"), *[part(i + 3).alias(n) for i, n in enumerate(("smart", "favor", "logic", "hot"))])
