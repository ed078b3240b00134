"""Connected components of an edge table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import written


def followed(labels: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """labels (id, comp, any others) after each map (id, comp) in turn has sent the labels that it has elsewhere."""
    others = labels.columns[2:]
    for m in maps:
        m = m.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        labels = labels.join(m, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"), *others)
    return labels


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, comp (the smallest id that is reachable) for each id in edges (a, b).

    Contraction: each id moves to its smallest neighbour, or that one's, and the links are rewritten; those inside one
    place and repeated ones go. So links shrink from round to round, and a star is done after one. Each round is a
    written table. Self links keep an id without other links. No edges: no rows.
    """
    links, maps = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), []
    for _ in range(rounds):
        both = links.union(links.select("b", "a"))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("m")), "hooks")
        far = hook.select(F.col("id").alias("m"), F.col("m").alias("comp"))
        maps.append(written(hook.join(far, "m").select("id", "comp"), "places"))
        at = [maps[-1].select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
        moved = links.where("a != b").join(at[0], "a").join(at[1], "b").where("ca != cb")
        links = written(moved.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return followed(maps[0], maps[1:])
    raise RuntimeError("the links did not contract")
