"""Mixing sources to target weights (operator 2) by hierarchical budgeting.

A budget of tokens goes down a tree of levels (domain, language, source). Among siblings it is shared by weight; a
child that has less than its share keeps what it has, and the shortage goes to its siblings. As a node never gets more
than its subtree can give, what the siblings cannot take has gone to the ancestors' siblings. A leaf then takes whole
epochs of its documents and the token-prefix of one more, seeded epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import written

#: Most times that a document is repeated; buckets of the shuffled order.
EPOCHS, DIGITS = 4, 4
#: Leaves are looked up by a plain join; Spark broadcasts their written table only below its own size limit.


def word_count(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(path: list[str], weights: dict[tuple[str, ...], int]) -> Column:
    """The declared weight of a node, else 1."""
    mine = [(k, w) for k, w in sorted(weights.items()) if len(k) == len(path)]
    out = F.lit(1)
    for key, w in mine:
        hit = F.lit(True)
        for c, v in zip(path, key):
            hit = hit & (F.col(c) == F.lit(v))
        out = F.when(hit, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, name, w, cap, budget of the parent) with `give`: shares by weight, capped, with the rest
    redistributed; rounded down to whole tokens."""
    by = Window.partitionBy(*parent, "budget").orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = children.withColumn("left", (F.col("budget") - before).cast("double")).withColumn("sw", after.cast("double"))
    rows = rows.withColumn("full", F.col("cap").cast("double") * F.col("sw") <= F.col("w").cast("double") * F.col("left"))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("sw"))).over(Window.partitionBy(*parent, "budget"))
    give = F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.floor(F.col("w").cast("double") * level), F.lit(0))).cast("long")
    return rows.withColumn("give", give).drop("left", "sw", "full")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: int, epochs: int = EPOCHS) -> DataFrame:
    """leaves (levels, have) with `give`, the tokens that each is to contribute. Weights of 0 take a subtree out."""
    tree = leaves.withColumn("room", F.col("have") * epochs)
    zero = F.lit(False)
    for depth in range(len(levels)):
        zero = zero | (_weight(levels[: depth + 1], weights) == 0)
    tree = tree.withColumn("room", F.when(zero, F.lit(0)).otherwise(F.col("room")))
    given = None
    for depth, name in enumerate(levels):
        path = levels[: depth + 1]
        nodes = tree.groupBy(*path).agg(F.sum("room").alias("cap")).withColumn("w", F.greatest(_weight(path, weights), F.lit(1)))
        nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("long")) if given is None else nodes.join(given, levels[:depth])
        given = fill(nodes, levels[:depth], name).select(*path, F.col("give").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "give"), levels)


def mixed(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple[str, ...], int], share: tuple[int, int] = (6, 10), epochs: int = EPOCHS, seed: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the mixture: the columns of docs, then mix_<level> for each level, n_tokens (words) and epoch (from 0).

    The budget is share[0] / share[1] of all tokens. levels names the tree from the root down with an expression each;
    NULL counts as the empty name. weights maps paths of names to whole weights; a node without one has 1. A leaf takes
    as many whole epochs as its budget holds and, of the next one, the documents in a seeded order as long as their sum
    does not exceed the rest. A document without tokens adds nothing and comes along where it stands in that order; a
    leaf without tokens gives no rows. Repeated rows count one by one. Columns of docs that are named like the output's own
    (mix_<level>, n_tokens, epoch, in any case) are left out; other names cannot clash. Order is by md5 of seed, epoch and id (of a
    NULL id, of the text); ties by id and text.
    """
    names = [f"mix_{k}" for k in levels]
    own = {c.lower() for c in (*names, "n_tokens", "epoch")}  # Spark tells names apart without their case
    kept_cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    rows = docs.select(F.struct(*kept_cols).alias("doc"), F.col(id_col).alias("doc_key"), F.coalesce(text_col, F.lit("")).alias("doc_text"), *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())], word_count(F.col(text_col)).alias("n_tokens"))
    leaves = written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("have")), "leaves")
    budget = int(leaves.agg(F.sum("have")).first()[0] or 0) * share[0] // share[1]
    plan = budgets(leaves, names, weights, budget, epochs).where("have > 0 and give > 0").select(*names, "have", F.floor(F.col("give") / F.col("have")).cast("int").alias("whole"), (F.col("give") % F.col("have")).alias("rest"))
    plan = written(plan, "plan")

    def ordered(leaf: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_key").cast("string"), F.md5("doc_text"))))
        return rows.join(leaf, names).withColumn("mix_key", key)

    sums = ordered(plan).groupBy(*names, "rest", F.substring("mix_key", 1, DIGITS).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    cut = sums.where("upto > rest").groupBy(*names).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("cut"))
    plan = written(plan.join(cut, names, "left").select(*names, "whole", "rest", F.col("cut.bucket").alias("mix_cut"), F.col("cut.before").alias("mix_before")), "plan")

    all_rows = ordered(plan).withColumn("mix_at", F.substring("mix_key", 1, DIGITS))
    clear = all_rows.where("mix_at != mix_cut").withColumn("mix_n", F.col("whole") + (F.col("mix_at") < F.col("mix_cut")).cast("int"))
    order = Window.partitionBy(*names).orderBy("mix_key", "doc_key", F.md5("doc_text")).rowsBetween(Window.unboundedPreceding, 0)
    edge = all_rows.where("mix_at = mix_cut").withColumn("mix_n", F.col("whole") + (F.col("mix_before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("int"))
    kept = clear.unionByName(edge).where("mix_n > 0")
    return kept.select("doc.*", *names, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)).alias("epoch"))
