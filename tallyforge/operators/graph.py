"""Dominance graphs of finalists: edges, round-robin scores, cycles, fronts. Graphs have as many nodes as there are finalists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.folders import settled


def win_edges(decisions: DataFrame, delta: float = 0.03) -> DataFrame:
    """src, dst, kind (practical or statistical), distance of the deciding bound beyond the threshold. Every practical edge is a
    statistical one as well."""
    a = F.col("decision").endswith("_a")
    side = decisions.where(F.col("decision").startswith("practical") | F.col("decision").startswith("statistical")).select(F.when(a, F.col("strategy_a")).otherwise(F.col("strategy_b")).alias("src"), F.when(a, F.col("strategy_b")).otherwise(F.col("strategy_a")).alias("dst"), F.col("decision").startswith("practical").alias("practical"), F.when(a, F.col("s_low")).otherwise(-F.col("s_high")).alias("bound"))
    statistical = side.select("src", "dst", F.lit("statistical").alias("kind"), F.col("bound").alias("distance"))
    return statistical.unionByName(side.where("practical").select("src", "dst", F.lit("practical").alias("kind"), (F.col("bound") - delta).alias("distance")))


def round_robin_scores(decisions: DataFrame) -> DataFrame:
    """Per node: mean pairwise rate, practical wins, losses and net, eligibility (all its pairs complete)."""
    d = F.col("decision")
    a = decisions.select(F.col("strategy_a").alias("strategy"), F.col("balanced_rate").alias("rate"), (d == "practical_dominance_a").alias("won"), (d == "practical_dominance_b").alias("lost"), "complete")
    b = decisions.select(F.col("strategy_b").alias("strategy"), (1 - F.col("balanced_rate")).alias("rate"), (d == "practical_dominance_b").alias("won"), (d == "practical_dominance_a").alias("lost"), "complete")
    g = a.unionByName(b).groupBy("strategy").agg(F.avg("rate").alias("mean_rate"), F.sum(F.col("won").cast("int")).alias("wins"), F.sum(F.col("lost").cast("int")).alias("losses"), F.bool_and("complete").alias("eligible"))
    return g.withColumn("net", F.col("wins") - F.col("losses"))


def _trimmed(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges (src, dst) without those of nodes that nothing leads to or that lead nowhere: such nodes are on no cycle. As often as
    that takes edges away, at most `rounds` times."""
    edges = settled(edges)
    size = edges.count()
    for _ in range(rounds):
        inner = edges.select("src").intersect(edges.select(F.col("dst").alias("src")))
        edges = settled(edges.join(inner, "src", "left_semi").join(inner.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        if (now := edges.count()) in (0, size):
            break
        size = now
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """strategy, colour of the nodes of edges (src, dst): the smallest node that leads there, itself included. The colours go
    along the edges until none changes; a round moves each colour on by two edges, over a table as long as the nodes."""
    push = lambda now: now.join(edges, now["strategy"] == edges["src"]).select(F.col("dst").alias("strategy"), "colour")
    now = settled(edges.select(F.col("src").alias("strategy")).union(edges.select("dst")).distinct().withColumn("colour", F.col("strategy")))
    while True:
        one = now.union(push(now)).groupBy("strategy").agg(F.min("colour").alias("colour"))
        two = now.withColumnRenamed("colour", "was").join(one.union(push(one)).groupBy("strategy").agg(F.min("colour").alias("colour")), "strategy")
        two = settled(two)
        now = two.select("strategy", "colour")
        if two.where("colour < was").isEmpty():
            return now


def cycle_groups(edges: DataFrame, nodes: DataFrame, trims: int = 3) -> DataFrame:
    """strategy, component (the smallest member) and size of the strongly connected components: nodes that reach each other.

    Nodes that are on no cycle are trimmed. Every other one takes as its colour the smallest node that leads to it; of the nodes of
    a colour, those that lead back to it are its component. They go, and the rest is coloured again. No table has
    more rows than there are edges or nodes. Repeated edges and loops change nothing.
    """
    links, found = settled(edges.where("src != dst").select("src", "dst").distinct()), None
    while True:
        links = _trimmed(links, trims)
        if links.isEmpty():
            break
        colour = _coloured(links)
        ends = [colour.select(F.col("strategy").alias(x), F.col("colour").alias(f"{x}_colour")) for x in ("src", "dst")]
        inside = settled(links.join(ends[0], "src").join(ends[1], "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("component")))
        back = settled(colour.where("strategy = colour").select("strategy", F.col("colour").alias("component")))
        front = back
        while True:  # backwards from each colour's own node, within the colour
            step = inside.join(front, (inside["dst"] == front["strategy"]) & (inside["component"] == front["component"])).select(F.col("src").alias("strategy"), inside["component"]).distinct()
            front = settled(step.join(back, ["strategy", "component"], "left_anti"))
            if front.isEmpty():
                break
            back = settled(back.union(front))
        found = back if found is None else settled(found.union(back))
        out = back.select(F.col("strategy").alias("src"))
        links = settled(links.join(out, "src", "left_anti").join(out.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    groups = nodes.withColumn("component", F.col("strategy")) if found is None else nodes.join(found, "strategy", "left").select("strategy", F.coalesce("component", "strategy").alias("component"))
    return groups.withColumn("size", F.count("*").over(Window.partitionBy("component")))


def dominance_fronts(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """strategy, component, front: a component's front is 1 + the longest path of components that leads to it."""
    of = groups.select("strategy", "component")
    links = edges.join(of.withColumnRenamed("strategy", "src").withColumnRenamed("component", "a"), "src").join(of.withColumnRenamed("strategy", "dst").withColumnRenamed("component", "b"), "dst").where("a != b").select("a", "b").distinct()
    links, front = settled(links), settled(of.select("component").distinct().withColumn("front", F.lit(1)))
    while True:
        push = links.join(front.withColumnRenamed("component", "a"), "a").groupBy("b").agg((F.max("front") + 1).alias("pushed")).withColumnRenamed("b", "component")
        new = settled(front.join(push, "component", "left").select("component", F.greatest("front", F.coalesce("pushed", "front")).alias("front"), (F.coalesce("pushed", "front") > F.col("front")).alias("moved")))
        front = new.select("component", "front")
        if new.where("moved").isEmpty():
            return groups.join(front, "component").select("strategy", "component", "front")


def fronts_display(fronts: DataFrame, scores: DataFrame, screening: DataFrame) -> DataFrame:
    """Order within a front: mean rate, net wins, screening score, id."""
    x = fronts.join(scores, "strategy").join(screening.select("strategy", "score"), "strategy", "left")
    return x.withColumn("place", F.row_number().over(Window.partitionBy("front").orderBy(F.desc(F.round("mean_rate", 9)), F.desc("net"), F.desc_nulls_last(F.round("score", 9)), "strategy")))


def shortest_cycles(inner: DataFrame) -> DataFrame:
    """component, cycle of the edges (component, src, dst) of strongly connected components: the nodes of a cycle of fewest edges, from its
    smallest node on; of equal ones the first in the order of nodes.

    From each node backwards goes a frontier over larger nodes (a cycle is found from its smallest one), with distances; a
    component's frontiers end when one of them meets an edge from its own root. Then one walk leads from the smallest such root,
    always to the smallest node that is near enough to close the cycle in the edges that are left.
    """
    step = inner.select("component", F.col("src").alias("to"), F.col("dst").alias("node"))
    front = inner.where("src > dst").select("component", F.col("dst").alias("root"), F.col("src").alias("node"), F.lit(1).alias("far"))
    front = settled(front)
    near, closed = front, None
    open_at = 1
    while not front.isEmpty():
        hit = front.join(inner.select("component", F.col("src").alias("root"), F.col("dst").alias("node")), ["component", "root", "node"])
        done = settled(hit.groupBy("component").agg(F.min("root").alias("root"), F.lit(open_at + 1).alias("edges")))
        closed = done if closed is None else closed.union(done)
        go = front.join(done.select("component"), "component", "left_anti")
        grown = go.join(step, ["component", "node"]).where("to > root").select("component", "root", F.col("to").alias("node")).distinct()
        open_at += 1
        front = settled(grown.join(near, ["component", "root", "node"], "left_anti").select("component", "root", "node", F.lit(open_at).alias("far")))
        near = settled(near.union(front))
    kind = inner.schema["src"].dataType.simpleString()
    if closed is None:
        return inner.sparkSession.createDataFrame([], f"component {inner.schema['component'].dataType.simpleString()}, cycle array<{kind}>")
    walk, out = settled(closed.select("component", "root", "edges", F.col("root").alias("at"), F.array("root").alias("cycle"))), None
    while not walk.isEmpty():
        over = walk.where(F.size("cycle") == F.col("edges")).select("component", "cycle")
        out = over if out is None else out.union(over)
        left = walk.where(F.size("cycle") < F.col("edges"))
        there = left.join(inner.select("component", F.col("src").alias("at"), F.col("dst").alias("node")), ["component", "at"]).join(near, ["component", "root", "node"]).where(F.col("far") == F.col("edges") - F.size("cycle"))
        walk = settled(there.groupBy("component", "root", "edges", "cycle").agg(F.min("node").alias("at")).select("component", "root", "edges", "at", F.concat("cycle", F.array("at")).alias("cycle")))
    return out


def cycle_report(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per component of several nodes: size, members, weakest and strongest internal edge, and the canonical shortest cycle: fewest
    edges, then the smallest after rotation to its smallest member."""
    big = groups.where("size > 1").select("strategy", "component")
    inner = edges.where("src != dst").join(big.withColumnRenamed("strategy", "src"), "src").join(big.select(F.col("strategy").alias("dst"), F.col("component").alias("c2")), "dst").where("component = c2").select("component", "src", "dst", "distance")
    inner = settled(inner)
    stats = inner.groupBy("component").agg(F.min(F.struct("distance", "src", "dst")).alias("weak"), F.max_by(F.struct("distance", "src", "dst"), F.struct("distance", -F.col("src"), -F.col("dst"))).alias("strong"))
    members = big.groupBy("component").agg(F.array_sort(F.collect_list("strategy")).alias("members"))
    found = shortest_cycles(inner.select("component", "src", "dst").distinct())
    return members.join(stats, "component").join(found, "component", "left").select("component", F.size("members").alias("size"), "members", F.col("weak.distance").alias("weakest"), F.col("strong.distance").alias("strongest"), "cycle")


def unique_best(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """The eligible node with a practical edge to every other one; no row if there is none."""
    n = scores.agg((F.count("*") - 1).alias("others"))
    wins = edges.where("kind = 'practical'").groupBy("src").agg(F.countDistinct("dst").alias("beats"))
    return wins.join(scores.where("eligible"), wins["src"] == scores["strategy"]).crossJoin(F.broadcast(n)).where("beats = others").select("strategy", "beats")


def pair_family_issues(pairs: DataFrame) -> DataFrame:
    """Issues of a pair table: self pairs, repeated pair ids, repeated unordered pairs, pairs of the family that are absent."""
    low, high = F.least("strategy_a", "strategy_b"), F.greatest("strategy_a", "strategy_b")
    x = pairs.select("pair_id", low.alias("low"), high.alias("high"))
    own = x.where("low = high").select(F.lit("self_pair").alias("issue"), "low", "high")
    ids = x.join(x.groupBy("pair_id").count().where("count > 1"), "pair_id", "left_semi").select(F.lit("repeated_id").alias("issue"), "low", "high")
    twice = x.groupBy("low", "high").count().where("count > 1").select(F.lit("repeated_pair").alias("issue"), "low", "high")
    nodes = x.select("low").union(x.select("high")).distinct().toDF("s")
    all_pairs = nodes.select(F.col("s").alias("low")).join(nodes.select(F.col("s").alias("high")), F.col("low") < F.col("high"))
    gone = all_pairs.join(x, ["low", "high"], "left_anti").select(F.lit("absent").alias("issue"), "low", "high")
    return own.union(ids).union(twice).union(gone)


#: The classes that decision() gives.
CLASSES = ("unresolved_nonviable", "practical_dominance_a", "practical_dominance_b", "statistical_only_advantage_a", "statistical_only_advantage_b", "equivalent", "unresolved")


def decision_family_issues(decisions: DataFrame, scores: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """issue, strategy (NULL where it is the table's), n: unknown decision classes, finalists that have not been compared with every other one (n: how
    often they were), finalists without exactly one score of complete support (n: how many they have), and more than one family where
    the pairs carry a family_hash. decisions: pair_id, strategy_a, strategy_b, decision; scores: strategy, complete. Nothing is
    paired: the comparisons of a finalist are counted."""
    none = F.lit(None).cast(decisions.schema["strategy_a"].dataType)
    other = decisions.where(~F.col("decision").isin(*classes)).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("unknown_decision").alias("issue"), none.alias("strategy"), "n")
    sides = decisions.select(F.col("strategy_a").alias("strategy"), F.col("strategy_b").alias("other")).union(decisions.select("strategy_b", "strategy_a")).where("strategy != other")
    met = sides.groupBy("strategy").agg(F.countDistinct("other").alias("n"))
    lone = met.crossJoin(F.broadcast(met.agg((F.count("*") - 1).alias("others")))).where("n != others").select(F.lit("incomplete").alias("issue"), "strategy", "n")
    whole = scores.where("complete").groupBy("strategy").agg(F.count("*").alias("n"))
    bare = met.select("strategy").join(whole, "strategy", "left").select(F.lit("scores").alias("issue"), "strategy", F.coalesce("n", F.lit(0)).alias("n")).where("n != 1")
    out = other.unionByName(lone).unionByName(bare)
    if "family_hash" in decisions.columns:
        out = out.unionByName(decisions.agg(F.countDistinct("family_hash").alias("n")).where("n > 1").select(F.lit("families").alias("issue"), none.alias("strategy"), "n"))
    return out
