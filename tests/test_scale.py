"""Operators that must hold for large groups, against brute force: ranges with halo rows, matrix products, components by colours, shortest
cycles by frontiers, inversions, rank selection, skylines, strengths by lookup."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import folders
from tallyforge.operators import gamestats, graph, lag, performance, quantiles, ratings, resample, reshape, stability, validate
from tallyforge.plans import contest
from tallyforge.sources import files


# lags
def by_hand(values, step):
    x = [(values[i], values[i - step]) for i in range(step, len(values)) if values[i] is not None and values[i - step] is not None]
    a, b = np.array([p for p, _ in x], float), np.array([q for _, q in x], float)
    return len(x), float(np.corrcoef(a, b)[0, 1]) if len(x) > 1 and a.std() > 0 and b.std() > 0 else None


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_lags_over_the_borders_of_ranges(spark, ranges):
    rng = random.Random(3)
    groups = {("hot", None): 500, ("a", 1): 1, ("a", 2): 3, ("b", 1): 40, ("b", None): 7, ("c", 5): 12}
    series = {g: [rng.choice([None, *range(-5, 9)]) for _ in range(n)] for g, n in groups.items()}
    rows = [(*g, i, x) for g, xs in series.items() for i, x in enumerate(xs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, k int, i int, x int")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = lag.range_sums(df, ["s", "k"], ["i"], F.col("x"), (1, 3, 30)).collect()
        got = {(r["s"], r["k"], r["lag"]): r for r in lag.lag_autocorrelation(df, ["s", "k"], ["i"], F.col("x"), (1, 3, 30)).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    borders = [r["border"]["part"] for r in parts if r["border"] is not None and r["s"] == "hot"]
    assert len(set(borders)) >= min(ranges, 2) and (ranges < 23 or len(set(borders)) > 15)  # the large group is many tasks
    assert max(r["observations"] for r in parts if r["s"] == "hot") <= 500 / len(set(borders)) * 3
    assert len(got) == 3 * len(groups)
    for g, xs in series.items():
        for step in (1, 3, 30):
            r, (pairs, corr) = got[(*g, step)], by_hand(xs, step)
            assert (r["observations"], r["pairs"]) == (len(xs), pairs)
            assert r["autocorr"] == (None if corr is None else pytest.approx(corr))


def test_lags_of_no_rows(spark):
    df = spark.createDataFrame([], "s string, i int, x int")
    assert lag.lag_autocorrelation(df, ["s"], ["i"], F.col("x"), (1,)).count() == 0


def test_lag_query_has_one_shuffle_of_rows(spark, sf_dir):
    plan = contest.QUERIES["lag_autocorr_events"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(user_id") == 1 and "Window" not in plan


# bootstrap
def cells(spark, seed=0):
    rng = random.Random(seed)
    rows = [(root, k, b, s, rng.randint(0, 20), 0 if (root, k, b, s) == (0, 2, 1, 3) else rng.randint(20, 40)) for root in (0, 1) for k in (2, 3) for b in range(5) for s in (3, 5, 8)]
    return rows, spark.createDataFrame(rows, "root long, k int, batch int, strategy int, wins long, exposures long")


def replicate(rows, root, rep, names=(3, 5, 8)):
    out = {}
    for s in names:
        x = []
        for k in (2, 3):
            bad = {b for r, kk, b, _, _, n in rows if (r, kk) == (root, k) and n == 0}
            good = [b for b in range(5) if b not in bad]
            take = [good[i] for i in resample.draw(root, k, rep, len(good))]
            of = {b: (w, n) for r, kk, b, ss, w, n in rows if (r, kk, ss) == (root, k, s)}
            x.append(sum(of[b][0] for b in take) / sum(of[b][1] for b in take) - 1 / k)
        out[s] = sum(x) / 2
    return out


def test_replicates_by_hand(spark):
    rows, df = cells(spark)
    got = {(r["root"], r["rep"], r["strategy"]): r["score"] for r in resample.replicate_scores(df, 70).collect()}
    want = {(root, rep, s): v for root in (0, 1) for rep in range(70) for s, v in replicate(rows, root, rep).items()}
    assert got == pytest.approx(want)
    ranks = {(root, s): [] for root in (0, 1) for s in (3, 5, 8)}
    for root, rep in itertools.product((0, 1), range(70)):
        of = {s: round(v, 9) for s, v in replicate(rows, root, rep).items()}
        for i, s in enumerate(sorted(of, key=lambda s: (-of[s], s))):
            ranks[root, s].append((i + 1, of[s] >= round(max(of.values()) - 0.03, 9)))
    for r in resample.bootstrap_ranks(df, 70, top=1).collect():
        x = ranks[r["root"], r["strategy"]]
        at = [a for a, _ in x]
        assert (r["rank_mean"], r["rank_sd"], r["top_frequency"], r["shortlist_frequency"]) == pytest.approx((np.mean(at), np.std(at), np.mean([a == 1 for a in at]), np.mean([n for _, n in x])))


def test_no_exchange_holds_rows_times_replicates(spark):
    _, df = cells(spark)
    df = folders.settled(df)
    plan = lambda n: resample.bootstrap_ranks(df, n)
    shuffled = []
    for n in (64, 640):
        out = plan(n)
        out.collect()
        text = out._jdf.queryExecution().executedPlan()
        nodes, sizes = [text], []
        while nodes:
            node = nodes.pop()
            if "ShuffleQueryStage" in node.getClass().getSimpleName():
                sizes.append(int(str(node.getRuntimeStatistics().rowCount().get())))
            nodes += [c for c in _children(node)]
        shuffled.append(max(sizes))
    assert shuffled[0] <= 60 and shuffled[1] <= 60 * 10  # cells x blocks of 64 replicates, not cells x replicates


def _children(node):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    found = node.children()
    return [found.apply(i) for i in range(found.size())]


# graphs
def closure(edges, nodes):
    reach = {n: {n} for n in nodes}
    while True:
        before = sum(map(len, reach.values()))
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n] |= reach[b]
        if before == sum(map(len, reach.values())):
            return reach


def shortest(edges, members):
    for size in range(2, len(members) + 1):
        found = [p for p in itertools.permutations(sorted(members), size) if p[0] == min(p) and all((p[i], p[(i + 1) % size]) in edges for i in range(size))]
        if found:
            return list(min(found))
    return None


@pytest.mark.parametrize("seed", range(6))
def test_components_and_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(7 + seed % 3))
    edges = {(a, b) for a in nodes for b in nodes if a != b and rng.random() < (0.12, 0.2, 0.3)[seed % 3]}
    reach = closure(edges, nodes)
    group = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    e = spark.createDataFrame([(a, b, 0.1 * a + b) for a, b in sorted(edges)], "src int, dst int, distance double")
    n = spark.createDataFrame([(i,) for i in nodes], "strategy int")
    groups = folders.settled(graph.cycle_groups(e, n))
    assert {r["strategy"]: (r["component"], r["size"]) for r in groups.collect()} == {i: (c, sum(x == c for x in group.values())) for i, c in group.items()}
    want = {c: shortest(edges, [i for i in nodes if group[i] == c]) for c in set(group.values()) if sum(x == c for x in group.values()) > 1}
    assert {r["component"]: r["cycle"] for r in graph.cycle_report(e, groups).collect()} == want


def test_long_chains_loops_and_no_edges(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(1, 12)] + [(12, 5, 1.0), (3, 3, 1.0), (1, 2, 1.0)], "src int, dst int, distance double")
    n = spark.createDataFrame([(i,) for i in range(1, 14)], "strategy int")
    groups = folders.settled(graph.cycle_groups(e, n))
    assert {r["strategy"]: r["component"] for r in groups.collect()} == {i: 5 if 5 <= i <= 12 else i for i in range(1, 14)}
    assert [r["cycle"] for r in graph.cycle_report(e, groups).collect()] == [list(range(5, 13))]
    none = graph.cycle_groups(e.limit(0), n)
    assert none.where("size != 1 or component != strategy").count() == 0 and graph.cycle_report(e.limit(0), none).count() == 0


# Kendall
def tau(x, y):
    n = len(x)
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i in range(n) for j in range(i)]
    c, a, b = sum(p * q for p, q in pairs), sum(abs(p) for p, _ in pairs), sum(abs(q) for _, q in pairs)
    return c / math.sqrt(a * b) if a and b else None


@pytest.mark.parametrize("n", [1, 2, 3, 64, 200])
def test_inversions(n):
    rng = np.random.default_rng(n)
    x, w = rng.integers(0, 20, n), rng.integers(1, 4, n)
    assert performance.inversions(x, w) == sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if x[i] > x[j])


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_kendall_by_inversions(spark, parts):
    rng = random.Random(parts)
    rows = [(s, i, rng.choice([None, *range(m)]), rng.choice(range(m + 3))) for s, (n, m) in enumerate([(120, 30), (60, 3), (1, 2), (5, 1)]) for i in range(n)]
    df = spark.createDataFrame(rows, "scope int, id int, x int, y int")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["scope"]: r for r in performance.rank_correlation(df, ["scope"]).collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    for s in range(4):
        some = [(i, x, y) for t, i, x, y in rows if t == s and x is not None]
        if not some:
            assert s not in got
            continue
        want = tau([x for _, x, _ in some], [y for *_, y in some])
        assert got[s]["n"] == len(some) and got[s]["kendall"] == (None if want is None else pytest.approx(want))
        if len(some) > 1:
            place = lambda c: np.argsort(np.argsort([(r[c], r[0]) for r in some], axis=0)[:, 0]) if False else [sorted((q[c], q[0]) for q in some).index((r[c], r[0])) for r in some]
            assert got[s]["ordinal"] == pytest.approx(np.corrcoef(place(1), place(2))[0, 1])
    assert "Nested" not in performance.rank_correlation(df, ["scope"])._jdf.queryExecution().executedPlan().toString()


# quantiles
@pytest.mark.parametrize("buckets, few", [(1024, 4096), (4, 2), (3, 50)])
def test_quantiles_by_rank_selection(spark, buckets, few):
    rng = random.Random(5)
    values = {1: [rng.randint(-50, 50) ** 5 for _ in range(400)], 2: [7], 3: [1, 2], 4: [0] * 30 + [10**12], 5: [-3, -3, 9, 9, 9]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(1, None), (6, None)], "k int, x long")
    held = quantiles.counted_values(df, ["k"], F.col("x"))
    ranks = F.array(F.lit(0), F.floor((F.col("n") - 1) * 0.37), F.col("n") - 1).cast("array<long>")
    got = {(r["k"], r["r"]): r["v"] for r in quantiles.at_ranks(held, ["k"], ranks, buckets, few).collect()}
    assert got == {(k, r): sorted(vs)[r] for k, vs in values.items() for r in {0, int((len(vs) - 1) * 0.37), len(vs) - 1}}
    p = {r["k"]: r["p"] for r in quantiles.linear_quantiles(held, ["k"], (0.1, 0.5, 0.9)).collect()}
    assert {k: pytest.approx(np.quantile(vs, [0.1, 0.5, 0.9])) for k, vs in values.items()} == p
    m = {r["k"]: (r["n"], r["mean"], r["sd"]) for r in quantiles.moments(held, ["k"], {}).collect()}
    assert m == {k: pytest.approx((len(vs), np.mean(vs), np.std(vs))) for k, vs in values.items()}
    assert quantiles.linear_quantiles(quantiles.counted_values(df.limit(0), ["k"], F.col("x")), ["k"], (0.5,)).count() == 0


def test_length_stats_read_the_exposures_once(spark):
    e = spark.createDataFrame([(2, s, g, seat, n) for g, n in enumerate((1, 5, 12, 25)) for seat, s in ((1, 7), (2, 8))], "k int, strategy int, game int, seat int, n_rounds int")
    got = {r["strategy"]: r for r in gamestats.length_stats(e).collect()}
    for r in got.values():
        assert (r["n"], r["mean"], r["p50"], r["le_5"], r["ge_20"]) == (4, 10.75, 8.5, 0.5, 0.25)
    assert set(got) == {7, 8, None}


# skyline, strengths, convergence
def test_skylines_merge_to_the_front(spark):
    rng = random.Random(7)
    points = {s: [rng.choice([0.1, 0.2, 0.3, 0.5, 0.7]) for _ in range(4)] for s in range(600)}
    beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
    want = {s for s, v in points.items() if not any(beats(w, v) for w in points.values())}
    rows = spark.createDataFrame([(0, k, s, v[k]) for s, v in points.items() for k in range(4)] + [(0, 1, 1000, 9.0)], "root long, k int, strategy int, delta double")
    assert {r["strategy"] for r in performance.pareto_front(rows).collect()} == want
    assert "NestedLoop" not in performance.pareto_front(rows)._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_stages_of_a_game():
    assert stages_by_hand([2.0, 1.0, 3.0]) == pytest.approx(ratings.stage_loads(np.array([[2.0, 1.0, 3.0]]))[0])


def stages_by_hand(g):
    stages = [sum(g[i:]) for i in range(len(g) - 1)]
    return [sum(1 / s for s in stages[: i + 1]) for i in range(len(g))]


def test_strengths_by_lookup_and_by_join_agree_with_a_round_by_hand(spark):
    games = {0: [1, 2, 3], 1: [2, 1, 3], 2: [3, 1, 2], 3: [1, 1, 2]}
    e = spark.createDataFrame([(0, 3, g, s, i + 1, False) for g, ids in games.items() for i, s in enumerate(ids)] + [(0, 3, 9, 4, None, True)], "root long, k int, game long, strategy int, rank int, safety boolean")
    load, w = {1: 0.0, 2: 0.0, 3: 0.0}, {1: 0, 2: 0, 3: 0}
    for ids in games.values():
        for i, (s, x) in enumerate(zip(ids, stages_by_hand([1.0] * 3))):
            load[s] += x
            w[s] += i < 2
    want = {s: math.log((w[s] + 0.5) / (load[s] + 0.5)) for s in load}
    for lookup in (10**6, 0):
        got = {r["strategy"]: r for r in ratings.ratings_batch(e, rounds=1, lookup=lookup).collect()}
        assert {s: got[s]["mu"] for s in want} == pytest.approx(want)
        assert got[4]["status"] == "prior" and got[4]["mu"] is None and got[1]["updates"] == 1 + 2 + 2 + 1 + 2
    two = [{(r["root"], r["strategy"]): r["mu"] for r in ratings.ratings_batch(e, rounds=4, lookup=n).collect()} for n in (10**6, 0)]
    assert two[0] == pytest.approx(two[1])


def test_running_sums_end_where_fractions_do(spark):
    rows, df = cells(spark, 2)
    df = df.where("not (root = 0 and k = 2 and strategy = 5 and batch in (1, 4))")
    kept = [r for r in rows if not (r[0] == 0 and r[1] == 2 and r[3] == 5 and r[2] in (1, 4))]
    got = {(r["fraction"], r["root"], r["k"], r["strategy"]): (r["w"], r["n"], r["b"]) for r in stability.cumulative_cells(df, (0.2, 0.5, 1.0)).collect()}
    want = {}
    for f, root, k, s in itertools.product((0.2, 0.5, 1.0), (0, 1), (2, 3), (3, 5, 8)):
        some = [(w, n) for r, kk, b, ss, w, n in kept if (r, kk, ss) == (root, k, s) and b < math.ceil(f * 5)]
        if some:
            want[f, root, k, s] = (sum(w for w, _ in some), sum(n for _, n in some), sum(n > 0 for _, n in some))
    assert got == want


@pytest.mark.parametrize("name", ["performance_by_k", "performance_across_k", "pareto_front", "bootstrap_ranks", "half_drift", "matched_convergence"])
def test_line_items_are_read_once(spark, sf_dir, name):
    """The tables are read while the cells are written; the plan that is left reads none of them again."""
    plan = contest.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and plan.count("FileScan") == 0


# decisions per root
BLOCKS = "pair_id int, strategy_a int, strategy_b int, root int, seat_order int, attempted long, completed long, wins_a long, status string"


def test_decisions_of_roots_are_those_of_each_root_alone(spark):
    from tallyforge.operators import h2h

    counts = {(1, 2): ((3000, 2000), (3000, 2000)), (1, 3): ((2600, 2500), (2500, 2500)), (2, 3): ((2500, 2500), (2400, 2600)), (1, 4): ((10, 5), None)}
    rows = []
    for i, ((a, b), of) in enumerate(counts.items()):
        for root, x in enumerate(of):
            for order in (0, 1) if x else ():
                rows.append((i, a, b, root, order, 5000, 5000, x[0] if order == 0 else 5000 - x[1], "complete" if i < 3 else "short"))
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = {r["pair_id"]: r for r in h2h.root_decisions(blocks).collect()}
    for root in (0, 1):
        alone = {r["pair_id"]: r for r in h2h.h2h_inference(h2h.order_combine(blocks.where(f"root = {root}"))).collect()}
        assert {i: (r["decision"], r["d"]) for i, r in alone.items()} == {i: (got[i][f"decision_{root}"], got[i][f"d_{root}"]) for i in alone}
    assert [got[i]["decision_0"] for i in range(3)] == ["practical_dominance_a", "unresolved", "unresolved"]
    assert (got[0]["holm_0"], got[0]["holm_agrees"], got[0]["direction_agrees"]) == ("advantage_a", True, True)
    assert (got[2]["direction_agrees"], got[3]["holm_0"], got[3]["decision_1"], got[3]["decision_agrees"]) == (False, "not_viable", None, None)


def test_two_sided_p_of_whole_columns(spark):
    from tallyforge.operators import h2h

    pairs = spark.createDataFrame([(30, 50, 20, 50), (5, 5, 5, 5), (0, 0, 1, 2)], "wins_1 long, n_1 long, wins_2 long, n_2 long")
    assert [r["p"] for r in h2h.score_test(pairs).collect()] == [pytest.approx(math.erfc(2 / math.sqrt(2))), 1.0, None]


# footers
def test_footers_answer_without_reading_columns(spark, sf_dir, tmp_path):
    from tallyforge.sources import footers

    rows = spark.createDataFrame([(2, 1, -3, 5, "x"), (2, 2, 4, -1, None), (3, 3, 7, None, "y")], "k int, game long, margin int, loss_margin int, name string")
    rows.write.partitionBy("k").parquet(f"{tmp_path}/by_k")
    rows.write.parquet(f"{tmp_path}/all")
    assert {r["column"]: (r["minimum"], r["maximum"], r["rows"]) for r in footers.column_ranges(spark, f"{tmp_path}/all").collect()} == {"k": (2, 3, 3), "game": (1, 3, 3), "margin": (-3, 7, 3)}
    assert [tuple(r) for r in footers.negative_columns(spark, f"{tmp_path}/all").collect()] == [("margin", -3)]
    assert {r["k"]: r["rows"] for r in footers.shard_rows(spark, f"{tmp_path}/by_k", ["k"]).collect()} == {2: 2, 3: 1}
    plan = footers.column_ranges(spark, f"{tmp_path}/all")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "MIN(margin)" in plan
    plan = footers.shard_rows(spark, f"{tmp_path}/by_k", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [k]" in plan
    ok = footers.reconcile_combined(spark, f"{tmp_path}/by_k", f"{tmp_path}/all").first()
    assert (ok["rows_by_k"], ok["rows_combined"], ok["agrees"]) == (3, 3, True)
    rows.limit(2).withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/other")
    bad = footers.reconcile_combined(spark, f"{tmp_path}/by_k", f"{tmp_path}/other").first()
    assert (bad["agrees"], bad["only_combined"], bad["only_by_k"]) == (False, ["more"], [])
    manifest = spark.createDataFrame([(2, 2), (3, 5), (4, 1)], "k int, rows long")
    assert {r["k"]: r["issue"] for r in footers.reconcile_shards(spark, manifest, f"{tmp_path}/by_k", ["k"]).collect()} == {3: "row_count", 4: "missing"}
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


# streaming sums
def test_sum_log_stays_small_and_repeats_nothing(spark, tmp_path):
    from tallyforge.streaming import incremental

    log = incremental.SumLog(spark, f"{tmp_path}/log", ["key"], ["x"], every=3)
    assert log.read() is None
    total = {}
    for epoch in range(14):
        batch = spark.createDataFrame([(k, epoch) for k in ("a", f"k{epoch}")], "key string, x long")
        log.add(batch, epoch)
        if epoch % 4 == 2:
            log.add(batch, epoch)  # a batch that is repeated after a crash
        for k in ("a", f"k{epoch}"):
            total[k] = total.get(k, 0) + epoch
        assert {r["key"]: r["x"] for r in log.read().collect()} == total
        assert len(log.whole("snapshot")) <= 2 and len(log.whole("delta")) <= 6


def test_late_rows_and_expired_coordinates(spark, tmp_path):
    from tallyforge.streaming import incremental

    schema, src = "id long, key string, x long, t timestamp", tmp_path / "in"
    row = lambda i, x, hour: (i, "a", x, f"2024-01-01 {hour:02d}:00:00")

    def land(*rows):
        spark.createDataFrame(rows, "id long, key string, x long, t string").selectExpr("id", "key", "x", "cast(t as timestamp) t").coalesce(1).write.mode("append").parquet(str(src))

    def call():
        stream = incremental.file_stream(spark, str(src), schema, files=1)
        return incremental.incremental_sums(stream, str(tmp_path / "state"), ["key"], ["x"], ["id"], time="t", late="2 hours").first()

    land(row(1, 5, 1), row(1, 5, 1))
    assert (call()["x"], call()["rows"]) == (5, 1)
    land(row(2, 7, 10))
    assert call()["x"] == 12
    land(row(1, 5, 1), row(2, 7, 10), row(3, 1, 9))  # far too late; known; late, but within the time
    assert (call()["x"], call()["rows"]) == (13, 3)


# identifiers, sinks, caps
def test_identifiers_are_never_parsed(spark):
    from tallyforge.operators import validate

    df = spark.createDataFrame([(1, 2**31, "7", 1.0), (None, -1, "8", 2.0)], "a int, b long, c string, d double")
    got = {tuple(r) for r in validate.id_issues(df, ["a", "b", "c", "d"]).collect()}
    assert got == {("a", "null", 1), ("b", "negative", 1), ("b", "too_large", 1), ("c", "wrong_type", None), ("d", "wrong_type", None)}
    assert dict(validate.canonical_ids(df.withColumn("a", F.col("a").cast("long")), ["a"], nullable=("a",)).dtypes)["a"] == "int"
    with pytest.raises(ValueError):
        validate.canonical_ids(df, ["b"])
    assert validate.id_issues(df, ["c"]).count() == 1 and validate.id_issues(df.limit(0), ["a", "b"]).count() == 0
    small = validate.smallest_integers(spark.createDataFrame([(127, -129, 2**40, None)], "a long, b long, c long, d int"), ["a", "b", "c", "d"])
    assert [t for _, t in small.dtypes] == ["tinyint", "smallint", "bigint", "tinyint"] and tuple(small.first()) == (127, -129, 2**40, None)


def test_counter_csv(spark, tmp_path):
    from tallyforge.sources import files

    files.write_counter_csv(spark.createDataFrame([(3, 2), (1, 5), (3, 4), (2, 5)], "strategy int, wins int"), f"{tmp_path}/c")
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("*.csv")))
    assert text.splitlines() == ["strategy,wins", "3,6", "1,5", "2,5"]


def test_caps_say_what_they_leave(spark):
    groups = spark.createDataFrame([(i, i > 2) for i in range(6)], "g int, eligible boolean")
    assert [lag.cap_status(groups, n).first()["status"] for n in (2, 3)] == ["blocked_by_cap", "complete"]
    assert tuple(lag.cap_status(groups.where("not eligible"), 2).first()) == (0, 0, "not_estimable")


# wide rows
def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_wide_rows_of_all_k_come_from_one_pass(spark, sf_dir):
    e = contest.exposures(spark, sf_dir)
    got = contest._stacked_wide(spark, sf_dir)
    want = reshape.combine_k({k: reshape.widened(e, k) for k in range(2, 7)}, 6)
    assert got.schema == want.schema and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert reshape.gathered(e, 6).exceptAll(want).isEmpty()
    assert scans(got) == scans(e)
    assert scans(contest.QUERIES["wide_contract_violations"](spark, sf_dir)) == scans(e)


def test_contract_counts_rows_of_equal_faults_and_of_equal_coordinates(spark):
    seats = ", ".join(f"P{i}_score int, P{i}_strategy int, P{i}_rank byte, P{i}_loss_margin int, P{i}_n_turns short" for i in (1, 2))
    row = lambda root, game, rounds=5, winner="P1": (root, 2, 0, game, rounds, False, winner, 9, 1, 1, 0, 3, 4, 2, 2, 5, 3)
    rows = [row(0, 1), row(0, 1), row(0, 1, rounds=-1), row(None, 2), row(None, 2), row(1, 2), row(0, 3, winner=None), row(None, None, -2), row(None, 4, winner="P2")]
    df = spark.createDataFrame(rows, f"root long, k short, batch int, game long, n_rounds short, safety boolean, winner_seat string, {seats}")
    got = {r["rule"]: r["rows"] for r in validate.wide_contract_violations(df, 2).collect()}
    assert {rule: n for rule, n in got.items() if n} == {"repeated_coordinates": 5, "null_root": 4, "null_game": 1, "no_rounds": 2, "winner_missing": 1, "winner_rank": 1}
    assert len(got) == 24
    assert {r["rows"] for r in validate.wide_contract_violations(df.limit(0), 2).collect()} == {0}


# held-out games
def test_split_in_time_selects_the_last_training_game(spark):
    rng = random.Random(5)
    sizes = {(0, 2): 1, (0, 3): 7, (1, 2): 3000}
    games = {g: rng.sample(range(10**9), n) for g, n in sizes.items()}
    df = spark.createDataFrame([(*g, i) for g, ids in games.items() for i in ids], "root long, k int, game long")
    x = ratings.split_in_time(df)
    got = {g: sorted(r["game"] for r in x.where("train").collect() if (r["root"], r["k"]) == g) for g in games}
    assert got == {g: sorted(ids)[: max(1, math.floor(0.8 * len(ids)))] for g, ids in games.items()}
    assert x.count() == len(df.collect())


def test_calibration_reads_written_games(spark, sf_dir):
    plan = contest.QUERIES["heldout_calibration"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_fronts_are_shown_from_written_decisions_and_cells(spark, sf_dir, monkeypatch):
    passes, made = [], contest.exposures
    monkeypatch.setattr(contest, "exposures", lambda *a: passes.append(a) or made(*a))
    plan = contest.QUERIES["fronts_display"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and len(passes) == 2


@pytest.mark.parametrize("name", ["materialize", "curate"])
def test_published_rows_come_from_one_pass(spark, sf_dir, monkeypatch, name):
    passes, made = [], contest.exposures
    monkeypatch.setattr(contest, "exposures", lambda *a: passes.append(a) or made(*a))
    rows, games = contest.QUERIES[name](spark, sf_dir).collect(), made(spark, sf_dir).select("game").distinct().count()
    assert len(passes) == 1
    assert sum(r["rows_combined" if name == "materialize" else "rows"] for r in rows) == games


def test_rows_are_published_where_they_lie(spark, tmp_path):
    df = spark.range(0, 60, 1, 3).select((F.col("id") % 2 + 2).alias("k"), (F.col("id") % 5).alias("root"), F.col("id").alias("game"))
    assert {(r["k"], r["rows"]) for r in files.curate(df, str(tmp_path / "games")).collect()} == {(2, 30), (3, 30)}
    found = spark.read.parquet(str(tmp_path / "games")).groupBy("k", F.input_file_name()).agg(F.min("game").alias("lo"), F.max("game").alias("hi")).collect()
    assert sorted((r["lo"] // 20, r["hi"] // 20) for r in found) == [(i, i) for i in (0, 0, 1, 1, 2, 2)]


def test_the_whole_table_has_as_many_tasks_as_its_rows_take(spark, sf_dir, tmp_path, monkeypatch):
    files.materialize(spark.range(0, 60, 1, 12), str(tmp_path / "all"), None)
    assert len(list((tmp_path / "all").glob("part-*"))) == 12
    asked, made = [], files.materialize
    monkeypatch.setattr(files, "materialize", lambda df, path, n=1: asked.append(n) or made(df, path, n))
    assert contest.QUERIES["materialize"](spark, sf_dir).first()["agrees"] and asked == [None]


def test_items_are_sorted_twice_and_joined_as_they_lie(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = contest.exposures(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Sort [") == 3 and plan.count("Exchange hashpartitioning") == 2  # orders are sorted for the join
