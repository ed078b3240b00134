"""Hand oracles of the contest operators, and every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import stats
from tallyforge.operators import agreement, gamestats, graph, h2h, lag, metrics, performance, ratings, reshape, seats, stability, validate
from tallyforge.plans import contest, sql

E = "game long, root long, k int, batch int, seat int, strategy int, score long, n_turns int, n_rounds int, safety boolean, winner_seat int, rank int, loss_margin long"


def cells(spark, rows):
    return spark.createDataFrame(rows, "root long, k int, batch int, strategy int, wins long, exposures long").selectExpr("*", "exposures AS completed", "0L AS safety_exposures", "exposures - wins AS losses")


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_batch_metrics_and_returns(spark):
    e = spark.createDataFrame([(0, 0, 2, 0, 1, 10, 100, 2, 2, False, 1, 1, 0), (0, 0, 2, 0, 2, 20, 50, 3, 2, False, 1, 2, 50), (1, 0, 2, 0, 1, 20, 80, 4, 4, False, 1, 1, 0), (1, 0, 2, 0, 2, 10, 0, 4, 4, False, 1, 2, 80)], E)
    m = by(metrics.turn_returns(metrics.batch_metrics(e)), "strategy")
    assert (m[10]["exposures"], m[10]["wins"], m[10]["score_sum"], m[10]["turns_sum"], m[10]["mismatches"]) == (2, 1, 100, 6, 0)
    assert m[10]["turn_return"] == pytest.approx(100 / 6) and m[10]["game_return"] == 25 and m[10]["round_return"] == 25
    assert m[20]["turn_return"] == pytest.approx(130 / 7) and m[20]["game_return"] == pytest.approx((50 / 3 + 20) / 2)
    assert m[20]["round_return"] == 22.5 and m[20]["mismatch_rate"] == 0.5 and m[20]["rank_sum"] == 3


def test_performance_pareto_and_maximin(spark):
    wins = {2: {1: (60, 80), 2: (45, 35), 3: (50, 0)}, 4: {1: (30, 40), 2: (20, 20)}, 12: {1: (13, 14), 2: (8, 9)}}
    rows = [(0, k, b, s, w[b], 0 if (s, b) == (3, 1) else 100) for k, of in wins.items() for s, w in of.items() for b in (0, 1)]
    by_k = performance.performance_by_k(cells(spark, rows)).cache()
    got = by(by_k, "k", "strategy")
    assert got[2, 1]["win_rate"] == pytest.approx(0.7) and got[2, 1]["delta"] == pytest.approx(0.2) and got[2, 1]["mcse"] == pytest.approx(0.1)
    assert got[2, 3]["excluded_cells"] == 1 and got[2, 3]["mcse"] is None
    across = by(performance.performance_across_k(by_k), "strategy")
    assert across[1]["score"] == pytest.approx((0.2 + 0.1 + (27 / 200 - 1 / 12)) / 3) and across[1]["mcse"] == pytest.approx(math.sqrt((0.01 + 0.0025 + 0.005**2) / 9))
    assert across[1]["worst_k"] == 12 and across[3]["score"] is None
    assert [r["strategy"] for r in performance.maximin(performance.performance_across_k(by_k)).collect()] == [1]
    assert {r["strategy"] for r in performance.pareto_front(by_k).collect()} == {1}


def test_pareto_keeps_ties(spark):
    points = {1: (1, 0), 2: (0, 1), 3: (0.5, 0.5), 4: (0.4, 0.4), 5: (1, 0)}
    rows = spark.createDataFrame([(0, k, s, float(v[k - 2])) for s, v in points.items() for k in (2, 3)], "root long, k int, strategy int, delta double")
    assert {r["strategy"] for r in performance.pareto_front(rows).collect()} == {1, 2, 3, 5}


def test_lag_of_a_short_series(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate((1, 0, 1, 1))], "s int, i int, x int")
    got = by(lag.lag_autocorrelation(rows, ["s"], ["i"], F.col("x"), (1, 4)), "lag")
    assert got[1]["autocorr"] == pytest.approx(-0.5) and got[4]["autocorr"] is None and got[4]["status"] == "insufficient_pairs"


def test_cluster_mcse(spark):
    got = stability.root_combined_by_k(cells(spark, [(0, 2, b, 1, w, 100) for b, w in enumerate((40, 50, 60, 70))])).where("root = 0").first()
    assert got["mcse"] == pytest.approx(np.std([0.4, 0.5, 0.6, 0.7], ddof=1) / 2)


def test_balanced_tail(spark):
    rows = [(i, i, None) for i in range(1, 9)] + [(i, None, i - 8) for i in range(9, 17)]
    family = spark.createDataFrame(rows, "strategy int, rate_rank int, rating_rank int")
    kept = {r["strategy"] for r in agreement.balanced_tail_cap(family, 8, 12).where("kept").collect()}
    assert kept == {*range(1, 7), *range(9, 15)}


def test_score_rank_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(0, 4, 0.5), (0, 2, 0.5), (0, 3, 0.5), (0, 1, 0.6)], "root int, strategy int, score double")
    assert [r["strategy"] for r in performance.score_rank(rows).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_head_to_head(spark):
    counts = {(1, 2): (3000, 2000), (1, 3): (2600, 2500), (2, 3): (2500, 2500)}
    rows = [(i, a, b, root, order, 5000, 5000, x[0] if order == 0 else 5000 - x[1], "complete") for i, ((a, b), x) in enumerate(counts.items()) for root in (0, 1) for order in (0, 1)]
    blocks = spark.createDataFrame(rows, "pair_id int, strategy_a int, strategy_b int, root int, seat_order int, attempted long, completed long, wins_a long, status string")
    got = by(h2h.h2h_inference(h2h.order_combine(blocks)), "pair_id")
    assert got[0]["q_ab"] == pytest.approx(0.6) and got[0]["q_ba"] == pytest.approx(0.4) and got[0]["d"] == pytest.approx(0.1)
    assert [got[i]["decision"] for i in range(3)] == ["practical_dominance_a", "statistical_only_advantage_a", "unresolved"]
    assert [got[i]["holm_reject"] for i in range(3)] == [True, True, False]
    assert all(r["s_low"] <= r["o_low"] <= r["o_high"] <= r["s_high"] for r in got.values())
    assert {r["direction_agrees"] for r in h2h.root_agreement(blocks).collect()} == {True}


def test_score_interval_inverts_the_score_test():
    x1, n1, x2, n2, z = np.array([30, 10, 0, 7]), np.array([50, 10, 20, 9]), np.array([20, 0, 0, 4]), np.array([50, 10, 20, 15]), 1.959963984540054
    low, high = h2h.interval_bounds(x1, n1, x2, n2, z)
    for i in range(4):
        for d in (low[i], high[i]):
            if abs(d) < 1 - 1e-9:
                p2 = np.linspace(max(0, -d) + 1e-9, min(1, 1 - d) - 1e-9, 200001)
                fit = x1[i] * np.log(p2 + d) + (n1[i] - x1[i]) * np.log1p(-p2 - d) + x2[i] * np.log(p2) + (n2[i] - x2[i]) * np.log1p(-p2)
                q = p2[fit.argmax()]
                seen = (x1[i] / n1[i] - x2[i] / n2[i] - d) / math.sqrt((q + d) * (1 - q - d) / n1[i] + q * (1 - q) / n2[i])
                assert abs(seen) == pytest.approx(z, abs=2e-3)
    assert high[1] == pytest.approx(1, abs=1e-6) and low[2] == pytest.approx(-high[2], abs=1e-9)


def test_cycle_and_fronts(spark):
    edges = spark.createDataFrame([(1, 2, 0.06), (2, 3, 0.07), (3, 1, 0.08), (1, 4, 0.1), (2, 4, 0.1), (3, 4, 0.1)], "src int, dst int, distance double").withColumn("kind", F.lit("practical"))
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "strategy int")
    groups = graph.cycle_groups(edges, nodes)
    assert {r["strategy"]: (r["component"], r["size"]) for r in groups.collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1)}
    assert {r["strategy"]: r["front"] for r in graph.dominance_fronts(edges, groups).collect()} == {1: 1, 2: 1, 3: 1, 4: 2}
    report = graph.cycle_report(edges, groups).first()
    assert report["cycle"] == [1, 2, 3] and report["weakest"] == 0.06 and report["strongest"] == 0.08
    scores = spark.createDataFrame([(i, True) for i in range(1, 5)], "strategy int, eligible boolean")
    assert graph.unique_best(edges, scores).count() == 0
    best = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "src int, dst int").withColumn("kind", F.lit("practical"))
    assert graph.unique_best(best, scores).first()["strategy"] == 1


def test_softmax_and_quantiles(spark):
    p = spark.range(1).select(stats.softmax(F.array(F.lit(30.0), F.lit(20.0)), 5.0).alias("p")).first()["p"]
    assert p == pytest.approx([1 / (1 + math.exp(-2)), 1 / (1 + math.exp(2))])
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.7062047364) and stats.t_quantile(0.975, 9) == pytest.approx(2.2621571628)
    wide = spark.range(1, 201).select(F.col("id").alias("df"), stats.t_critical(F.col("id")).alias("t"))
    got = {r["df"]: r["t"] for r in wide.collect()}
    assert got[100] == pytest.approx(1.9839715185, abs=1e-8) and got[61] == pytest.approx(stats.t_quantile(0.975, 61), abs=1e-8)


def test_seats_mirrors_and_selfplay(spark):
    games = [(0, 2, [10, 20], 1), (1, 2, [20, 10], 2), (2, 2, [10, 10], 1), (3, 2, [30, 10], 2), (4, 4, [10, 20, 10, 20], 2), (5, 4, [20, 10, 20, 10], 1)]
    g = spark.createDataFrame([(i, 0, k, 0, s, w, False) for i, k, s, w in games], "game long, root long, k int, batch int, strategies array<int>, winner_seat int, safety boolean")
    e = g.select("*", F.posexplode("strategies").alias("p", "strategy")).withColumn("seat", F.col("p") + 1)
    effects = seats.seat_effects(seats.seat_counts(e))
    got = by(effects, "k", "strategy", "seat")
    assert got[2, 10, 1]["wins"] == 2 and got[2, 10, 1]["effect"] == 0.5
    assert by(seats.seat_standardized(effects, {2: 1, 4: 1}), "strategy", "seat")[10, 1]["effect"] == pytest.approx(0.125)
    mix = by(seats.seat_mixture(seats.seat_counts(e)), "strategy", "seat")[10, 1]
    assert mix["baseline"] == pytest.approx(1.25 / 3) and mix["effect"] == pytest.approx(0.25)
    assert seats.selfplay(g).first()["effect"] == 0.5
    pair = by(seats.mirrored_pairs(g), "low", "high")[10, 20]
    assert pair["matches"] == 1 and pair["mean_difference"] == 1 and by(seats.mirrored_pairs(g), "low", "high")[10, 30]["mean_difference"] is None


def test_ratings_recover_an_order(spark):
    rng, rows = np.random.default_rng(1), []
    for game in range(400):
        a, b = rng.choice(4, 2, replace=False)
        first = rng.random() < math.exp(a) / (math.exp(a) + math.exp(b))
        rows += [(0, 2, game, int(a), 1 if first else 2, False), (0, 2, game, int(b), 2 if first else 1, False)]
    e = spark.createDataFrame(rows, "root long, k int, game long, strategy int, rank int, safety boolean")
    mu = {r["strategy"]: r["mu"] for r in ratings.ratings_batch(e, rounds=15).collect()}
    assert sorted(mu, key=mu.get) == [0, 1, 2, 3]


def test_validation_finds_planted_faults(spark, sf_dir):
    g = contest.games(contest.exposures(spark, sf_dir))
    bad = g.withColumn("winner_seat", F.when(F.col("game") % 50 == 1, F.col("k")).otherwise(F.col("winner_seat")))
    rules = {r["rule"]: r["rows"] for r in validate.row_contract_violations(bad).collect()}
    assert rules["winner_not_first"] + rules["safety_has_winner"] > 0 and rules["rank_permutation"] == 0


def test_sources_round_trip(spark, sf_dir, tmp_path):
    from tallyforge.sources import files

    wide = reshape.widened(contest.exposures(spark, sf_dir), 3)
    counts = files.curate(wide, f"{tmp_path}/games")
    assert counts.first()["rows"] == wide.count() == files.read_all_k(spark, f"{tmp_path}/games").count()
    assert files.read_games(spark, f"{tmp_path}/games/k=3", 3, ["game", "P1_score"]).columns == ["game", "P1_score"]
    (tmp_path / "m.json").write_text('{"root": 0, "k": 2, "shard": 1, "rows": "5"}\n{"root": "x", "k": 2, "shard": 2, "rows": 1}\n')
    assert [r["root"] for r in files.manifest_scan(spark, f"{tmp_path}/m.json").orderBy("shard").collect()] == [0, None]
    (tmp_path / "log.json").write_text('{"event": "step", "status": "failed"}\n{"event": "run_end", "status": "ok"}\n')
    assert files.event_log_health(spark, f"{tmp_path}/log.json").first()["healthy"] is False


def test_incremental_sums_are_idempotent(spark, tmp_path):
    from tallyforge.streaming import incremental

    schema, src = "id long, key string, x long", tmp_path / "in"
    call = lambda: incremental.incremental_sums(incremental.file_stream(spark, str(src), schema), str(tmp_path / "state"), ["key"], ["x"], ["id"])
    spark.createDataFrame([(1, "a", 5), (2, "b", 7), (1, "a", 5)], schema).write.parquet(str(src))
    assert by(call(), "key")["a"]["x"] == 5
    spark.createDataFrame([(1, "a", 5), (3, "a", 4)], schema).write.mode("append").parquet(str(src))
    got = by(call(), "key")
    assert (got["a"]["x"], got["a"]["rows"], got["b"]["x"]) == (9, 2, 7)
    assert by(call(), "key") == got  # no new file: the sums that are kept


def test_incremental_sums_without_files(spark, tmp_path):
    from tallyforge.streaming import incremental

    (tmp_path / "in").mkdir()
    stream = incremental.file_stream(spark, str(tmp_path / "in"), "id long, key string, x long")
    assert incremental.incremental_sums(stream, str(tmp_path / "state"), ["key"], ["x"], ["id"]).collect() == []


def test_weights_must_cover_every_k(spark):
    rows = spark.createDataFrame([(0, k, 1, 0.1, 0.01) for k in (2, 3)], "root int, k int, strategy int, delta double, mcse double")
    assert performance.weighted_across_k(rows, {2: 1, 3: 3, 4: 5}).count() == 0  # a weighted k that the strategy lacks
    assert performance.weighted_across_k(rows, {2: 1, 3: 3}).first()["score"] == pytest.approx(0.1)
    for weights in ({2: 1}, {2: 1, 3: 0}, {2: 1, 3: -1}):
        with pytest.raises(ValueError):
            performance.weighted_across_k(rows, weights)


def test_every_item_of_an_order_of_several_is_a_seat(spark, sf_dir):
    e = contest.exposures(spark, sf_dir)
    orders = contest.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    assert e.count() == orders.where("count > 1").agg(F.sum("count")).first()[0]
    seats = e.groupBy("game").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.min("seat").alias("low"), F.max("seat").alias("high"))
    assert seats.where("n != k or low != 1 or high != k or k not between 2 and 6").count() == 0
    assert e.select("game").distinct().count() == orders.where("count > 1").agg(F.sum(F.ceil(F.col("count") / 6))).first()[0]


def test_ids_that_repeat_across_roots_are_different_games(spark):
    rows = [(r, 2, 7, s, s, 10 * s + 100 * r, s, False, 1) for r in (0, 1) for s in (1, 2)]
    e = spark.createDataFrame(rows, "root int, k int, game long, seat int, strategy int, score long, rank int, safety boolean, winner_seat int")
    assert {r["margin"] for r in gamestats.with_margins(e).collect()} == {10}
    one = by(ratings.ratings_batch(e.where("root = 0"), rounds=3), "strategy")
    both = by(ratings.ratings_batch(e, rounds=3).where("root = 0"), "strategy")
    assert {k: v["mu"] for k, v in one.items()} == pytest.approx({k: v["mu"] for k, v in both.items()})


def test_binned_quantile_counts_the_whole_bin(spark):
    rows = spark.createDataFrame([(2, 1, m, False) for m in (10, 30, 60)], "k int, strategy int, margin long, safety boolean")
    got = gamestats.margin_stats_binned(rows, threshold=26).first()
    assert got["quantile"] == 37.5 and got["share_le"] == pytest.approx(2 / 3)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(map(one, v))
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([one(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df, out = contest.QUERIES[name](spark, sf_dir), duck.sql(sql.SQL[name])
    assert sorted(df.columns) == sorted(out.columns)
    assert plain(df.collect(), df.columns) == plain(out.fetchall(), out.columns)
