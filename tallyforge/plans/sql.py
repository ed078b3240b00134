"""The queries of plans.contest as SQL for DuckDB."""

from __future__ import annotations

from tallyforge.functions.stats import normal_quantile, t_quantile
from tallyforge.operators.h2h import FAMILY_ALPHA, PRACTICAL
from tallyforge.plans.contest import BATCHES, CAP, FEW, ROOM, SCORES, SEATS, TARGET

Z = repr(normal_quantile(0.975))


def d(expr: str, name: str) -> str:
    """A double as it is compared."""
    return f"round({expr}, 6) + 0.0 AS {name}"


def n(expr: str, name: str) -> str:
    return f"({expr})::BIGINT AS {name}"


#: Classes of a noisy price as strategies.
STRENGTH = "least(floor((l_extendedprice + l_partkey % 50 * 4000) / 60000), 4) * 2 % 5"


def base(strategies: int | str = 100) -> str:
    """Exposures e, games g, cells bm, zero-filled cells zf. A strategy is the supplier modulo a number, or an expression."""
    strategy = strategies if isinstance(strategies, str) else f"l_suppkey % {strategies}"
    return f"""WITH RECURSIVE o AS (SELECT o_orderkey, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS safety, (SELECT max(o_orderkey) + 1 FROM orders) AS top FROM orders),
    l0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS nr, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    l1 AS (SELECT *, (n + {SEATS - 1}) // {SEATS} AS deals, nr % ((n + {SEATS - 1}) // {SEATS}) AS deal FROM l0 WHERE n > 1),
    li AS (SELECT l_orderkey, l_orderkey * {ROOM} + deal AS game, nr // deals + 1 AS seat, count(*) OVER (PARTITION BY l_orderkey, deal) AS k, ({strategy})::INT AS strategy, round(l_extendedprice * 100)::BIGINT AS score,
        l_quantity::INT AS n_turns, max(l_quantity::INT) OVER (PARTITION BY l_orderkey, deal) AS n_rounds FROM l1),
    er AS (SELECT li.*, safety, l_orderkey % 2 AS root, (l_orderkey * {BATCHES} // top)::INT AS batch,
        CASE WHEN NOT safety THEN row_number() OVER (PARTITION BY game ORDER BY score DESC, seat) END AS rank FROM li JOIN o ON l_orderkey = o_orderkey),
    e0 AS (SELECT *, max(CASE WHEN rank = 1 THEN seat END) OVER (PARTITION BY game) AS winner_seat,
        CASE WHEN NOT safety THEN max(score) OVER (PARTITION BY game) - score END AS loss_margin FROM er),
    e AS (SELECT *, coalesce(winner_seat = seat, false)::INT AS won FROM e0),
    g AS (SELECT game, any_value(root) AS root, any_value(k) AS k, any_value(batch) AS batch, any_value(n_rounds) AS n_rounds, any_value(safety) AS safety, any_value(winner_seat) AS winner_seat,
        list(strategy ORDER BY seat) AS strategies, list(score ORDER BY seat) AS scores, list(rank ORDER BY seat) AS ranks, list(seat ORDER BY rank) AS finish,
        CASE WHEN NOT any_value(safety) THEN list(score ORDER BY score DESC)[1] - list(score ORDER BY score DESC)[2] END AS margin,
        CASE WHEN NOT any_value(safety) THEN max(score) - min(score) END AS spread, list(score ORDER BY score DESC)[2] AS second FROM e GROUP BY game),
    em AS (SELECT e.*, margin, spread, second FROM e JOIN g USING (game)),
    bm AS (SELECT root, k, batch, strategy, count(*) AS exposures, sum((NOT safety)::INT) AS completed, sum(safety::INT) AS safety_exposures, sum(won) AS wins, sum(1 - won) AS losses FROM e GROUP BY ALL),
    zf AS (SELECT b.root, b.k, b.batch, s.strategy, coalesce(wins, 0) AS wins, coalesce(exposures, 0) AS exposures, coalesce(completed, 0) AS completed, coalesce(safety_exposures, 0) AS safety_exposures, coalesce(losses, 0) AS losses
        FROM (SELECT DISTINCT root, k, batch FROM bm) b JOIN (SELECT DISTINCT root, k, strategy FROM bm) s USING (root, k) LEFT JOIN bm USING (root, k, batch, strategy))"""


_T = "CASE batches - 1 " + " ".join(f"WHEN {i} THEN {t_quantile(0.975, i)!r}" for i in range(1, BATCHES)) + " END"


def performance(strategies: int = 100) -> str:
    """Adds pk (per k), ak (across k) and lo (log odds)."""
    return base(strategies) + f""",
    p0 AS (SELECT root, k, strategy, sum(wins)::DOUBLE AS w, sum(exposures)::DOUBLE AS x, sum(completed) AS completed, sum(safety_exposures) AS safety_exposures, sum(losses) AS losses, count(DISTINCT batch) AS declared_batches,
        sum((exposures > 0)::INT) AS batches, stddev_samp(CASE WHEN exposures > 0 THEN wins / exposures END) AS sd FROM zf GROUP BY root, k, strategy HAVING sum(exposures) > 0),
    p1 AS (SELECT *, w / x AS rate, CASE WHEN batches >= 2 THEN sd / sqrt(batches) END AS mcse, {_T} AS crit, {Z} * {Z} AS z2 FROM p0),
    p2 AS (SELECT *, (rate + z2 / (2 * x)) AS mid, {Z} * sqrt((rate * (1 - rate) + z2 / (4 * x)) / x) AS half, 1 + z2 / x AS scale, rate - 1.0::DOUBLE / k AS delta FROM p1),
    pk AS (SELECT *, least(greatest((mid - half) / scale, 0), 1) AS wl, least(greatest((mid + half) / scale, 0), 1) AS wh FROM p2),
    kk AS (SELECT root, count(DISTINCT k) AS all_k FROM pk GROUP BY root),
    a0 AS (SELECT root, strategy, count(DISTINCT k) AS n_k, any_value(all_k) AS all_k, sum(delta) AS ds, sum(mcse * mcse) AS v, count(mcse) AS nm, min(delta) AS min_delta, min((delta, k))[2] AS worst_k, sum(w) AS w, sum(x) AS x FROM pk JOIN kk USING (root) GROUP BY root, strategy),
    ak AS (SELECT *, n_k = all_k AS complete, CASE WHEN n_k = all_k THEN ds / all_k END AS score, CASE WHEN n_k = all_k AND nm = all_k THEN sqrt(v) / all_k END AS mcse FROM a0),
    lo AS (SELECT root, k, strategy, CASE WHEN rate > 0 AND rate < 1 THEN ln(rate / (1 - rate)) - ln((1 / k) / (1 - 1 / k)) END AS log_odds, CASE WHEN rate <= 0 THEN 'rate_0' WHEN rate >= 1 THEN 'rate_1' END AS reason FROM pk)"""


def combined(strategies: int) -> str:
    """Adds rc (per root and combined, by k) and ra (across k)."""
    return base(strategies) + """,
    rc0 AS (SELECT root, k, strategy, sum(wins)::DOUBLE AS w, sum(exposures)::DOUBLE AS x, count(*) AS batches, sum(wins::DOUBLE * wins) AS ww, sum(wins::DOUBLE * exposures) AS wn, sum(exposures::DOUBLE * exposures) AS nn
        FROM bm GROUP BY GROUPING SETS ((root, k, strategy), (k, strategy))),
    rc1 AS (SELECT *, w / x AS r FROM rc0),
    rc AS (SELECT *, r - 1.0::DOUBLE / k AS delta, CASE WHEN batches >= 2 THEN sqrt(batches / (batches - 1) * greatest(ww - 2 * r * wn + r * r * nn, 0)) / x END AS mcse FROM rc1),
    ra AS (SELECT root, strategy, avg(delta) AS score, CASE WHEN count(mcse) = count(*) THEN sqrt(sum(mcse * mcse)) / count(*) END AS mcse FROM rc GROUP BY root, strategy HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM rc)),
    rr AS (SELECT root, strategy, round(score, 9) AS score, row_number() OVER (PARTITION BY root ORDER BY round(score, 9) DESC, strategy) AS rank FROM ra),
    ab AS (SELECT a.strategy, a.rank AS a, b.rank AS b FROM rr a JOIN rr b ON a.strategy = b.strategy AND a.root = 0 AND b.root = 1)"""


def position(x: str) -> str:
    return f"CASE WHEN {x} >= 0.03 THEN 'above' WHEN {x} <= -0.03 THEN 'below' WHEN {x} IS NOT NULL THEN 'between' END"


def standardized(raw: str, expected: str) -> str:
    return f"CASE WHEN {expected} <> 0 THEN round({raw} / {expected}, 6) + 0.0 WHEN {raw} = 0 THEN 0.0 WHEN {raw} > 0 THEN 'inf'::DOUBLE WHEN {raw} < 0 THEN '-inf'::DOUBLE END"


def discrepancy(source: str, keys: str, value: str) -> str:
    on = " AND ".join(f"a.{k} = b.{k} AND a.{k} = c.{k}" for k in keys.split(", "))
    names = ", ".join(f"a.{k}::BIGINT AS {k}" for k in keys.split(", "))
    raw, expected = f"(a.{value} - b.{value})", "sqrt(a.mcse * a.mcse + b.mcse * b.mcse)"
    return f"""SELECT {names}, {d(f'a.{value}', 'a_value')}, {d(f'b.{value}', 'b_value')}, {d(f'c.{value}', 'both_value')}, {d(raw, 'raw')}, {d(expected, 'expected')}, {standardized(raw, expected)} AS standardized,
        {d(f'abs({raw}) / 0.03', 'threshold_share')}, {position(f'a.{value}')} <> {position(f'b.{value}')} AS position_changed
        FROM {source} a, {source} b, {source} c WHERE {on} AND a.root = 0 AND b.root = 1 AND c.root IS NULL"""


def attempts(used: str = "true", strategies: int | str = 10) -> str:
    """Adds att (attempts), bl (blocks of the used attempts), oc (pairs) and pd (plain decisions)."""
    return base(strategies) + f""",
    at0 AS (SELECT least(strategies[1], strategies[2]) AS strategy_a, greatest(strategies[1], strategies[2]) AS strategy_b, root, (strategies[1] > strategies[2])::INT AS seat_order, game, (NOT safety)::INT AS completed, coalesce(winner_seat = 1, false)::INT AS first_won FROM g WHERE k = 2 AND strategies[1] <> strategies[2]),
    att AS (SELECT *, strategy_a * 10 + strategy_b AS pair_id, row_number() OVER w - 1 AS attempt, coalesce(sum(completed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM at0 WINDOW w AS (PARTITION BY strategy_a, strategy_b, root, seat_order ORDER BY game)),
    bl0 AS (SELECT pair_id, strategy_a, strategy_b, root, seat_order, count(*) AS attempted, sum(completed) AS completed, sum(completed * first_won) AS wins_seat1 FROM att WHERE {used} GROUP BY ALL),
    bl AS (SELECT *, attempted - completed AS safety, greatest(attempted - {TARGET}, 0) AS replacements, completed - wins_seat1 AS wins_seat2, CASE WHEN seat_order = 1 THEN completed - wins_seat1 ELSE wins_seat1 END AS wins_a, CASE WHEN seat_order = 1 THEN wins_seat1 ELSE completed - wins_seat1 END AS wins_b, CASE WHEN completed >= {TARGET} THEN 'complete' ELSE 'short' END AS status FROM bl0),
    oc AS (SELECT pair_id, strategy_a, strategy_b, sum(attempted) FILTER (seat_order = 0) AS attempted_0, sum(attempted) FILTER (seat_order = 1) AS attempted_1, coalesce(sum(completed) FILTER (seat_order = 0), 0) AS completed_0, coalesce(sum(completed) FILTER (seat_order = 1), 0) AS completed_1,
        coalesce(sum(wins_a) FILTER (seat_order = 0), 0) AS wins_a_0, coalesce(sum(wins_a) FILTER (seat_order = 1), 0) AS wins_a_1, bool_and(status = 'complete') AND count(DISTINCT seat_order) = 2 AS complete FROM bl GROUP BY ALL),
    pd0 AS (SELECT pair_id, strategy_a, strategy_b, sum(completed * CASE WHEN seat_order = 0 THEN first_won ELSE 1 - first_won END) / sum(completed) AS q FROM att GROUP BY ALL HAVING sum(completed) > 0),
    pd AS (SELECT *, q - 0.5 AS d, CASE WHEN q - 0.5 > 0.05 THEN 'practical_dominance_a' WHEN q - 0.5 < -0.05 THEN 'practical_dominance_b' WHEN q - 0.5 > 0 THEN 'statistical_only_advantage_a' WHEN q - 0.5 < 0 THEN 'statistical_only_advantage_b' ELSE 'unresolved' END AS decision FROM pd0),
    ed0 AS (SELECT CASE WHEN d > 0 THEN strategy_a ELSE strategy_b END AS src, CASE WHEN d > 0 THEN strategy_b ELSE strategy_a END AS dst, decision LIKE 'practical%' AS practical, abs(d) AS bound FROM pd WHERE d <> 0),
    ed AS (SELECT src, dst, 'statistical' AS kind, bound AS distance FROM ed0 UNION ALL SELECT src, dst, 'practical', bound - 0.05 FROM ed0 WHERE practical),
    pe AS (SELECT src, dst, distance FROM ed WHERE kind = 'practical'),
    nd AS (SELECT DISTINCT strategy FROM e),
    rb AS (SELECT src, dst FROM pe UNION SELECT rb.src, pe.dst FROM rb JOIN pe ON rb.dst = pe.src),
    cg AS (SELECT strategy, least(strategy, coalesce((SELECT min(x.dst) FROM rb x JOIN rb y ON x.src = y.dst AND x.dst = y.src WHERE x.src = strategy), strategy)) AS component FROM nd),
    cl AS (SELECT DISTINCT a.component AS a, b.component AS b FROM pe JOIN cg a ON src = a.strategy JOIN cg b ON dst = b.strategy WHERE a.component <> b.component),
    cf AS (SELECT DISTINCT component, 1 AS front FROM cg UNION SELECT b, front + 1 FROM cf JOIN cl ON a = cf.component),
    fr AS (SELECT component, max(front) AS front FROM cf GROUP BY component),
    sd AS (SELECT strategy_a AS strategy, q AS rate, decision = 'practical_dominance_a' AS won, decision = 'practical_dominance_b' AS lost, pair_id FROM pd UNION ALL SELECT strategy_b, 1 - q, decision = 'practical_dominance_b', decision = 'practical_dominance_a', pair_id FROM pd),
    rs AS (SELECT strategy, avg(rate) AS mean_rate, sum(won::INT) AS wins, sum(lost::INT) AS losses, bool_and(complete) AS eligible FROM sd JOIN (SELECT pair_id, complete FROM oc) USING (pair_id) GROUP BY strategy),
    f10 AS (SELECT strategy, row_number() OVER (ORDER BY round(avg(won), 9) DESC, strategy) AS rate_rank, row_number() OVER (ORDER BY sum(score) DESC, strategy) AS rating_rank FROM e GROUP BY strategy),
    pa AS (SELECT pair_id, strategy_a, strategy_b, decision, CASE WHEN a.rate_rank < b.rate_rank THEN 'a' ELSE 'b' END AS by_rate, CASE WHEN a.rating_rank < b.rating_rank THEN 'a' ELSE 'b' END AS by_rating, CASE WHEN d > 0 THEN 'a' WHEN d < 0 THEN 'b' END AS by_h2h
        FROM pd JOIN f10 a ON a.strategy = strategy_a JOIN f10 b ON b.strategy = strategy_b),
    rg0 AS (SELECT pair_id, root, (coalesce(sum(wins_a) FILTER (seat_order = 0), 0) / nullif(sum(completed) FILTER (seat_order = 0), 0) - (sum(completed) FILTER (seat_order = 1) - coalesce(sum(wins_a) FILTER (seat_order = 1), 0)) / nullif(sum(completed) FILTER (seat_order = 1), 0)) / 2 AS d FROM bl GROUP BY ALL),
    rg AS (SELECT pair_id, max(d) FILTER (root = 0) AS d_0, max(d) FILTER (root = 1) AS d_1 FROM rg0 GROUP BY pair_id)"""


#: Normal quantiles of the Bonferroni level by the size of the family.
_LEVELS = "CASE m " + " ".join(f"WHEN {m} THEN {normal_quantile(1 - FAMILY_ALPHA / m / 2)!r}" for m in range(1, 46)) + " END"


def inference(by_root: bool = False) -> str:
    """Adds dc: tests, intervals and decisions of the pairs (and roots) of bl. p comes from the series of erf with positive terms, bounds
    from 60 bisections of the score statistic with the closed form of the constrained rate."""
    root, family = (", root", "PARTITION BY root") if by_root else ("", "")
    key = "pair_id" + root
    pick = lambda c, o: f"coalesce(sum({c}) FILTER (seat_order = {o}), 0)"
    return f""",
    in0 AS (SELECT {key}, strategy_a, strategy_b, {pick('wins_a', 0)}::DOUBLE AS x1, {pick('completed', 0)}::DOUBLE AS n1, ({pick('completed', 1)} - {pick('wins_a', 1)})::DOUBLE AS x2, {pick('completed', 1)}::DOUBLE AS n2,
        bool_and(status = 'complete') AND count(DISTINCT seat_order) = 2 AS complete FROM bl GROUP BY {key}, strategy_a, strategy_b),
    in1 AS (SELECT *, (x1 + x2) / (n1 + n2) AS pool, count(*) OVER ({family}) AS m FROM in0),
    in2 AS (SELECT *, CASE WHEN n1 <= 0 OR n2 <= 0 THEN NULL WHEN pool * (1 - pool) <= 0 THEN 0.0 ELSE (x1 / n1 - x2 / n2) / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)) END AS z FROM in1),
    in3 AS (SELECT *, abs(z) / sqrt(2) AS u FROM in2),
    in4 AS (SELECT *, CASE WHEN u IS NULL THEN NULL WHEN u > 8 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-u * u) * list_reduce(list_transform(range(1, 400), lambda i: [i::DOUBLE, 0.0]), lambda s, i: [s[1] * 2 * u * u / (2 * i[1] + 1), s[2] + s[1] * 2 * u * u / (2 * i[1] + 1)], [u, u])[2] END AS p FROM in3),
    in5 AS (SELECT *, least(coalesce(p, 1) * (m - row_number() OVER ({family} ORDER BY coalesce(p, 1), pair_id) + 1), 1) AS s FROM in4),
    in6 AS (SELECT *, max(s) OVER ({family} ORDER BY coalesce(p, 1), pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS holm_p FROM in5),
    bi AS (SELECT {key}, kind, edge, x1, n1, x2, n2, CASE kind WHEN 'o' THEN {Z} ELSE {_LEVELS} END AS q, x1 / n1 - x2 / n2 AS inside, edge AS outside, edge AS tried, NULL::BOOLEAN AS hit, -1 AS step FROM in1, unnest(['o', 's']) a(kind), unnest([-1.0::DOUBLE, 1.0]) b(edge) WHERE n1 > 0 AND n2 > 0
        UNION ALL SELECT {key}, kind, edge, x1, n1, x2, n2, q, CASE WHEN far OR step < 0 THEN inside ELSE tried END, CASE WHEN far AND step >= 0 THEN tried ELSE outside END,
            CASE WHEN step < 0 THEN (inside + outside) / 2 WHEN far THEN (inside + tried) / 2 ELSE (tried + outside) / 2 END, CASE WHEN step < 0 THEN far ELSE hit END, step + 1
        FROM (SELECT *, CASE WHEN v > 0 THEN gap * gap > q * q * greatest(v, 1e-300) ELSE abs(gap) > 1e-12 END AS far
        FROM (SELECT *, x1 / n1 - x2 / n2 - tried AS gap, p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2 AS v
        FROM (SELECT *, least(greatest(p2 + tried, 0), 1) AS p1
        FROM (SELECT *, least(greatest(2 * b * cos((pi() + acos(CASE WHEN b = 0 THEN 0 ELSE least(greatest(c / (b * b * b), -1), 1) END)) / 3) - a2 / (3 * a3), greatest(0, -tried)), least(1, 1 - tried)) AS p2
        FROM (SELECT *, CASE WHEN c >= 0 THEN 1 ELSE -1 END * sqrt(greatest(a2 * a2 / (9 * a3 * a3) - a1 / (3 * a3), 0)) AS b
        FROM (SELECT *, a2 * a2 * a2 / (27 * a3 * a3 * a3) - a1 * a2 / (6 * a3 * a3) + x2 * tried * (1 - tried) / (2 * a3) AS c
        FROM (SELECT *, n1 + n2 AS a3, (n1 + 2 * n2) * tried - n1 - n2 - x1 - x2 AS a2, (n2 * tried - n1 - n2 - 2 * x2) * tried + x1 + x2 AS a1 FROM bi WHERE step < 60))))))) AS far_at),
    bo AS (SELECT {key}, {", ".join(f"max(CASE WHEN hit THEN inside ELSE edge END) FILTER (kind = '{k}' AND edge = {e}) / 2 AS {k}_{name}" for k in "os" for e, name in ((-1, "low"), (1, "high")))} FROM bi WHERE step = 60 GROUP BY {key}),
    dc0 AS (SELECT *, x1 / nullif(n1, 0) AS q_ab, x2 / nullif(n2, 0) AS q_ba, (x1 / nullif(n1, 0) - x2 / nullif(n2, 0)) / 2 AS d, holm_p <= {FAMILY_ALPHA} AS holm_reject FROM in6 LEFT JOIN bo USING ({key})),
    dc AS (SELECT *, 0.5 + d AS balanced_rate, CASE WHEN NOT complete THEN 'unresolved_nonviable' WHEN s_low > {PRACTICAL} THEN 'practical_dominance_a' WHEN s_high < -{PRACTICAL} THEN 'practical_dominance_b'
        WHEN holm_reject AND d > 0 THEN 'statistical_only_advantage_a' WHEN holm_reject AND d < 0 THEN 'statistical_only_advantage_b' ELSE 'unresolved' END AS decision FROM dc0)"""


_DECIDED = "SELECT pair_id::BIGINT AS pair_id, strategy_a::BIGINT AS strategy_a, strategy_b::BIGINT AS strategy_b, complete, " + ", ".join(d(c, c) for c in ("q_ab", "q_ba", "d", "o_low", "o_high", "s_low", "s_high", "z", "p", "holm_p", "balanced_rate")) + ", holm_reject, decision FROM dc"
#: Graph tables on decisions: wx (edges), sx (scores), fx (fronts). Components are single strategies here unless a cycle joins them.
_WON = """, w0 AS (SELECT CASE WHEN decision LIKE '%_a' THEN strategy_a ELSE strategy_b END AS src, CASE WHEN decision LIKE '%_a' THEN strategy_b ELSE strategy_a END AS dst, decision LIKE 'practical%' AS practical, CASE WHEN decision LIKE '%_a' THEN s_low ELSE -s_high END AS bound FROM dc WHERE decision LIKE 'practical%' OR decision LIKE 'statistical%'),
    wx AS (SELECT src, dst, 'statistical' AS kind, bound AS distance FROM w0 UNION ALL SELECT src, dst, 'practical', bound - 0.03 FROM w0 WHERE practical),
    wp AS (SELECT src, dst FROM wx WHERE kind = 'practical'),
    sx0 AS (SELECT strategy_a AS strategy, balanced_rate AS rate, decision = 'practical_dominance_a' AS won, decision = 'practical_dominance_b' AS lost, complete FROM dc UNION ALL SELECT strategy_b, 1 - balanced_rate, decision = 'practical_dominance_b', decision = 'practical_dominance_a', complete FROM dc),
    sx AS (SELECT strategy, avg(rate) AS mean_rate, sum(won::INT) AS wins, sum(lost::INT) AS losses, bool_and(complete) AS eligible FROM sx0 GROUP BY strategy),
    rx AS (SELECT src, dst FROM wp UNION SELECT rx.src, wp.dst FROM rx JOIN wp ON rx.dst = wp.src),
    gx AS (SELECT strategy, least(strategy, coalesce((SELECT min(x.dst) FROM rx x JOIN rx y ON x.src = y.dst AND x.dst = y.src WHERE x.src = strategy), strategy)) AS component FROM sx),
    lx AS (SELECT DISTINCT a.component AS a, b.component AS b FROM wp JOIN gx a ON src = a.strategy JOIN gx b ON dst = b.strategy WHERE a.component <> b.component),
    fx0 AS (SELECT DISTINCT component, 1 AS front FROM gx UNION SELECT b, front + 1 FROM fx0 JOIN lx ON a = fx0.component),
    fx AS (SELECT component, max(front) AS front FROM fx0 GROUP BY component)"""
_STRENGTH = attempts(strategies=STRENGTH)


def strengths(source: str, rounds: int, prior: float = 0.5) -> str:
    """Adds gw (wins and updates of the completed exposures of source) and g<rounds> (strengths after so many rounds), each round written out."""
    out = f""",
    gd AS (SELECT root, k, game, strategy, rank FROM {source} WHERE NOT safety),
    gw AS (SELECT root, k, strategy, sum((rank < k)::INT) AS w, sum(least(rank, k - 1)) AS updates FROM gd GROUP BY root, k, strategy),
    g0 AS (SELECT root, k, strategy, 1.0::DOUBLE AS g FROM gw)"""
    for i in range(1, rounds + 1):
        out += f""",
    gs{i} AS (SELECT *, sum(g) OVER (PARTITION BY root, k, game ORDER BY rank DESC) AS stage FROM gd JOIN g{i - 1} USING (root, k, strategy)),
    gl{i} AS (SELECT *, sum(CASE WHEN rank < k THEN 1 / stage ELSE 0 END) OVER (PARTITION BY root, k, game ORDER BY rank) AS load FROM gs{i}),
    g{i} AS (SELECT root, k, strategy, (any_value(w) + {prior}) / (sum(load) + 2 * {prior} / (any_value(g) + 1)) AS g FROM gl{i} JOIN gw USING (root, k, strategy) GROUP BY root, k, strategy)"""
    return out


def family() -> str:
    return base() + """, fa AS (SELECT strategy, row_number() OVER (ORDER BY round(avg(won), 9) DESC, strategy) AS rate_rank, row_number() OVER (ORDER BY sum(score) DESC, strategy) AS rating_rank FROM e GROUP BY strategy)"""


def lagged(source: str, keys: str, order: str, value: str, lags: tuple[int, ...]) -> str:
    parts = []
    for lag in lags:
        parts.append(f"""SELECT {keys}, {lag}::BIGINT AS lag, count(*) AS observations, count(y) AS pairs, count(y)::HUGEINT * sum(CASE WHEN y IS NOT NULL THEN x * x END) - sum(CASE WHEN y IS NOT NULL THEN x END)::HUGEINT * sum(CASE WHEN y IS NOT NULL THEN x END) AS vx,
            count(y)::HUGEINT * sum(y * y) - sum(y)::HUGEINT * sum(y) AS vy, count(y)::HUGEINT * sum(x * y) - sum(CASE WHEN y IS NOT NULL THEN x END)::HUGEINT * sum(y) AS c
            FROM (SELECT {keys}, x, lag(x, {lag}) OVER (PARTITION BY {keys} ORDER BY {order}) AS y FROM (SELECT *, ({value})::BIGINT AS x FROM {source})) GROUP BY {keys}""")
    return f"""lg AS ({' UNION ALL '.join(parts)}), ls AS (SELECT *, CASE WHEN pairs < 2 THEN 'insufficient_pairs' WHEN vx <= 0 OR vy <= 0 THEN 'zero_variance' ELSE 'estimated' END AS status FROM lg)"""


def lag_out(keys: str) -> str:
    names = ", ".join(k if k == "matchup" else f"{k}::BIGINT AS {k}" for k in keys.split(", "))
    return f"SELECT {names}, {n('observations', 'observations')}, lag, {n('pairs', 'pairs')}, CASE WHEN status = 'estimated' THEN round(c::DOUBLE / (sqrt(vx::DOUBLE) * sqrt(vy::DOUBLE)), 6) + 0.0 END AS autocorr, status, CASE WHEN pairs > 0 THEN round(1.96 / sqrt(pairs), 6) END AS band FROM ls"


def boot() -> str:
    """Adds sc (replicate scores)."""
    return combined(FEW) + f""",
    full_n AS (SELECT root, k, count(DISTINCT strategy) AS all_n FROM bm GROUP BY ALL),
    good AS (SELECT root, k, batch, row_number() OVER (PARTITION BY root, k ORDER BY batch) - 1 AS pos FROM (SELECT root, k, batch FROM bm JOIN full_n USING (root, k) GROUP BY root, k, batch, all_n HAVING count(*) = all_n)),
    sz AS (SELECT root, k, count(*) AS b FROM good GROUP BY ALL),
    dr AS (SELECT root, k, rep, (('0x' || substr(md5(concat_ws(':', root, k, rep, dd)), 1, 8))::BIGINT % b) AS pos FROM sz, range({SCORES}) r(rep), range({BATCHES}) q(dd) WHERE dd < b),
    mu AS (SELECT root, k, rep, pos, count(*) AS times FROM dr GROUP BY ALL),
    sk AS (SELECT root, k, rep, strategy, sum(times * wins) / sum(times * exposures) - 1.0::DOUBLE / k AS x FROM mu JOIN good USING (root, k, pos) JOIN bm USING (root, k, batch) GROUP BY root, k, rep, strategy),
    sc AS (SELECT root, rep, strategy, avg(x) AS score FROM sk GROUP BY ALL)"""


#: The cells of each fraction's batches counted anew, and all pairs of strategies compared.
_CONVERGENCE = f""", ps AS (SELECT *, dense_rank() OVER (PARTITION BY root, k ORDER BY batch) - 1 AS pos FROM bm), nb AS (SELECT root, k, count(DISTINCT batch) AS nb FROM bm GROUP BY ALL),
    y0 AS (SELECT f AS fraction, root, k, strategy, sum(wins)::DOUBLE AS w, sum(exposures)::DOUBLE AS x, count(*) AS b, sum(wins::DOUBLE * wins) AS ww, sum(wins::DOUBLE * exposures) AS wn, sum(exposures::DOUBLE * exposures) AS nn
        FROM ps JOIN nb USING (root, k), unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) u(f) WHERE pos < ceil(f * nb) GROUP BY GROUPING SETS ((f, root, k, strategy), (f, k, strategy))),
    y AS (SELECT *, w / x - 1.0::DOUBLE / k AS delta, CASE WHEN b >= 2 THEN sqrt(b / (b - 1) * greatest(ww - 2 * (w / x) * wn + (w / x) * (w / x) * nn, 0)) / x END AS mcse FROM y0),
    fk AS (SELECT fraction, count(DISTINCT k) AS all_k FROM y GROUP BY fraction),
    s AS (SELECT fraction, root, strategy, round(avg(delta), 9) AS score, CASE WHEN count(mcse) = count(*) THEN sqrt(sum(mcse * mcse)) / count(*) END AS mcse FROM y JOIN fk USING (fraction) GROUP BY fraction, root, strategy, all_k HAVING count(*) = all_k),
    r AS (SELECT *, row_number() OVER (PARTITION BY fraction, root ORDER BY score DESC, strategy) AS rank, score >= round(max(score) OVER (PARTITION BY fraction, root) - 0.03, 9) AS near FROM s),
    ra AS (SELECT * FROM r WHERE root = 0), rb AS (SELECT * FROM r WHERE root = 1), rc AS (SELECT * FROM r WHERE root IS NULL), rf AS (SELECT u.f AS fraction, strategy, rank, near FROM rc, unnest([0.25::DOUBLE, 0.5, 0.75, 1.0]) u(f) WHERE fraction = 1),
    x AS (SELECT fraction, strategy, ra.rank AS a, rb.rank AS b, rc.rank AS c, rf.rank AS f, coalesce(rc.near, false) AS c_near, coalesce(rf.near, false) AS f_near, rc.mcse, abs(ra.score - rb.score) AS gap
        FROM ra FULL JOIN rb USING (fraction, strategy) FULL JOIN rc USING (fraction, strategy) FULL JOIN rf USING (fraction, strategy)),
    q AS (SELECT fraction, 'roots' AS kind, strategy, a AS x, b AS y FROM x UNION ALL SELECT fraction, 'a_final', strategy, a, f FROM x UNION ALL SELECT fraction, 'b_final', strategy, b, f FROM x UNION ALL SELECT fraction, 'both_final', strategy, c, f FROM x),
    qk AS (SELECT *, row_number() OVER (PARTITION BY fraction, kind ORDER BY x) AS rx, row_number() OVER (PARTITION BY fraction, kind ORDER BY y) AS ry FROM q WHERE x IS NOT NULL AND y IS NOT NULL),
    sp AS (SELECT fraction, kind, CASE WHEN count(*) >= 2 THEN corr(rx, ry) END AS spearman FROM qk GROUP BY ALL),
    kt AS (SELECT a.fraction, a.kind, avg(sign(a.x - b.x) * sign(a.y - b.y)) AS kendall FROM qk a JOIN qk b ON a.fraction = b.fraction AND a.kind = b.kind AND a.strategy < b.strategy GROUP BY ALL),
    al AS (SELECT fraction, {", ".join(f"max({c}) FILTER (kind = '{k}') AS {k}_{c}" for k, c in (("roots", "spearman"), ("roots", "kendall"), ("a_final", "spearman"), ("b_final", "spearman"), ("both_final", "spearman"), ("both_final", "kendall")))} FROM sp LEFT JOIN kt USING (fraction, kind) GROUP BY fraction),
    cv AS (SELECT fraction, count(a + b) AS n, sum(coalesce(a <= 2 AND b <= 2, false)::INT) AS top_both, sum((coalesce(a <= 2, false) OR coalesce(b <= 2, false))::INT) AS either, sum((c_near <> f_near)::INT) AS shortlist_difference, {Z} * quantile_cont(mcse, 0.5) AS half_width, max(gap) AS largest FROM x GROUP BY fraction)
    SELECT fraction, {n('cv.n', 'n')}, {n('top_both', 'top_both')}, {n('shortlist_difference', 'shortlist_difference')}, {d('half_width', 'half_width')}, {d('largest', 'largest_difference')}, {d('top_both / either', 'top_jaccard')},
        {", ".join(d(c, c) for c in ("roots_spearman", "roots_kendall", "a_final_spearman", "b_final_spearman", "both_final_spearman", "both_final_kendall"))} FROM cv LEFT JOIN al USING (fraction)"""


#: Distances back to each root by walks of any length over larger nodes; then the walks from the smallest root that closes soonest.
_CYCLES = f""", sz AS (SELECT component, count(*) AS size, list(strategy ORDER BY strategy) AS members FROM cg GROUP BY component HAVING count(*) > 1),
    ie AS (SELECT a.component, src, dst, distance FROM pe JOIN cg a ON src = a.strategy JOIN cg b ON dst = b.strategy JOIN sz ON sz.component = a.component WHERE a.component = b.component),
    bd AS (SELECT component, dst AS root, src AS node, 1 AS far FROM ie WHERE src > dst UNION SELECT ie.component, root, src, far + 1 FROM bd JOIN ie ON ie.component = bd.component AND dst = node WHERE src > root AND far < (SELECT max(size) FROM sz)),
    nr AS (SELECT component, root, node, min(far) AS far FROM bd GROUP BY ALL),
    cz AS (SELECT ie.component, min((far + 1, src)) AS best FROM ie JOIN nr ON nr.component = ie.component AND root = src AND node = dst GROUP BY ie.component),
    cy AS (SELECT component, best[1] AS edges, best[2] AS root, [best[2]] AS path FROM cz
        UNION ALL SELECT cy.component, edges, cy.root, list_append(path, dst) FROM cy JOIN ie ON ie.component = cy.component AND src = path[-1] JOIN nr ON nr.component = cy.component AND nr.root = cy.root AND nr.node = dst AND nr.far = edges - len(path) WHERE len(path) < edges),
    cb AS (SELECT component, min(path) AS cycle FROM cy WHERE len(path) = edges GROUP BY component)
    SELECT sz.component::BIGINT AS component, {n('size', 'size')}, members, {d('min(distance)', 'weakest')}, {d('max(distance)', 'strongest')}, any_value(cycle) AS cycle FROM sz JOIN ie USING (component) JOIN cb USING (component) GROUP BY sz.component, size, members"""


_P, _C, _F = performance(), combined(100), combined(FEW)
_len = lambda extra: f"{n('count(*)', 'n')}, {d('avg(n_rounds)', 'mean')}, {d('stddev_pop(n_rounds)', 'sd')}, {extra}"
_quant = ", ".join(d(f"quantile_cont(n_rounds, {q})", f"p{int(q * 100)}") for q in (0.1, 0.5, 0.9))
_shares = f"{d('avg((n_rounds <= 5)::INT)', 'le_5')}, {d('avg((n_rounds <= 10)::INT)', 'le_10')}, {d('avg((n_rounds >= 20)::INT)', 'ge_20')}"
#: Exposures with scores in hundreds, so that sums of squares stay exact in doubles.
_SMALL = "(SELECT * REPLACE (score // 10000 AS score) FROM e)"
_beh = ", ".join(f"count({b})::BIGINT AS {b}_observations, sum({b})::BIGINT AS {b}_sum, sum({b} * {b})::BIGINT AS {b}_square_sum" for b in ("rank", "loss_margin"))
_SEAT = base() + ", sc AS (SELECT root, k, batch, strategy, seat, sum(won) AS wins, count(*) AS attempted, sum((NOT safety)::INT) AS completed, sum(safety::INT) AS safety_exposures FROM e GROUP BY ALL), se AS (SELECT k, strategy, seat, sum(wins) AS wins, sum(attempted) AS attempted, sum(completed) AS completed, sum(wins) / sum(attempted) - 1.0::DOUBLE / k AS effect FROM sc GROUP BY GROUPING SETS ((k, strategy, seat), (k, seat)))"
_MIRROR = base(FEW) + """, two AS (SELECT *, least(strategies[1], strategies[2]) AS low, greatest(strategies[1], strategies[2]) AS high, strategies[1] < strategies[2] AS forward FROM g WHERE k = 2 AND strategies[1] <> strategies[2]),
    dn AS (SELECT *, row_number() OVER (PARTITION BY root, batch, low, high, forward ORDER BY game) AS rn FROM two WHERE NOT safety),
    f AS (SELECT root, batch, low, high, rn, (winner_seat = 1)::INT AS w FROM dn WHERE forward), r AS (SELECT root, batch, low, high, rn, (winner_seat = 1)::INT AS w FROM dn WHERE NOT forward),
    fr AS (SELECT root, batch, low, high, count(f.w) FILTER (r.w IS NOT NULL) AS matches, coalesce(sum(f.w - r.w), 0) AS difference, sum((f.w IS NULL OR r.w IS NULL)::INT) AS unmatched FROM f FULL JOIN r USING (root, batch, low, high, rn) GROUP BY root, batch, low, high),
    mp AS (SELECT two.root, two.batch, two.low, two.high, sum(safety::INT) AS safety_games, coalesce(any_value(matches), 0) AS matches, coalesce(any_value(difference), 0) AS difference, coalesce(any_value(unmatched), 0) AS unmatched FROM two LEFT JOIN fr ON two.root = fr.root AND two.batch = fr.batch AND two.low = fr.low AND two.high = fr.high GROUP BY ALL)"""
_mirror_out = f"{n('safety_games', 'safety_games')}, {n('matches', 'matches')}, {n('difference', 'difference')}, {n('unmatched', 'unmatched')}, CASE WHEN matches > 0 THEN round(difference / matches, 6) + 0.0 END AS mean_difference"

SQL = {
    "exposures": base() + " SELECT game, seat::BIGINT AS seat, strategy::BIGINT AS strategy, score, rank::BIGINT AS rank, winner_seat::BIGINT AS winner_seat, loss_margin, safety FROM e",
    "combine_k": base() + " SELECT game, k::BIGINT AS k, strategies[1]::BIGINT AS P1_strategy, strategies[2]::BIGINT AS P2_strategy, strategies[3]::BIGINT AS P3_strategy, strategies[6]::BIGINT AS P6_strategy FROM g",
    "winner_decode": base() + " SELECT game, winner_seat::BIGINT AS winner_seat, strategies[winner_seat]::BIGINT AS winner_strategy FROM g",
    "wide_exposures": base() + f" SELECT k::BIGINT AS k, seat::BIGINT AS seat, {n('count(*)', 'rows')}, {n('sum(score)', 'score')}, {n('sum(winner_seat)', 'winners')} FROM e GROUP BY k, seat",
    "normalize_ids": f"SELECT event_type, {n('count(t)', 'n')}, {n('count(try_cast(t AS INT))', 'whole')}, {n('max(try_cast(t AS INT))', 'largest')} FROM (SELECT event_type, props::JSON ->> '$.k' AS t FROM events) GROUP BY event_type",
    "parse_strategy_text": "SELECT p_partkey, p_partkey % 7 <> 0 AS parsed, CASE WHEN p_partkey % 7 <> 0 THEN p_size::BIGINT END AS score_threshold, CASE WHEN p_partkey % 7 <> 0 THEN 2::BIGINT END AS dice_threshold, CASE WHEN p_partkey % 7 <> 0 THEN 'SD' END AS smart, CASE WHEN p_partkey % 7 <> 0 THEN 'FO' END AS favor, CASE WHEN p_partkey % 7 <> 0 THEN 'AND' END AS logic, CASE WHEN p_partkey % 7 <> 0 THEN 'H-' END AS hot FROM part",
    "manifest_reconcile": base() + """, f AS (SELECT root, k, batch AS shard, count(*) AS found FROM g GROUP BY ALL),
        m AS (SELECT root, k, shard, CASE WHEN root = 1 AND shard = 4 THEN found + 1 ELSE found END AS declared, 1 AS records FROM f WHERE NOT (root = 0 AND shard = 3)),
        m2 AS (SELECT root, k, shard, CASE WHEN root = 1 AND k = 2 AND shard = 5 THEN 2 * declared ELSE declared END AS declared, CASE WHEN root = 1 AND k = 2 AND shard = 5 THEN 2 ELSE 1 END AS records FROM m),
        x AS (SELECT root, k, shard, declared, found, CASE WHEN found IS NULL THEN 'missing' WHEN records IS NULL THEN 'extra' WHEN records > 1 THEN 'repeated' WHEN declared <> found THEN 'row_count' END AS issue FROM m2 FULL JOIN f USING (root, k, shard))
        SELECT root, k::BIGINT AS k, shard::BIGINT AS shard, declared::BIGINT AS declared, found::BIGINT AS found, issue FROM x WHERE issue IS NOT NULL""",
    "negative_columns": base() + ' SELECT \'debt\' AS "column", min(seat - k)::BIGINT AS minimum FROM e',
    "rowcount_reconcile": base() + f" SELECT k::BIGINT AS k, {n('count(*)', 'rows')} FROM g GROUP BY GROUPING SETS ((k), ())",
    "rectangular_support": base() + f" SELECT zf.root, zf.k::BIGINT AS k, {n('count(*)', 'cells')}, {n('count(bm.exposures)', 'declared')}, {n('sum((zf.exposures > 0)::INT)', 'positive')}, 0::BIGINT AS zero, 0::BIGINT AS repeated, {n('sum((bm.exposures IS NULL)::INT)', 'missing')} FROM zf LEFT JOIN bm USING (root, k, batch, strategy) GROUP BY zf.root, zf.k",
    "exposure_conservation": base() + " SELECT root, k::BIGINT AS k, batch::BIGINT AS batch, strategy::BIGINT AS strategy, unnest(CASE WHEN wins > completed - 1 THEN ['attempted', 'wins'] ELSE ['attempted'] END) AS rule FROM bm WHERE strategy = 7",
    "rank_row_classify": base() + " SELECT CASE WHEN safety THEN 'excluded' ELSE 'rated' END AS class, count(*) AS count FROM g GROUP BY 1",
    "row_contract_violations": base() + " SELECT rule, CASE WHEN rule = 'repeated_strategy' THEN (SELECT count(*) FROM g WHERE len(list_distinct(strategies)) < k) ELSE 0 END AS rows FROM unnest(['k_mismatch', 'null_strategy', 'null_score', 'id_range', 'repeated_strategy', 'no_rounds', 'winner_missing', 'winner_not_first', 'rank_permutation', 'rank_order', 'winning_score', 'margin', 'safety_has_winner', 'safety_has_margin', 'safety_has_ranks']) t(rule)",
    "pair_family_issues": attempts() + ", x AS (SELECT * FROM pd WHERE pair_id % 11 <> 3), ns AS (SELECT strategy_a AS s FROM x UNION SELECT strategy_b FROM x) SELECT 'absent' AS issue, a.s::BIGINT AS low, b.s::BIGINT AS high FROM ns a JOIN ns b ON a.s < b.s WHERE NOT EXISTS (SELECT 1 FROM x WHERE strategy_a = a.s AND strategy_b = b.s)",
    "batch_metrics": base() + f""" SELECT root, k::BIGINT AS k, batch::BIGINT AS batch, strategy::BIGINT AS strategy, {n('count(*)', 'exposures')}, {n('sum((NOT safety)::INT)', 'completed')}, {n('sum(safety::INT)', 'safety_exposures')}, {n('sum(won)', 'wins')}, {n('sum(1 - won)', 'losses')}, {n('sum((n_turns <> n_rounds)::INT)', 'mismatches')},
        {n('sum(score)', 'score_sum')}, {n('sum(score * score)', 'score_square_sum')}, {n('sum(n_turns)', 'turns_sum')}, {n('sum(n_turns * n_turns)', 'turns_square_sum')}, {n('sum(n_turns - n_rounds)', 'gap_sum')}, {n('sum((n_turns - n_rounds) * (n_turns - n_rounds))', 'gap_square_sum')},
        {d('sum(score / n_turns)', 'per_turn_sum')}, {d('sum((score / n_turns) * (score / n_turns))', 'per_turn_square_sum')}, {d('sum(score / n_rounds)', 'per_round_sum')}, {d('sum((score / n_rounds) * (score / n_rounds))', 'per_round_square_sum')}, {_beh} FROM {_SMALL} GROUP BY root, k, batch, strategy""",
    "turn_returns": base() + f", x AS (SELECT root, k, batch, strategy, sum(score) / sum(n_turns) AS t, sum(score / n_turns) / count(*) AS a, sum(score / n_rounds) / count(*) AS r, avg((n_turns <> n_rounds)::INT) AS m, avg(won) AS w, sum(won) / nullif(sum((NOT safety)::INT), 0) AS wc, avg(safety::INT) AS s FROM {_SMALL} GROUP BY ALL) SELECT root, k::BIGINT AS k, batch::BIGINT AS batch, strategy::BIGINT AS strategy, {d('t', 'turn_return')}, {d('a', 'game_return')}, {d('r', 'round_return')}, {d('r - a', 'return_gap')}, {d('(r - a) / a', 'relative_gap')}, {d('m', 'mismatch_rate')}, {d('w', 'win_rate')}, {d('wc', 'win_rate_completed')}, {d('s', 'safety_rate')} FROM x",
    "game_summary": base() + f" SELECT k::BIGINT AS k, winner_seat::BIGINT AS winner_seat, {n('count(*)', 'games')}, {d('avg(n_rounds)', 'mean_rounds')}, {d('count(*) / sum(count(*)) OVER (PARTITION BY k)', 'share')} FROM g GROUP BY k, winner_seat",
    "winner_metrics": base() + ", x AS (SELECT k, strategy, count(*) AS attempted, sum(won) AS wins, " + ", ".join(f"coalesce(sum({c}) FILTER (won = 1), 0)::DOUBLE AS {c}_s, coalesce(sum({c}::BIGINT * {c}) FILTER (won = 1), 0)::DOUBLE AS {c}_q" for c in ("score", "n_turns", "n_rounds")) + f" FROM {_SMALL} GROUP BY k, strategy) SELECT k::BIGINT AS k, strategy::BIGINT AS strategy, " + f"{n('attempted', 'attempted')}, {n('wins', 'wins')}, " + ", ".join(f"{n(f'{c}_s', f'{c}_sum')}, {n(f'{c}_q', f'{c}_square_sum')}, {d(f'CASE WHEN wins > 0 THEN {c}_s / wins ELSE 0 END', f'{c}_mean')}, {d(f'CASE WHEN wins > 0 THEN greatest({c}_q / wins - ({c}_s / wins) * ({c}_s / wins), 0) ELSE 0 END', f'{c}_variance')}" for c in ("score", "n_turns", "n_rounds")) + f", {d('score_s / attempted', 'expected_score')} FROM x",
    "seat_counts": _SEAT + f" SELECT root, k::BIGINT AS k, batch::BIGINT AS batch, strategy::BIGINT AS strategy, seat::BIGINT AS seat, {n('wins', 'wins')}, {n('attempted', 'attempted')}, {n('completed', 'completed')}, {n('safety_exposures', 'safety_exposures')} FROM sc",
    "seat_effects": _SEAT + f" SELECT k::BIGINT AS k, strategy::BIGINT AS strategy, seat::BIGINT AS seat, {n('wins', 'wins')}, {n('attempted', 'attempted')}, {n('completed', 'completed')}, {n('attempted - wins', 'losses')}, {d('wins / attempted', 'win_rate')}, {d('CASE WHEN completed > 0 THEN wins / completed END', 'win_rate_completed')}, {d('effect', 'effect')} FROM se",
    "seat_standardized": _SEAT + f" SELECT strategy::BIGINT AS strategy, seat::BIGINT AS seat, {d('sum(CASE k WHEN 4 THEN 0.5 ELSE 0.25 END * effect)', 'effect')} FROM se WHERE k IN (2, 3, 4) AND seat <= 2 GROUP BY strategy, seat HAVING count(DISTINCT k) = 3",
    "seat_mixture": _SEAT + f" SELECT strategy::BIGINT AS strategy, seat::BIGINT AS seat, {n('sum(wins)', 'wins')}, {n('sum(attempted)', 'attempted')}, {d('sum(wins) / sum(attempted)', 'win_rate')}, {d('sum(attempted / k) / sum(attempted)', 'baseline')}, {d('(sum(wins) - sum(attempted / k)) / sum(attempted)', 'effect')} FROM sc GROUP BY strategy, seat",
    "selfplay": base() + f", x AS (SELECT root, k, strategies[1] AS strategy, sum(coalesce(winner_seat = 1, false)::INT) AS w, count(*) AS a, sum((NOT safety)::INT) AS c FROM g WHERE len(list_distinct(strategies)) = 1 GROUP BY ALL) SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, {n('w', 'first_wins')}, {n('a', 'attempted')}, {n('c', 'completed')}, {d('w / a', 'first_rate')}, {d('CASE WHEN c > 0 THEN w / c END', 'first_rate_completed')}, {d('w / a - 1.0::DOUBLE / k', 'effect')} FROM x",
    "length_stats": base() + f" SELECT k::BIGINT AS k, strategy::BIGINT AS strategy, {_len(_quant)}, {_shares} FROM e GROUP BY k, strategy UNION ALL SELECT k::BIGINT, NULL, {_len(_quant)}, {_shares} FROM g GROUP BY k",
    "global_length_stats": base() + f" SELECT k::BIGINT AS players, {_len(d('quantile_cont(n_rounds, 0.5)', 'p50'))} FROM g GROUP BY k",
    "margin_stats": base() + f" SELECT k::BIGINT AS k, strategy::BIGINT AS strategy, {n('count(margin)', 'n')}, " + ", ".join(f"{d(f'avg({c})', f'{c}_mean')}, {d(f'quantile_cont({c}, 0.5)', f'{c}_median')}, {d(f'stddev_pop({c})', f'{c}_sd')}, {d(f'avg(({c} <= 50000)::INT)', f'{c}_le_50000')}, {d(f'avg(({c} <= 500000)::INT)', f'{c}_le_500000')}" for c in ("margin", "spread")) + " FROM em WHERE NOT safety GROUP BY k, strategy",
    "margin_stats_binned": base() + f", b AS (SELECT k, strategy, margin // 25 AS bin, count(*) AS c FROM em WHERE NOT safety GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY k, strategy ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY k, strategy) AS total FROM b) SELECT k::BIGINT AS k, strategy::BIGINT AS strategy, {n('max(total)', 'n')}, {d('(min(bin) FILTER (cum >= ceil(total * 0.5)) + 0.5) * 25', 'quantile')}, {d('coalesce(sum(c) FILTER (bin <= 20000), 0) / max(total)', 'share_le')} FROM r GROUP BY k, strategy",
    "rare_event_flags": base() + ", x AS (SELECT game, k, strategies, len(list_filter(scores, lambda s: s >= 4000000)) >= 2 AS multi_target, coalesce(margin <= 50000, false) AS margin_le_50000 FROM g) SELECT game, k::BIGINT AS k, unnest(strategies)::BIGINT AS strategy, multi_target, margin_le_50000 FROM x WHERE multi_target OR margin_le_50000",
    "rare_event_rates": base() + f", x AS (SELECT k, strategy, count(*) AS a, sum((NOT safety)::INT) AS c, sum((second >= 4000000)::INT) AS t, coalesce(sum((margin <= 50000)::INT), 0) AS m1, coalesce(sum((margin <= 100000)::INT), 0) AS m2 FROM em GROUP BY GROUPING SETS ((k, strategy), (k))) SELECT k::BIGINT AS k, strategy::BIGINT AS strategy, {n('a', 'attempted')}, {n('c', 'completed')}, {n('t', 'target_count')}, {n('m1', 'le_50000_count')}, {n('m2', 'le_100000_count')}, {d('t / a', 'target_rate')}, {d('m1 / nullif(c, 0)', 'le_50000_rate')}, {d('m2 / nullif(c, 0)', 'le_100000_rate')} FROM x",
    "rare_thresholds": base() + f" SELECT k::BIGINT AS k, {n('quantile_disc(margin, 0.05)', 'margin_threshold')}, {n('quantile_disc(second, 0.95)', 'target')} FROM g GROUP BY k",
    "event_thresholds": f", r AS (SELECT event_type, v, sum(c) OVER (PARTITION BY event_type ORDER BY v) AS cum, sum(c) OVER (PARTITION BY event_type) AS n FROM (SELECT event_type, round_even(value, 0)::BIGINT AS v, count(*) AS c FROM events GROUP BY 1, 2)) SELECT event_type, {n('min(v)', 'threshold')}, {n('any_value(n)', 'n')} FROM r WHERE cum >= ceil(n * 0.9) GROUP BY event_type".replace(", r AS", "WITH r AS", 1),
    "equal_k_mean": base() + f", x AS (SELECT k, strategy, count(*) AS n, avg(n_rounds) AS m, stddev_pop(n_rounds) AS s, quantile_cont(n_rounds, 0.5) AS p FROM e GROUP BY k, strategy) SELECT strategy::BIGINT AS strategy, {n('sum(n)', 'n')}, {d('avg(m)', 'mean')}, {d('avg(s)', 'sd')}, {d('avg(p)', 'p50')} FROM x GROUP BY strategy HAVING count(DISTINCT k) = (SELECT count(DISTINCT k) FROM e)",
    "performance_by_k": _P + f""" SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, {n('w', 'wins')}, {n('x', 'exposures')}, {n('completed', 'completed')}, {n('safety_exposures', 'safety_exposures')}, {n('losses', 'losses')}, {n('declared_batches', 'declared_batches')}, {n('batches', 'batches')}, {n('declared_batches - batches', 'excluded_cells')}, {d('rate', 'win_rate')}, {d('CASE WHEN completed > 0 THEN w / completed END', 'win_rate_completed')}, {d('delta', 'delta')},
        {d('wl', 'wilson_low')}, {d('wh', 'wilson_high')}, wh - wl <= 0.03 AS resolved, {d('mcse', 'mcse')}, {d('CASE WHEN mcse IS NOT NULL THEN greatest(rate - crit * mcse, 0) END', 'batch_low')}, {d('CASE WHEN mcse IS NOT NULL THEN least(rate + crit * mcse, 1) END', 'batch_high')} FROM pk""",
    "performance_across_k": _P + f" SELECT root, strategy::BIGINT AS strategy, {n('n_k', 'n_k')}, complete, {n('w', 'wins')}, {n('x', 'exposures')}, {d('score', 'score')}, {d('mcse', 'mcse')}, {d(f'score - {Z} * mcse', 'low')}, {d(f'score + {Z} * mcse', 'high')}, {d('min_delta', 'min_delta')}, {n('worst_k', 'worst_k')} FROM ak",
    "weighted_across_k": _P + f", x AS (SELECT *, (k - 1)::DOUBLE / 15 AS wt FROM pk) SELECT root, strategy::BIGINT AS strategy, {d('sum(wt * delta)', 'score')}, {d('sqrt(sum(wt * wt * mcse * mcse))', 'mcse')} FROM x GROUP BY root, strategy HAVING count(DISTINCT k) = 5",
    "log_odds_effects": _P + f" SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, {d('log_odds', 'log_odds')}, reason FROM lo",
    "log_odds_spread": _P + f" SELECT root, k::BIGINT AS k, {n('count(log_odds)', 'n')}, {d('stddev_samp(log_odds)', 'sd')}, {d('quantile_cont(log_odds, 0.75) - quantile_cont(log_odds, 0.25)', 'iqr')}, {d('max(log_odds) - quantile_cont(log_odds, 0.5)', 'top_gap')} FROM lo GROUP BY root, k",
    "k_pair_contrast": _P + f" SELECT a.root, a.strategy::BIGINT AS strategy, a.k::BIGINT AS k_a, b.k::BIGINT AS k_b, {d('b.log_odds - a.log_odds', 'contrast')} FROM lo a JOIN lo b ON a.root = b.root AND a.strategy = b.strategy AND a.k < b.k",
    "score_rank": _P + " SELECT root, strategy::BIGINT AS strategy, row_number() OVER (PARTITION BY root ORDER BY round(score, 9) DESC, strategy) AS rank FROM ak WHERE score IS NOT NULL",
    "score_leaders": _P + f", x AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY round(score, 9) DESC, strategy) AS place FROM ak WHERE score IS NOT NULL) SELECT root, place, strategy::BIGINT AS strategy, {d('score', 'score')}, {n('worst_k', 'worst_k')}, {d('min_delta', 'min_delta')} FROM x WHERE place <= 5",
    "maximin": _P + f", x AS (SELECT root, strategy, round(min_delta, 9) AS m FROM ak WHERE complete) SELECT root, min(strategy)::BIGINT AS strategy, {d('any_value(m)', 'min_delta')} FROM x WHERE m >= (SELECT max(m) FROM x y WHERE y.root = x.root) GROUP BY root",
    "pareto_front": _P + ", v AS (SELECT root, strategy, list(round(delta, 9) ORDER BY k) AS v FROM pk JOIN kk USING (root) GROUP BY root, strategy, all_k HAVING count(*) = all_k) SELECT root, strategy::BIGINT AS strategy FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE a.root = b.root AND len(list_filter(list_zip(b.v, a.v), lambda z: z[1] < z[2])) = 0 AND len(list_filter(list_zip(b.v, a.v), lambda z: z[1] > z[2])) > 0)",
    "screening_frame": _P + f""", x AS (SELECT root, strategy, round(score, 9) AS score FROM ak WHERE complete), y AS (SELECT root, strategy, round(delta, 9) >= max(round(delta, 9)) OVER (PARTITION BY root, k) - 0.03 AS near FROM pk), z AS (SELECT root, strategy, bool_and(near) AS band_every_k, sum(near::INT) AS band_count FROM y GROUP BY ALL)
        SELECT root, strategy::BIGINT AS strategy, {d('score', 'score')}, row_number() OVER w AS rank, row_number() OVER w <= 10 AS top, score >= max(score) OVER (PARTITION BY root) - 0.03 AS band, band_every_k, {n('band_count', 'band_count')}, strategy IN (1, 2) AS control FROM x JOIN z USING (root, strategy) WINDOW w AS (PARTITION BY root ORDER BY score DESC, strategy)""",
    "root_combined_by_k": _F + f" SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, {n('w', 'wins')}, {n('x', 'exposures')}, {n('batches', 'batches')}, {d('r', 'win_rate')}, {d('delta', 'delta')}, {d('mcse', 'mcse')}, {position('delta')} AS position FROM rc",
    "root_discrepancies": _F + " " + discrepancy("rc", "k, strategy", "delta"),
    "root_discrepancies_across_k": _F + " " + discrepancy("ra", "strategy", "score"),
    "half_drift": base(FEW) + f""", ps AS (SELECT *, dense_rank() OVER (PARTITION BY root, k ORDER BY batch) - 1 AS pos FROM bm), nb AS (SELECT root, k, count(DISTINCT batch) AS nb FROM bm GROUP BY ALL),
        h AS (SELECT root, k, strategy, (pos >= nb // 2)::INT AS half, sum(wins)::DOUBLE AS w, sum(exposures)::DOUBLE AS x, count(*) AS b, sum(wins::DOUBLE * wins) AS ww, sum(wins::DOUBLE * exposures) AS wn, sum(exposures::DOUBLE * exposures) AS nn FROM ps JOIN nb USING (root, k) GROUP BY ALL),
        hh AS (SELECT *, w / x AS r, CASE WHEN b >= 2 THEN sqrt(b / (b - 1) * greatest(ww - 2 * (w / x) * wn + (w / x) * (w / x) * nn, 0)) / x END AS m FROM h)
        SELECT a.root, a.k::BIGINT AS k, a.strategy::BIGINT AS strategy, {d('a.r', 'rate_0')}, {d('b.r', 'rate_1')}, {d('b.r - a.r', 'drift')}, {d('sqrt(a.m * a.m + b.m * b.m)', 'expected')}, {standardized('(b.r - a.r)', 'sqrt(a.m * a.m + b.m * b.m)')} AS standardized FROM hh a JOIN hh b ON a.root = b.root AND a.k = b.k AND a.strategy = b.strategy AND a.half = 0 AND b.half = 1""",
    "safety_by_cell": base() + f", x AS (SELECT root, k, sum(exposures) AS a, sum(completed) AS c, sum(safety_exposures) AS s FROM bm GROUP BY ALL) SELECT root, k::BIGINT AS k, {n('a // k', 'attempted_games')}, {n('c // k', 'completed_games')}, {n('s // k', 'safety_games')}, a % k = 0 AND c % k = 0 AS whole, {d('s / a', 'safety_rate')} FROM x",
    "mirrored_pairs": _MIRROR + f" SELECT root, batch::BIGINT AS batch, low::BIGINT AS low, high::BIGINT AS high, {_mirror_out} FROM mp",
    "mirrored_totals": _MIRROR + f", mt AS (SELECT root, low, high, sum(safety_games) AS safety_games, sum(matches) AS matches, sum(difference) AS difference, sum(unmatched) AS unmatched FROM mp GROUP BY ALL) SELECT root, low::BIGINT AS low, high::BIGINT AS high, {_mirror_out} FROM mt",
    "observation_histogram": base() + f", x AS (SELECT strategy, k, count(*) AS o FROM e GROUP BY ALL) SELECT {n('(o >= 2)::INT + (o >= 10)::INT + (o >= 100)::INT + (o >= 1000)::INT', 'size_class')}, {n('count(*)', 'groups')}, {n('sum(o)', 'observations')} FROM x GROUP BY 1",
    "group_eligibility": base() + " SELECT strategy::BIGINT AS strategy, k::BIGINT AS k, count(*) AS observations, count(*) >= 32 AS eligible FROM e GROUP BY strategy, k",
    "eligible_rows": base() + f" SELECT k::BIGINT AS k, {n('count(*)', 'rows')}, {n('sum(score)', 'score')} FROM e WHERE (strategy, k) IN (SELECT (strategy, k) FROM e GROUP BY strategy, k HAVING count(*) >= 32) GROUP BY k",
    "priority_cap": base() + f", x AS (SELECT strategy, count(*) AS o FROM e GROUP BY strategy) SELECT strategy::BIGINT AS strategy, {n('o', 'observations')}, o >= 3 AS eligible, (SELECT count(*) FROM x) AS total, CASE WHEN (SELECT count(*) FROM x) > 20 THEN 'blocked_by_cap' ELSE 'complete' END AS status FROM x ORDER BY md5(strategy::VARCHAR), strategy LIMIT 20",
    "lag_autocorr_strategy": base() + ", " + lagged("e", "strategy, k", "root, game, seat", "won", (1, 2, 4)) + " " + lag_out("strategy, k"),
    "lag_autocorr_matchup": base(FEW) + ", gm AS (SELECT *, array_to_string(list_sort(strategies), ' | ') AS matchup FROM g), " + lagged("gm", "matchup", "root, game", "n_rounds", (1,)) + " " + lag_out("matchup"),
    "lag_autocorr_events": "WITH " + lagged("events", "user_id", "ts, event_id", "round(value * 100)", (1, 2)) + " " + lag_out("user_id"),
    "estimability": "WITH " + lagged("events", "user_id", "ts, event_id", "round(value * 100)", (1, 2)) + " SELECT lag, status, count(*) AS count FROM ls GROUP BY ALL",
    "top_n_overlap": _C + f" SELECT t::BIGINT AS top_n, {n('sum((a <= t AND b <= t)::INT)', 'both')}, {n('sum((a <= t OR b <= t)::INT)', 'either')}, {d('sum((a <= t AND b <= t)::INT) / sum((a <= t OR b <= t)::INT)', 'jaccard')} FROM ab, unnest([10, 25, 50]) u(t) GROUP BY t",
    "rank_movement": _C + f", x AS (SELECT abs(a - b) AS move, unnest(CASE WHEN least(a, b) <= 25 THEN ['all', 'top'] ELSE ['all'] END) AS scope FROM ab) SELECT scope, {n('count(*)', 'n')}, {d('quantile_cont(move, 0.5)', 'median')}, {d('quantile_cont(move, 0.95)', 'p95')}, {n('max(move)', 'largest')} FROM x GROUP BY scope",
    "control_movement": _C + f", x AS (SELECT * FROM rr WHERE strategy IN (1, 2, 3)) SELECT strategy::BIGINT AS strategy, {', '.join(f'{n(f'max(rank) FILTER ({c})', f'{p}_rank')}, {d(f'max(score) FILTER ({c})', f'{p}_score')}' for p, c in (('a', 'root = 0'), ('b', 'root = 1'), ('both', 'root IS NULL')))} FROM x GROUP BY strategy",
    "shortlist_changes": _C + ", x AS (SELECT root, strategy, score >= round(max(score) OVER (PARTITION BY root) - 0.03, 9) AS near FROM rr), y AS (SELECT strategy, bool_or(near) FILTER (root = 0) AS in_a, bool_or(near) FILTER (root = 1) AS in_b, bool_or(near) FILTER (root IS NULL) AS in_both FROM x GROUP BY strategy) SELECT strategy::BIGINT AS strategy, in_a, in_b, in_both, in_a <> in_b AS changed, in_a <> in_both OR in_b <> in_both AS differs FROM y WHERE in_a <> in_b OR in_a <> in_both OR in_b <> in_both",
    "matched_convergence": base(FEW) + _CONVERGENCE,
    "pair_schedule": base(10) + ", s AS (SELECT DISTINCT strategy FROM e), p AS (SELECT a.strategy AS sa, b.strategy AS sb, row_number() OVER (ORDER BY a.strategy, b.strategy) - 1 AS pair_id FROM s a JOIN s b ON a.strategy < b.strategy) SELECT pair_id, sa::BIGINT AS strategy_a, sb::BIGINT AS strategy_b, root, so::BIGINT AS seat_order, CASE so WHEN 0 THEN sa ELSE sb END::BIGINT AS seat1, CASE so WHEN 0 THEN sb ELSE sa END::BIGINT AS seat2, substr(md5(concat_ws(':', sa, sb, root, so)), 1, 16) AS block_id, 100::BIGINT AS target FROM p, (SELECT DISTINCT root FROM e), unnest([0, 1]) u(so)",
    "schedule_coverage": attempts() + """, s AS (SELECT a.strategy * 10 + b.strategy AS pair_id, root, so AS seat_order FROM nd a JOIN nd b ON a.strategy < b.strategy, (SELECT DISTINCT root FROM e), unnest([0, 1]) u(so)), x AS (SELECT pair_id, root, seat_order, pair_id = 13 AS bad FROM bl WHERE pair_id % 5 <> 2)
        SELECT pair_id::BIGINT AS pair_id, root, seat_order::BIGINT AS seat_order, CASE WHEN bad IS NULL THEN 'missing' ELSE 'inconsistent' END AS issue FROM s LEFT JOIN x USING (pair_id, root, seat_order) WHERE bad IS NULL OR bad""",
    "prefix_until_target": attempts(f"before < {TARGET} AND attempt < {CAP}") + f" SELECT pair_id::BIGINT AS pair_id, strategy_a::BIGINT AS strategy_a, strategy_b::BIGINT AS strategy_b, root, seat_order::BIGINT AS seat_order, {', '.join(n(c, c) for c in ('attempted', 'completed', 'safety', 'replacements', 'wins_seat1', 'wins_seat2', 'wins_a', 'wins_b'))}, status FROM bl",
    "order_combine": attempts() + f" SELECT pair_id::BIGINT AS pair_id, strategy_a::BIGINT AS strategy_a, strategy_b::BIGINT AS strategy_b, {n('coalesce(attempted_0, 0)', 'attempted_0')}, {n('coalesce(attempted_1, 0)', 'attempted_1')}, {', '.join(n(c, c) for c in ('completed_0', 'completed_1', 'wins_a_0', 'wins_a_1'))}, {d('completed_0 / attempted_0', 'completion_0')}, {d('completed_1 / attempted_1', 'completion_1')}, complete FROM oc",
    "viability": attempts() + f", x AS (SELECT strategy_a AS s, * FROM bl UNION ALL SELECT strategy_b AS s, * FROM bl) SELECT s::BIGINT AS strategy, {n('sum(attempted)', 'attempted')}, {n('sum(completed)', 'completed')}, bool_and(status = 'complete') AS inferential, {d('sum(completed) / sum(attempted)', 'rate')}, sum(completed) / sum(attempted) >= 0.95 AS operational FROM x GROUP BY s",
    "root_agreement": attempts() + f" SELECT pair_id::BIGINT AS pair_id, {d('d_0', 'd_0')}, {d('d_1', 'd_1')}, {d('d_0 - d_1', 'discrepancy')}, sign(d_0) = sign(d_1) AS direction_agrees, abs(d_0 - d_1) > 0.03 AS practical_difference FROM rg",
    "holm_adjust": attempts() + f", x AS (SELECT pair_id, CASE WHEN pair_id % 7 <> 0 THEN round(exp(-40 * d * d), 6) END AS p FROM pd), y AS (SELECT *, least(coalesce(p, 1) * (count(*) OVER () - row_number() OVER (ORDER BY coalesce(p, 1), pair_id) + 1), 1) AS s FROM x), z AS (SELECT *, max(s) OVER (ORDER BY coalesce(p, 1), pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM y) SELECT pair_id::BIGINT AS pair_id, {d('p', 'p')}, {d('h', 'holm_p')}, h <= 0.02 AS holm_reject FROM z",
    "decision_table": attempts() + f" SELECT decision, {n('count(*)', 'pairs')}, {d('avg(abs(d))', 'mean_effect')} FROM pd GROUP BY decision",
    "win_edges": attempts() + f" SELECT src::BIGINT AS src, dst::BIGINT AS dst, kind, {d('distance', 'distance')} FROM ed",
    "round_robin_scores": attempts() + f" SELECT strategy::BIGINT AS strategy, {d('mean_rate', 'mean_rate')}, {n('wins', 'wins')}, {n('losses', 'losses')}, eligible, {n('wins - losses', 'net')} FROM rs",
    "cycle_groups": attempts() + " SELECT strategy::BIGINT AS strategy, component::BIGINT AS component, count(*) OVER (PARTITION BY component) AS size FROM cg",
    "h2h_inference": attempts() + inference() + " " + _DECIDED,
    "score_test": attempts() + inference() + f" SELECT pair_id::BIGINT AS pair_id, {d('z', 'z')}, {d('p', 'p')} FROM dc",
    "score_interval": attempts() + inference() + f" SELECT pair_id::BIGINT AS pair_id, {d('2 * o_low', 'ordinary_low')}, {d('2 * o_high', 'ordinary_high')} FROM dc",
    "strength_decisions": _STRENGTH + inference() + " " + _DECIDED,
    "strength_edges": _STRENGTH + inference() + _WON + f" SELECT src::BIGINT AS src, dst::BIGINT AS dst, kind, {d('distance', 'distance')} FROM wx",
    "strength_fronts": _STRENGTH + inference() + _WON + f" SELECT strategy::BIGINT AS strategy, component::BIGINT AS component, front::BIGINT AS front, {d('mean_rate', 'mean_rate')}, {n('wins', 'wins')}, {n('losses', 'losses')}, {n('wins - losses', 'net')}, eligible FROM gx JOIN fx USING (component) JOIN sx USING (strategy)",
    "strength_best": _STRENGTH + inference() + _WON + " SELECT src::BIGINT AS strategy, count(DISTINCT dst) AS beats FROM wp JOIN sx ON strategy = src WHERE eligible GROUP BY src HAVING count(DISTINCT dst) = (SELECT count(*) - 1 FROM sx)",
    "root_decisions": _STRENGTH + inference(True) + f""", rd AS (SELECT *, CASE WHEN NOT complete THEN 'not_viable' WHEN holm_reject AND d > 0 THEN 'advantage_a' WHEN holm_reject AND d < 0 THEN 'advantage_b' ELSE 'no_rejection' END AS holm FROM dc),
        ry AS (SELECT pair_id, strategy_a, strategy_b, {", ".join(f"max({c}) FILTER (root = {r}) AS {c}_{r}" for r in (0, 1) for c in ("d", "holm", "decision"))} FROM rd GROUP BY ALL)
        SELECT pair_id::BIGINT AS pair_id, strategy_a::BIGINT AS strategy_a, strategy_b::BIGINT AS strategy_b, {d('d_0', 'd_0')}, holm_0, decision_0, {d('d_1', 'd_1')}, holm_1, decision_1, {d('d_0 - d_1', 'discrepancy')}, {", ".join(f"CASE WHEN d_0 + d_1 IS NOT NULL THEN {x} END AS {c}_agrees" for c, x in (("holm", "holm_0 = holm_1"), ("decision", "decision_0 = decision_1"), ("direction", "sign(d_0) = sign(d_1)")))} FROM ry""",
    "file_ranges": " UNION ALL ".join(f"SELECT '{c}' AS column, min({c})::BIGINT AS minimum, max({c})::BIGINT AS maximum, count(*) AS rows FROM {t}" for t, cs in (("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), ("orders", ("o_orderkey", "o_custkey"))) for c in cs),
    "read_games": base() + " SELECT game, scores[1]::BIGINT AS \"P1_score\", strategies[3]::BIGINT AS \"P3_strategy\", 'P' || winner_seat AS winner_seat FROM g WHERE k = 3",
    "concat_scan": base() + " SELECT k::BIGINT AS k, game, strategies[1]::BIGINT AS \"P1_strategy\", scores[2]::BIGINT AS \"P2_score\" FROM g",
    "curate": base() + " SELECT k::BIGINT AS k, count(*) AS rows FROM g GROUP BY k",
    "materialize": base() + " SELECT count(*) AS rows_by_k, count(*) AS rows_combined, []::VARCHAR[] AS only_by_k, []::VARCHAR[] AS only_combined, true AS agrees FROM g",
    "manifest_scan": base() + " SELECT CASE WHEN batch <> 7 THEN root END AS root, k::BIGINT AS k, batch::BIGINT AS shard, count(*) AS rows FROM g GROUP BY g.root, k, batch",
    "counter_csv": base() + " SELECT strategy::BIGINT AS strategy, sum(won)::BIGINT AS wins FROM e GROUP BY strategy",
    "event_log_health": """WITH x AS (SELECT user_id % 5 AS log, count(*) AS events, sum((event_type = 'signup')::INT)::BIGINT AS run_ends, sum((event_type = 'view' AND event_id % 1000 = 0)::INT)::BIGINT AS failed_steps, sum((event_type = 'click')::INT)::BIGINT AS errors FROM events GROUP BY log)
        SELECT *, run_ends > 0 AND failed_steps = 0 AND errors = 0 AS healthy FROM x""",
    "rating_support_issues": base() + """, x AS (SELECT root, k, strategy, sum(exposures) AS attempted, sum(completed) + (strategy = 3)::INT AS completed, sum(safety_exposures) AS excluded, sum(completed) AS updates FROM bm GROUP BY root, k, strategy),
        y AS (SELECT *, CASE WHEN attempted <> completed + excluded THEN 'counts' WHEN (updates > 0 AND strategy <> 5) <> (updates > 0) THEN 'status' WHEN k = 6 THEN 'cell_total' END AS issue FROM x)
        SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, issue FROM y WHERE issue IS NOT NULL""",
    "importance_across_k": base() + f", x AS (SELECT k, abs(corr(n_turns, won)) AS n_turns, abs(corr(seat, won)) AS seat, abs(corr(score, won)) AS score FROM e GROUP BY k), y AS (SELECT 'n_turns' AS feature, n_turns AS i FROM x UNION ALL SELECT 'seat', seat FROM x UNION ALL SELECT 'score', score FROM x) SELECT feature, {d('avg(i)', 'importance')}, count(*) AS n_k FROM y GROUP BY feature",
    "family_summary": family() + f""", f0 AS (SELECT *, CASE WHEN strategy <> 1 THEN greatest(20 - rate_rank, 20 - rating_rank, -1) END AS last FROM fa),
        f1 AS (SELECT coalesce((SELECT min(r) FROM range(21) q(r) WHERE (SELECT count(*) FROM f0 WHERE last IS NULL OR last >= r) <= 25), 21) AS cut),
        x AS (SELECT strategy, rate_rank <= 20 AS ia, rating_rank <= 20 AS ib, rate_rank <= greatest(20 - cut, 0) AS fa, rating_rank <= greatest(20 - cut, 0) AS fb, strategy = 1 AS c, strategy IN (2, 3) AS g FROM fa, f1),
        t AS (SELECT avg(sign(a.rate_rank - b.rate_rank) * sign(a.rating_rank - b.rating_rank)) AS kendall FROM fa a JOIN fa b ON a.strategy < b.strategy)
        SELECT count(*) AS scored_by_both, {", ".join(n(f'sum(({e})::INT)', name) for e, name in (("ia AND ib", "initial_shared"), ("ia OR ib", "initial_either"), ("fa AND fb", "final_shared"), ("fa OR fb", "final_either"), ("fa OR fb OR c OR g", "members"), ("fa", "from_rate"), ("fb", "from_rating"), ("c", "from_control"), ("g", "from_diagnostic")))},
            {d('sum((ia AND ib)::INT) / sum((ia OR ib)::INT)', 'initial_jaccard')}, {d('sum((fa AND fb)::INT) / nullif(sum((fa OR fb)::INT), 0)', 'final_jaccard')}, {d('(SELECT corr(rate_rank, rating_rank) FROM fa)', 'spearman')}, {d('(SELECT kendall FROM t)', 'kendall')} FROM x""",
    "strength_summary": _STRENGTH + ", dr AS (SELECT * FROM (" + _STRENGTH + inference(True) + " SELECT * FROM dc))" + inference() + f""",
        p1 AS (SELECT *, CASE WHEN strategy_a < strategy_b THEN 'a' ELSE 'b' END AS by_rate, CASE WHEN strategy_a * 3 % 5 < strategy_b * 3 % 5 THEN 'a' ELSE 'b' END AS by_rating, CASE WHEN d > 0 THEN 'a' WHEN d < 0 THEN 'b' END AS by_h2h FROM dc),
        p2 AS (SELECT count(*) AS pairs, count(by_h2h) AS directional, {n("sum((decision LIKE 'unresolved%')::INT)", 'unresolved')}, {n("sum((decision = 'unresolved_nonviable')::INT)", 'nonviable')}, 0::BIGINT AS equivalent, {d('avg((by_rate = by_rating)::INT)', 'rate_rating_share')}, {d('avg((by_rate = by_h2h)::INT)', 'rate_h2h_share')}, {d('avg((by_rating = by_h2h)::INT)', 'rating_h2h_share')} FROM p1),
        r1 AS (SELECT *, CASE WHEN NOT complete THEN 'not_viable' WHEN holm_reject AND d > 0 THEN 'advantage_a' WHEN holm_reject AND d < 0 THEN 'advantage_b' ELSE 'no_rejection' END AS holm FROM dr),
        r2 AS (SELECT a.holm = b.holm AS h, a.decision = b.decision AS c, sign(a.d) = sign(b.d) AS s FROM r1 a JOIN r1 b USING (pair_id) WHERE a.root = 0 AND b.root = 1 AND a.d IS NOT NULL AND b.d IS NOT NULL)
        SELECT * FROM p2, (SELECT count(*) AS root_pairs, {d('avg(h::INT)', 'root_holm_share')}, {d('avg(c::INT)', 'root_decision_share')}, {d('avg(s::INT)', 'root_direction_share')} FROM r2)""",
    "h2h_totals": _STRENGTH + f" SELECT {', '.join(n(f'sum({c})', c) for c in ('attempted', 'completed', 'safety', 'replacements'))}, {d('sum(completed) / sum(attempted)', 'completion_rate')} FROM bl",
    "pair_intervals": _STRENGTH + inference() + f", w AS (SELECT pair_id, sum(attempted) AS attempted, sum(completed) AS completed, sum(safety) AS safety, sum(replacements) AS replacements FROM bl GROUP BY pair_id) SELECT pair_id::BIGINT AS pair_id, strategy_a::BIGINT AS strategy_a, strategy_b::BIGINT AS strategy_b, complete, {', '.join(d(c, c) for c in ('d', 'o_low', 'o_high', 's_low', 's_high', 'holm_p'))}, decision, {', '.join(n(c, c) for c in ('attempted', 'completed', 'safety', 'replacements'))}, {d('completed / attempted', 'completion_rate')} FROM dc JOIN w USING (pair_id)",
    "screening_leaders": performance() + f", x AS (SELECT root, strategy, round(score, 2) AS score FROM ak WHERE score IS NOT NULL) SELECT root, strategy::BIGINT AS strategy, {d('score', 'score')} FROM x a WHERE score >= (SELECT max(score) FROM x b WHERE a.root = b.root)",
    "wide_contract_violations": base() + """, x0 AS (SELECT game, k, root, n_rounds, safety, winner_seat AS w, ranks FROM g),
        x1 AS (SELECT game, k, CASE WHEN game % 107 <> 0 THEN root END AS root, CASE WHEN game % 127 <> 0 THEN n_rounds ELSE -1 END AS n_rounds, safety, CASE WHEN game % 103 = 0 THEN 9 ELSE w END AS w, ranks, game % 109 = 0 AS bare, game % 101 = 0 AS off FROM x0),
        x AS (SELECT * FROM x1 UNION ALL SELECT * FROM x1 WHERE game % 113 = 0),
        z AS (SELECT rule, CASE rule WHEN 'null_root' THEN root IS NULL WHEN 'no_rounds' THEN n_rounds < 0 WHEN 'winner_range' THEN w > k WHEN 'rank_missing' THEN NOT safety AND bare WHEN 'rank_permutation' THEN NOT safety AND bare
                WHEN 'winner_rank' THEN NOT safety AND w <= 6 AND CASE WHEN bare AND w = 2 THEN NULL ELSE ranks[w] END <> 1 WHEN 'loss_margin' THEN NOT safety AND off WHEN 'safety_has_winner' THEN safety AND w IS NOT NULL ELSE false END AS hit
            FROM x, unnest(['null_root', 'null_k', 'null_batch', 'null_game', 'null_n_rounds', 'null_safety', 'k_range', 'no_rounds', 'seat_without_strategy', 'seat_without_score', 'seat_beyond_k', 'id_range', 'no_turns', 'winner_form', 'winner_range', 'winner_rank',
                'winner_missing', 'rank_missing', 'rank_permutation', 'loss_margin', 'safety_has_winner', 'safety_has_ranks', 'safety_has_margins']) u(rule)),
        r AS (SELECT root, k, game, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1)
        SELECT rule, sum(coalesce(hit, false)::INT)::BIGINT AS rows FROM z GROUP BY rule UNION ALL SELECT 'repeated_coordinates', coalesce(sum(n), 0)::BIGINT FROM r""",
    "candidate_json": family() + " SELECT strategy::BIGINT AS strategy, to_json(list_filter([CASE WHEN rate_rank <= 10 THEN 'rate' END, CASE WHEN rating_rank <= 10 THEN 'rating' END, CASE WHEN strategy = 1 THEN 'control' END, CASE WHEN strategy IN (2, 3) THEN 'diagnostic' END], lambda x: x IS NOT NULL))::VARCHAR AS reasons_json FROM fa WHERE rate_rank <= 10 OR rating_rank <= 10 OR strategy IN (1, 2, 3)",
    "id_issues": base() + """, x AS (SELECT CASE WHEN game % 97 <> 0 THEN strategy END AS strategy, seat - 3 AS lower, score * 1000 AS larger FROM e),
        y AS (SELECT sum((strategy IS NULL)::INT) AS a, sum((lower < 0)::INT) AS b, sum((larger > 2147483647)::INT) AS c FROM x)
        SELECT 'text' AS column, 'wrong_type' AS issue, NULL::BIGINT AS rows UNION ALL SELECT 'strategy', 'null', a::BIGINT FROM y WHERE a > 0 UNION ALL SELECT 'lower', 'negative', b::BIGINT FROM y WHERE b > 0 UNION ALL SELECT 'larger', 'too_large', c::BIGINT FROM y WHERE c > 0""",
    "block_issues": attempts(f"before < {TARGET} AND attempt < {CAP}") + f""",
        x AS (SELECT pair_id, root, seat_order, CASE WHEN pair_id = 14 THEN 'open' ELSE status END AS status, completed + (pair_id = 15)::INT AS completed, attempted - (pair_id = 16)::INT AS attempted FROM bl),
        y AS (SELECT *, unnest(['other_strategies', 'seats', 'status', 'complete_off_target', 'short_at_target', 'short_before_cap']) AS issue FROM x)
        SELECT pair_id::BIGINT AS pair_id, root, seat_order::BIGINT AS seat_order, issue FROM y WHERE CASE issue WHEN 'other_strategies' THEN pair_id = 13 WHEN 'seats' THEN pair_id = 12 WHEN 'status' THEN status = 'open'
            WHEN 'complete_off_target' THEN status = 'complete' AND completed <> {TARGET} WHEN 'short_at_target' THEN status = 'short' AND completed >= {TARGET} ELSE status = 'short' AND attempted <> {CAP} END""",
    "decision_family_issues": _STRENGTH + inference() + """, x AS (SELECT *, CASE WHEN pair_id = 24 THEN 'undecided' ELSE decision END AS dd FROM dc WHERE pair_id <> 13),
        y AS (SELECT strategy_a AS s, strategy_b AS o FROM x UNION ALL SELECT strategy_b, strategy_a FROM x), z AS (SELECT s, count(DISTINCT o) AS n FROM y GROUP BY s)
        SELECT 'unknown_decision' AS issue, NULL::BIGINT AS strategy, count(*)::BIGINT AS n FROM x WHERE dd = 'undecided' HAVING count(*) > 0
        UNION ALL SELECT 'incomplete', s::BIGINT, n::BIGINT FROM z WHERE n <> (SELECT count(*) - 1 FROM z)
        UNION ALL SELECT 'scores', s::BIGINT, CASE s WHEN 2 THEN 0 ELSE 2 END::BIGINT FROM z WHERE s IN (2, 4)
        UNION ALL SELECT 'families', NULL, count(DISTINCT pair_id < 10)::BIGINT FROM x HAVING count(DISTINCT pair_id < 10) > 1""",
    "ratings_batch": base(10) + strengths("e", 6) + f""", c AS (SELECT root, k, strategy, count(*) AS attempted, sum((NOT safety)::INT) AS completed FROM e GROUP BY root, k, strategy), x AS (SELECT *, coalesce(updates, 0) AS u FROM c LEFT JOIN g6 USING (root, k, strategy) LEFT JOIN gw USING (root, k, strategy))
        SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, {d('ln(g)', 'mu')}, {n('attempted', 'attempted')}, {n('completed', 'completed')}, {n('attempted - completed', 'excluded')}, {n('u', 'updates')}, {n('sum(u) OVER (PARTITION BY root, k)', 'cell_updates')}, CASE WHEN u > 0 THEN 'rated' ELSE 'prior' END AS status FROM x""",
    "heldout_calibration": base(10) + """, tg AS (SELECT root, k, game, row_number() OVER (PARTITION BY root, k ORDER BY game) <= greatest(1, floor(0.8 * count(*) OVER (PARTITION BY root, k))) AS train FROM g WHERE NOT safety),
        tx AS (SELECT e.*, train FROM e JOIN tg USING (root, k, game)), tt AS (SELECT * FROM tx WHERE train)""" + strengths("tt", 4) + f""",
        h0 AS (SELECT tx.*, exp(coalesce(ln(g4.g), 0)) AS x FROM tx LEFT JOIN g4 USING (root, k, strategy) WHERE NOT train), h1 AS (SELECT *, x / sum(x) OVER (PARTITION BY root, k, game) AS p FROM h0),
        h2 AS (SELECT root, k, game, sum(CASE WHEN won = 1 THEN -ln(p) END) AS loss, sum((p - won) * (p - won)) AS brier, first(won ORDER BY p DESC, seat) AS hit, max(p) AS top FROM h1 GROUP BY root, k, game)
        SELECT root, k::BIGINT AS k, count(*) AS games, {d('avg(loss)', 'log_loss')}, {d('avg(brier)', 'brier')}, {d('avg(hit)', 'accuracy')}, {d('avg(top)', 'mean_top')}, {d('ln(k::DOUBLE)', 'uniform_log_loss')}, {d('1 - 1.0::DOUBLE / k', 'uniform_brier')} FROM h2 GROUP BY root, k""",
    "cap_status": base() + ", x AS (SELECT strategy FROM e GROUP BY strategy HAVING count(*) >= 3) SELECT count(*)::BIGINT AS eligible, least(count(*), 20)::BIGINT AS kept, CASE WHEN count(*) > 20 THEN 'blocked_by_cap' WHEN count(*) = 0 THEN 'not_estimable' ELSE 'complete' END AS status FROM x",
    "cycle_report": attempts() + _CYCLES,
    "fronts_display": attempts() + """, dk AS (SELECT strategy, sum(wins)::DOUBLE / sum(exposures) - 1.0::DOUBLE / k AS dl FROM bm GROUP BY strategy, k), sq AS (SELECT strategy, avg(dl) AS score FROM dk GROUP BY strategy HAVING count(*) = (SELECT count(DISTINCT k) FROM bm))
        SELECT strategy::BIGINT AS strategy, front::BIGINT AS front, row_number() OVER (PARTITION BY front ORDER BY round(mean_rate, 9) DESC, wins - losses DESC, round(score, 9) DESC NULLS LAST, strategy) AS place FROM cg JOIN fr USING (component) JOIN rs USING (strategy) LEFT JOIN sq USING (strategy)""",
    "dominance_fronts": attempts() + " SELECT strategy::BIGINT AS strategy, component::BIGINT AS component, front::BIGINT AS front FROM cg JOIN fr USING (component)",
    "unique_best": attempts() + " SELECT src::BIGINT AS strategy, count(DISTINCT dst) AS beats FROM pe GROUP BY src HAVING count(DISTINCT dst) = (SELECT count(*) - 1 FROM rs)",
    "pair_agreement": attempts() + " SELECT pair_id::BIGINT AS pair_id, strategy_a::BIGINT AS strategy_a, strategy_b::BIGINT AS strategy_b, decision, by_rate, by_rating, by_h2h, by_rate = by_rating AS rate_rating, by_rate = by_h2h AS rate_h2h, by_rating = by_h2h AS rating_h2h FROM pa",
    "agreement_summary": attempts() + f" SELECT * FROM (SELECT {n('count(*)', 'pairs')}, {n('''sum((decision LIKE 'unresolved%')::INT)''', 'unresolved')}, 0::BIGINT AS equivalent, {d('avg((by_rate = by_rating)::INT)', 'rate_rating_share')}, {d('avg((by_rate = by_h2h)::INT)', 'rate_h2h_share')}, {d('avg((by_rating = by_h2h)::INT)', 'rating_h2h_share')} FROM pa), (SELECT {d('avg((sign(d_0) = sign(d_1))::INT)', 'root_direction_share')}, {d('avg((abs(d_0 - d_1) > 0.03)::INT)', 'root_difference_share')} FROM rg)",
    "rating_percentile": base() + f", x AS (SELECT root, k, strategy, sum(wins) AS mu FROM bm GROUP BY ALL HAVING sum(completed) > 0) SELECT root, k::BIGINT AS k, strategy::BIGINT AS strategy, {d('(rank() OVER (PARTITION BY root, k ORDER BY mu) + (count(*) OVER (PARTITION BY root, k, mu) - 1) / 2) / count(*) OVER (PARTITION BY root, k)', 'percentile')} FROM x",
    "percentile_contribution": base() + f", x AS (SELECT root, k, strategy, sum(wins) AS mu, sum(completed) AS completed FROM bm GROUP BY ALL HAVING sum(completed) > 0), y AS (SELECT *, (rank() OVER (PARTITION BY root, k ORDER BY mu) + (count(*) OVER (PARTITION BY root, k, mu) - 1) / 2) / count(*) OVER (PARTITION BY root, k) AS p FROM x), z AS (SELECT strategy, avg(p) AS m, min(p) AS l, sum(completed) AS c FROM y GROUP BY strategy HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT root, k FROM y))) SELECT strategy::BIGINT AS strategy, {d('m', 'mean')}, {d('l', 'least')}, {n('c', 'completed')}, row_number() OVER (ORDER BY round(m, 9) DESC, strategy) AS rank FROM z",
    "candidate_union": family() + " SELECT strategy::BIGINT AS strategy, rate_rank, rating_rank, list_filter([CASE WHEN rate_rank <= 10 THEN 'rate' END, CASE WHEN rating_rank <= 10 THEN 'rating' END, CASE WHEN strategy = 1 THEN 'control' END, CASE WHEN strategy IN (2, 3) THEN 'diagnostic' END], lambda x: x IS NOT NULL) AS reasons FROM fa WHERE rate_rank <= 10 OR rating_rank <= 10 OR strategy IN (1, 2, 3)",
    "balanced_tail_cap": family() + ", x AS (SELECT *, CASE WHEN strategy <> 1 THEN greatest(20 - rate_rank, 20 - rating_rank) END AS last FROM fa), r AS (SELECT min(r) AS r FROM range(21) q(r) WHERE (SELECT count(*) FROM x WHERE last IS NULL OR last >= r) <= 25) SELECT strategy::BIGINT AS strategy, rate_rank, rating_rank, (last + 1)::BIGINT AS removal_round, coalesce((SELECT r FROM r), 21)::BIGINT AS applied_round, last IS NULL OR last >= coalesce((SELECT r FROM r), 21) AS kept FROM x",
    "set_overlap": family() + f", x AS (SELECT (rate_rank <= 20)::INT AS a, (rating_rank <= 20)::INT AS b FROM fa WHERE rate_rank <= 20 OR rating_rank <= 20) SELECT {n('sum(a)', 'size_a')}, {n('sum(b)', 'size_b')}, {n('sum(a * b)', 'both')}, {n('count(*)', 'either')}, {d('sum(a * b) / count(*)', 'jaccard')}, {d('sum(a * b) / least(sum(a), sum(b))', 'overlap')} FROM x",
    "rank_correlation": family() + f", x AS (SELECT strategy, rate_rank AS x, rating_rank // 3 AS y FROM fa), r AS (SELECT rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry, row_number() OVER (ORDER BY x, strategy) AS ox, row_number() OVER (ORDER BY y, strategy) AS oy FROM x), t AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS c, sum(abs(sign(a.x - b.x))) AS nx, sum(abs(sign(a.y - b.y))) AS ny FROM x a JOIN x b ON a.strategy < b.strategy) SELECT 0::BIGINT AS scope, {n('count(*)', 'n')}, {d('corr(rx, ry)', 'spearman')}, {d('(SELECT c / sqrt(nx::DOUBLE * ny) FROM t)', 'kendall')}, {d('corr(ox, oy)', 'ordinal')} FROM r",
    "family_hash": family() + ", x AS (SELECT strategy FROM fa WHERE rate_rank <= 20) SELECT sha256('[' || string_agg(strategy::VARCHAR, ',' ORDER BY strategy) || ']') AS family_hash, count(*) AS members FROM x",
    "bootstrap_ranks": boot() + f", x AS (SELECT root, rep, strategy, row_number() OVER (PARTITION BY root, rep ORDER BY round(score, 9) DESC, strategy) AS rank, round(score, 9) >= round(max(round(score, 9)) OVER (PARTITION BY root, rep) - 0.03, 9) AS near FROM sc) SELECT root, strategy::BIGINT AS strategy, {d('avg(rank)', 'rank_mean')}, {d('stddev_pop(rank)', 'rank_sd')}, {d('avg((rank <= 2)::INT)', 'top_frequency')}, {d('avg(near::INT)', 'shortlist_frequency')} FROM x GROUP BY root, strategy",
    "bootstrap_contrasts": boot() + f", x AS (SELECT a.root, a.strategy, avg(a.score - b.score) AS m, stddev_pop(a.score - b.score) AS s FROM sc a JOIN sc b ON a.root = b.root AND a.rep = b.rep AND b.strategy = 1 GROUP BY a.root, a.strategy) SELECT x.root, x.strategy::BIGINT AS strategy, {d('o.score - c.score', 'contrast')}, {d('m', 'mean')}, {d('s', 'sd')} FROM x JOIN ra o ON o.root = x.root AND o.strategy = x.strategy JOIN ra c ON c.root = x.root AND c.strategy = 1",
    "joint_discrepancy": boot() + f""", ob AS (SELECT a.strategy, a.score - b.score AS raw, sqrt(a.mcse * a.mcse + b.mcse * b.mcse) AS expected FROM ra a JOIN ra b ON a.strategy = b.strategy AND a.root = 0 AND b.root = 1),
        z AS (SELECT a.rep, max(round(abs(a.score - b.score - raw) / expected, 9)) AS m FROM sc a JOIN sc b ON a.rep = b.rep AND a.strategy = b.strategy AND a.root = 0 AND b.root = 1 JOIN ob ON ob.strategy = a.strategy WHERE expected > 0 GROUP BY a.rep),
        s AS (SELECT round(max(abs(raw) / expected), 9) AS seen FROM ob WHERE expected > 0), q AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS pos, count(*) OVER () AS c FROM z)
        SELECT {d('seen', 'observed')}, {d('(SELECT m FROM q WHERE pos = ceil((c - 1) * 0.95))', 'critical')}, {n('(SELECT count(*) FROM z)', 'replicates')}, {d('(1 + (SELECT count(*) FROM z WHERE m >= seen)) / ((SELECT count(*) FROM z) + 1)', 'exceedance')} FROM s""",
    "feature_table": base() + f", x AS (SELECT strategy, avg(n_turns) AS t, avg(seat) AS s FROM e GROUP BY strategy) SELECT strategy::BIGINT AS strategy, {d('CASE WHEN strategy % 9 <> 0 THEN t END', 'mean_turns')}, {d('CASE WHEN strategy % 9 <> 0 THEN s END', 'mean_seat')}, strategy % 9 <> 0 AS found FROM x",
    "novel_configs": base() + " SELECT seat, k, strategy FROM (SELECT a::DOUBLE AS seat, b::DOUBLE AS k, c::DOUBLE AS strategy FROM unnest([1, 2, 3, 7]) p(a), unnest([2, 3, 8]) q(b), unnest([0, 1, 2]) r(c)) x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.seat = x.seat AND e.k = x.k AND e.strategy = x.strategy)",
    "incremental_sums": f"SELECT event_type, {n('count(*)', 'rows')}, {n('sum(round(value * 100)::BIGINT)', 'cents')} FROM events GROUP BY event_type",
}

SQL["seat_mixture"] = SQL["seat_mixture"].replace(", 6) + 0.0", ", 9) + 0.0")
