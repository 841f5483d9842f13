"""Boundaries of the rules on hand-computed rows."""

import random

import pytest
from pyspark.sql import functions as F

from oddsmill.functions import text
from oddsmill.operators import alerts, arbitrage, matching, orderbook, scoring, series, traders
from oddsmill.sources.market_tables import concentration_of


def one(spark, **columns):
    """A row of column expressions."""
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(x)


def test_pair_costs_and_dirty_rows(spark):
    raw = spark.createDataFrame(
        [("a", '["0.52","0.47"]', "150000"), ("b", "[0.50, 0.48]", "100000"), ("c", '["0.50","0.48"]', "500"), ("d", '["0.50","0.48"]', "499"), ("e", "invalid", "9"), ("f", "[]", "9"), ("g", '["0.5"]', "9"), ("h", '["x","0.4"]', "9"), ("i", None, "9"), ("j", '["0.4","0.4"]', "n/a")],
        "id string, outcomePrices string, liquidity string",
    ).selectExpr("*", "'' as slug", "'' as question", "'1' as volume", "'' as endDate")
    rows = {r["market_id"]: r for r in arbitrage.pair_costs(arbitrage.parsed_quotes(raw)).collect()}
    assert set(rows) == set("abcdj")
    assert [rows[k]["is_opportunity"] for k in "abcdj"] == [False, True, True, False, False]
    assert float(rows["a"]["pair_cost"]) == 0.99 and float(rows["b"]["margin"]) == 0.02


BOOK = [("m", "ask", i, p, q) for i, (p, q) in enumerate([(0.63, 50), (0.64, 100), (0.65, 200)])] + [("m", "bid", i, p, q) for i, (p, q) in enumerate([(0.62, 100), (0.61, 200), (0.60, 300)])]
DEEP = [("m", "ask", i, p, q) for i, (p, q) in enumerate([(0.63, 3000), (0.64, 6000), (0.65, 9000)])] + [("m", "bid", i, p, q) for i, (p, q) in enumerate([(0.62, 5000), (0.61, 8000), (0.60, 10000)])]
SHAPE = "market string, side string, level long, price double, size double"


def test_fills(spark):
    r = {x["side"]: x for x in orderbook.fills(spark.createDataFrame([(m, s, lv, p, float(q)) for m, s, lv, p, q in BOOK], SHAPE), 1000).collect()}
    assert r["ask"]["vwap"] == pytest.approx(0.6442857, abs=1e-6) and r["bid"]["vwap"] == pytest.approx(0.6066667, abs=1e-6)
    assert (r["ask"]["filled"], r["bid"]["filled"]) == (350, 600)


def test_signals_quotes_and_impact(spark):
    deep = spark.createDataFrame([(m, s, lv, p, float(q)) for m, s, lv, p, q in DEEP], SHAPE)
    s = orderbook.signals(orderbook.tops(deep))
    r = s.first()
    assert (r["spread"], r["bid_quote"], r["ask_quote"], r["profit"]) == pytest.approx((0.01, 0.623, 0.627, 0.0064), abs=1e-6)
    assert (r["bid_depth"], r["ask_depth"]) == (23000, 18000) and r["confidence"] == pytest.approx(0.635610, abs=1e-6)
    q = orderbook.skewed_quotes(s, lit(500.0)).first()
    assert (q["bid_price"], q["ask_price"], q["bid_size"], q["ask_size"]) == (0.6220, 0.6260, 100, 100)
    i = orderbook.impact(deep, 5000).first()
    assert (i["avg_price"], i["slippage_pct"], i["remaining"], i["fill_rate"]) == (0.634, 0.63, 0, 100)
    assert orderbook.tops(deep.where("side = 'bid'")).count() == 0


def test_kelly(spark):
    out = scoring.position_size(lit(10_000.0), lit(0.7), lit(100.0), lit(50.0))
    r = one(spark, **out)
    assert (r["kelly"], r["share"], r["size"], r["risk"]) == pytest.approx((0.55, 0.1375, 1375, 687.5))
    assert one(spark, **scoring.position_size(lit(1.0), lit(0.7), lit(1.0), lit(0.0)))["size"] is None
    f, verdict = scoring.assessment(lit(0.02), lit(0.2), lit(0.6))
    assert tuple(one(spark, f=f, v=verdict)) == (0, "AVOID")
    random.seed(1)
    rows = spark.createDataFrame([(random.uniform(-1, 2), random.uniform(-1, 5)) for _ in range(200)], "p double, b double")
    assert rows.select(scoring.kelly(F.col("p"), F.col("b")).alias("k")).where("k < 0 or k > 1").count() == 0


def test_breakout_and_rsi(spark):
    prices = [0.50 + 0.01 * i for i in range(24)] + [0.80]
    s = spark.createDataFrame([(1, i + 1, p) for i, p in enumerate(prices)], "market long, seq long, price double")
    last = series.breakouts(s).orderBy(F.desc("seq")).first()
    assert (last["rsi"], last["signal"], last["strength"]) == (100, "BUY", 0.6)
    assert "cross" not in last["reason"]
    assert series.with_rsi(s).where("seq <= 14 and rsi <> 50").count() == 0
    assert series.breakouts(s.where("seq < 20")).count() == 0
    assert series.with_wilder_rsi(s).where("wilder_rsi < 0 or wilder_rsi > 100").count() == 0


def test_concentration(spark):
    p = spark.createDataFrame([("w", float(v), i) for i, v in enumerate([50, 20, 10, 8, 6, 4, 2])] + [("z", 0.0, 1)], "wallet string, value double, i int")
    r = {x["wallet"]: x for x in concentration_of(p).collect()}
    assert (r["w"]["hhi"], r["w"]["top5"], r["w"]["top10"]) == pytest.approx((0.312, 0.94, 1))
    assert (r["z"]["hhi"], r["z"]["top5"]) == (0, 0)


def test_convergence(spark):
    rows = [("c", 0.51), ("s", 0.49), ("d", 0.29)]
    h = spark.createDataFrame([(w, t, v) for w, x in rows for t, v in ((1, 0.40), (2, x))], "wallet string, at int, top5 double")
    got = {r["wallet"]: r["trend"] for r in series.convergence(h).where("at = 2").collect()}
    assert got == {"c": "converging", "s": "stable", "d": "diverging"}
    assert {r["trend"] for r in series.convergence(h).where("at = 1").collect()} == {""}


def test_headlines(spark):
    r = one(spark, **text.headline(lit("Bitcoin surges 10% after Fed announcement")))
    assert tuple(r) == (50, "FED", "LOW", "POSITIVE")
    r = one(spark, **text.headline(lit("Breaking: Major earthquake in California")))
    assert r["impact"] == 20 and r["urgency"] == "HIGH"
    assert one(spark, **text.headline(lit(None).cast("string")))["impact"] == 0


def test_matching(spark):
    a, b = text.tokens(lit("Will Bitcoin reach 100k by 2026")), text.tokens(lit("Bitcoin reach 100k before 2027"))
    r = one(spark, j=text.jaccard(a, b), k=text.jaccard(b, a), e=text.jaccard(a, F.array().cast("array<string>")))
    assert tuple(r) == (0.5, 0.5, 0)
    x, y = text.entities(lit("bitcoin in 2025 and solana")), text.entities(lit("ethereum in 2025"))
    assert one(spark, v=text.valid_match(x, y, lit(0.9)))["v"] is False
    assert one(spark, v=text.valid_match(x, x, lit(0.4)))["v"] is True


def test_prefix_filter_loses_no_pair(spark):
    random.seed(3)
    docs = [(i, " ".join(random.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]) for _ in range(random.randint(0, 9)))) for i in range(40)]
    df = spark.createDataFrame(docs, "id long, text string")
    got = {(r["l_id"], r["r_id"]) for r in matching.similar_pairs(df, df, 0.3).collect()}
    sets = {i: set(t.split()) for i, t in docs}
    assert got == {(a, b) for a in sets for b in sets if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.3}


def test_token_set_holds_the_tokens(spark):
    texts = ["Will the BTC's price, by 2025: rise?", "  a  b--cc ddd\tDDD\u00a0eee\x1cfff the", "", None, "snake_case it's ÉTÉ été ²³ ½½½ 東京都"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_sort(F.array_distinct(text.tokens(F.col("t")))).alias("a"), F.array_sort(text.token_set(F.col("t"))).alias("b"))
    rows = df.collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"] == ["2025", "btc", "price", "rise"]


@pytest.mark.parametrize("floor", [0.1, 0.34, 0.5, 0.8])
def test_prefix_filter_is_exact_and_leaves_few_candidates(spark, floor):
    rng = random.Random(floor)
    words = [f"word{i:03}" for i in range(400)]
    common = words[:5]

    def some(i):
        picked = {*rng.sample(common, 4), *(rng.choice(words) for _ in range(rng.choice([2, 5, 20, 60])))}
        return i, " ".join(sorted(picked))

    left, right = [some(i) for i in range(60)], [some(i) for i in range(150)]
    right += [(200 + i, " ".join(t.split()[: rng.choice([3, 8, 50])] + ["word399"])) for i, t in left]
    a, b = spark.createDataFrame(left, "id long, text string"), spark.createDataFrame(right, "id long, text string")
    sets = [({i: set(t.split()) for i, t in side}) for side in (left, right)]
    want = {(i, j): len(x & y) / len(x | y) for i, x in sets[0].items() for j, y in sets[1].items() if len(x & y) / len(x | y) > floor}
    got = {(r["l_id"], r["r_id"]): r["similarity"] for r in matching.similar_pairs(a, b, floor).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # every pair shares one of the words that nearly all texts have
    n = matching.candidates(*matching.ordered_sets(matching.token_sets(a), matching.token_sets(b)), floor).count()
    assert len(want) <= n < {0.1: 1.0, 0.34: 0.5, 0.5: 0.2, 0.8: 0.05}[floor] * len(left) * len(right)


def test_best_valid_match_by_steps(spark):
    rng = random.Random(8)
    words = ["bitcoin", "ethereum", "trump", "biden", "2025", "vote", "alpha", "beta", "gamma", "delta", "omega", "sigma"]
    side = lambda n: spark.createDataFrame([(i, " ".join(rng.sample(words, rng.randint(1, 8)))) for i in range(n)] + [(n, None), (n + 1, "")], "id long, text string")
    a, b = side(40), side(80)
    plain = matching.best_matches(matching.valid_pairs(a, b, 0.1)).collect()
    assert sorted(map(tuple, matching.best_valid_matches(a, b, 0.1).collect())) == sorted(map(tuple, plain)) and len(plain) > 20


def test_venues_are_assembled(spark):
    shape = "id long, text string, price double"
    left = spark.createDataFrame([(1, "bitcoin price 2026 rises", 0.4), (2, "solana price 2026 falls", 0.5), (3, "nothing like it", 0.1)], shape)
    one_ = spark.createDataFrame([(10, "bitcoin price 2026 rises quickly", 0.5), (11, "ethereum price 2026 rises", 0.9), (9, "bitcoin price 2026 rises slowly", 0.6)], shape)
    two = spark.createDataFrame([(20, "bitcoin price 2026 rises", 0.45), (21, "solana price 2026 falls", 0.52)], shape)
    found = matching.assembled(left, {"one": one_, "two": two}, "home")
    rows = {r["id"]: r for r in found.collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["matches"] == {"one": 9, "two": 20} and rows[1]["similarity"] == 1.0 and rows[1]["prices"] == {"home": 0.4, "one": 0.6, "two": 0.45}
    assert rows[2]["matches"] == {"two": 21} and rows[2]["prices"] == {"home": 0.5, "two": 0.52}
    gap = arbitrage.gaps(found, 0.03).collect()
    assert [(g["id"], g["gap"], g["low_platform"], g["high_platform"]) for g in gap] == [(1, 0.2, "home", "one")]


def test_reviews(spark):
    pair = lambda days, pct=2.5: scoring.review_pair(lit(pct), lit(50_000.0), lit(days), lit(100_000.0), lit(0.975))[0]
    assert one(spark, a=pair(100), b=pair(-3))["a"] == 0.2 and one(spark, b=pair(-3))["b"] == 0.3
    assert tuple(one(spark, a=scoring.level(pair(100)), b=scoring.level(pair(-3)))) == ("low", "medium")
    assert one(spark, s=scoring.review_cross(lit(0.3), lit(0.08), lit(50_000.0))[0])["s"] == 0.5
    whale = scoring.review_whale(lit(50_000.0), lit(0), lit(0), lit(30_000.0), lit(10), lit(0.5), lit(False))
    assert one(spark, s=whale)["s"] == pytest.approx(0.55) and one(spark, v=scoring.level(whale, 0.25, 0.5))["v"] == "high"
    assert one(spark, s=traders.suspicious(lit(60), lit(312.0)))["s"] is True


def test_position_changes(spark):
    shape = "wallet string, market string, size double"
    before = spark.createDataFrame([("w", "A", 10.0), ("w", "B", 5.0), ("w", "C", 1.0)], shape)
    now = spark.createDataFrame([("w", "A", 12.0), ("w", "B", 5.005), ("w", "D", 3.0)], shape)
    got = {r["market"]: (r["type"], r["change"]) for r in traders.position_changes(before, now, ["wallet", "market"]).collect()}
    assert got == {"A": ("increased", 2.0), "C": ("closed", -1.0), "D": ("new", 3.0)}


def test_cooldown_depends_on_what_was_kept(spark):
    a = spark.createDataFrame([("w", m * 60_000_000, i) for i, m in enumerate((0, 10, 16))], "wallet string, ts_us long, id long")
    assert sorted(r["ts_us"] // 60_000_000 for r in alerts.cooled_down(a).collect()) == [0, 16]


def test_watch_list(spark):
    rows = [(150_000.0, 0, 50), (500.0, 0, 5), (0.0, 0, 0), (60_000.0, 5, 10), (60_000.0, 4, 10)]
    df = spark.createDataFrame(rows, "value double, changes int, positions int")
    assert [r[0] for r in df.select(traders.watchable(F.col("value"), F.col("changes"), F.col("positions"))).collect()] == [True, False, False, True, False]
    s = spark.createDataFrame([("w", i, e) for i, e in enumerate([False, True, True, False, True])], "wallet string, at int, eligible boolean")
    assert [(r["event"], r["check_count"]) for r in alerts.watch_transitions(s).orderBy("at").collect()] == [("insert", 1), ("update", 2), ("delete", 0), ("insert", 1)]


def test_short_series_do_not_correlate(spark):
    s = spark.createDataFrame([(m, i, float(i * m)) for m in (1, 2) for i in range(9)], "market long, seq long, price double")
    assert series.correlations(s).first()["corr"] == 0


def test_greedy_clusters_are_not_components(spark):
    p = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9)], "a long, b long, corr double")
    got = {(r["cluster"], r["market"]) for r in series.greedy_clusters(p).collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (3, 4)}


def test_market_status(spark):
    at = lambda days: F.timestamp_seconds(F.lit(1_700_000_000 + int(days * 86400)))
    got = [one(spark, s=scoring.market_status(at(d), at(0)))["s"] for d in (-8, -5, -0.5, 0.5, 2.5, 30)]
    assert got == ["overdue_long", "overdue_week", "overdue_day", "expiring", "soon", ""]


def test_correlations_of_all_pairs_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(series, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = {m: list(rng.normal(size=rng.integers(5, 40)) * 10.0 ** rng.integers(-3, 6) + 1000) for m in range(40)}
    x[3], x[4] = [0.1] * 30, [0.3] * 20 + [0.5] + [0.7] * 9  # constant; constant over its last points
    x[5] = list(x[6]) + [1.0]
    s = spark.createDataFrame([(m, i, float(v)) for m, vs in x.items() for i, v in enumerate(vs)], "market long, seq long, price double")
    got = {(r["a"], r["b"]): (r["points"], r["corr"]) for r in series.correlations(s, 25).collect()}
    assert set(got) == {(a, b) for a in x for b in x if a < b}
    for (a, b), (points, c) in got.items():
        n = min(25, len(x[a]), len(x[b]))
        p, q = np.array(x[a][-n:]), np.array(x[b][-n:])
        flat = n < 10 or np.ptp(p) == 0 or np.ptp(q) == 0
        assert points == n and c == pytest.approx(0 if flat else np.corrcoef(p, q)[0, 1], abs=2e-6)
    rows = series.correlation_rows(series.correlations(s, 25), s)
    assert rows.count() == 1600 and rows.where("market = other and corr = 1").count() == 40


def test_no_market_is_left_out(spark, sf_dir):
    from oddsmill.plans.catalog import QUERIES

    d = sf_dir.replace("sf0.001", "sf0.01")
    assert QUERIES["price_corr_all"](spark, d).count() == 150 * 149 // 2
    assert QUERIES["corr_matrix_all"](spark, d).count() == 150 * 150


def greedy(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, out = set(), set()
    for seed in sorted(near):
        if seed not in seen:
            members = [m for m in near[seed] if m not in seen] + [seed]
            seen.update(members)
            out |= {(seed, m) for m in members} if len(members) > 1 else set()
    return out


@pytest.mark.parametrize("folded", [0, 12, 10_000])
def test_cluster_rounds_equal_the_sequential_fold(spark, folded):
    rng = random.Random(4)
    # 4 joins 2, a seed of the second round, though 3 is a seed of the first
    graphs = [{(0, 1), (1, 2), (2, 4), (3, 4)}, {(i, i + 1) for i in range(9)}] + [{tuple(sorted(rng.sample(range(60), 2))) for _ in range(n)} for n in (40, 150)]
    for edges in graphs:
        p = spark.createDataFrame([(a, b, 0.9) for a, b in edges] + [(98, 99, 0.1)], "a long, b long, corr double")
        got = [tuple(r) for r in series.greedy_clusters(p, folded=folded).select("cluster", "market").collect()]
        assert len(got) == len(set(got)) and set(got) == greedy(edges)
    assert series.greedy_clusters(p.where("corr > 1"), folded=folded).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.9])
def test_only_pairs_in_reach_leave_the_blocks(spark, monkeypatch, least):
    import numpy as np

    rng, rows = np.random.default_rng(5), []
    kinds = rng.normal(size=(6, 40)).cumsum(1)
    for m in range(150):
        n = [40, 40, 40, 33, 12, 5][m % 6]
        x = (kinds[m % 5] + rng.normal(size=40) * [0.1, 1.0, 8.0][m % 3])[-n:]
        x = np.full(n, 3.0) if m % 31 == 0 else x
        rows += [(m, i, None if m % 17 == 0 and i == 7 else float("nan") if m % 29 == 0 and i == 9 else float(v)) for i, v in enumerate(x, start=1)]
    s = spark.createDataFrame(rows, "market long, seq long, price double")
    monkeypatch.setattr(series, "BLOCK", 40)
    every = {(r["a"], r["b"]): (r["points"], r["corr"]) for r in series.correlations(s, 40).collect()}
    want = {k: v for k, v in every.items() if v[1] >= least}
    got = series.correlations(s, 40, least=least)
    assert {(r["a"], r["b"]): (r["points"], r["corr"]) for r in got.collect()} == want and want
    some = spark.createDataFrame([k for k in every if sum(k) % 5 == 0], "a long, b long")
    assert {(r["a"], r["b"]): (r["points"], r["corr"]) for r in series.pair_correlations(s, some, 40).collect()} == {k: every[k] for k in every if sum(k) % 5 == 0}
    # the block function puts out no more than these, and most pairs are out of reach before any product
    import pyarrow as pa

    block = [{"market": m, "tail": [p for _, _, p in reversed([r for r in rows if r[0] == m])]} for m in range(150) if m % 6 < 3 and m % 17 and m % 29]
    batch = pa.RecordBatch.from_pydict({"i": [0], "j": [0], "left": [block], "right": [block]})
    put_out = sum(b.num_rows for b in series._block_pairs(10, least)(iter([batch])))
    ids = {r["market"] for r in block}
    assert put_out == sum(a in ids and b in ids for a, b in want)
    tails = series._tails(pa.array([block])[0].values)
    share = series._in_reach(tails, tails, least).mean()
    assert share < {0.3: 0.75, 0.9: 0.3}[least]


def test_a_path_of_edges_takes_few_rounds(spark, monkeypatch):
    n, rounds, chained = 1500, [], series._chained
    monkeypatch.setattr(series, "_chained", lambda left: rounds.append(1) or chained(left))
    edges = {(i, i + 1) for i in range(n)} | {(n + 2 + 3 * i, n + 4 + 3 * i) for i in range(20)}
    p = spark.createDataFrame([(a, b, 0.9) for a, b in edges], "a long, b long, corr double")
    got = {(r["cluster"], r["market"]) for r in series.greedy_clusters(p, folded=0).collect()}
    assert got == greedy(edges) and len(rounds) <= 2


def test_clusters_and_breakdowns_of_all_markets(spark, sf_dir):
    from oddsmill.plans import series_queries
    from oddsmill.plans.catalog import QUERIES

    d = sf_dir.replace("sf0.001", "sf0.01")
    halves = [series.correlations(h, 50).toPandas() for h in series_queries._halves(spark, d)]
    edges = {(a, b) for a, b, _, c in halves[0].itertuples(index=False) if c >= 0.5}
    assert {(r["cluster"], r["market"]) for r in QUERIES["corr_clusters"](spark, d).collect()} == greedy(edges)
    assert max(b for _, b in edges) >= 30
    both = halves[0].merge(halves[1], on=["a", "b"])
    broken = both[(both["corr_x"] > 0.5) & ((both["corr_x"] - both["corr_y"]).abs().round(6) > 0.3)]
    got = {(r["a"], r["b"]) for r in QUERIES["corr_breakdown_all"](spark, d).collect()}
    assert got == set(zip(broken["a"], broken["b"], strict=True)) and max(b for _, b in got) >= 30


def test_a_vetoed_match_hides_no_valid_one(spark):
    left = spark.createDataFrame([(1, "will bitcoin reach 2026 high price"), (2, "trump wins the race"), (3, "solid gold")], "id long, text string")
    right = spark.createDataFrame(
        [(10, "will ethereum reach 2026 high price"), (11, "bitcoin price 2026 rises"), (12, "biden wins the race"), (13, "gold medal count")],
        "id long, text string",
    )
    pairs = matching.similar_pairs(left, right, 0.1)
    assert {(r["l_id"], r["r_id"]) for r in matching.best_matches(pairs).collect()} == {(1, 10), (2, 12), (3, 13)}
    assert [(r["l_id"], r["r_id"]) for r in matching.best_matches(matching.valid_pairs(left, right, 0.1)).collect()] == [(1, 11)]
    e = matching.with_entities(pairs, left, right)
    assert {(r["l_id"], r["r_id"]): r["valid"] for r in e.collect()} == {(r["l_id"], r["r_id"]): (r["l_id"], r["r_id"]) == (1, 11) for r in pairs.collect()}


def test_cooldown_spreads_a_key_over_chunks(spark):
    rng = random.Random(6)
    rows = [(None if i % 11 == 0 else f"w{i % 3}", rng.choice([rng.randrange(10**6), rng.randrange(10**4), None if i % 50 == 0 else 5]), i) for i in range(1500)]
    rows += [("one", t, 5000 + t) for t in range(0, 4000)]
    a = spark.createDataFrame([(w, t if t is None else t * 1_000_000, i) for w, t, i in rows], "wallet string, ts_us long, id long")
    want, last = [], {}
    for w, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        if t is None or w not in last or t - last[w] >= 97:
            want.append((w, t if t is None else t * 1_000_000, i))
            last |= {} if t is None else {w: t}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = alerts.kept_with_gap(a, ["wallet"], 97)
        got = [tuple(r) for r in df.collect()]
        assert "collect_list" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("longest", [1_000_000, 5])
def test_cooldown_by_segments(spark, longest, monkeypatch):
    monkeypatch.setattr(alerts, "CHUNK", 3)
    rng = random.Random(longest)
    rows, i = [], 0
    for w in (None, "a", "b"):
        t = rng.randrange(-500, 500)
        for _ in range(250):
            t += rng.choice([0, 1, 9, 10, 11, 3, 5, 2, 2, 40, 1000])
            rows.append((w, t, i := i + 1))
    # one key holds most rows, in one segment over many chunks
    rows += [("hot", 7 * t, i + t) for t in range(1500)]
    rng.shuffle(rows)
    want, last = set(), {}
    for w, t, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if w not in last or t - last[w] >= 10:
            want.add((w, n))
            last[w] = t
    a = spark.createDataFrame([(w, t * 1_000_000, n) for w, t, n in rows], "wallet string, ts_us long, id long")
    got = [(r["wallet"], r["id"]) for r in alerts.kept_with_gap(a, ["wallet"], 10, longest=longest).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert alerts.kept_with_gap(a.where("1 = 0"), ["wallet"], 10).count() == 0


def wilder(prices, period=14):
    """The definition: first means of `period` deltas, then recursive smoothing; 100 without losses."""
    out, up, down = [50.0] * min(len(prices), period), None, None
    d = [b - a for a, b in zip(prices, prices[1:], strict=False)]
    for i in range(period, len(d) + 1):
        if up is None:
            up, down = (sum(max(s * x, 0.0) for x in d[:period]) / period for s in (1, -1))
        else:
            up, down = ((y * (period - 1) + max(s * d[i - 1], 0.0)) / period for y, s in ((up, 1), (down, -1)))
        out.append(100 - 100 / (1 + up / down) if down else 100.0)
    return out


def test_macd_over_chunks_equals_the_recursion(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(9)
    x = {m: 5 + rng.normal(size=n).cumsum() for m, n in ((1, 4000), (2, 1), (3, 700), (4, 30))}
    s = spark.createDataFrame([(m, 3 * i, float(v)) for m, vs in x.items() for i, v in enumerate(vs)] + [(1, 10, None), (3, 61, float("nan"))], "market long, seq long, price double")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["market"], r["seq"]): (r["macd"], r["signal"]) for r in series.with_macd(s, 12, 26, 9).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)

    def ema(vs, span):
        keep, total, weight, out = 1 - 2 / (span + 1), 0.0, 0.0, []
        for v in vs:
            total, weight = total * keep + v, weight * keep + 1
            out.append(total / weight)
        return np.array(out)

    assert len(got) == sum(map(len, x.values()))
    for m, vs in x.items():
        macd = ema(vs, 12) - ema(vs, 26)
        want = list(zip(macd.tolist(), ema(macd, 9).tolist(), strict=True))
        assert [got[m, 3 * i] for i in range(len(vs))] == [pytest.approx(w, abs=1e-9) for w in want]


def test_wilder_rsi_over_chunks_equals_one_fold(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    x = {m: rng.normal(size=n) for m, n in ((1, 3000), (2, 20), (3, 21), (4, 1), (5, 65), (6, 14), (7, 15))}
    x[1][40:70], x[5][:] = 0.5, np.arange(65.0)
    s = spark.createDataFrame([(m, 3 * i, float(v)) for m, vs in x.items() for i, v in enumerate(vs)] + [(1, 10, None), (2, 61, float("nan"))], "market long, seq long, price double")
    for chunk in (4096, 600):
        monkeypatch.setattr(series, "CHUNK", chunk)
        got = {(r["market"], r["seq"]): r["wilder_rsi"] for r in series.with_wilder_rsi(s).collect()}
        assert len(got) == sum(map(len, x.values()))  # rows without a price are left out
        for m, vs in x.items():
            assert [got[m, 3 * i] for i in range(len(vs))] == pytest.approx(wilder(list(map(float, vs))), abs=1e-7)


def test_rates_at_a_half_round_as_the_sql_does(spark, duck):
    """5710 of 20000 is 28.55 %, whose double's shortest text lies below the half; 5530 is 27.65, whose text lies above it."""
    rows = spark.createDataFrame([(1, "ask", 0, 0.5, 5710.0), (2, "ask", 0, 0.5, 5530.0), (3, "ask", 0, 0.5, 5490.0)], "market int, side string, level long, price double, size double")
    got = {r["market"]: r["fill_rate"] for r in orderbook.impact(rows, 20000).collect()}
    want = dict(duck.execute("select m, round_even(f / 20000.0 * 100, 1) from (values (1, 5710::double), (2, 5530::double), (3, 5490::double)) t(m, f)").fetchall())
    assert got == want == {1: 28.6, 2: 27.6, 3: want[3]}


def test_sums_of_groups_follow_the_given_order_not_the_files(spark):
    """Prices in cents add up to different doubles in different orders; a comparison of two sums must not depend on tasks."""
    from oddsmill.functions.columns import summed

    rng = random.Random(5)
    rows = [(i, i % 40, round(rng.random() * 500, 2)) for i in range(4000)]
    want = {g: 0.0 for g in range(40)}
    for _, g, v in rows:
        want[g] += v
    for parts in (1, 7):
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "i int, g int, v double").repartition(parts)
        assert {r["g"]: (r["value"], r["n"]) for r in summed(df, ["g"], "v", ["i"]).collect()} == {g: (want[g], 100) for g in want}


def test_pairs_meet_in_cells_without_copies_of_all_blocks(spark, monkeypatch):
    """A row is sent to at most `most` cells, each pair meets in one of them, and results are those of the plain definitions."""
    import numpy as np

    rng, most = np.random.default_rng(3), 16
    monkeypatch.setattr(series, "BLOCK", 5)
    monkeypatch.setattr(series, "WIDTH", 7)
    lengths = [12, 15, 11, 9, 14]
    one = spark.createDataFrame([(m, i, float(v)) for m in range(300) for i, v in enumerate(rng.normal(size=lengths[m % 5]))], "market long, seq long, price double")
    two = spark.createDataFrame([(m, i, float(v)) for m in range(290) for i, v in enumerate(rng.normal(size=lengths[m % 4]))], "market long, seq long, price double")
    assert series._cells(series.tails_of(one, 50)).count() == 300 * most
    every = {(r["a"], r["b"]): r["corr"] for r in series.correlations(one, 50).collect()}
    assert len(every) == 300 * 299 // 2
    base = series.correlations(one, 50, least=0.5)
    want = series.breakdowns(base, series.pair_correlations(two, base, 50), series.tail_aligned(two, 50), tau=0.5)
    names = ["a", "b", "base", "now", "divergence", "direction", "confidence"]
    got = [tuple(r) for r in series.broken_pairs(one, two, 50, tau=0.5).select(*names).collect()]
    assert sorted(got) == sorted(tuple(r) for r in want.select(*names).collect()) and got
    for batch in (3, 1000):
        found = {(r["cluster"], r["market"]) for r in series.seed_clusters(one, 50, 0.5, batch=batch).select("cluster", "market").collect()}
        assert found == greedy({p for p, c in every.items() if c >= 0.5})
    assert series.seed_clusters(one.where("1 = 0"), 50, 0.5).count() == 0


def test_all_pairs_of_large_blocks_leave_in_order_of_correlation(spark, monkeypatch):
    """A table of all pairs is the result itself; with equal values side by side it takes less room than block by block."""
    import numpy as np

    rng = np.random.default_rng(8)
    monkeypatch.setattr(series, "BLOCK", 2000)
    monkeypatch.setattr(series, "WIDTH", 500)
    s = spark.createDataFrame([(m, i, float(v)) for m in range(2000) for i, v in enumerate(rng.integers(0, 3, size=12))], "market long, seq long, price double")
    rows = series.correlations(s, 12).toPandas()
    assert len(rows) == len(rows.drop_duplicates(["a", "b"])) == 2000 * 1999 // 2 and (rows["a"] < rows["b"]).all()
    assert (np.diff(rows["corr"]) < 0).sum() == 0
    some = rows.sample(3000, random_state=1)
    given = series.pair_correlations(s, spark.createDataFrame(some[["a", "b"]]), 12).toPandas()
    assert some.merge(given, on=["a", "b", "points", "corr"]).shape[0] == 3000


def test_weeks_of_the_watch_list_add_positions_up_as_they_were_opened(spark, duck, tmp_path):
    """Three positions make 1000 in one order and 999.9999999999999 in another: the one in which they were opened decides, in any order of the file."""
    import datetime
    import itertools
    from functools import reduce

    from oddsmill.plans.catalog import ORACLES, QUERIES

    plain = lambda values: reduce(lambda a, v: a + v, values)  # Python's own sum corrects itself
    rng, start, made = random.Random(2), datetime.datetime(2024, 1, 1), []
    while len(made) < 60:
        a, b = round(rng.random() * 600, 2), round(rng.random() * 400, 2)
        three = [a, b, round(1000 - a - b, 2)]
        if len({plain(p) >= 1000 for p in itertools.permutations(three)}) == 2:
            made.append(three)
    kinds = [rng.sample(["click", "view", "purchase"], 3) for _ in made]
    rows = [(3 * u + k, start + datetime.timedelta(minutes=7 * k + u), u, kinds[u][k], v, "{}") for u, three in enumerate(made) for k, v in enumerate(three)]
    rows.sort(key=lambda r: r[1])
    shape = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    want = {f"w{u}" for u, three in enumerate(made) if three[0] + three[1] + three[2] >= 1000}
    assert 10 < len(want) < len(made)
    for n, some in enumerate((rows, rng.sample(rows, len(rows)))):
        spark.createDataFrame(some, shape).coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        assert {r["wallet"] for r in QUERIES["watch_transition"](spark, f"{tmp_path}/{n}").collect()} == want
    one = duck.cursor()
    one.execute("set threads = 1")
    sql = ORACLES["watch_transition"].replace("from events", f"from '{tmp_path}/0/events.parquet/*.parquet'")
    assert {r[0] for r in one.execute(f"select wallet from ({sql})").fetchall()} == want
