"""Operators without SQL, against brute force; hand-made unit cases."""

import math
import random
from functools import reduce
from operator import add

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.functions import graphs
from tidebook.functions.graphs import components
from tidebook.functions.products import correlations
from tidebook.functions.quantiles import percentiles
from tidebook.functions.storage import SPREAD_ROWS, spread
from tidebook.functions.temporal import asof_join, cooldown, interval_join
from tidebook.operators import compound, graph, history, ingest, signals
from tidebook.plans import all_plans
from tidebook.sources import tables

QUOTE = "event_id long, asset_id string, condition_id string, source_us long, ingestion_us long, best_bid double, best_ask double, bid_size double, ask_size double, spread_bps double"


def quotes(spark, rows):
    return spark.createDataFrame([(i, r.get("asset", "0"), "c", int(r["t"] * 1e6), int(r["t"] * 1e6), r.get("bid", 0.45), r.get("ask", 0.55), r.get("bs", 1000.0), r.get("as", 1000.0), r.get("bps")) for i, r in enumerate(rows)], QUOTE)


def mids(spark, values, step=10.0):
    return quotes(spark, [{"t": i * step, "bid": m - 0.01, "ask": m + 0.01} for i, m in enumerate(values)])


@pytest.mark.parametrize(
    ("rows", "rule", "fires"),
    [
        ([{"t": 0, "bid": 0.55, "ask": 0.55}], ("CROSSED_BOOK", 0.0), True),
        ([{"t": 0, "bs": 0.0, "as": None}], ("EMPTY_BOOK", 0.0), True),
        ([{"t": 0, "bs": 9000.0, "as": 1000.0}], ("MICROPRICE_DIVERGENCE", 50.0), True),
        ([{"t": 0, "bs": 650.0, "as": 350.0}, {"t": 30, "bs": 300.0, "as": 700.0}], ("IMBALANCE_SHIFT", 0.3, None, 60_000), True),
        ([{"t": 0}, {"t": 61}], ("STALE_QUOTE", 30_000.0), True),
        ([{"t": 0, "bs": 5000.0}, {"t": 1, "bs": 1000.0}], ("LARGE_FILL", 1000.0), True),
        ([{"t": 0, "bs": 1000.0}, {"t": 1, "bs": 5000.0}], ("LARGE_FILL", 1000.0), False),
        ([{"t": i / 5} for i in range(50)], ("QUOTE_VELOCITY", 2.0, None, 10_000), True),
        ([{"t": 0, "bid": None}], ("PRICE_ABOVE", 0.1, "BID"), False),
    ],
)
def test_unit_cases(spark, rows, rule, fires):
    assert (signals.signal(quotes(spark, rows), *rule).count() > 0) is fires


def test_volatility_and_trend(spark):
    assert signals.signal(mids(spark, [0.50, 0.55, 0.48, 0.56, 0.49]), "VOLATILITY_SPIKE", 1.0, None, 60_000).count() > 0
    assert signals.signal(mids(spark, [0.500, 0.501, 0.500, 0.502, 0.501]), "VOLATILITY_SPIKE", 5.0, None, 60_000).count() == 0
    up = mids(spark, [0.50, 0.51, 0.52, 0.53, 0.54])
    assert signals.signal(up, "MID_PRICE_TREND", 4.0, "ASK").first().actual_value == 4
    assert signals.signal(up, "MID_PRICE_TREND", 3.0, "BID").count() == 0


def test_cooldown_is_greedy(spark):
    times = [0, 3, 5, 9, 10, 11, 20]
    rows = spark.createDataFrame([("a", t, i, 5) for i, t in enumerate(times)], "k string, t long, i long, w long")
    assert sorted(r.t for r in cooldown(rows, ["k"], "t", "i", "w").collect()) == [0, 5, 10, 20]


def test_asof_and_interval(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("b", 2, 3.0)], "k string, t long, v double")
    assert {(r.k, r.t): r.asof_v for r in asof_join(left, right, ["k"], "t", ["v"]).collect()} == {("a", 5): 1.0, ("a", 10): 2.0, ("b", 1): None}
    near = interval_join(left.withColumnRenamed("t", "u"), right, ["k"], "t", F.col("u") - 1, F.col("u") + 1, 3)
    assert sorted((r.k, r.u, r.v) for r in near.select("l.k", "u", "v").collect()) == [("a", 5, 1.0), ("a", 10, 2.0), ("b", 1, 3.0)]


def test_cycles_equal_a_plain_search(spark):
    rng = random.Random(3)
    names = [f"m{i}" for i in range(11)]
    rows = [(a, b, rng.choice(["hedge", "correlation", "causal"]), rng.uniform(0.05, 1.5)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.6]
    # cycles of four and five markets apart from the rest, and a pair that has links of two types
    rows += [("x1", "x2", "hedge", 1.0), ("x2", "x3", "causal", 0.2), ("x3", "x4", "hedge", 0.5), ("x1", "x4", "causal", 0.3), ("x1", "x4", "hedge", 0.2)]
    rows += [(f"y{i}", f"y{i % 5 + 1}", "hedge" if i == 2 else "causal", 2.0 if i == 2 else 0.4) for i in range(1, 6)]
    w = {}
    for a, b, kind, x in rows:
        if x > 0.1:
            x = -x if kind == "hedge" else x
            w[a, b] = w[b, a] = min(x, w.get((a, b), x))
    every = sorted({a for a, _ in w})

    def plain(low, high, below):
        out = {}

        def go(path, total):
            for v in every:
                if (path[-1], v) in w:
                    if v == path[0] and low <= len(path) and len(path) > 2 and path[1] < path[-1] and total + w[path[-1], v] < below:
                        out["->".join(path)] = round(total + w[path[-1], v], 9)
                    if v > path[0] and v not in path and len(path) < high:
                        go([*path, v], total + w[path[-1], v])

        for v in every:
            go([v], 0.0)
        return out

    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    for low, high, below in ((3, 6, 0.0), (4, 5, -1.0)):
        got = {r.cycle: round(r.total, 9) for r in graph.negative_cycles(edges, high, 0.1, below, low).collect()}
        assert got == plain(low, high, below)
        assert {len(c.split("->")) for c in got} == set(range(low, high + 1))
    assert any(c.startswith("x1") for c in got) or graph.negative_cycles(edges, 4, 0.1, 0.0, 4).where("cycle like 'x1%'").count() == 1
    none = edges.where("edge_type <> 'hedge'")
    assert graph.negative_cycles(none, 5, 0.1).count() == 0 and graph.negative_cycles(edges.limit(0), 4, 0.1).count() == 0


@pytest.mark.parametrize("slice_us", [3, 50, 10**9])
def test_cooldown_by_slices_equals_a_plain_fold(spark, slice_us):
    rng = random.Random(slice_us)
    rows = []
    for key, n, waits in (("hot", 700, [17]), ("none", 40, [0]), ("mixed", 200, [5, 40, 0]), (None, 60, [9]), ("long", 50, [400]), ("one", 1, [3])):
        rows += [(key, 1, rng.randrange(-50, 600), i, rng.choice(waits)) for i in range(n)]
    want = set()
    last: dict = {}
    for key, _, t, i, w in sorted(rows, key=lambda r: (r[0] or "", r[2], r[3])):
        if key not in last or t - last[key] >= w:
            last[key] = t
            want.add((key, i))
    df = spark.createDataFrame(rows, "k string, other int, t long, i int, w int").repartition(3)
    got = cooldown(df, ["k", "other"], "t", "i", "w", slice_us)
    assert got.columns == df.columns and {(r.k, r.i) for r in got.collect()} == want
    assert cooldown(df.limit(0), ["k"], "t", "i", "w").count() == 0


def test_correlations_of_blocks_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((3, 90))
    rows = []
    for i in range(23):
        x = base[i % 3] * rng.choice([-1, 1]) + rng.standard_normal(90) * 0.4 if i != 5 else np.full(90, 0.4)
        rows += [(f"s{i:02d}", int(t) - 40, float(x[t])) for t in np.flatnonzero(rng.random(90) < (0.5 if i else 0.03))]
    rows.append(("s22", 200, None))
    got = {(r.a, r.b): (r.r, r.n) for r in correlations(spark.createDataFrame(rows, "series string, step long, value double"), 3, 0.5, series=4, steps=16).collect()}
    by = {}
    for name, t, v in rows:
        if v is not None:
            by.setdefault(name, {})[t] = v
    want = {}
    for a in by:
        for b in by:
            both = sorted(by[a].keys() & by[b].keys())
            if a < b and len(both) >= 3:
                x, y = [by[a][t] for t in both], [by[b][t] for t in both]
                want[a, b] = (None if "s05" in (a, b) else np.corrcoef(x, y)[0, 1], len(both))
    assert got.keys() == want.keys() and len(want) > 200
    for k, (r, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if r is None else abs(got[k][0] - r) < 1e-9)
    assert correlations(spark.createDataFrame([], "series string, step long, value double"), 3).count() == 0


def test_best_paths_equal_a_plain_search(spark):
    rng = random.Random(6)
    names = [f"m{i}" for i in range(9)]
    rows = [(a, b, kind, round(rng.uniform(0.2, 1.6), 2)) for i, a in enumerate(names) for b in names[i + 1 :] for kind in ("arbitrage", "correlation", "hedge") if rng.random() < 0.4]
    links = [(x, y, k, max(0.0, np.exp(w) - 1) * 10_000 if k == "arbitrage" else max(0.0, np.exp(w) - 1.8) * 1000) for a, b, k, w in rows if k != "hedge" and w >= 0.5 for x, y in ((a, b), (b, a))]
    every = []

    def go(path, types, bps):
        if len(path) >= 3 and round(bps) > 0:
            every.append((-float(np.floor(bps + 0.5)), "->".join(path), ",".join(types)))
        if len(path) <= 5:
            for a, b, k, g in links:
                if a == path[-1] and b not in path:
                    go([*path, b], [*types, k], bps + g)

    go(["m0"], [], 0.0)
    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    for limit, beam in ((40, 1), (7, 4), (10**6, 1)):
        got = [(-r.bps, r.path, r.types) for r in graph.arbitrage_paths(edges, "m0", 5, 0.5, limit, beam).collect()]
        assert got == sorted(every)[:limit]
    assert len(every) > 1000 and graph.arbitrage_paths(edges.limit(0), "m0", 3, 0.5, 5).count() == 0


def test_paths_of_more_than_a_hundred_links(spark):
    chain = spark.createDataFrame([(f"m{i:04d}", f"m{i + 1:04d}", "causal", 1.0) for i in range(115)], "market_a string, market_b string, edge_type string, weight double")
    end = graph.shortest_path(chain, "m0000", "m0115").first()
    assert abs(end.dist - 115 / 2) < 1e-9 and len(end.path) == 116 and end.types == ["causal"] * 115


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    ids = rng.sample(range(3000), 3000)  # a chain whose ids are in no order
    pairs = list(zip(ids[:-1], ids[1:], strict=True)) + [(9000, 9000 + i) for i in range(400)] + [(8000 + i, 8001 + i // 2) for i in range(300)] + [(7000, 7000), (7001, 7000)]
    root = {x: x for p in pairs for x in p}
    for _ in range(4000):
        new = dict(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == root
    named = edges.select(F.struct(F.lit("x"), "a").alias("a"), F.struct(F.lit("x"), F.col("b").alias("a")).alias("b"))
    assert {r.id.a: r.component.a for r in components(named.limit(300)).collect()}.keys() <= root.keys()
    assert components(edges.where("a < 0")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("slice_us", [7_000_000, 10**12])
def test_books_by_slices_equal_one_fold(spark, sf_dir, slice_us):
    """A hot asset's history, cut into slices: the first rows have no book yet."""
    snaps, deltas = tables.snapshots(spark, sf_dir), tables.raw_levels(spark, sf_dir)
    one = lambda t: t.withColumn("asset_id", F.lit("hot"))
    late = one(snaps).where(F.col("source_us") % 3 == 0).where(F.col("source_us") > tables.START_US + 20_000_000)
    both = late, one(deltas)
    want = {(r.source_us, r.event_id): tuple(r)[3:] for r in ingest.reconstruct_bbo_series(*both, slice_us=10**15).collect()}
    got = {(r.source_us, r.event_id): tuple(r)[3:] for r in ingest.reconstruct_bbo_series(*both, slice_us=slice_us).collect()}
    assert got == want and len(want) > 300
    assert min(want)[0] > tables.START_US + 20_000_000


def test_rebuilt_books_equal_a_plain_fold(spark, sf_dir):
    snaps, deltas = tables.snapshots(spark, sf_dir), tables.raw_levels(spark, sf_dir)
    events = [(r.asset_id, r.source_us, r.event_id, r) for r in snaps.collect()] + [(r.asset_id, r.source_us, r.event_id, r) for r in deltas.collect()]
    books, want = {}, {}
    for asset, at, event, r in sorted(events, key=lambda e: e[:3]):
        if "bid_prices" in r.__fields__:
            books[asset] = dict(zip(r.bid_prices, r.bid_sizes)), dict(zip(r.ask_prices, r.ask_sizes))
        elif asset in books:
            side = books[asset][r.side == "SELL"]
            side[r.price] = r.new_size
            if not r.new_size:
                del side[r.price]
        else:
            continue
        want[asset, at, event] = max(books[asset][0], default=None), min(books[asset][1], default=None)
    got = {(r.asset_id, r.source_us, r.event_id): (r.best_bid, r.best_ask) for r in ingest.reconstruct_bbo_series(snaps, deltas).collect()}
    assert got == want


def test_compound_equals_a_plain_fold(spark):
    states = [("t", "ALL_OF", 0, 2, p, t, t, m) for t, p, m in [(0, 0, True), (1, 1, False), (2, 1, True), (3, 0, True), (70_000_000, 1, True), (70_000_001, 0, True)]]
    df = spark.createDataFrame(states, "trigger_id string, mode string, needed int, n int, pos int, source_us long, event_id long, met boolean")
    assert sorted(r.source_us for r in compound.compound_eval(df).collect()) == [2, 70_000_001]


def test_distances_match_paths(spark):
    edges = spark.createDataFrame([("a", "b", "hedge", 1.0), ("b", "c", "hedge", 1.0), ("a", "c", "causal", 0.1), ("c", "d", "causal", 3.0)], "market_a string, market_b string, edge_type string, weight double")
    got = {r.market: (round(r.dist, 6), "".join(r.path)) for r in graph.shortest_distances(edges, "a", 0.0).collect()}
    assert got == {"a": (0.0, "a"), "b": (0.5, "ab"), "c": (round(1 / 1.1, 6), "ac"), "d": (round(1 / 1.1 + 0.25, 6), "acd")}


def test_cycles_of_four_and_pruning(spark):
    rows = [("a", "b", "hedge", 1.0), ("b", "c", "hedge", 1.0), ("c", "d", "hedge", 0.3), ("a", "d", "correlation", 2.0), ("d", "e", "causal", 0.2), ("e", "f", "correlation", 5.0), ("d", "f", "causal", 0.2)]
    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    got = {(r.cycle, r.n, round(r.total, 6), r.kind) for r in graph.negative_cycles(edges, 5, 0.1).collect()}
    assert got == {("a->b->c->d", 4, -0.3, "hedge_loop")}
    assert graph.negative_cycles(edges, 3, 0.1).count() == 0
    assert graph.has_negative_cycle(edges).first().asDict() == {"found": True, "pairs": 3}
    assert graph.has_negative_cycle(edges.where("edge_type <> 'hedge'")).first().asDict() == {"found": False, "pairs": 0}
    assert graph.has_negative_cycle(edges.limit(0)).first().found is False


def test_cycles_in_passes(spark):
    """Few starts at once give the same cycles, and no half path stays on disk."""
    from pathlib import Path

    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(90)})
    rows = [(f"m{a:02}", f"m{b:02}", rng.choice(["hedge", "correlation"]), rng.uniform(0.2, 1.0)) for a, b in pairs]
    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    for high, below, low in ((4, 0.0, 3), (6, -1.0, 5)):
        want = sorted(tuple(r) for r in graph.negative_cycles(edges, high, 0.1, below, low).collect())
        got = sorted(tuple(r) for r in graph.negative_cycles(edges, high, 0.1, below, low, pass_paths=300).collect())
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want] and want
        assert np.allclose([r[2] for r in got], [r[2] for r in want])
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    assert not [*shared.glob("paths-*/*.parquet")]


def cycles_by_hand(rows, lengths, below, min_weight=0.1):
    """Cycle to length and sum, added as the SQL does: both halves from the least market on."""
    link = {}
    for a, b, kind, weight in rows:
        if weight > min_weight:
            w = (-abs(weight) if kind == "hedge" else weight, kind)
            link[a, b] = link[b, a] = min(link.get((a, b), w), w)
    near = {}
    for a, b in link:
        near.setdefault(a, set()).add(b)
    found, paths = {}, [(m,) for m in near]
    for n in range(2, max(lengths) + 1):
        paths = [(*p, m) for p in paths for m in near[p[-1]] if m > p[0] and m not in p]
        for p in paths if n in lengths else ():
            if p[0] in near[p[-1]] and p[1] < p[-1]:
                w = [link[e][0] for e in zip(p, (*p[1:], p[0]))]
                half = n - n // 2
                total = reduce(add, w[:half]) + reduce(add, w[:half - 1:-1])
                hedges = sum(link[e][1] == "hedge" for e in zip(p, (*p[1:], p[0])))
                if total < below:
                    found["->".join(map(str, p))] = n, total, "hedge_loop" if hedges * 2 > n else "inverse_correlation"
    return found


def random_edges(seed, markets, links):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(markets), 2))) for _ in range(links)})
    # few weights, so that sums meet the bar up to rounding, and some pairs of several types
    return [(a, b, rng.choice(["hedge", "correlation", "arbitrage"]), rng.choice([0.1, 0.2, 0.3, 0.5, 0.6, 0.7, 0.9])) for a, b in pairs for _ in range(rng.choice([1, 1, 2]))]


@pytest.mark.parametrize(("blocks", "pass_links"), [(1, 10**9), (3, 1), (5, 1000)])
def test_short_cycles_by_blocks(spark, blocks, pass_links):
    """All cycles with the sums of the SQL to the last bit, by names and by numbers."""
    rows = random_edges(5, 40, 260)
    want = cycles_by_hand(rows, (3, 4), 0.0)
    numbered = spark.createDataFrame(rows, "market_a long, market_b long, edge_type string, weight double")
    got = graph.negative_cycles(numbered, 4, 0.1, blocks=blocks, pass_links=pass_links, name=lambda c: f"cast({c} AS string)")
    assert {r.cycle: (r.n, r.total, r.kind) for r in got.collect()} == want and len(want) > 200 and got.count() == len(want)
    # names whose order is not that of the numbers, and pairs in either order
    rows = [(f"m{(a * 7) % 40}", f"m{(b * 7) % 40}", k, w) for a, b, k, w in rows]
    want = cycles_by_hand(rows, (3, 4), 0.0)
    named = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    got = graph.negative_cycles(named, 4, 0.1, blocks=blocks, pass_links=pass_links)
    assert {r.cycle: (r.n, r.total, r.kind) for r in got.collect()} == want and got.count() == len(want)


def test_short_cycles_write_links_only(spark, monkeypatch):
    """Hubs of 60 neighbours have 1,770 paths of two links each; none is written."""
    written = []
    put = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, *a, **k: written.append(put(df, *a, **k)) or written[-1])
    monkeypatch.setattr(graph, "discard", lambda df: None)
    rows = [(f"h{h}", f"m{i:02}", "hedge" if i == h else "correlation", 0.2) for h in range(6) for i in range(60)]
    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    got = graph.negative_cycles(edges, 4, 0.1, -0.1)
    assert got.count() == 0 and max(df.count() for df in written) <= len(rows)


def test_cycle_alerts_write_no_paths(spark, sf_dir, monkeypatch):
    labels, put = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="table", *a, **k: labels.append(label) or put(df, label, *a, **k))
    assert all_plans.QUERIES["cycle_alerts"](spark, sf_dir).count() > 100_000
    assert not [x for x in labels if x.startswith("paths")]


@pytest.mark.parametrize(("seed", "below", "pass_paths"), [(1, -1.0, 10**9), (2, -1.6, 60)])
def test_deep_cycles(spark, monkeypatch, seed, below, pass_paths):
    """Few links are below a low bar's mean: all cycles of five to seven, with the sums of the
    SQL, without the half paths of all links."""
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(90)})
    rows = [(f"m{a:02}", f"m{b:02}", *(("hedge", rng.uniform(0.8, 1.7)) if i % 9 == 0 else ("causal", rng.uniform(0.11, 0.6)))) for i, (a, b) in enumerate(pairs)]
    want = cycles_by_hand(rows, (5, 6, 7), below)
    monkeypatch.delattr(graph, "_half_paths")
    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    got = graph.negative_cycles(edges, 7, 0.1, below, 5, pass_paths=pass_paths).collect()
    assert {r.cycle: (r.n, r.total, r.kind) for r in got} == want and len(got) == len(want) > 20
    assert {r.n for r in got} == {5, 6, 7}


def test_a_path_over_some_types(spark):
    rows = [("a", "b", "hedge", 1.0), ("b", "c", "causal", 1.0), ("a", "c", "arbitrage", 9.0), ("a", "c", "causal", 0.1)]
    edges = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, weight double")
    one = graph.shortest_path(edges, "a", "c").first()
    assert one.path == ["a", "c"] and one.types == ["arbitrage"]
    two = graph.shortest_path(edges, "a", "c", 0.5, ["hedge", "causal"]).first()
    assert two.path == ["a", "b", "c"] and two.types == ["hedge", "causal"]
    assert graph.shortest_path(edges, "a", "z").count() == 0


@pytest.mark.parametrize(("kinds"), [("PRICE_MOVE", "VOLATILITY_SPIKE", "IMBALANCE_SHIFT", "QUOTE_VELOCITY", "MID_PRICE_TREND", "LARGE_FILL", "STALE_QUOTE", "EMPTY_BOOK", "CROSSED_BOOK", "MICROPRICE_DIVERGENCE", "PRICE_BELOW", "SIZE_SPIKE", "IMBALANCE_ASK", "SPREAD_NARROW")])
def test_streamed_signals_equal_batch_ones(spark, sf_dir, kinds):
    from tidebook.functions.storage import new_path
    from tidebook.plans.signal_plans import SIGNALS
    from tidebook.plans.stream_plans import _feed
    from tidebook.streaming import feeds

    rules = [(n, k, t, s, w, 0) for n, (k, t, s, w) in SIGNALS.items() if k in kinds]
    ticks = tables.quotes(spark, sf_dir).where("cast(asset_id AS int) % 4 = 0")
    got = feeds.run_to_end(feeds.stream_signals(_feed(spark, ticks), rules), "signals", spark, new_path(spark, "ckpt"))
    got = {(r.rule_id, r.event_id): round(r.actual_value, 5) for r in got.collect()}
    want = {(n, r.event_id): round(r.actual_value, 5) for n, k, t, s, w, _ in rules for r in signals.signal(ticks, k, t, s, w).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_streams_refuse_unknown_signals(spark, sf_dir):
    from tidebook.streaming import feeds

    with pytest.raises(ValueError, match="no such signal"):
        feeds.stream_signals(tables.quotes(spark, sf_dir), [("r", "ARBITRAGE_BUY", 0.9, None, 0, 0)])
    with pytest.raises(ValueError, match="window"):
        feeds.stream_signals(tables.quotes(spark, sf_dir), [("r", "PRICE_MOVE", 0.9, None, 600_000, 0)])


def test_cooldown_cuts_and_keeps_columns(spark):
    import random

    random.seed(4)
    rows = [(f"k{i % 3}", random.randrange(3000), i, 50, None if i % 2 else 2**60 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long, w long, big long")
    want = set()
    for k in ("k0", "k1", "k2"):
        last = None
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            if last is None or r[1] - last >= 50:
                want.add(r)
                last = r[1]
    assert {tuple(r) for r in cooldown(df, ["k"], "t", "i", "w").collect()} == want


def test_wide_ids(spark):
    n = 2**255 + 12345
    rows = spark.createDataFrame([(hex(n),), ("0x0",), ("plain",), (None,)], "v string")
    assert [r.o for r in rows.select(ingest.normalize_condition_id(F.col("v")).alias("o")).collect()] == [str(n), "0", "plain", None]


def test_ids_of_every_length(spark):
    whole = ["0x" + ("9" + "f07a" * 16)[:n] for n in range(1, 65)] + ["0X" + "F" * 64, "0x" + "0" * 64, "0x000a"]
    other = ["0x", "0xg1", "0x" + "1" * 65, "0x1_0", "0xab\n", "ab", ""]
    rows = spark.createDataFrame([(v,) for v in whole + other], "v string")
    got = {r.v: r.o for r in rows.select("v", ingest.normalize_condition_id(F.col("v")).alias("o")).collect()}
    assert got == {v: str(int(v, 16)) for v in whole} | {v: v for v in other}


def _odd_ticks(spark, n=600):
    """Pauses, repeated times, one-sided quotes, rows without a time or an asset."""
    rng = random.Random(7)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 1, 3, 7, 20, 400])
        bid = rng.choice([None, 0.40, 0.41, 0.42, 0.43])
        at = None if i % 97 == 5 else t * 1_000_000
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), "c", at, at, bid, rng.choice([0.5, 0.51, None]) if i % 3 else 0.5, rng.choice([None, 0.0, 10.0, 9000.0]), rng.choice([10.0, 4000.0]), 1.0))
    return spark.createDataFrame(rows, QUOTE)


@pytest.mark.parametrize("width_s", [1, 60, 700])
def test_slices_tell_the_same_as_one_history(spark, width_s):
    ticks = _odd_ticks(spark)
    wanted = [("PRICE_MOVE", None, 60_000), ("VOLATILITY_SPIKE", None, 60_000), ("IMBALANCE_SHIFT", None, 30_000), ("QUOTE_VELOCITY", None, 5_000), ("MID_PRICE_TREND", None, 0), ("MID_PRICE_TREND", "ASK", 0), ("LARGE_FILL", None, 0), ("LARGE_FILL", "BID", 0), ("STALE_QUOTE", None, 0)]

    def values(slice_us):
        rows = history.prepare(ticks, 60_000, slice_us=slice_us)
        got = rows.select("event_id", "_own", "_slice", *[signals.value(*w).cast("double").alias(f"v{i}") for i, w in enumerate(wanted)]).where("_own").collect()
        return len({r["_slice"] for r in got}), sorted((r.event_id, *[r[f"v{i}"] for i in range(len(wanted))]) for r in got)

    slices, cut = values(width_s * 1_000_000)
    whole, one = values(10**15)
    assert whole <= 2 < slices  # rows without a time are a slice of their own
    assert [r[0] for r in cut] == list(range(600)) == [r[0] for r in one]
    assert cut == one
    assert all(any(r[i + 1] is not None for r in one) for i in range(len(wanted)))


def test_trend_and_fill_of_slices_against_a_plain_pass(spark):
    ticks = _odd_ticks(spark)
    got = {r.event_id: (r.run, r.direction, r.bid_before) for r in history.prepare(ticks, 0, slice_us=30_000_000).where("_own").collect()}
    by_asset = {}
    for r in ticks.collect():
        by_asset.setdefault(r.asset_id, []).append(r)
    for rows in by_asset.values():
        mid = run = way = size = None
        for r in sorted(rows, key=lambda r: (r.source_us if r.source_us is not None else -1, r.event_id)):
            now = None if r.best_bid is None or r.best_ask is None else (r.best_bid + r.best_ask) / 2
            if now is not None and mid is not None and now != mid:
                step = 1 if now > mid else -1
                run, way = (run + 1 if step == way else 1), step
            mid = mid if now is None else now
            assert got[r.event_id] == (run, way, size)
            size = r.bid_size


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([rng.uniform(-5, 5), rng.expovariate(1) * 1e6, 0.0, 1.0, None]) for _ in range(400)]]
    rows += [("one", 2.5), ("none", None), ("two", 1.0), ("two", 2.0), ("same", 7.0), ("same", 7.0), ("far", float("inf")), ("far", -1e-300), ("far", 1e300), ("odd", float("nan")), ("odd", 1.0), ("odd", -0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {r.k: r.q for r in percentiles(df, ["k"], F.col("v"), points).collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("q")).where("q IS NOT NULL").collect()}
    assert set(got) == set(want) == {"a", "b", None, "one", "two", "same", "far", "odd"}
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)
    assert percentiles(df.limit(0), ["k"], F.col("v"), points).count() == 0


@pytest.mark.parametrize("slice_s", [5, 90, 100_000])
def test_compound_rules_by_slices_against_a_plain_fold(spark, slice_s):
    rng = random.Random(11)
    rows = []
    for rule, (mode, needed, n) in {"all": ("ALL_OF", 2, 3), "any": ("ANY_OF", 1, 2), "some": ("N_OF_M", 3, 5), "many": ("N_OF_M", 12, 80), "never": ("N_OF_M", 4, 2)}.items():
        t = 0
        for i in range(500):
            t += rng.choice([0, 0, 1, 2, 5, 61 if rng.random() < 0.1 else 3])
            rows.append((rule, mode, needed, n, rng.randrange(n), t * 1_000_000, i, rng.random() < (0.9 if n > 5 else 0.4)))
    want, held, last = [], {}, {}
    for rule, mode, needed, n, pos, t, i, met in sorted(rows, key=lambda r: (r[0], r[5], r[6], r[4])):
        if t - last.get(rule, t) > compound.IDLE_US:
            held[rule] = set()
        last[rule], now = t, held.setdefault(rule, set())
        now.add(pos) if met else now.discard(pos)
        if len(now) >= compound.required(mode, needed, n):
            want.append((rule, t, i, len(now)))
            held[rule] = set()
    states = spark.createDataFrame(rows, "trigger_id string, mode string, needed int, n int, pos int, source_us long, event_id long, met boolean")
    got = sorted(map(tuple, compound.compound_eval(states, slice_s * 1_000_000).collect()))
    assert got == sorted(want)
    assert {r[0] for r in got} == {"all", "any", "some", "many"}
    assert compound.compound_eval(states.limit(0)).count() == 0


def test_equal_weights_stay_equal(spark):
    # the JVM's pow misses some of these by a unit
    rows = [("a", f"m{n:02}", "hedge", "user_analysis", "u", 1.0, (90 - n) * graph.DAY_US) for n in range(91)]
    signals_ = spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, signal_source string, user_id string, strength double, created_us long")
    ages = signals_.select(F.col("market_b"), graph._decay(F.lit(90) - F.floor(F.col("created_us") / graph.DAY_US), 90).alias("d")).collect()
    assert [r.d for r in sorted(ages)] == [2.0 ** (-n / 30) for n in range(91)]
    far = spark.createDataFrame([(200,), (-3,), (None,)], "age long").select(graph._decay(F.col("age"), 90).alias("d")).collect()
    assert [None if r.d is None else round(r.d, 12) for r in far] == [round(2.0 ** (-200 / 30), 12), round(2.0**0.1, 12), None]


def test_ranks_of_nearly_equal_weights(spark):
    # 0.8 * 1.5 is a unit above 1.2, which fifty days shrink but don't level
    rows = [("a", "x", "hedge", "user_analysis", "u", 1.2, 40 * graph.DAY_US), ("a", "y", "hedge", "user_trigger", "u", 0.8, 40 * graph.DAY_US)]
    edges = graph.edge_weights(spark.createDataFrame(rows, "market_a string, market_b string, edge_type string, signal_source string, user_id string, strength double, created_us long"), 90 * graph.DAY_US)
    known = spark.createDataFrame([("x", "q", 1)], "market string, question string, end_us long")
    assert [r.dst for r in graph.suggestions(edges, known, 2, 1).where("src = 'a'").orderBy("rank").collect()] == ["y", "x"]
    assert [r.dst for r in graph.neighbors(edges, "a", 0.1, 2).orderBy("rank").collect()] == ["y", "x"]


@pytest.mark.parametrize("files", [3, 150])
def test_a_batch_takes_one_slice(spark, sf_dir, files):
    from tests.test_queries import plain
    from tidebook.plans import all_plans
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", files)
    try:
        got = all_plans.QUERIES["stream_late_rows"](spark, sf_dir)
        want = con.execute(all_plans.ORACLES["stream_late_rows"])
        assert plain(got.select(*[c[0] for c in want.description]).collect()) == plain(want.fetchall())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


SIGNALS = "market_a string, market_b string, edge_type string, signal_source string, user_id string, strength double, created_us long"


def test_weights_are_nearest_logarithms(spark):
    # the JVM's logarithm is off by a unit at some of these
    sums = [float.fromhex("0x1.adbcb94b7499ep+2") - 1] + [n / 7 for n in range(200)]
    rows = [("a", f"m{i}", "hedge", "user_analysis", "u", s, 90 * graph.DAY_US) for i, s in enumerate(sums)]
    got = {r.market_b: r.weight for r in graph.edge_weights(spark.createDataFrame(rows, SIGNALS), 90 * graph.DAY_US).collect()}
    assert got == {f"m{i}": math.log(max(0.001, 1 + s)) for i, s in enumerate(sums)}


def test_signals_add_up_in_order(spark):
    size = [0.1, 0.2, 0.3, 0.7, 1e-17, 0.6, 0.3, 0.1]
    rows = [("a", "b", "hedge", "user_analysis", ["u", "v", "", None][i % 4], s, 90 * graph.DAY_US, i) for i, s in enumerate(size)]
    for way in (1, -1):
        told = spark.createDataFrame([(*r[:7], way * r[7]) for r in rows], SIGNALS + ", place int").repartition(4)
        r = graph.edge_weights(told, 90 * graph.DAY_US, order="place").first()
        total = 0.0
        for s in size[::way]:
            total += s
        assert (r.weight, r.user_count, r.signal_count, r.last_us) == (math.log(1 + total), 2, 8, 90 * graph.DAY_US)


def test_versions_are_dealt_by_their_number(spark):
    rows = spark.range(60).selectExpr("concat('a', id % 20) AS market_a", "'b' AS market_b", "'hedge' AS edge_type", "id AS updated_us")
    few, many = graph.latest_edges(rows), graph.latest_edges(rows, 20 * SPREAD_ROWS)
    parts = lambda n: spread(spark.range(2000), ["id"], n).select(F.spark_partition_id()).distinct().count()
    assert (parts(2000), parts(20 * SPREAD_ROWS)) == (1, 20)
    assert sorted(few.collect()) == sorted(many.collect()) == sorted((f"a{i}", "b", "hedge", 40 + i) for i in range(20))


def test_slices_are_dealt_by_the_number_of_quotes(spark, monkeypatch):
    ticks, dealt = _odd_ticks(spark, 300), []
    monkeypatch.setattr(history, "spread", lambda df, keys, rows: dealt.append((tuple(keys), rows)) or spread(df, keys, rows))
    assert history.prepare(ticks, 1000).where("_own").count() == ticks.count()
    assert dealt == [(("asset_id", "_slice"), ticks.count())] * 2


def test_only_two_links_a_market_go_through_the_stars(spark, sf_dir, monkeypatch):
    held, write = [], graphs.materialize
    monkeypatch.setattr(graphs, "materialize", lambda df, label: held.append((label, write(df, label))) or held[-1][1])
    monkeypatch.setattr(graphs, "discard", lambda df: None)
    found = all_plans.QUERIES["connected_components"](spark, sf_dir)
    assert max(df.count() for label, df in held if label == "links") <= 2 * found.count()


@pytest.mark.parametrize("links", [1.2, 2.0, 8.0])
def test_dense_components_take_turns(spark, links, monkeypatch):
    rng, turns = random.Random(int(links * 10)), []
    inside = lambda g: (1000 * g + rng.randrange(300), 1000 * g + rng.randrange(300))
    pairs = [inside(g) for g in range(3) for _ in range(int(300 * links))] + [(5, 5), (9001, 9000), (9000, 9001), (9001, 9000)]
    root = {x: x for a, b in pairs if a != b for x in (a, b)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    monkeypatch.setattr(graphs, "components", lambda edges: turns.append(1) or components(edges))
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    assert {r.id: r.component for r in graphs.dense_components(edges).collect()} == {x: top(x) for x in root}
    assert len(turns) > 1 or links > 1.2
    named = edges.select(*[F.format_string("n%05d", c).alias(c) for c in "ab"])
    assert {r.id: r.component for r in graphs.dense_components(named).collect()} == {f"n{x:05d}": f"n{top(x):05d}" for x in root}
    assert graphs.dense_components(edges.where("a < 0")).count() == 0


def test_edges_at_the_bar_are_added_up_in_order(spark):
    rng, bar = random.Random(5), 0.1
    odd = [[None], [0.2, None], [float("nan")], [float("inf"), -1.0], [float("inf"), float("-inf")], [float("-inf")], [5.0], [-5.0], [0.05, 0.05]]
    close = [[*(one := [rng.uniform(-3, 3) for _ in range(6)]), math.exp(bar) - 1 - sum(one) + rng.randrange(-4, 5) * 2**-53] for _ in range(300)]
    rows = [(f"a{i % 7}", f"m{i}", "hedge" if i % 5 else None, "user_analysis", "u", s, 90 * graph.DAY_US, k) for i, sizes in enumerate(odd + close) for k, s in enumerate(sizes)]
    told = spark.createDataFrame(rows, SIGNALS + ", place int").repartition(3)
    want = graph.edge_weights(told, 90 * graph.DAY_US, order="place").where(F.col("weight") > bar).select(*graph.EDGE)
    got = graph.edges_above(told, 90 * graph.DAY_US, bar, order="place")
    assert {tuple(r) for r in got.collect()} == (kept := {tuple(r) for r in want.collect()}) and got.count() == len(kept)
    assert 100 < len(kept) < 250 and {"m1", "m3"} <= {b for _, b, _ in kept}
    sure = told.where("market_b in ('m6', 'm7', 'm8')")
    assert [r.market_b for r in graph.edges_above(sure, 90 * graph.DAY_US, bar).collect()] == ["m6"]


@pytest.mark.parametrize("shift", [0, 9_999_900])
def test_numbers_of_markets_stand_for_their_names(spark, sf_dir, tmp_path, shift):
    tables.read(spark, sf_dir, "lineitem").withColumn("l_partkey", F.col("l_partkey") + shift).write.parquet(f"{tmp_path}/lineitem.parquet")
    named, numbered = tables.edge_signals(spark, str(tmp_path)), tables.edge_signals(spark, str(tmp_path), numbered=True)
    back = numbered.selectExpr(*[f"{tables.market_name(c)} AS {c}" for c in ("market_a", "market_b")], *numbered.columns[2:])
    assert back.exceptAll(named).isEmpty() and named.exceptAll(back).isEmpty()


def test_components_of_markets_below_zero(spark, sf_dir, tmp_path):
    """Their names are no digits, and have another order than their numbers."""
    lines = tables.read(spark, sf_dir, "lineitem").where("l_linenumber > 2").withColumn("l_partkey", F.col("l_partkey") - 150)
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = all_plans.QUERIES["connected_components"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(all_plans.ORACLES["connected_components"])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in found.select(*columns).collect()) == sorted(want.fetchall())
