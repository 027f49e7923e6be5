"""Queries over signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import ingest, signals
from tidebook.plans.base_sql import sql
from tidebook.plans.ingest_plans import greedy_sql
from tidebook.plans.registry import query, rounded
from tidebook.sources import tables

_O = "(PARTITION BY asset_id ORDER BY source_us, event_id)"
PREPARED = f"""p1 AS (SELECT *, (best_bid + best_ask) / 2 AS mid, CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END AS imb,
  CASE WHEN bid_size + ask_size > 0 THEN (best_bid * ask_size + best_ask * bid_size) / (bid_size + ask_size) END AS micro FROM bbo),
p2 AS (SELECT *, last_value(mid IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY source_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mid_before FROM p1),
p3 AS (SELECT *, CASE WHEN mid_before > 0 THEN (mid - mid_before) / mid_before END AS ret, CASE WHEN mid <> mid_before THEN sign(mid - mid_before)::INT END AS move FROM p2),
p4 AS (SELECT *, last_value(move IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY source_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_move FROM p3),
p5 AS (SELECT *, sum(CASE WHEN move IS NOT NULL AND move IS DISTINCT FROM last_move THEN 1 ELSE 0 END) OVER {_O} AS island FROM p4),
p AS (SELECT *, CASE WHEN island > 0 THEN count(move) OVER (PARTITION BY asset_id, island ORDER BY source_us, event_id) END AS run, CASE WHEN island > 0 THEN first_value(move IGNORE NULLS) OVER (PARTITION BY asset_id, island ORDER BY source_us, event_id) END AS direction,
  lag(bid_size) OVER {_O} AS bid_before, lag(ask_size) OVER {_O} AS ask_before, lead(source_us) OVER {_O} - source_us AS silence_us FROM p5)"""


def _w(ms: int) -> str:
    return f"OVER (PARTITION BY asset_id ORDER BY source_us RANGE BETWEEN {ms * 1000} PRECEDING AND CURRENT ROW)"


def value_sql(kind: str, side: str | None, ms: int) -> str:
    w = _w(ms)
    first_imb = f"CASE WHEN count(imb) {w} > 100 THEN lag(imb, 99) OVER {_O} ELSE first_value(imb IGNORE NULLS) {w} END"
    edge = f"first_value(ret) {w}"
    n, s = f"(count(ret) {w} - ({edge} IS NOT NULL)::INT)", f"(sum(ret) {w} - coalesce({edge}, 0))"
    q = f"(sum(ret * ret) {w} - coalesce({edge} * {edge}, 0))"
    fill = {"BID": "CASE WHEN bid_size < bid_before THEN (bid_before - bid_size) * best_bid END", "ASK": "CASE WHEN ask_size < ask_before THEN (ask_before - ask_size) * best_ask END"}
    return {
        "PRICE_ABOVE": "best_ask" if side == "ASK" else "best_bid", "PRICE_BELOW": "best_ask" if side == "ASK" else "best_bid", "SPREAD_NARROW": "spread_bps", "SPREAD_WIDE": "spread_bps", "IMBALANCE_BID": "imb", "IMBALANCE_ASK": "-imb",
        "SIZE_SPIKE": "ask_size" if side == "ASK" else "bid_size", "CROSSED_BOOK": "CASE WHEN best_bid >= best_ask THEN best_bid - best_ask END", "EMPTY_BOOK": "CASE WHEN coalesce(bid_size, 0) = 0 AND coalesce(ask_size, 0) = 0 THEN 0e0 END",
        "MICROPRICE_DIVERGENCE": "CASE WHEN mid > 0 THEN abs(micro - mid) / mid * 10000 END", "MID_PRICE_TREND": "run::DOUBLE" if side is None else f"CASE WHEN direction = {1 if side == 'ASK' else -1} THEN run::DOUBLE END", "STALE_QUOTE": "silence_us / 1000",
        "LARGE_FILL": fill[side] if side else f"greatest({fill['BID']}, {fill['ASK']})", "PRICE_MOVE": f"CASE WHEN first_value(mid IGNORE NULLS) {w} > 0 THEN abs(mid - first_value(mid IGNORE NULLS) {w}) / first_value(mid IGNORE NULLS) {w} * 100 END",
        "IMBALANCE_SHIFT": f"abs(imb - ({first_imb}))", "QUOTE_VELOCITY": f"count(*) {w} / {ms / 1000 or 1}",
        "VOLATILITY_SPIKE": f"CASE WHEN {n} >= 2 AND mid IS NOT NULL THEN sqrt(greatest(0, {q} / {n} - ({s} / {n}) * ({s} / {n}))) * 100 END",
    }[kind]


def _fires(kind: str, v: str, t) -> str:
    op = signals.COMPARE[kind]
    return f"{v} IS NOT NULL" if op == "any" else f"{v} {op} {t}"


#: Thresholds at which the derived feed fires: type, threshold, side, window in ms.
SIGNALS = {
    "price_above": ("PRICE_ABOVE", 0.75, "BID", 0), "price_below": ("PRICE_BELOW", 0.25, "BID", 0), "spread_narrow": ("SPREAD_NARROW", 50.0, None, 0), "spread_wide": ("SPREAD_WIDE", 300.0, None, 0),
    "imbalance_bid": ("IMBALANCE_BID", 0.6, None, 0), "imbalance_ask": ("IMBALANCE_ASK", 0.6, None, 0), "size_spike": ("SIZE_SPIKE", 4000.0, "BID", 0), "price_move": ("PRICE_MOVE", 3.0, None, 60_000), "crossed_book": ("CROSSED_BOOK", 0.0, None, 0),
    "empty_book": ("EMPTY_BOOK", 0.0, None, 0), "volatility_spike": ("VOLATILITY_SPIKE", 2.0, None, 60_000), "microprice_divergence": ("MICROPRICE_DIVERGENCE", 50.0, None, 0), "imbalance_shift": ("IMBALANCE_SHIFT", 0.4, None, 30_000),
    "mid_price_trend": ("MID_PRICE_TREND", 3.0, None, 0), "quote_velocity": ("QUOTE_VELOCITY", 0.8, None, 5_000), "stale_quote": ("STALE_QUOTE", 30_000.0, None, 0), "large_fill": ("LARGE_FILL", 1000.0, None, 0),
}

for _name, (_k, _t, _s, _ms) in SIGNALS.items():
    query(sql(f"WITH {PREPARED}, v AS (SELECT event_id, asset_id, source_us, {value_sql(_k, _s, _ms)} AS actual_value FROM p) SELECT event_id, asset_id, source_us, round(actual_value, 6) AS actual_value FROM v WHERE {_fires(_k, 'actual_value', _t)}", "bbo"), _name)(
        lambda spark, d, a=(_k, _t, _s, _ms): rounded(signals.signal(tables.quotes(spark, d), *a))
    )


def _rules_sql(rules) -> str:
    """A row for each firing of each rule, as one union over the prepared rows."""
    cols = ", ".join(f"{value_sql(k, s, w)} AS v{i}" for i, (_, k, _, s, w, _, _) in enumerate(rules))
    parts = " UNION ALL ".join(f"SELECT '{r}' AS rule_id, event_id, asset_id, source_us, v{i} AS actual_value, {cd * 1000} AS wait FROM f WHERE {_fires(k, f'v{i}', t)}" for i, (r, k, t, s, w, cd, _) in enumerate(rules))
    return f"{PREPARED}, f AS (SELECT *, {cols} FROM p), fired AS ({parts})"


def _fired(spark, d, rules):
    return signals.evaluate_rules(tables.quotes(spark, d), signals.rules_table(spark, rules))


_SEEN = f"(count(mid) {_w(60_000)} >= 5 AND count(mid) {_w(10_000)} >= 3)"


def _global_sql() -> str:
    cols = ", ".join(f"{value_sql(k, s, w)} AS v{i}" for i, (k, _, s, w) in enumerate(signals.ALWAYS_ON))
    parts = " UNION ALL ".join(f"SELECT 'global_{k.lower()}' AS rule_id, event_id, asset_id, source_us FROM f WHERE {_fires(k, f'v{i}', t)}" + " AND seen" * (k == "VOLATILITY_SPIKE") for i, (k, t, _, _) in enumerate(signals.ALWAYS_ON))
    return f"WITH {PREPARED}, f AS (SELECT *, {_SEEN} AS seen, {cols} FROM p) {parts}"


@query(sql(greedy_sql(_global_sql(), "asset_id, rule_id", "500000", "rule_id, event_id, asset_id"), "bbo"))
def global_signals(spark, d):
    return signals.global_signals(tables.quotes(spark, d)).select("rule_id", "event_id", "asset_id")


@query(sql(f"WITH {_rules_sql(signals.production_rules())} SELECT rule_id, event_id, asset_id, round(actual_value, 6) AS actual_value FROM fired", "bbo"))
def production_signals(spark, d):
    return rounded(_fired(spark, d, signals.production_rules()).select("rule_id", "event_id", "asset_id", "actual_value"))


def _mixed_rules():
    """Wildcard rules, a rule of each single-asset type for one asset, price
    rules for 50 assets, rules over several assets, and one that is disabled."""
    price = [(f"asset_{a}", "PRICE_ABOVE", 0.3 + a % 40 / 100, "BID" if a % 3 else "ASK", 0, 1000, str(a)) for a in range(0, 150, 3)]
    each = [(f"each_{n}", k, t, s, w, 1000, str(i)) for i, (n, (k, t, s, w)) in enumerate(SIGNALS.items())]
    pairs = [(f"{k.lower()}_{m}", k, t, None, 0, 1000, str(2 * m), str(2 * m + 1)) for m in range(30) for k, t in (("ARBITRAGE_BUY", 0.99), ("ARBITRAGE_SELL", 1.0))]
    sets = [(f"set_{g}", "MULTI_OUTCOME_ARBITRAGE", 1.985, None, 0, 1000, str(4 * g), None, [str(4 * g + i) for i in range(4)]) for g in range(20)]
    off = [("off", "PRICE_ABOVE", 0.0, "BID", 0, 1000, "*", None, None, False)]
    return signals.production_rules() + price + each + pairs + sets + off


_EACH = " UNION ALL ".join(f"SELECT event_id, 'each_{n}' AS rule_id FROM (SELECT event_id, {value_sql(k, s, w)} AS v FROM p WHERE asset_id = '{i}') WHERE {_fires(k, 'v', t)}" for i, (n, (k, t, s, w)) in enumerate(SIGNALS.items()))
PAIRS = """x AS (SELECT *, CASE WHEN asset_id::INT % 2 = 0 THEN last_value(CASE WHEN asset_id::INT % 2 = 1 THEN {u: source_us, b: best_bid, a: best_ask, bs: bid_size, s: ask_size} END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN asset_id::INT % 2 = 0 THEN {u: source_us, b: best_bid, a: best_ask, bs: bid_size, s: ask_size} END IGNORE NULLS) OVER w END AS o
 FROM bbo WINDOW w AS (PARTITION BY condition_id ORDER BY source_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), y AS (SELECT * FROM x WHERE source_us - o.u <= 5000000)"""
SETS = """g AS (SELECT *, (asset_id::INT // 4)::VARCHAR AS group_id FROM bbo), m AS (SELECT group_id, count(DISTINCT asset_id) AS n FROM g GROUP BY 1),
j AS (SELECT t.group_id, t.event_id, t.asset_id, t.source_us, r.asset_id AS other, max_by({a: r.best_ask, s: r.ask_size}, (r.source_us, r.event_id)) AS l FROM g t JOIN g r ON t.group_id = r.group_id AND r.source_us BETWEEN t.source_us - 5000000 AND t.source_us AND (r.source_us, r.event_id) <= (t.source_us, t.event_id) GROUP BY ALL)"""


@query(sql(f"""WITH {_rules_sql(signals.production_rules())}, own AS (SELECT event_id, 'asset_' || asset_id AS rule_id, CASE WHEN asset_id::INT % 3 <> 0 THEN best_bid ELSE best_ask END AS v, 0.3 + (asset_id::INT % 40) / 100 AS t FROM bbo WHERE asset_id::INT % 3 = 0 AND asset_id::INT < 150),
{PAIRS}, {SETS}, sums AS (SELECT group_id, event_id, asset_id, sum(l.a) AS total FROM j GROUP BY ALL HAVING count(l.a) = 4),
every AS (SELECT rule_id, event_id FROM fired UNION ALL SELECT rule_id, event_id FROM own WHERE v > t UNION ALL SELECT rule_id, event_id FROM ({_EACH})
 UNION ALL SELECT 'arbitrage_buy_' || (asset_id::INT // 2), event_id FROM y WHERE asset_id::INT % 2 = 0 AND asset_id::INT < 60 AND best_ask + o.a < 0.99 UNION ALL SELECT 'arbitrage_sell_' || (asset_id::INT // 2), event_id FROM y WHERE asset_id::INT % 2 = 0 AND asset_id::INT < 60 AND best_bid + o.b > 1.0
 UNION ALL SELECT 'set_' || group_id, event_id FROM sums WHERE asset_id::INT % 4 = 0 AND asset_id::INT < 80 AND total < 1.985)
SELECT rule_id, count(*) AS fired, min(event_id) AS first_event FROM every GROUP BY 1""", "bbo"))
def evaluate_rules(spark, d):
    return _fired(spark, d, _mixed_rules()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"), F.min("event_id").alias("first_event"))


_CD = greedy_sql("SELECT asset_id, source_us, event_id FROM bbo WHERE bid_size > 4000", "asset_id", "30000000", "asset_id, source_us, event_id")


@query(sql(_CD, "bbo"))
def apply_cooldown(spark, d):
    fired = signals.signal(tables.quotes(spark, d), "SIZE_SPIKE", 4000.0, "BID").withColumn("rule_id", F.lit("r")).withColumn("cooldown_ms", F.lit(30_000))
    return signals.apply_cooldown(fired).select("asset_id", "source_us", "event_id")


@query(sql("""WITH b AS (SELECT 'own_' || a AS rule_id, a::VARCHAR AS ra, 0.2 + (a % 5) / 10 AS lo, CASE WHEN a % 2 = 0 THEN 0.6 END AS hi FROM range(0, 200) t(a))
SELECT rule_id, count(*) AS n FROM bbo JOIN b ON asset_id = ra WHERE best_bid >= lo AND (hi IS NULL OR best_ask <= hi) AND best_ask IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM bbo WHERE best_bid >= 0.4 AND best_ask IS NOT NULL""", "bbo"))
def rule_prefilter(spark, d):
    own = spark.range(200).selectExpr("concat('own_', id) AS rule_id", "cast(id AS string) AS asset_id", "cast(0.2D + (id % 5) / 10D AS double) AS min_bid", "cast(null AS double) AS max_bid", "cast(null AS double) AS min_ask", "CASE WHEN id % 2 = 0 THEN 0.6D END AS max_ask")
    every = spark.range(1).selectExpr("'all' AS rule_id", "'*' AS asset_id", "0.4D AS min_bid", "cast(null AS double) AS max_bid", "cast(null AS double) AS min_ask", "cast(null AS double) AS max_ask")
    return signals.rule_prefilter(tables.quotes(spark, d), own.unionByName(every)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def _arb_sql(price, size, o_price, o_size, test, gain):
    return sql(f"WITH {PAIRS}, z AS (SELECT *, {price} + o.{o_price} AS total, least(coalesce({size}, 0), coalesce(o.{o_size}, 0)) AS lot FROM y) SELECT event_id, asset_id, condition_id, source_us, round(total, 6) AS total, round(({gain}) * 10000, 6) AS profit_bps, lot AS size, round(lot * total, 6) AS notional, round(lot * ({gain}), 6) AS profit FROM z WHERE total {test}", "bbo")


@query(_arb_sql("best_ask", "ask_size", "a", "s", "< 0.99", "1 - total"))
def arbitrage_buy(spark, d):
    return rounded(signals.arbitrage(tables.quotes(spark, d), True, 0.99))


@query(_arb_sql("best_bid", "bid_size", "b", "bs", "> 1.0", "total - 1"))
def arbitrage_sell(spark, d):
    return rounded(signals.arbitrage(tables.quotes(spark, d), False, 1.0))


@query(sql(f"""WITH {SETS}
SELECT j.group_id, event_id, asset_id, source_us, m.n, round(sum(l.a), 6) AS total, min(coalesce(l.s, 0)) AS size FROM j JOIN m ON j.group_id = m.group_id GROUP BY ALL HAVING count(l.a) = m.n AND sum(l.a) < 1.945""", "bbo"))
def multi_outcome_arbitrage(spark, d):
    ticks = tables.quotes(spark, d)
    groups = ticks.select("asset_id").distinct().withColumn("group_id", F.floor(F.col("asset_id").cast("long") / 4).cast("string"))
    return rounded(signals.multi_outcome_arbitrage(ticks, groups, 1.945))


_KINDS = [*signals.COMPARE, *signals.TOTALS, "NO_SUCH"]
_RULES = f"""SELECT 'r' || lpad(p_partkey::VARCHAR, 9, '0') AS rule_id, ({_KINDS!r})[(p_partkey % {len(_KINDS)} + 1)::INT] AS type, CASE WHEN p_partkey % 13 > 0 THEN 0.5e0 END AS threshold, (['BID', 'ASK', 'UP'])[(p_size % 4 + 1)::INT] AS side,
 CASE WHEN p_size % 5 > 0 THEN p_size * 3000 END AS window_ms, CASE p_size % 7 WHEN 0 THEN 99 WHEN 1 THEN 100 ELSE (p_size - 3) * 100000 END AS cooldown_ms, (p_partkey % 3)::VARCHAR AS asset_id, CASE WHEN p_size % 3 > 0 THEN p_size::VARCHAR END AS counterpart_asset_id, range(p_size % 4) AS outcomes, CASE WHEN p_partkey % 17 = 0 THEN 'equity' ELSE 'prediction' END AS market_type FROM part"""


@query(f"""WITH r AS ({_RULES}), e AS (SELECT rule_id, list_filter([
 CASE WHEN type = 'NO_SUCH' THEN 'unknown type' END, CASE WHEN type IN ('ARBITRAGE_BUY', 'ARBITRAGE_SELL', 'MULTI_OUTCOME_ARBITRAGE') AND market_type <> 'prediction' THEN 'not for this market type' END, CASE WHEN threshold IS NULL THEN 'threshold missing' END,
 CASE WHEN type IN ('PRICE_ABOVE', 'PRICE_BELOW', 'SIZE_SPIKE') AND coalesce(side, '') NOT IN ('BID', 'ASK') THEN 'side must be BID or ASK' END, CASE WHEN type IN ('MID_PRICE_TREND', 'LARGE_FILL') AND side NOT IN ('BID', 'ASK') THEN 'side must be BID or ASK if given' END,
 CASE WHEN type IN ('PRICE_MOVE', 'VOLATILITY_SPIKE', 'IMBALANCE_SHIFT', 'QUOTE_VELOCITY') AND coalesce(window_ms, 0) <= 0 THEN 'window missing' END, CASE WHEN type IN ('PRICE_MOVE', 'VOLATILITY_SPIKE') AND window_ms > 60000 THEN 'window over 60 s' END,
 CASE WHEN type LIKE 'ARBITRAGE%' AND counterpart_asset_id IS NULL THEN 'counterpart missing' END, CASE WHEN type = 'MULTI_OUTCOME_ARBITRAGE' AND len(outcomes) < 2 THEN 'outcomes missing' END, CASE WHEN cooldown_ms < 100 OR cooldown_ms > 3600000 THEN 'cooldown out of bounds' END,
 CASE WHEN row_number() OVER (PARTITION BY asset_id ORDER BY rule_id) > 50 THEN 'too many rules for the asset' END], lambda x: x IS NOT NULL) AS errors FROM r) SELECT rule_id, len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors FROM e""")
def validate_rules(spark, d):
    kinds = ", ".join(f"'{k}'" for k in _KINDS)
    rules = tables.read(spark, d, "part").selectExpr(
        "concat('r', lpad(p_partkey, 9, '0')) AS rule_id", f"element_at(array({kinds}), cast(p_partkey % {len(_KINDS)} + 1 AS int)) AS type", "CASE WHEN p_partkey % 13 > 0 THEN 0.5D END AS threshold", "get(array('BID', 'ASK', 'UP'), cast(p_size % 4 AS int)) AS side",
        "CASE WHEN p_size % 5 > 0 THEN p_size * 3000 END AS window_ms", "CASE p_size % 7 WHEN 0 THEN 99 WHEN 1 THEN 100 ELSE (p_size - 3) * 100000 END AS cooldown_ms", "cast(p_partkey % 3 AS string) AS asset_id", "CASE WHEN p_size % 3 > 0 THEN cast(p_size AS string) END AS counterpart_asset_id",
        "slice(array('a', 'b', 'c'), 1, cast(p_size % 4 AS int)) AS outcome_asset_ids", "CASE WHEN p_partkey % 17 = 0 THEN 'equity' ELSE 'prediction' END AS market_type",
    )
    return signals.validate_rules(rules).select("rule_id", "valid", F.array_join("errors", "; ").alias("errors"))


_TYPES = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{k}'" for r, k, *_ in signals.production_rules()) + " END"


@query(sql(f"WITH {_rules_sql(signals.production_rules())}, t AS (SELECT *, {_TYPES} AS type FROM fired), c AS (SELECT type, count(*) AS of_type FROM t GROUP BY 1), r AS (SELECT * FROM t ORDER BY source_us DESC, event_id DESC, rule_id LIMIT 500) SELECT rule_id, event_id, asset_id, type, of_type, (SELECT count(*) FROM t) AS buffered FROM r JOIN c USING (type) WHERE type = 'SPREAD_WIDE'", "bbo"))
def event_feed(spark, d):
    return signals.event_feed(_fired(spark, d, signals.production_rules()), 500, "SPREAD_WIDE").select("rule_id", "event_id", "asset_id", "type", "of_type", "buffered")


_LAT = """f AS (SELECT event_id, source_us, ingestion_us - source_us AS latency_us, asset_id::INT % 25 AS shard FROM bbo WHERE spread_bps > 300),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY shard ORDER BY source_us DESC, event_id DESC) <= 1000), g AS (SELECT shard, list(latency_us ORDER BY latency_us) AS l, avg(latency_us) AS mean FROM l GROUP BY 1),
s AS (SELECT shard, len(l) AS n, l[least(len(l), floor(len(l) * 0.5)::INT + 1)] AS p50, l[least(len(l), floor(len(l) * 0.95)::INT + 1)] AS p95, l[least(len(l), floor(len(l) * 0.99)::INT + 1)] AS p99, round(mean, 6) AS mean, l[1] AS low, l[-1] AS high FROM g)"""


def _latencies(spark, d):
    wide = tables.quotes(spark, d).where("spread_bps > 300").withColumn("latency_us", F.col("ingestion_us") - F.col("source_us"))
    return signals.event_latency(wide, F.col("asset_id").cast("long") % 25)


@query(sql(f"WITH {_LAT} SELECT * FROM s", "bbo"))
def event_latency_stats(spark, d):
    return rounded(_latencies(spark, d))


@query(sql(f"WITH {_LAT}, r AS (SELECT count(*) AS shards, sum(n)::BIGINT AS n, sum(p50 * n) / sum(n) AS p50, sum(p95 * n) / sum(n) AS p95, sum(p99 * n) / sum(n) AS p99 FROM s) SELECT shards, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, CASE WHEN p95 > 15000 OR shards < 20 THEN 'critical' WHEN p95 > 5000 OR shards < 24 THEN 'degraded' ELSE 'healthy' END AS status FROM r", "bbo"))
def fleet_latency_rollup(spark, d):
    return rounded(signals.fleet_rollup(_latencies(spark, d)))
