"""Queries over markets, fills and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import fills, markets, usage
from tidebook.plans.base_sql import sql
from tidebook.plans.registry import feed_end, query, rounded
from tidebook.sources import tables

_NOW = "(SELECT max(source_us) FROM bbo)"
_TOK = "id, condition_id, question, category, end_us, asset_id"


def _tokens(spark, d):
    return markets.market_tokens(tables.metadata(spark, d))


@query(sql("SELECT id, condition_id, pos, asset_id FROM tokens", "tokens"))
def market_tokens(spark, d):
    return _tokens(spark, d).select("id", "condition_id", "pos", "asset_id")


@query(sql(f"""WITH a AS (SELECT asset_id, count(*) AS tick_count FROM bbo WHERE source_us > {_NOW} - 86400000000 GROUP BY 1),
r AS (SELECT t.asset_id, t.condition_id, t.end_us, coalesce(a.tick_count, 0) AS tick_count, count(*) OVER () AS total FROM tokens t LEFT JOIN a USING (asset_id) WHERE t.end_us > {_NOW})
SELECT *, total > 75 AS has_more FROM r ORDER BY tick_count DESC, end_us, asset_id LIMIT 50 OFFSET 25""", "bbo", "tokens"))
def list_markets(spark, d):
    ticks = tables.quotes(spark, d)
    page = markets.list_markets(_tokens(spark, d), ticks, feed_end(ticks), 50, 25, active=True)
    return page.select("asset_id", "condition_id", "end_us", "tick_count", "total", "has_more")


@query(sql(f"SELECT {_TOK} FROM tokens WHERE contains(lower(question), 'ring') AND end_us > {_NOW} ORDER BY end_us, asset_id LIMIT 50", "bbo", "tokens"))
def search_markets(spark, d):
    return markets.search_markets(_tokens(spark, d), "RING", feed_end(tables.quotes(spark, d)), 50).select("id", "condition_id", "question", "category", "end_us", "asset_id")


@query(sql(f"SELECT t.asset_id, t.condition_id, a.tick_count FROM tokens t JOIN (SELECT asset_id, count(*) AS tick_count FROM bbo WHERE source_us > {_NOW} - 600000000 GROUP BY 1) a USING (asset_id) WHERE t.end_us > {_NOW} ORDER BY tick_count DESC, asset_id LIMIT 1", "bbo", "tokens"))
def top_activity_market(spark, d):
    ticks = tables.quotes(spark, d)
    return markets.top_activity_market(_tokens(spark, d), ticks, feed_end(ticks)).select("asset_id", "condition_id", "tick_count")


@query(sql(f"""WITH s AS (SELECT asset_id, arg_max([best_bid, best_ask], (source_us, event_id)) AS l, count_if(source_us > {_NOW} - 86400000000) AS ticks_24h, max(CASE WHEN source_us > {_NOW} - 86400000000 THEN best_bid END) AS high_24h, min(CASE WHEN source_us > {_NOW} - 86400000000 THEN best_bid END) AS low_24h FROM bbo GROUP BY 1)
SELECT t.asset_id, t.condition_id, t.question, t.category, t.end_us, l[1] AS best_bid, l[2] AS best_ask, ticks_24h, high_24h, low_24h FROM tokens t JOIN s USING (asset_id)""", "bbo", "tokens"))
def market_detail(spark, d):
    ticks = tables.quotes(spark, d)
    return markets.market_detail(_tokens(spark, d), ticks, feed_end(ticks))


@query(sql("SELECT asset_id, source_us, best_bid, best_ask, bid_size, ask_size FROM bbo QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY source_us DESC, event_id DESC) = 1", "bbo"))
def latest_bbo(spark, d):
    return markets.latest_bbo(tables.quotes(spark, d))


@query(sql("SELECT event_id, source_us, sequence_number, best_bid, best_ask FROM bbo WHERE asset_id = '42' AND source_us BETWEEN 1704067200000000 AND 1704070800000000 ORDER BY source_us, sequence_number LIMIT 10000", "bbo"))
def export_ticks(spark, d):
    return markets.export_ticks(tables.quotes(spark, d), "42", tables.START_US, tables.START_US + 3_600_000_000, 10_000).select("event_id", "source_us", "sequence_number", "best_bid", "best_ask")


def _bars_sql(width: int) -> str:
    edge = lambda c, n: f"round((list({c} ORDER BY source_us, event_id))[1], 6) AS open_{n}, round((list({c} ORDER BY source_us, event_id))[-1], 6) AS close_{n}"
    return sql(f"""SELECT asset_id, source_us // {width} * {width} AS bar_us, {edge('best_bid', 'bid')}, {edge('best_ask', 'ask')}, {edge('(best_bid + best_ask) / 2', 'mid')},
      round(avg(spread_bps), 6) AS avg_spread_bps, count(*) AS ticks, min(sequence_number) AS seq_start, max(sequence_number) AS seq_end FROM bbo GROUP BY 1, 2""", "bbo")


for _label, _width in (("1m", 60_000_000), ("5m", 300_000_000), ("1h", 3_600_000_000)):
    query(_bars_sql(_width), f"ohlc_bars_{_label}")(lambda spark, d, w=_width: rounded(markets.ohlc_bars(tables.quotes(spark, d), w)))


@query(sql("SELECT asset_id, source_us // 86400000000 * 86400000000 AS bar_us, max(best_bid) AS high, min(best_bid) AS low FROM bbo GROUP BY 1, 2", "bbo"))
def ohlc_high_low(spark, d):
    return markets.ohlc_high_low(tables.quotes(spark, d), markets.DAY_US)


@query(sql("SELECT asset_id, count(*) AS ticks, min(source_us) AS first_us, max(source_us) AS last_us, count(DISTINCT source_us // 86400000000) AS days FROM bbo GROUP BY 1 HAVING count(*) >= 50 ORDER BY ticks DESC, asset_id LIMIT 100", "bbo"))
def backtest_assets(spark, d):
    return markets.backtest_assets(tables.quotes(spark, d), 50, 100)


@query(sql("""SELECT asset_id, count(*) AS ticks, min(source_us) AS first_us, max(source_us) AS last_us, round(quantile_cont((ingestion_us - source_us) / 1000, 0.5), 6) AS p50, round(quantile_cont((ingestion_us - source_us) / 1000, 0.95), 6) AS p95, round(quantile_cont((ingestion_us - source_us) / 1000, 0.99), 6) AS p99, count_if(is_resync) AS resyncs,
 min(sequence_number) AS seq_min, max(sequence_number) AS seq_max, count(DISTINCT sequence_number) AS seq_unique, round(1 - count(DISTINCT sequence_number) / (max(sequence_number) - min(sequence_number) + 1), 6) AS gap_ratio FROM bbo GROUP BY 1""", "bbo"))
def asset_quality(spark, d):
    return rounded(markets.asset_quality(tables.quotes(spark, d)))


@query(sql("""WITH r AS (SELECT source_us, ingestion_us, 'bbo' AS kind FROM bbo UNION ALL SELECT source_us, ingestion_us, 'trade' FROM trades)
SELECT source_us // 3600000000 * 3600000000 AS hour_us, kind, count(*) AS n, round(quantile_cont((ingestion_us - source_us) / 1000, 0.5), 6) AS p50, round(quantile_cont((ingestion_us - source_us) / 1000, 0.95), 6) AS p95, round(quantile_cont((ingestion_us - source_us) / 1000, 0.99), 6) AS p99 FROM r GROUP BY 1, 2""", "bbo", "trades"))
def hourly_latency_stats(spark, d):
    pick = lambda t, kind: t.select("source_us", "ingestion_us", F.lit(kind).alias("kind"))
    return rounded(markets.hourly_latency_stats(pick(tables.quotes(spark, d), "bbo").unionByName(pick(tables.trades(spark, d), "trade"))))


@query(sql(f"SELECT asset_id, condition_id, end_us < {_NOW} AS ended, neg_risk, 0.01e0 AS tick_size FROM tokens", "tokens", "bbo"))
def ended_markets(spark, d):
    return markets.ended_markets(_tokens(spark, d), feed_end(tables.quotes(spark, d)))


@query(sql("""WITH n AS (SELECT id, CASE WHEN k % 3 = 0 THEN 'RESOLVED' ELSE 'NEW_MARKET' END AS event, inserted_us - (k % 10) * 86400000000 AS notified_us FROM meta WHERE k % 2 = 0),
c AS (SELECT id, condition_id, 'NEW_MARKET' AS event, 7 * 86400000000 AS ttl FROM meta WHERE active AND NOT closed UNION ALL SELECT id, condition_id, 'RESOLVED', 86400000000 FROM meta WHERE closed)
SELECT id, condition_id, event FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = c.id AND n.event = c.event AND n.notified_us > 1704067200000000 - c.ttl)""", "meta"))
def lifecycle_events(spark, d):
    meta = tables.metadata(spark, d)
    told = meta.where("k % 2 = 0").selectExpr("id", "CASE WHEN k % 3 = 0 THEN 'RESOLVED' ELSE 'NEW_MARKET' END AS event", "inserted_us - (k % 10) * 86400000000 AS notified_us")
    return markets.lifecycle_events(meta, told, tables.START_US)


@query(sql("SELECT id, condition_id, trim(question) AS question, category, neg_risk::INT AS neg_risk, active::INT AS active, closed::INT AS closed, inserted_us FROM meta", "meta"))
def upsert_metadata(spark, d):
    return markets.upsert_metadata(tables.metadata_versions(spark, d)).select("id", "condition_id", "question", "category", "neg_risk", "active", "closed", "inserted_us")


@query(sql("""WITH e AS (SELECT id AS market_id, inserted_us, unnest(['e' || (k % 50), 'g' || (k % 7)]) AS event_id, question AS title FROM metav)
SELECT market_id, inserted_us, event_id, title FROM e QUALIFY row_number() OVER (PARTITION BY event_id, market_id ORDER BY inserted_us DESC) = 1""", "metav"))
def explode_market_events(spark, d):
    rows = tables.metadata_versions(spark, d).selectExpr("id", "inserted_us", "array(named_struct('event_id', concat('e', k % 50), 'title', question), named_struct('event_id', concat('g', k % 7), 'title', question)) AS events")
    return markets.explode_market_events(rows)


# --- fills


def _trades(spark, d):
    return fills.fills_to_trades(tables.fills(spark, d))


@query(sql("SELECT id, maker, taker, asset_id, shares, usdc, side, fee, us, round(CASE WHEN shares > 0 THEN usdc / shares END, 6) AS price FROM fill_trades", "fill_trades"))
def fills_to_trades(spark, d):
    return _trades(spark, d).withColumn("price", F.round("price", 6))


for _user in ("maker", "taker"):
    query(sql(f"SELECT {_user}, asset_id, us // 60000000 * 60000000 AS minute_us, count(*) AS trades, round(sum(usdc), 6) AS usdc FROM fill_trades GROUP BY 1, 2, 3", "fill_trades"), f"{_user}_minute_rollup")(
        lambda spark, d, u=_user: rounded(fills.user_minute_rollup(_trades(spark, d), u))
    )

_MARKET_SUMS = "count(*) AS trades, count_if(side = 'BUY') AS buys, count_if(side = 'SELL') AS sells, round(sum(usdc), 6) AS usdc, round(sum(shares), 6) AS shares, round(sum(fee), 6) AS fees"


@query(sql(f"SELECT asset_id, us // 60000000 * 60000000 AS minute_us, {_MARKET_SUMS} FROM fill_trades GROUP BY 1, 2", "fill_trades"))
def market_minute_rollup(spark, d):
    return rounded(fills.market_minute_rollup(_trades(spark, d)))


@query(sql(f"SELECT asset_id, us // 3600000000 * 3600000000 AS hour_us, {_MARKET_SUMS} FROM fill_trades GROUP BY 1, 2", "fill_trades"))
def rollup_merge(spark, d):
    minutes = fills.market_minute_rollup(_trades(spark, d)).withColumn("hour_us", F.floor(F.col("minute_us") / 3_600_000_000) * 3_600_000_000).drop("minute_us")
    return rounded(fills.rollup_merge(minutes, ["asset_id", "hour_us"]))


# --- usage

_KIND = "CASE WHEN method IN ('POST', 'PUT', 'DELETE') OR (endpoint LIKE '%/triggers%' AND endpoint NOT LIKE '%/events%') THEN 'admin' ELSE 'data' END AS kind"
_MAX = "CASE tier WHEN 'free' THEN CASE kind WHEN 'data' THEN 60 ELSE 15 END WHEN 'pro' THEN CASE kind WHEN 'data' THEN 120 ELSE 30 END ELSE CASE kind WHEN 'data' THEN 600 ELSE 120 END END"


@query(sql("SELECT api_key_hash, tier, endpoint, strftime(make_timestamp(us), '%Y-%m') AS billing_cycle, count(*) AS requests, sum(rows_returned)::BIGINT AS rows FROM usage GROUP BY 1, 2, 3, 4", "usage"))
def usage_by_cycle(spark, d):
    return usage.usage_by_cycle(tables.usage(spark, d))


@query(sql(f"WITH u AS (SELECT *, {_KIND} FROM usage), c AS (SELECT api_key_hash, tier, kind, us // 60000000 * 60000000 AS minute_us, count(*) AS calls FROM u GROUP BY ALL), m AS (SELECT *, {_MAX} AS max_calls FROM c) SELECT *, greatest(0, max_calls - calls) AS remaining, greatest(0, calls - max_calls) AS over FROM m", "usage"))
def rate_limit_breaches(spark, d):
    return usage.rate_limit_breaches(tables.usage(spark, d))


@query(sql(f"WITH u AS (SELECT *, {_KIND} FROM usage), n AS (SELECT *, row_number() OVER (PARTITION BY api_key_hash, kind, us // 60000000 ORDER BY us, request_id) AS nth FROM u) SELECT request_id, api_key_hash, kind, nth FROM n WHERE nth > {_MAX}", "usage"))
def rejected_calls(spark, d):
    return usage.rejected_calls(tables.usage(spark, d)).select("request_id", "api_key_hash", "kind", "nth")
