"""Queries over the ingest and integrity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import new_path
from tidebook.operators import ingest, integrity
from tidebook.plans.base_sql import sql
from tidebook.plans.registry import as_text, feed_end, query, rounded
from tidebook.sources import tables

_BBO_W = "OVER (PARTITION BY asset_id ORDER BY source_us, event_id)"
_J = "json_extract_string"
_KIND = """SELECT *, CASE json_extract_string(j, '$.event_type') WHEN 'price_change' THEN 'price_change' WHEN 'last_trade_price' THEN 'trade' WHEN 'tick_size_change' THEN 'tick_size' WHEN 'book' THEN 'book'
  ELSE CASE WHEN json_extract(j, '$.bids') IS NOT NULL AND json_extract(j, '$.asks') IS NOT NULL THEN 'book' ELSE 'unknown' END END AS kind
  FROM (SELECT event_id, us, CASE WHEN value LIKE '[%' THEN json_extract(value, '$[0]') ELSE value::JSON END AS j FROM raw WHERE value LIKE '[%' OR (value LIKE '{%' AND json_valid(value)))"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return ingest.parse_raw_events(tables.raw_messages(spark, d))


@query(sql(f"WITH p AS ({_KIND}) SELECT event_id, kind, coalesce({_J}(j, '$.asset_id'), '') AS asset_id, {_J}(j, '$.market') AS condition_id, {_J}(j, '$.timestamp')::BIGINT AS ts_ms FROM p", "raw"))
def parse_raw_events(spark, d):
    return _parsed(spark, d).select("event_id", "kind", F.coalesce("msg.asset_id", F.lit("")).alias("asset_id"), F.col("msg.market").alias("condition_id"), F.col("msg.timestamp").cast("long").alias("ts_ms"))


@query(sql(f"WITH p AS ({_KIND}) SELECT kind, count(*) AS n FROM p GROUP BY kind", "raw"))
def event_type_counts(spark, d):
    return _parsed(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(sql(f"""WITH p AS ({_KIND}), b AS (SELECT event_id, j, from_json(json_extract(j, '$.bids'), '[{{"price":"DOUBLE","size":"DOUBLE"}}]') AS bids, from_json(json_extract(j, '$.asks'), '[{{"price":"DOUBLE","size":"DOUBLE"}}]') AS asks FROM p WHERE kind = 'book'),
c AS (SELECT *, list_sort(bids)[-1] AS bid, list_sort(asks)[1] AS ask FROM b)
SELECT event_id, {_J}(j, '$.asset_id') AS asset_id, {_J}(j, '$.market') AS condition_id, {_J}(j, '$.timestamp')::BIGINT * 1000 AS source_us, {_J}(j, '$.hash') AS book_hash,
 bid.price AS best_bid, ask.price AS best_ask, bid.size AS bid_size, ask.size AS ask_size, round((ask.price - bid.price) / ((bid.price + ask.price) / 2) * 10000, 6) AS spread_bps FROM c""", "raw"))
def book_to_bbo(spark, d):
    return rounded(ingest.book_to_bbo(_parsed(spark, d)))


@query(sql(f"""WITH p AS ({_KIND}), b AS (SELECT event_id, j, from_json(json_extract(j, '$.bids'), '[{{"price":"DOUBLE","size":"DOUBLE"}}]') AS bids, from_json(json_extract(j, '$.asks'), '[{{"price":"DOUBLE","size":"DOUBLE"}}]') AS asks FROM p WHERE kind = 'book')
SELECT event_id, {_J}(j, '$.asset_id') AS asset_id, {_J}(j, '$.market') AS condition_id, list_aggregate(list_transform(list_sort(bids), lambda x: x.price), 'string_agg', ',') AS bid_prices, list_aggregate(list_transform(list_sort(bids), lambda x: x.size), 'string_agg', ',') AS bid_sizes,
 list_aggregate(list_transform(list_reverse_sort(asks), lambda x: x.price), 'string_agg', ',') AS ask_prices, list_aggregate(list_transform(list_reverse_sort(asks), lambda x: x.size), 'string_agg', ',') AS ask_sizes FROM b""", "raw"))
def book_to_l2(spark, d):
    rows = ingest.book_to_l2(_parsed(spark, d))
    return rows.select("event_id", "asset_id", "condition_id", *[as_text(F.col(c)).alias(c) for c in ("bid_prices", "bid_sizes", "ask_prices", "ask_sizes")])


@query(sql(f"""WITH p AS ({_KIND}), c AS (SELECT event_id, j, unnest(from_json(json_extract(j, '$.price_changes'), '[{{"asset_id":"VARCHAR","side":"VARCHAR","price":"DOUBLE","size":"DOUBLE"}}]')) AS c, generate_subscripts(from_json(json_extract(j, '$.price_changes'), '["JSON"]'), 1) - 1 AS pos FROM p WHERE kind = 'price_change')
SELECT event_id, pos, {_J}(j, '$.market') AS condition_id, {_J}(j, '$.timestamp')::BIGINT * 1000 AS source_us, c.asset_id, c.side, c.price, c.size AS new_size, CASE WHEN c.size = 0 THEN 'REMOVE' ELSE 'ADD' END AS change_type FROM c""", "raw"))
def explode_price_changes(spark, d):
    return ingest.explode_price_changes(_parsed(spark, d))


@query(sql("SELECT event_id, asset_id, side, price, old_size, new_size, size_delta, change_type FROM levels", "levels"))
def classify_level_changes(spark, d):
    return ingest.classify_level_changes(tables.raw_levels(spark, d)).select("event_id", "asset_id", "side", "price", "old_size", "new_size", "size_delta", "change_type")


@query(sql(f"""WITH p AS ({_KIND}), t AS (SELECT event_id, {_J}(j, '$.asset_id') AS asset_id, {_J}(j, '$.market') AS condition_id, {_J}(j, '$.timestamp') AS ts, {_J}(j, '$.price') AS p, {_J}(j, '$.size') AS s, {_J}(j, '$.side') AS side FROM p WHERE kind = 'trade')
SELECT event_id, md5(asset_id || '|' || ts || '|' || p || '|' || s || '|' || side) AS trade_id, asset_id, condition_id, ts::BIGINT * 1000 AS source_us, p::DOUBLE AS price, s::DOUBLE AS size, side, round(p::DOUBLE * s::DOUBLE, 6) AS notional FROM t""", "raw"))
def normalize_trades(spark, d):
    return rounded(ingest.normalize_trades(_parsed(spark, d)))


@query(sql("""WITH c AS (SELECT asset_id, us AS source_us, CASE WHEN v % 2 = 0 THEN 0.001e0 ELSE 0.01e0 END AS new_tick_size FROM q0 WHERE event_type = 'signup')
SELECT b.event_id, b.asset_id, coalesce(c.new_tick_size, 0.01e0) AS effective_tick_size FROM bbo b ASOF LEFT JOIN c ON b.asset_id = c.asset_id AND b.source_us >= c.source_us""", "q0", "bbo"))
def tick_size_asof(spark, d):
    parsed = _parsed(spark, d).where("kind = 'tick_size'")
    changes = parsed.select(F.col("msg.asset_id").alias("asset_id"), F.col("us").alias("source_us"), F.col("msg.new_tick_size").cast("double").alias("new_tick_size"))
    return ingest.tick_size_asof(tables.quotes(spark, d).select("event_id", "asset_id", "source_us"), changes).drop("source_us")


_AT = "(SELECT max(source_us) - 20000000 FROM bbo)"
_LIVE = f"""WITH cut AS (SELECT {_AT} AS t),
s AS (SELECT asset_id, max_by(snaps, (source_us, event_id)) AS s FROM snaps, cut WHERE source_us <= t GROUP BY asset_id),
b AS (SELECT asset_id, 'BUY' AS side, unnest(s.bid_prices) AS price, unnest(s.bid_sizes) AS size, s.source_us AS source_us, -1 AS event_id FROM s UNION ALL SELECT asset_id, 'SELL', unnest(s.ask_prices), unnest(s.ask_sizes), s.source_us, -1 FROM s),
b1 AS (SELECT asset_id, side, price, max(size) AS size, source_us, event_id FROM b GROUP BY ALL),
l AS (SELECT r.asset_id, r.side, r.price, r.new_size AS size, r.source_us, r.event_id FROM rawlev r JOIN s USING (asset_id), cut WHERE r.source_us > s.s.source_us AND r.source_us <= t),
live AS (SELECT asset_id, side, price, max_by(size, (source_us, event_id)) AS size FROM (SELECT * FROM b1 UNION ALL SELECT * FROM l) GROUP BY ALL HAVING max_by(size, (source_us, event_id)) > 0)"""


def _live(spark, d):
    at = feed_end(tables.quotes(spark, d)) - 20_000_000
    return ingest.book_levels_at(tables.snapshots(spark, d), tables.raw_levels(spark, d), at)


@query(sql(f"{_LIVE} SELECT * FROM live", "bbo", "snaps", "rawlev"))
def reconstruct_book(spark, d):
    return _live(spark, d)


@query(sql(f"""{_LIVE}, g AS (SELECT asset_id, coalesce(list(price ORDER BY price DESC) FILTER (side = 'BUY'), []) AS bp, coalesce(list(size ORDER BY price DESC) FILTER (side = 'BUY'), []) AS bs, coalesce(list(price ORDER BY price) FILTER (side = 'SELL'), []) AS ap, coalesce(list(size ORDER BY price) FILTER (side = 'SELL'), []) AS az, sum(size) AS depth FROM live GROUP BY asset_id)
SELECT asset_id, array_to_string(bp, ',') AS bid_prices, array_to_string(bs, ',') AS bid_sizes, array_to_string(ap, ',') AS ask_prices, array_to_string(az, ',') AS ask_sizes, depth, round((ap[1] - bp[1]) / ((bp[1] + ap[1]) / 2) * 10000) AS spread_bps FROM g""", "bbo", "snaps", "rawlev"))
def book_snapshot(spark, d):
    rows = ingest.book_snapshot(_live(spark, d))
    side = lambda c, f: as_text(F.transform(c, lambda x: x[f])).alias(f"{c[:3]}_{f}s")
    return rows.select("asset_id", side("bids", "price"), side("bids", "size"), side("asks", "price"), side("asks", "size"), "depth", "spread_bps")


#: The book of each part of an asset's history, which starts at a snapshot, as of each of the part's events.
_BOOKS = """x AS (SELECT asset_id, source_us, event_id, true AS snap FROM snaps UNION ALL SELECT asset_id, source_us, event_id, false FROM rawlev),
v AS (SELECT * FROM (SELECT *, count_if(snap) OVER (PARTITION BY asset_id ORDER BY source_us, event_id) AS part FROM x) WHERE part > 0),
lv AS (SELECT v.asset_id, v.part, v.source_us, v.event_id, 'BUY' AS side, unnest(bid_prices) AS price, unnest(bid_sizes) AS size FROM v JOIN snaps s ON v.snap AND s.asset_id = v.asset_id AND s.source_us = v.source_us AND s.event_id = v.event_id
 UNION ALL SELECT v.asset_id, v.part, v.source_us, v.event_id, 'SELL', unnest(ask_prices), unnest(ask_sizes) FROM v JOIN snaps s ON v.snap AND s.asset_id = v.asset_id AND s.source_us = v.source_us AND s.event_id = v.event_id
 UNION ALL SELECT v.asset_id, v.part, v.source_us, v.event_id, side, price, new_size FROM v JOIN rawlev r ON NOT v.snap AND r.asset_id = v.asset_id AND r.source_us = v.source_us AND r.event_id = v.event_id),
l1 AS (SELECT asset_id, part, source_us, event_id, side, price, last(size) AS size FROM lv GROUP BY 1, 2, 3, 4, 5, 6),
st AS (SELECT v.asset_id, v.source_us, v.event_id, l.side, l.price, max_by(l.size, (l.source_us, l.event_id)) AS size FROM v LEFT JOIN l1 l ON l.asset_id = v.asset_id AND l.part = v.part AND (l.source_us, l.event_id) <= (v.source_us, v.event_id) GROUP BY 1, 2, 3, 4, 5)"""


@query(sql(f"WITH {_BOOKS} SELECT asset_id, source_us, event_id, max(price) FILTER (side = 'BUY' AND size > 0) AS best_bid, min(price) FILTER (side = 'SELL' AND size > 0) AS best_ask, max_by(size, price) FILTER (side = 'BUY' AND size > 0) AS bid_size, min_by(size, price) FILTER (side = 'SELL' AND size > 0) AS ask_size FROM st GROUP BY 1, 2, 3", "snaps", "rawlev"))
def reconstruct_bbo_series(spark, d):
    return ingest.reconstruct_bbo_series(tables.snapshots(spark, d), tables.raw_levels(spark, d))


@query(sql("""WITH f AS (SELECT asset_id, min(source_us) AS first_delta, count(*) AS n FROM rawlev GROUP BY 1), b AS (SELECT asset_id, min(source_us) AS first_book FROM snaps GROUP BY 1)
SELECT f.asset_id, first_delta, n, first_book, (first_book IS NULL OR first_book - first_delta > 30000000) AS missing FROM f LEFT JOIN b USING (asset_id) WHERE first_book IS NULL OR first_delta < first_book""", "rawlev", "snaps"))
def missing_initial_book(spark, d):
    return ingest.missing_initial_book(tables.snapshots(spark, d), tables.raw_levels(spark, d))


@query(sql(f"""SELECT event_id, asset_id, best_bid, best_ask FROM (SELECT *, row_number() {_BBO_W} AS rn, lag(best_bid) {_BBO_W} AS pb, lag(best_ask) {_BBO_W} AS pa FROM bbo) WHERE rn = 1 OR pb IS DISTINCT FROM best_bid OR pa IS DISTINCT FROM best_ask""", "bbo"))
def suppress_unchanged_quotes(spark, d):
    return ingest.suppress_unchanged_quotes(tables.quotes(spark, d)).select("event_id", "asset_id", "best_bid", "best_ask")


@query(sql(f"""SELECT asset_id, source_us, event_id, ph AS old_hash, book_hash AS new_hash, source_us - pu AS gap_us FROM (SELECT *, lag(book_hash) {_BBO_W} AS ph, lag(source_us) {_BBO_W} AS pu FROM snaps) WHERE ph <> book_hash""", "snaps"))
def detect_resync(spark, d):
    return ingest.detect_resync(tables.snapshots(spark, d))


#: A greedy choice in time order: the next kept row is the first one late enough.
def greedy_sql(rows: str, keys: str, wait: str, out: str) -> str:
    k = [x.strip() for x in keys.split(",")]
    same = " AND ".join(f"n.{x} IS NOT DISTINCT FROM p.{x}" for x in k)
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY source_us, event_id) AS rn FROM ({rows})),
g AS (SELECT {keys}, list(source_us ORDER BY rn) AS t, list(event_id ORDER BY rn) AS e FROM r GROUP BY {keys}),
kept AS (SELECT {", ".join("g." + x for x in k)}, t, e, 1::BIGINT AS i FROM g UNION ALL
  SELECT {", ".join("p." + x for x in k)}, t, e, p.i + list_position(list_transform(t[p.i + 1 :], lambda x: x - t[p.i] >= {wait}), true) AS i FROM kept p WHERE list_position(list_transform(t[p.i + 1 :], lambda x: x - t[p.i] >= {wait}), true) > 0)
SELECT {out} FROM (SELECT {keys}, t[i] AS source_us, e[i] AS event_id FROM kept)"""


@query(sql(greedy_sql("SELECT asset_id, source_us, event_id FROM snaps", "asset_id", "1800000000", "asset_id, source_us, event_id"), "snaps"))
def periodic_l2_sample(spark, d):
    return ingest.periodic_sample(tables.snapshots(spark, d).select("asset_id", "source_us", "event_id"))


@query(sql("""SELECT event_id, asset_id, round((best_bid + best_ask) / 2, 6) AS mid, round(best_ask - best_bid, 6) AS spread, round(spread_bps, 6) AS spread_bps, round(CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END, 6) AS imbalance,
 round(CASE WHEN bid_size + ask_size > 0 THEN (best_bid * ask_size + best_ask * bid_size) / (bid_size + ask_size) END, 6) AS microprice, (ingestion_us - source_us) / 1000 AS latency_ms FROM bbo""", "bbo"))
def derive_bbo_columns(spark, d):
    return rounded(ingest.derive_bbo_columns(tables.quotes(spark, d)).select("event_id", "asset_id", "mid", "spread", "spread_bps", "imbalance", "microprice", "latency_ms"))


@query(sql("""SELECT event_id, asset_id, b AS bid_depth, a AS ask_depth, 5 AS bid_levels, 5 AS ask_levels, round(CASE WHEN a + b > 0 THEN (b - a) / (a + b) ELSE 0 END, 6) AS book_imbalance FROM (SELECT *, list_sum(bid_sizes) AS b, list_sum(ask_sizes) AS a FROM snaps)""", "snaps"))
def derive_l2_columns(spark, d):
    return rounded(ingest.derive_l2_columns(tables.snapshots(spark, d)).select("event_id", "asset_id", "bid_depth", "ask_depth", "bid_levels", "ask_levels", "book_imbalance"))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN p_type ELSE 'exchange' END AS market_source, CASE WHEN p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') THEN p_brand ELSE 'prediction' END AS market_type FROM part""")
def normalize_market_info(spark, d):
    rows = tables.read(spark, d, "part").selectExpr("p_partkey", "p_type AS market_source", "p_brand AS market_type")
    return ingest.normalize_market_info(rows, ["PROMO", "SMALL"], ["Brand#11", "Brand#22", "Brand#33"], "exchange", "prediction")


@query(sql("SELECT id, ('0x' || lpad(to_hex(k * 1000003), 12, '0')) AS condition_hex, (k * 1000003)::VARCHAR AS condition_dec FROM meta0", "meta0"))
def normalize_condition_id(spark, d):
    rows = tables.metadata_versions(spark, d).where(f"inserted_us = {tables.START_US}").selectExpr("id", "concat('0x', lpad(hex(k * 1000003), 12, '0')) AS condition_hex")
    return rows.withColumn("condition_dec", ingest.normalize_condition_id(F.col("condition_hex")))


@query(sql("""WITH c AS (SELECT *, CASE WHEN NOT (value LIKE '[%' OR value LIKE '{%') THEN 'control' WHEN json_valid(value) THEN 'ok' ELSE 'malformed' END AS origin FROM raw)
SELECT event_id, origin, value AS payload, CASE origin WHEN 'control' THEN 'not a JSON message' ELSE 'JSON does not parse' END AS error, us AS failed_us, count(*) OVER (PARTITION BY origin) AS of_origin FROM c WHERE origin <> 'ok'""", "raw"))
def route_bad_records(spark, d):
    """The feed split into good and dead-letter rows, read back from the dead letters."""
    path = new_path(spark, "routed")
    ingest.write_routed(tables.raw_messages(spark, d), path)
    dead = ingest.dead_letters(spark.read.parquet(f"{path}/dead"), "us")
    return dead.join(F.broadcast(dead.groupBy("origin").agg(F.count(F.lit(1)).alias("of_origin"))), "origin")


@query(sql("SELECT market_a, market_b, edge_type, created_us FROM signals WHERE created_us > 1706659200000000 - 90 * 86400000000", "signals"))
def retention_filter(spark, d):
    rows = tables.edge_signals(spark, d)
    return ingest.retention_filter(rows, "created_us", 1706659200000000, 90).select("market_a", "market_b", "edge_type", "created_us")


@query(sql("""WITH s AS (SELECT DISTINCT condition_id, asset_id FROM bbo), h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(range(length(condition_id)), lambda i: (ascii(condition_id[i + 1]) + i)::BIGINT)), lambda h, x: ((h * 32 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 - h + x) AS hash FROM s)
SELECT abs(hash) % 25 AS shard, count(*) AS assets, count(DISTINCT condition_id) AS conditions, count(*) > 450 AS over FROM h GROUP BY 1""", "bbo"))
def assign_shard(spark, d):
    return ingest.assign_shard(tables.quotes(spark, d))


# --- hash chains, gaps, recovery


@query(sql("SELECT event_id, asset_id, book_hash, is_resync FROM accepted", "accepted"))
def hash_chain_dedupe(spark, d):
    return integrity.hash_chain_dedupe(tables.quotes(spark, d)).select("event_id", "asset_id", "book_hash", "is_resync")


def _gaps(spark, d):
    return integrity.hash_chain_gaps(integrity.hash_chain_dedupe(tables.quotes(spark, d)))


@query(sql("SELECT * EXCLUDE resolution FROM gaps", "gaps"))
def hash_chain_gaps(spark, d):
    return _gaps(spark, d)


@query(sql(f"SELECT event_id, asset_id, row_number() {_BBO_W} AS chain_seq FROM accepted", "accepted"))
def chain_sequence(spark, d):
    return integrity.chain_sequence(integrity.hash_chain_dedupe(tables.quotes(spark, d))).select("event_id", "asset_id", "chain_seq")


@query(sql("SELECT resolution, count(*) AS gaps, round(avg(gap_duration_ms), 6) AS avg_ms, max(gap_duration_ms) AS max_ms, count_if(resolution = 'PENDING' AND detected_us < (SELECT max(source_us) FROM bbo) - 3600000000) AS stale_pending, round((SELECT count_if(resolution = 'RESOLVED') * 100 / count(*) FROM gaps), 6) AS resolution_rate FROM gaps GROUP BY 1", "gaps", "bbo"))
def gap_resolution_summary(spark, d):
    return rounded(integrity.gap_resolution_summary(integrity.with_resolution(_gaps(spark, d)), feed_end(tables.quotes(spark, d))))


@query(sql("""WITH e AS (SELECT g.asset_id, g.event_id, count(b.source_us) AS n FROM gaps g LEFT JOIN bbo b ON b.asset_id = g.asset_id AND b.is_resync AND b.source_us BETWEEN g.detected_us AND g.detected_us + 300000000 WHERE g.resolution = 'RESOLVED' GROUP BY 1, 2)
SELECT asset_id, count(*) AS resolved, count_if(n = 0) AS without_resync FROM e GROUP BY 1""", "gaps", "bbo"))
def gap_resync_match(spark, d):
    # a left row is in one or two buckets, each of which may miss: count both
    return integrity.gap_resync_match(integrity.with_resolution(_gaps(spark, d)), tables.quotes(spark, d))


_RESYNCED = """WITH w AS (SELECT g.asset_id, g.event_id, count(b.source_us) AS resyncs FROM gaps g LEFT JOIN bbo b ON b.asset_id = g.asset_id AND b.is_resync AND b.source_us BETWEEN g.detected_us AND g.detected_us + (g.gap_duration_ms * 1000)::BIGINT + 60000000 WHERE g.resolution = 'RESOLVED' GROUP BY 1, 2)"""


def _resync_windows(spark, d):
    return integrity.gap_resync_windows(integrity.with_resolution(_gaps(spark, d)), tables.quotes(spark, d))


@query(sql(f"{_RESYNCED} SELECT asset_id, event_id, resyncs, resyncs > 0 AS resynced FROM w", "gaps", "bbo"))
def gap_resync_windows(spark, d):
    return _resync_windows(spark, d)


@query(sql(f"{_RESYNCED} SELECT count(DISTINCT asset_id) AS gap_assets, count(DISTINCT CASE WHEN resyncs > 0 THEN asset_id END) AS resync_assets, count(*) AS total_gaps, count_if(resyncs > 0)::BIGINT AS gaps_with_resync FROM w", "gaps", "bbo"))
def gap_resync_totals(spark, d):
    return integrity.gap_resync_totals(_resync_windows(spark, d))


@query(sql("""WITH t AS (SELECT max(source_us) AS t FROM bbo) SELECT asset_id, count(*) AS n, (SELECT t FROM t) - max(source_us) AS age_us, (SELECT t FROM t) - max(source_us) > 60000000 AS stale_book, (SELECT t FROM t) - max(source_us) > 21600000000 AS stale_6h, (SELECT t FROM t) - max(source_us) > 86400000000 AS stale_1d
 FROM bbo WHERE source_us > (SELECT t FROM t) - 7 * 86400000000 GROUP BY 1 HAVING count(*) > 10""", "bbo"))
def stale_assets(spark, d):
    ticks = tables.quotes(spark, d)
    return integrity.stale_assets(ticks, feed_end(ticks))
