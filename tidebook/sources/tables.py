"""Market tables derived from the given base tables, by integer arithmetic.

No exchange data is at hand, so each table of the model is computed from the
star-schema and event tables. Every function takes (spark, sf_dir) and returns a
DataFrame over the whole base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.storage import spread

#: First microsecond of the derived feed.
START_US = 1704067200000000
KEYS = ["market_source", "market_type", "asset_id", "condition_id"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's shared integers: a row for each event."""
    return (
        read(spark, sf_dir, "events")
        .selectExpr(
            "event_id", "event_type", "user_id % 200 AS a", "cast(round(value * 100) AS bigint) AS v",
            "cast(get_json_object(props, '$.k') AS bigint) AS k",
            f"{START_US} + event_id * 20000 + (event_id div 500) * 45000000 AS us",
        )
        .selectExpr("*", "a div 2 AS m", "CASE WHEN v % 50 = 0 THEN -1 WHEN v % 51 = 0 THEN 0 ELSE 1 + (v div 7) % 5 END AS sp")
        .selectExpr("*", "20 + (m * 13) % 60 AS yb")
        .selectExpr("*", "(CASE WHEN a % 2 = 0 THEN yb ELSE 98 - yb END) + v % 7 - 3 AS bid_c")
        .selectExpr("*", "bid_c + sp AS ask_c", "'exchange' AS market_source", "'prediction' AS market_type", "cast(a AS string) AS asset_id", "concat('cond_', m) AS condition_id")
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of book: a row for each change."""
    order = Window.partitionBy("a").orderBy("event_id")
    rows = spread(events(spark, sf_dir), ["a"], read(spark, sf_dir, "events").count()).withColumn("rn", F.row_number().over(order).cast("long"))
    rows = rows.selectExpr(
        *KEYS, "event_id", "us AS source_us", "us + CASE WHEN event_id % 173 = 0 THEN -5000 ELSE k * 1000 END AS ingestion_us",
        "md5(concat(a, ':', bid_c, ':', sp)) AS book_hash",
        "CASE WHEN event_id % 101 <> 0 THEN bid_c / 100D END AS best_bid", "ask_c / 100D AS best_ask",
        "CASE WHEN event_id % 211 = 0 THEN 0D ELSE cast(10 + (v * 31 + event_id * 17) % 5000 AS double) END AS bid_size",
        "CASE WHEN event_id % 211 = 0 THEN 0D ELSE cast(10 + (v * 57 + event_id * 29) % 5000 AS double) END AS ask_size",
        "0.01D AS tick_size", "event_id % 137 = 0 AS is_resync", "rn + (event_id div 500) * 3 AS sequence_number",
    )
    bps = (F.col("best_ask") - F.col("best_bid")) / ((F.col("best_bid") + F.col("best_ask")) / 2) * 10000
    return rows.withColumn("spread_bps", bps + F.when(F.col("event_id") % 401 == 0, 50.0).otherwise(0.0))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").selectExpr(
        *KEYS, "event_id", "concat('t', CASE WHEN event_id % 307 = 0 THEN event_id - 1 ELSE event_id END) AS trade_id",
        "us + 7000 AS source_us", "us + 7000 + k * 1000 AS ingestion_us",
        "(CASE WHEN v % 29 = 0 THEN ask_c + 3 WHEN v % 2 = 0 THEN ask_c ELSE bid_c END) / 100D AS price",
        "cast(1 + v % 500 AS double) AS size", "CASE WHEN v % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full depth with levels from worst to best."""
    rows = events(spark, sf_dir).where("event_id % 5 = 0")
    return rows.selectExpr(
        *KEYS, "event_id", "us + 1000 AS source_us", "us + 1000 + k * 1000 AS ingestion_us", "md5(concat(a, ':', bid_c, ':', sp)) AS book_hash",
        "array((bid_c-4)/100D, (bid_c-3)/100D, (CASE WHEN event_id % 90 = 0 THEN bid_c-3 ELSE bid_c-2 END)/100D, (bid_c-1)/100D, bid_c/100D) AS bid_prices",
        "transform(array(3,5,7,11,13), n -> cast(10 + v*n % 700 AS double)) AS bid_sizes",
        "array((ask_c+4)/100D, (ask_c+3)/100D, (ask_c+2)/100D, (ask_c+1)/100D, ask_c/100D) AS ask_prices",
        "transform(array(2,3,5,7,11), n -> cast(10 + v*n % 700 AS double)) AS ask_sizes",
        "event_id % 137 = 0 AS is_resync", "0.01D AS tick_size",
    )


def raw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sizes at price levels, before they are compared with the old ones."""
    return events(spark, sf_dir).selectExpr(
        *KEYS, "event_id", "us AS source_us", "us + k * 1000 AS ingestion_us", "CASE WHEN v % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side",
        "(CASE WHEN v % 2 = 0 THEN bid_c - v % 3 ELSE ask_c + v % 3 END) / 100D AS price",
        "cast(CASE WHEN v % 4 = 0 THEN 0 ELSE 1 + v % 900 END AS double) AS new_size", "md5(concat(a, ':', bid_c, ':', sp)) AS book_hash",
    )


def metadata_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market descriptions, some in two versions."""
    part = read(spark, sf_dir, "part")
    rows = part.selectExpr(
        "p_partkey AS k", "cast(p_partkey AS string) AS id", "concat('cond_', p_partkey) AS condition_id", "p_name AS question", "p_brand AS category",
        "concat('[\"', 2*p_partkey, '\",\"', 2*p_partkey+1, '\"]') AS clob_token_ids",
        f"{START_US} + (p_size - 20) * 86400000000 AS end_us", "p_partkey % 5 = 0 AS neg_risk", "p_partkey % 11 <> 0 AS active", "p_partkey % 13 = 0 AS closed", f"{START_US} AS inserted_us",
    )
    older = rows.where("k % 7 = 0").selectExpr("k", "id", "condition_id", "concat('old ', question) AS question", "category", "clob_token_ids", "end_us", "neg_risk", "active", "closed", "inserted_us - 86400000000 AS inserted_us")
    return rows.unionByName(older)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidebook.functions.temporal import latest_by

    return latest_by(metadata_versions(spark, sf_dir), ["id"], ["inserted_us"])


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-chain fills, everything as text."""
    return (
        read(spark, sf_dir, "lineitem")
        .selectExpr("*", "cast(round(l_extendedprice * 100) AS bigint) * 10000 AS usdc")
        .selectExpr("*", "usdc * 100 div (1 + (l_orderkey * 7 + l_linenumber) % 99) AS shares", "l_linenumber % 2 = 0 AS even", "cast(l_partkey % 200 AS string) AS token")
        .selectExpr(
            "concat(l_orderkey, '-', l_linenumber) AS id", "concat('0xm', l_suppkey) AS maker", "concat('0xt', l_partkey % 500) AS taker",
            "CASE WHEN even THEN '0' ELSE token END AS maker_asset_id", "CASE WHEN even THEN token ELSE '0' END AS taker_asset_id",
            "cast(CASE WHEN even THEN usdc ELSE shares END AS string) AS maker_amount_filled", "cast(CASE WHEN even THEN shares ELSE usdc END AS string) AS taker_amount_filled",
            "cast(usdc div 500 AS string) AS fee", "cast(1704067200 + (l_orderkey * 60 + l_linenumber) % 2592000 AS string) AS timestamp", "cast(l_orderkey % 97 = 0 AS int) AS is_deleted",
        )
    )


def market_name(number: str) -> str:
    """The name, of one length always, of a market of the graph."""
    return f"concat('m', lpad(cast({number} AS string), 7, '0'))"


def edge_signals(spark: SparkSession, sf_dir: str, placed: bool = False, numbered: bool = False) -> DataFrame:
    """Signals between pairs of markets; as many markets as there are parts. ``placed``
    adds ``place``, the row's file and number in it; ``numbered`` gives markets by the
    number in their name, if no key is below zero (names hold seven digits at most)."""
    number = lambda x: f"CASE WHEN {x} < 10000000 THEN {x} ELSE cast(left(cast({x} AS string), 7) AS bigint) END"
    market = number if numbered else market_name
    place = ["struct(_metadata.file_name AS file, _metadata.row_index AS row) AS place"] if placed else []
    rows = read(spark, sf_dir, "lineitem").selectExpr("*", *place, "l_partkey AS x", "l_suppkey * 20 + l_linenumber AS y").where("x <> y")
    return rows.selectExpr(
        f"{market('least(x, y)')} AS market_a", f"{market('greatest(x, y)')} AS market_b",
        "CASE l_returnflag WHEN 'R' THEN 'correlation' WHEN 'A' THEN 'hedge' ELSE CASE l_linestatus WHEN 'F' THEN 'causal' ELSE 'arbitrage' END END AS edge_type",
        "coalesce(element_at(array('trigger_fire','user_trigger','user_analysis','trigger_miss','cron_correlation','metadata_tag','bellman_ford_cycle'), cast(l_linenumber AS int)), 'trigger_fire') AS signal_source",
        "CASE WHEN l_linenumber >= 5 THEN '' ELSE concat('u', l_orderkey % 300) END AS user_id",
        "CASE WHEN l_linenumber = 4 THEN -0.1D ELSE (l_linenumber + l_orderkey % 10) / 10D END AS strength",
        "1706659200000000 - ((l_orderkey * 13 + l_linenumber) % 120) * 86400000000 AS created_us", *["place"] * placed,
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "md5(cast(o_custkey % 20 AS string)) AS api_key_hash", "element_at(array('free','pro','enterprise'), cast(o_custkey % 20 % 3 + 1 AS int)) AS tier",
        "CASE o_orderstatus WHEN 'P' THEN '/triggers' WHEN 'F' THEN '/markets' ELSE '/ohlc' END AS endpoint", "CASE o_orderstatus WHEN 'P' THEN 'POST' ELSE 'GET' END AS method",
        "o_orderkey % 100 AS rows_returned", f"{START_US} + o_orderkey * 100000 AS us", "o_orderkey AS request_id",
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as text, one JSON message a row, noise included."""
    cents = lambda x: f"concat('0.', lpad(cast({x} AS string), 2, '0'))"
    level = lambda p, s: f"concat('{{\"price\":\"', {cents(p)}, '\",\"size\":\"', {s}, '\"}}')"
    head = "concat('\"asset_id\":\"', a, '\",\"market\":\"cond_', m, '\",\"timestamp\":\"', us div 1000, '\"')"
    book = f"concat('[{{', {head}, ',\"hash\":\"', md5(concat(a, ':', bid_c, ':', sp)), '\",\"bids\":[', {level('bid_c - 1', '10 + v % 50')}, ',', {level('bid_c', '10 + v % 90')}, '],\"asks\":[', {level('ask_c + 1', '10 + v % 70')}, ',', {level('ask_c', '10 + v % 30')}, ']}}]')"
    change = lambda side, p, s: f"concat('{{\"asset_id\":\"', a, '\",\"side\":\"{side}\",\"price\":\"', {cents(p)}, '\",\"size\":\"', {s}, '\"}}')"
    changes = f"concat('{{\"event_type\":\"price_change\",\"market\":\"cond_', m, '\",\"timestamp\":\"', us div 1000, '\",\"price_changes\":[', {change('BUY', 'bid_c', 'v % 4 * 10')}, ',', {change('SELL', 'ask_c', '5 + v % 9')}, ']}}')"
    trade = f"concat('{{\"event_type\":\"last_trade_price\",', {head}, ',\"price\":\"', {cents('ask_c')}, '\",\"size\":\"', 1 + v % 500, '\",\"side\":\"', CASE WHEN v % 2 = 0 THEN 'BUY' ELSE 'SELL' END, '\"}}')"
    tick = f"concat('{{\"event_type\":\"tick_size_change\",', {head}, ',\"old_tick_size\":\"0.01\",\"new_tick_size\":\"', CASE WHEN v % 2 = 0 THEN '0.001' ELSE '0.01' END, '\"}}')"
    noise = "CASE v % 3 WHEN 0 THEN 'PONG' WHEN 1 THEN 'INVALID OPERATION' ELSE concat('{\"asset_id\":\"', a) END"
    return events(spark, sf_dir).selectExpr("event_id", "us", f"CASE event_type WHEN 'click' THEN {book} WHEN 'view' THEN {changes} WHEN 'purchase' THEN {trade} WHEN 'signup' THEN {tick} ELSE {noise} END AS value")
