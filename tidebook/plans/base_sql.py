"""The derived tables as SQL, for checking results in another engine."""

from __future__ import annotations

_KEYS = "'exchange' AS market_source, 'prediction' AS market_type, a::VARCHAR AS asset_id, 'cond_' || m AS condition_id"
_HASH = "md5(a || ':' || bid_c || ':' || sp)"


def _cents(x: str) -> str:
    return f"'0.' || lpad(({x})::VARCHAR, 2, '0')"


def _level(p: str, s: str) -> str:
    return f"""'{{"price":"' || {_cents(p)} || '","size":"' || ({s}) || '"}}'"""


def _change(side: str, p: str, s: str) -> str:
    return f"""'{{"asset_id":"' || a || '","side":"{side}","price":"' || {_cents(p)} || '","size":"' || ({s}) || '"}}'"""


_HEAD = """'"asset_id":"' || a || '","market":"cond_' || m || '","timestamp":"' || (us // 1000) || '"'"""

TABLES = {
    "e0": ((), "SELECT event_id, event_type, user_id % 200 AS a, round(value * 100)::BIGINT AS v, json_extract_string(props, '$.k')::BIGINT AS k, 1704067200000000 + event_id * 20000 + (event_id // 500) * 45000000 AS us FROM events"),
    "e1": (("e0",), "SELECT *, a // 2 AS m, CASE WHEN v % 50 = 0 THEN -1 WHEN v % 51 = 0 THEN 0 ELSE 1 + (v // 7) % 5 END AS sp, 20 + ((a // 2) * 13) % 60 AS yb FROM e0"),
    "q0": (("e1",), f"SELECT *, bid_c + sp AS ask_c, {_KEYS} FROM (SELECT *, (CASE WHEN a % 2 = 0 THEN yb ELSE 98 - yb END) + v % 7 - 3 AS bid_c FROM e1)"),
    "bbo0": (("q0",), f"""SELECT market_source, market_type, asset_id, condition_id, event_id, us AS source_us, us + CASE WHEN event_id % 173 = 0 THEN -5000 ELSE k * 1000 END AS ingestion_us, {_HASH} AS book_hash,
      CASE WHEN event_id % 101 <> 0 THEN bid_c / 100e0 END AS best_bid, ask_c / 100e0 AS best_ask,
      CASE WHEN event_id % 211 = 0 THEN 0e0 ELSE (10 + (v * 31 + event_id * 17) % 5000)::DOUBLE END AS bid_size, CASE WHEN event_id % 211 = 0 THEN 0e0 ELSE (10 + (v * 57 + event_id * 29) % 5000)::DOUBLE END AS ask_size,
      0.01e0 AS tick_size, event_id % 137 = 0 AS is_resync, row_number() OVER (PARTITION BY a ORDER BY event_id) + (event_id // 500) * 3 AS sequence_number FROM q0"""),
    "bbo": (("bbo0",), "SELECT *, (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 10000 + CASE WHEN event_id % 401 = 0 THEN 50.0 ELSE 0.0 END AS spread_bps FROM bbo0"),
    "trades": (("q0",), "SELECT market_source, market_type, asset_id, condition_id, event_id, 't' || CASE WHEN event_id % 307 = 0 THEN event_id - 1 ELSE event_id END AS trade_id, us + 7000 AS source_us, us + 7000 + k * 1000 AS ingestion_us, (CASE WHEN v % 29 = 0 THEN ask_c + 3 WHEN v % 2 = 0 THEN ask_c ELSE bid_c END) / 100e0 AS price, (1 + v % 500)::DOUBLE AS size, CASE WHEN v % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM q0 WHERE event_type = 'purchase'"),
    "snaps": (("q0",), f"""SELECT market_source, market_type, asset_id, condition_id, event_id, us + 1000 AS source_us, us + 1000 + k * 1000 AS ingestion_us, {_HASH} AS book_hash,
      [(bid_c-4)/100e0, (bid_c-3)/100e0, (CASE WHEN event_id % 90 = 0 THEN bid_c-3 ELSE bid_c-2 END)/100e0, (bid_c-1)/100e0, bid_c/100e0] AS bid_prices,
      [(10 + v*3 % 700)::DOUBLE, (10 + v*5 % 700)::DOUBLE, (10 + v*7 % 700)::DOUBLE, (10 + v*11 % 700)::DOUBLE, (10 + v*13 % 700)::DOUBLE] AS bid_sizes,
      [(ask_c+4)/100e0, (ask_c+3)/100e0, (ask_c+2)/100e0, (ask_c+1)/100e0, ask_c/100e0] AS ask_prices,
      [(10 + v*2 % 700)::DOUBLE, (10 + v*3 % 700)::DOUBLE, (10 + v*5 % 700)::DOUBLE, (10 + v*7 % 700)::DOUBLE, (10 + v*11 % 700)::DOUBLE] AS ask_sizes,
      event_id % 137 = 0 AS is_resync, 0.01e0 AS tick_size FROM q0 WHERE event_id % 5 = 0"""),
    "rawlev": (("q0",), f"SELECT market_source, market_type, asset_id, condition_id, event_id, us AS source_us, us + k * 1000 AS ingestion_us, CASE WHEN v % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, (CASE WHEN v % 2 = 0 THEN bid_c - v % 3 ELSE ask_c + v % 3 END) / 100e0 AS price, (CASE WHEN v % 4 = 0 THEN 0 ELSE 1 + v % 900 END)::DOUBLE AS new_size, {_HASH} AS book_hash FROM q0"),
    "levels": (("rawlev",), "SELECT *, new_size - old_size AS size_delta, CASE WHEN new_size = 0 THEN 'REMOVE' WHEN old_size = 0 THEN 'ADD' ELSE 'UPDATE' END AS change_type FROM (SELECT *, lag(new_size, 1, 0e0) OVER (PARTITION BY asset_id, side, price ORDER BY source_us, event_id) AS old_size FROM rawlev)"),
    "meta0": ((), "SELECT p_partkey AS k, p_partkey::VARCHAR AS id, 'cond_' || p_partkey AS condition_id, p_name AS question, p_brand AS category, '[\"' || 2*p_partkey || '\",\"' || (2*p_partkey+1) || '\"]' AS clob_token_ids, 1704067200000000 + (p_size - 20) * 86400000000 AS end_us, p_partkey % 5 = 0 AS neg_risk, p_partkey % 11 <> 0 AS active, p_partkey % 13 = 0 AS closed, 1704067200000000 AS inserted_us FROM part"),
    "metav": (("meta0",), "SELECT * FROM meta0 UNION ALL SELECT k, id, condition_id, 'old ' || question, category, clob_token_ids, end_us, neg_risk, active, closed, inserted_us - 86400000000 FROM meta0 WHERE k % 7 = 0"),
    "meta": (("metav",), "SELECT * FROM metav QUALIFY row_number() OVER (PARTITION BY id ORDER BY inserted_us DESC) = 1"),
    "tokens": (("meta",), "SELECT meta.*, t.tok AS asset_id, t.pos::INT AS pos FROM meta, LATERAL (SELECT unnest(from_json(clob_token_ids, '[\"VARCHAR\"]')) AS tok, generate_subscripts(from_json(clob_token_ids, '[\"VARCHAR\"]'), 1) - 1 AS pos) t"),
    "f0": ((), "SELECT *, round(l_extendedprice * 100)::BIGINT * 10000 AS usdc FROM lineitem"),
    "fills": (("f0",), """SELECT l_orderkey || '-' || l_linenumber AS id, '0xm' || l_suppkey AS maker, '0xt' || (l_partkey % 500) AS taker,
      CASE WHEN even THEN '0' ELSE token END AS maker_asset_id, CASE WHEN even THEN token ELSE '0' END AS taker_asset_id,
      (CASE WHEN even THEN usdc ELSE shares END)::VARCHAR AS maker_amount_filled, (CASE WHEN even THEN shares ELSE usdc END)::VARCHAR AS taker_amount_filled,
      (usdc // 500)::VARCHAR AS fee, (1704067200 + (l_orderkey * 60 + l_linenumber) % 2592000)::VARCHAR AS timestamp, (l_orderkey % 97 = 0)::INT AS is_deleted
      FROM (SELECT *, usdc * 100 // (1 + (l_orderkey * 7 + l_linenumber) % 99) AS shares, l_linenumber % 2 = 0 AS even, (l_partkey % 200)::VARCHAR AS token FROM f0)"""),
    "fill_trades": (("fills",), """SELECT id, maker, taker, CASE WHEN maker_asset_id = '0' THEN taker_asset_id ELSE maker_asset_id END AS asset_id,
      (CASE WHEN maker_asset_id = '0' THEN taker_amount_filled ELSE maker_amount_filled END)::BIGINT / 1e6 AS shares,
      (CASE WHEN maker_asset_id = '0' THEN maker_amount_filled ELSE taker_amount_filled END)::BIGINT / 1e6 AS usdc,
      CASE WHEN maker_asset_id = '0' THEN 'SELL' ELSE 'BUY' END AS side, fee::BIGINT / 1e6 AS fee, timestamp::BIGINT * 1000000 AS us FROM fills WHERE is_deleted = 0"""),
    "signals": ((), """SELECT 'm' || lpad(least(x, y)::VARCHAR, 7, '0') AS market_a, 'm' || lpad(greatest(x, y)::VARCHAR, 7, '0') AS market_b,
      CASE l_returnflag WHEN 'R' THEN 'correlation' WHEN 'A' THEN 'hedge' ELSE CASE l_linestatus WHEN 'F' THEN 'causal' ELSE 'arbitrage' END END AS edge_type,
      coalesce((['trigger_fire','user_trigger','user_analysis','trigger_miss','cron_correlation','metadata_tag','bellman_ford_cycle'])[l_linenumber::INT], 'trigger_fire') AS signal_source,
      CASE WHEN l_linenumber >= 5 THEN '' ELSE 'u' || (l_orderkey % 300) END AS user_id,
      CASE WHEN l_linenumber = 4 THEN -0.1e0 ELSE (l_linenumber + l_orderkey % 10) / 10e0 END AS strength,
      1706659200000000 - ((l_orderkey * 13 + l_linenumber) % 120) * 86400000000 AS created_us
      FROM (SELECT *, l_partkey AS x, l_suppkey * 20 + l_linenumber AS y FROM lineitem) WHERE x <> y"""),
    "usage": ((), "SELECT md5((o_custkey % 20)::VARCHAR) AS api_key_hash, (['free','pro','enterprise'])[(o_custkey % 20 % 3 + 1)::INT] AS tier, CASE o_orderstatus WHEN 'P' THEN '/triggers' WHEN 'F' THEN '/markets' ELSE '/ohlc' END AS endpoint, CASE o_orderstatus WHEN 'P' THEN 'POST' ELSE 'GET' END AS method, o_orderkey % 100 AS rows_returned, 1704067200000000 + o_orderkey * 100000 AS us, o_orderkey AS request_id FROM orders"),
    "raw": (("q0",), f"""SELECT event_id, us, CASE event_type
      WHEN 'click' THEN '[{{' || {_HEAD} || ',"hash":"' || {_HASH} || '","bids":[' || {_level('bid_c - 1', '10 + v % 50')} || ',' || {_level('bid_c', '10 + v % 90')} || '],"asks":[' || {_level('ask_c + 1', '10 + v % 70')} || ',' || {_level('ask_c', '10 + v % 30')} || ']}}]'
      WHEN 'view' THEN '{{"event_type":"price_change","market":"cond_' || m || '","timestamp":"' || (us // 1000) || '","price_changes":[' || {_change('BUY', 'bid_c', 'v % 4 * 10')} || ',' || {_change('SELL', 'ask_c', '5 + v % 9')} || ']}}'
      WHEN 'purchase' THEN '{{"event_type":"last_trade_price",' || {_HEAD} || ',"price":"' || {_cents('ask_c')} || '","size":"' || (1 + v % 500) || '","side":"' || CASE WHEN v % 2 = 0 THEN 'BUY' ELSE 'SELL' END || '"}}'
      WHEN 'signup' THEN '{{"event_type":"tick_size_change",' || {_HEAD} || ',"old_tick_size":"0.01","new_tick_size":"' || CASE WHEN v % 2 = 0 THEN '0.001' ELSE '0.01' END || '"}}'
      ELSE CASE v % 3 WHEN 0 THEN 'PONG' WHEN 1 THEN 'INVALID OPERATION' ELSE '{{"asset_id":"' || a END END AS value FROM q0"""),
    "accepted": (("bbo",), "SELECT * EXCLUDE p FROM (SELECT *, lag(book_hash) OVER (PARTITION BY asset_id ORDER BY source_us, event_id) AS p FROM bbo WHERE NOT is_resync) WHERE p IS DISTINCT FROM book_hash UNION ALL SELECT * FROM bbo WHERE is_resync"),
    "gaps": (("accepted",), """SELECT asset_id, source_us AS detected_us, p_hash AS last_known_hash, book_hash AS new_hash, (source_us - p_us) / 1000e0 AS gap_duration_ms, event_id,
      (['PENDING','RESOLVED','FAILED'])[(event_id % 3 + 1)::INT] AS resolution FROM (SELECT *, lag(book_hash) OVER w AS p_hash, lag(source_us) OVER w AS p_us FROM accepted WINDOW w AS (PARTITION BY asset_id ORDER BY source_us, event_id))
      WHERE source_us - p_us > 30000000 AND source_us - p_us <= 86400000000"""),
    "edges": (("signals",), """SELECT market_a, market_b, edge_type, ln(greatest(0.001e0, 1 + sum(strength * CASE signal_source WHEN 'trigger_fire' THEN 2e0 WHEN 'user_trigger' THEN 1.5e0 WHEN 'user_analysis' THEN 1e0 WHEN 'trigger_miss' THEN 0.5e0 WHEN 'cron_correlation' THEN 1e0 WHEN 'metadata_tag' THEN 0.8e0 WHEN 'bellman_ford_cycle' THEN 2.5e0 ELSE 1e0 END * pow(2e0, -d / 30e0)))) AS weight,
      count(DISTINCT CASE WHEN user_id <> '' THEN user_id END) AS user_count, count(*) AS signal_count, max(created_us) AS last_us
      FROM (SELECT *, (1706659200000000 // 86400000000) - (created_us // 86400000000) AS d FROM signals) WHERE d <= 90 GROUP BY ALL"""),
}


def sql(body: str, *names: str) -> str:
    """``body`` with the derived tables it needs in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in TABLES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n][1]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head}" + (f",\n{body[5:]}" if body.upper().startswith("WITH ") else f"\n{body}")
