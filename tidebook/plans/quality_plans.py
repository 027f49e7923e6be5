"""Queries of the data-quality suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions.quantiles import percentiles
from tidebook.functions.temporal import latest_by
from tidebook.operators import ingest, integrity, markets, quality_checks as qc
from tidebook.plans.base_sql import sql
from tidebook.plans.registry import query, rounded
from tidebook.sources import tables

_W = "OVER (PARTITION BY asset_id ORDER BY source_us, event_id)"


def _levels(spark, d):
    return ingest.classify_level_changes(tables.raw_levels(spark, d))


def _gaps(spark, d):
    return integrity.with_resolution(integrity.hash_chain_gaps(integrity.hash_chain_dedupe(tables.quotes(spark, d))))


def _sales(spark, d):
    """Trades with the columns that a store computes as it takes them in."""
    rows = tables.trades(spark, d)
    return rows.withColumns({"notional": F.round(F.col("price") * F.col("size"), 6), "latency_ms": F.floor((F.col("ingestion_us") - F.col("source_us")) / 1000)})


def _times(spark, d):
    parts = [t(spark, d).select(F.lit(n).alias("t"), "source_us", "ingestion_us") for n, t in (("bbo", tables.quotes), ("trades", tables.trades), ("snaps", tables.snapshots), ("levels", tables.raw_levels))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _hashed(spark, d):
    parts = [t(spark, d).select(F.lit(n).alias("t"), "asset_id", "condition_id", "book_hash") for n, t in (("bbo", tables.quotes), ("snaps", tables.snapshots), ("levels", tables.raw_levels))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SOURCES = {"bbo": tables.quotes, "trades": tables.trades, "levels": _levels, "gaps": _gaps, "sales": _sales, "times": _times, "hashed": _hashed}
#: Unions and computed columns of the checks, over the derived tables they need.
VIEWS = {
    "sales": (("trades",), "SELECT *, round(price * size, 6) AS notional, floor((ingestion_us - source_us) / 1000) AS latency_ms FROM trades"),
    "times": (("bbo", "trades", "snaps", "rawlev"), " UNION ALL ".join(f"SELECT '{n}' AS t, source_us, ingestion_us FROM {t}" for n, t in (("bbo", "bbo"), ("trades", "trades"), ("snaps", "snaps"), ("levels", "rawlev")))),
    "hashed": (("bbo", "snaps", "rawlev"), " UNION ALL ".join(f"SELECT '{n}' AS t, asset_id, condition_id, book_hash FROM {t}" for n, t in (("bbo", "bbo"), ("snaps", "snaps"), ("levels", "rawlev")))),
}


#: Metrics that the other engine spells otherwise.
SPELLED = {"dq_required_fields": {"bad_asset": "count_if(NOT regexp_matches(asset_id, '^[0-9]+$'))", "bad_hash": "count_if(NOT regexp_matches(book_hash, '^[a-f0-9]+$'))"}}


def _oracle(name: str, c: qc.Check) -> str:
    keys = ", ".join(c.group)
    metrics = ", ".join(f"{e} AS {k}" for k, e in (c.metrics | SPELLED.get(name, {})).items())
    needs, view = VIEWS.get(c.table, ((c.table,), f"SELECT * FROM {c.table}"))
    inner = f"SELECT {keys + ', ' if keys else ''}{metrics} FROM ({view})" + (f" GROUP BY {keys}" if keys else "")
    return sql(f"SELECT *, coalesce({c.passed}, true) AS passed FROM ({inner})", *needs)


for _name, _check in qc.CHECKS.items():
    query(_oracle(_name, _check), _name)(lambda spark, d, c=_check: qc.run_check(SOURCES[c.table](spark, d), c))


@query(sql("""SELECT count(*) AS n, count_if(len(bid_prices) <> len(bid_sizes)) AS length, count_if(len(ask_prices) = 0) AS one_sided, count_if(bid_prices <> list_sort(list_distinct(bid_prices))) AS bid_order, count_if(ask_prices <> list_reverse_sort(list_distinct(ask_prices))) AS ask_order,
 count_if(len(list_distinct(bid_prices)) < len(bid_prices)) AS repeats, count_if(ask_prices[-1] < bid_prices[-1]) AS crossed, count_if(list_min(bid_sizes) < 0 OR list_min(ask_sizes) < 0) AS negative FROM snaps""", "snaps"))
def dq_l2_shape(spark, d):
    return qc.l2_shape(tables.snapshots(spark, d))


@query(sql("SELECT count(*) AS n, count_if(abs(b.best_bid - s.bid_prices[-1]) > 1e-9) AS bid_differs, count_if(abs(b.best_ask - s.ask_prices[-1]) > 1e-9) AS ask_differs, count_if(b.best_bid = 0 AND len(s.bid_prices) > 0) AS zero_bid_with_levels, count_if(b.best_ask = 0 AND len(s.ask_prices) > 0) AS zero_ask_with_levels FROM bbo b JOIN snaps s USING (event_id)", "bbo", "snaps"))
def dq_l2_top_match(spark, d):
    l = tables.quotes(spark, d).select("event_id", "best_bid", "best_ask")
    top = [x for side in ("bid", "ask") for x in (F.element_at(f"{side}_prices", -1).alias(side[0]), F.size(f"{side}_prices").alias(f"{side}_levels"))]
    both = l.join(tables.snapshots(spark, d).select("event_id", *top), "event_id")
    zero = [F.count_if((F.col(f"best_{x}") == 0) & (F.col(f"{x}_levels") > 0)).alias(f"zero_{x}_with_levels") for x in ("bid", "ask")]
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("best_bid") - F.col("b")) > 1e-9).alias("bid_differs"), F.count_if(F.abs(F.col("best_ask") - F.col("a")) > 1e-9).alias("ask_differs"), *zero)


@query(sql("WITH r AS (SELECT 'bbo' AS t, (ingestion_us - source_us) / 1000 AS ms FROM bbo UNION ALL SELECT 'trades', (ingestion_us - source_us) / 1000 FROM trades UNION ALL SELECT 'snaps', (ingestion_us - source_us) / 1000 FROM snaps) SELECT t, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.9), 6) AS p90, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, max(ms) AS worst FROM r GROUP BY 1", "bbo", "trades", "snaps"))
def dq_latency_dist(spark, d):
    rows = [t(spark, d).select(F.lit(n).alias("t"), markets.latency_ms().alias("ms")) for n, t in (("bbo", tables.quotes), ("trades", tables.trades), ("snaps", tables.snapshots))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    got = every.groupBy("t").agg(F.max("ms").alias("worst")).join(percentiles(every, ["t"], F.col("ms"), [0.5, 0.9, 0.95, 0.99]), "t", "left")
    return rounded(got.select("t", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))], "worst"))


@query(sql("""SELECT 'bbo' AS t, asset_id, count(*) AS n, count_if(back) AS regressions FROM (SELECT *, ingestion_us - lag(ingestion_us) OVER (PARTITION BY asset_id ORDER BY sequence_number, event_id) < 0 AS back FROM bbo) GROUP BY 2
UNION ALL SELECT 'trades', asset_id, count(*), count_if(source_us < prev) FROM (SELECT asset_id, source_us, lag(source_us) OVER (PARTITION BY asset_id ORDER BY event_id) AS prev FROM trades) GROUP BY 2""", "bbo", "trades"))
def dq_monotonic_ts(spark, d):
    quotes = qc.monotonic(tables.quotes(spark, d)).select(F.lit("bbo").alias("t"), "*")
    return quotes.unionByName(qc.chronological(tables.trades(spark, d)).select(F.lit("trades").alias("t"), "*"))


@query(sql("SELECT 'bbo' AS t, count_if(source_us > 1704067500000000) AS future, max(source_us) AS newest, (max(source_us) - min(source_us)) // 86400000000 AS days FROM bbo UNION ALL SELECT 'trades', count_if(source_us > 1704067500000000), max(source_us), (max(source_us) - min(source_us)) // 86400000000 FROM trades", "bbo", "trades"))
def dq_future_past(spark, d):
    one = lambda n, t: t.agg(F.lit(n).alias("t"), F.count_if(F.col("source_us") > 1704067500000000).alias("future"), F.max("source_us").alias("newest"), F.floor((F.max("source_us") - F.min("source_us")) / markets.DAY_US).alias("days"))
    return one("bbo", tables.quotes(spark, d)).unionByName(one("trades", tables.trades(spark, d)))


def _gap_sql(name: str, table: str, low: int, high: int) -> str:
    return f"SELECT '{name}' AS t, asset_id, count_if(dt > {low} AND dt <= {high}) AS gaps, count_if(dt > {high}) AS long_gaps, max(dt) AS max_us, round(avg(dt), 6) AS avg_us FROM (SELECT *, source_us - lag(source_us) {_W} AS dt FROM {table}) GROUP BY asset_id"


@query(sql(_gap_sql("bbo", "bbo", 30_000_000, 3_600_000_000) + " UNION ALL " + _gap_sql("trades", "trades", 1_800_000_000, 3_600_000_000), "bbo", "trades"))
def dq_time_gaps(spark, d):
    found = qc.time_gaps(tables.quotes(spark, d)).withColumn("t", F.lit("bbo"))
    return rounded(found.unionByName(qc.time_gaps(tables.trades(spark, d), 1_800_000_000).withColumn("t", F.lit("trades"))))


@query(sql(f"SELECT asset_id, count_if(ds > 1) AS jumps, count_if(ds < 0) AS back, count_if(ds > 1000) AS far, round(avg(ds), 6) AS mean_step, count_if(sequence_number <= 0) AS not_positive FROM (SELECT *, sequence_number - lag(sequence_number) {_W} AS ds FROM bbo) GROUP BY 1", "bbo"))
def dq_sequence(spark, d):
    return rounded(qc.sequence_steps(tables.quotes(spark, d)))


@query(sql("SELECT count(*) AS assets, round(avg(h / n), 6) AS avg_rate, round(min(h / n), 6) AS min_rate FROM (SELECT asset_id, count(DISTINCT book_hash) AS h, count(*) AS n FROM bbo GROUP BY 1) WHERE n > 5", "bbo"))
def dq_hash_change_rate(spark, d):
    return rounded(qc.hash_change_rate(tables.quotes(spark, d)))


@query(sql("SELECT asset_id, book_hash, count(*) AS n, count(DISTINCT coalesce(best_bid::VARCHAR, '-') || '|' || coalesce(best_ask::VARCHAR, '-')) AS quotes FROM bbo GROUP BY 1, 2 HAVING count(*) > 1", "bbo"))
def dq_hash_duplicates(spark, d):
    return qc.hash_duplicates(tables.quotes(spark, d))


#: Relation, its children, and the parents of which one must know the asset.
RELATIONS = {"trades_with_a_book": ("trades", ("snaps", "bbo")), "levels_with_a_snapshot": ("rawlev", ("snaps",)), "trades_with_quotes": ("trades", ("bbo",))}


def _relation_sql(name: str, child: str, parents: tuple[str, ...]) -> str:
    known = " UNION ".join(f"SELECT DISTINCT asset_id FROM {p}" for p in parents)
    return f"SELECT '{name}' AS relation, count(*) AS assets, count_if(s.asset_id IS NULL) AS orphans, coalesce(sum(CASE WHEN s.asset_id IS NULL THEN t.n END), 0)::BIGINT AS orphan_rows FROM (SELECT asset_id, count(*) AS n FROM {child} GROUP BY 1) t LEFT JOIN ({known}) s USING (asset_id)"


@query(sql(" UNION ALL ".join(_relation_sql(n, c, p) for n, (c, p) in RELATIONS.items()), "trades", "snaps", "bbo", "rawlev"))
def dq_referential(spark, d):
    table = {"trades": tables.trades, "snaps": tables.snapshots, "bbo": tables.quotes, "rawlev": tables.raw_levels}
    out = None
    for name, (child, parents) in RELATIONS.items():
        one = qc.referential(table[child](spark, d), *[table[p](spark, d) for p in parents]).withColumn("relation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql("WITH l AS (SELECT asset_id, count(DISTINCT condition_id) AS c, min(condition_id) AS o FROM bbo GROUP BY 1), r AS (SELECT asset_id, count(DISTINCT condition_id) AS c, min(condition_id) AS o FROM tokens GROUP BY 1) SELECT count_if(l.c > 1) AS several, count_if(l.o <> r.o) AS mismatch, count_if(l.o IS NULL OR r.o IS NULL) AS one_table_only FROM l FULL JOIN r USING (asset_id)", "bbo", "tokens"))
def dq_condition_mapping(spark, d):
    return qc.condition_mapping(tables.quotes(spark, d), markets.market_tokens(tables.metadata(spark, d)))


@query(sql("SELECT count(*) AS pairs, count_if(abs(best_bid - bid_prices[-1]) > 1e-9) AS bid_differs, count_if(abs(best_ask - ask_prices[-1]) > 1e-9) AS ask_differs, round(avg(abs(b.source_us - s.source_us)), 6) AS avg_us FROM bbo b JOIN snaps s ON b.asset_id = s.asset_id AND b.source_us // 1000000 = s.source_us // 1000000", "bbo", "snaps"))
def dq_bbo_vs_l2(spark, d):
    return rounded(qc.bbo_vs_l2(tables.quotes(spark, d), tables.snapshots(spark, d)))


@query(sql("""WITH q AS (SELECT asset_id, source_us, best_bid, best_ask FROM bbo WHERE best_bid IS NOT NULL), j AS (SELECT t.price, t.side, q.best_bid AS b, q.best_ask AS a FROM trades t ASOF LEFT JOIN q ON t.asset_id = q.asset_id AND t.source_us >= q.source_us)
SELECT count(*) AS n, count_if(b > 0 AND a > 0) AS quoted, count_if(b > 0 AND a > 0 AND price > a + 0.01 + 1e-9) AS above, count_if(b > 0 AND a > 0 AND price < b - 0.01 - 1e-9) AS below, count_if(b > 0 AND a > 0 AND side = 'BUY' AND price < b - 0.001 - 1e-9) AS buy_below_bid, count_if(b > 0 AND a > 0 AND side = 'SELL' AND price > a + 0.001 + 1e-9) AS sell_above_ask FROM j""", "trades", "bbo"))
def dq_trade_vs_quote(spark, d):
    return qc.trade_vs_quote(tables.trades(spark, d), tables.quotes(spark, d))


@query(sql("""WITH s AS (SELECT asset_id, source_us // 60000000 AS minute, min(list_sum(bid_sizes) + list_sum(ask_sizes)) AS low, max(list_sum(bid_sizes) + list_sum(ask_sizes)) AS high, count(*) AS snaps FROM snaps GROUP BY 1, 2), c AS (SELECT asset_id, source_us // 60000000 AS minute, count(*) AS deltas, sum(size_delta) AS net FROM levels GROUP BY 1, 2)
SELECT asset_id, minute, low, high, snaps, coalesce(deltas, 0) AS deltas, round(coalesce(net, 0), 6) AS net FROM s LEFT JOIN c USING (asset_id, minute)""", "snaps", "levels"))
def dq_depth_vs_deltas(spark, d):
    return rounded(qc.depth_vs_deltas(tables.snapshots(spark, d), _levels(spark, d)))


@query(sql("""WITH s AS (SELECT asset_id, source_us // 60000000 AS minute, max(list_sum(bid_sizes)) - min(list_sum(bid_sizes)) AS b, max(list_sum(ask_sizes)) - min(list_sum(ask_sizes)) AS a, count(*) AS snaps FROM snaps GROUP BY 1, 2), c AS (SELECT asset_id, source_us // 60000000 AS minute, sum(abs(size_delta)) AS changed, count(*) AS changes FROM levels GROUP BY 1, 2)
SELECT count(*) AS minutes, count_if(changed > 0 AND snaps > 0) AS active, round(avg(changes), 6) AS avg_changes, count_if(changed > 0 AND (b > 0 OR a > 0)) AS reflected FROM c JOIN s USING (asset_id, minute)""", "snaps", "levels"))
def dq_deltas_in_depth(spark, d):
    return rounded(qc.deltas_in_depth(tables.snapshots(spark, d), _levels(spark, d)))


@query(sql("""SELECT asset_id, count(*) AS snapshots, min(source_us) AS first_us, max(source_us) AS last_us, max(source_us) // 60000000 - min(source_us) // 60000000 AS minutes, round((max(source_us) // 60000000 - min(source_us) // 60000000) / count(*), 6) AS minutes_per_snapshot FROM snaps GROUP BY 1
HAVING max(source_us) // 60000000 - min(source_us) // 60000000 > 60 ORDER BY minutes_per_snapshot DESC, asset_id LIMIT 20""", "snaps"))
def dq_snapshot_frequency(spark, d):
    return rounded(qc.snapshot_frequency(tables.snapshots(spark, d)))


@query(sql(f"""WITH p AS (SELECT * FROM (SELECT asset_id, event_id, lag(source_us) {_W} AS f, source_us AS t, lag(book_hash) {_W} <> book_hash AS changed FROM snaps) WHERE t - f <= 60000000),
e AS (SELECT p.asset_id, p.event_id, count(l.source_us) AS deltas, bool_or(changed) AS changed FROM p LEFT JOIN rawlev l ON l.asset_id = p.asset_id AND l.source_us BETWEEN f + 1 AND t GROUP BY 1, 2)
SELECT count(*) AS pairs, sum(deltas)::BIGINT AS deltas, count_if(changed) AS changed, count_if(changed AND deltas > 0) AS explained FROM e""", "snaps", "rawlev"))
def dq_snapshot_pairs(spark, d):
    return qc.snapshot_pairs(tables.snapshots(spark, d), tables.raw_levels(spark, d))


_RANGE = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n, min(source_us) AS first_us, max(source_us) AS last_us FROM {t}" for t in ("bbo", "trades", "snaps"))


@query(sql(f"WITH r AS ({_RANGE}) SELECT *, max(last_us) OVER () - last_us AS behind_us FROM r", "bbo", "trades", "snaps"))
def dq_table_ranges(spark, d):
    from pyspark.sql import Window

    one = lambda n, t: t.agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n"), F.min("source_us").alias("first_us"), F.max("source_us").alias("last_us"))
    rows = one("bbo", tables.quotes(spark, d)).unionByName(one("trades", tables.trades(spark, d))).unionByName(one("snaps", tables.snapshots(spark, d)))
    return rows.withColumn("behind_us", F.max("last_us").over(Window.partitionBy(F.lit(1))) - F.col("last_us"))


@query(sql("SELECT 'trade_id' AS k, trade_id AS v, count(*) AS n FROM trades GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'quote', asset_id || '@' || source_us, count(*) FROM bbo GROUP BY 2 HAVING count(*) > 1", "trades", "bbo"))
def dq_duplicates(spark, d):
    dup = lambda t, k, v: t.groupBy(F.lit(k).alias("k"), v.alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return dup(tables.trades(spark, d), "trade_id", F.col("trade_id")).unionByName(dup(tables.quotes(spark, d), "quote", F.concat("asset_id", F.lit("@"), "source_us")))


@query(sql("SELECT count_if(l.asset_id IS NOT NULL AND r.asset_id IS NOT NULL) AS both, count_if(r.asset_id IS NULL) AS left_only, count_if(l.asset_id IS NULL) AS right_only FROM (SELECT DISTINCT asset_id FROM bbo) l FULL JOIN (SELECT DISTINCT asset_id FROM trades) r ON l.asset_id = r.asset_id", "bbo", "trades"))
def dq_coverage(spark, d):
    return qc.coverage(tables.quotes(spark, d), tables.trades(spark, d))


@query(sql("SELECT max(bid_size) AS max_bid, max(ask_size) AS max_ask, (SELECT max(size) FROM trades) AS max_trade FROM bbo", "bbo", "trades"))
def dq_max_sizes(spark, d):
    sizes = tables.quotes(spark, d).select(F.col("bid_size").alias("b"), F.col("ask_size").alias("a"), F.lit(None).cast("double").alias("t"))
    sold = tables.trades(spark, d).select(F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("a"), F.col("size").alias("t"))
    return sizes.unionByName(sold).agg(F.max("b").alias("max_bid"), F.max("a").alias("max_ask"), F.max("t").alias("max_trade"))


_LAST = "QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY source_us DESC, event_id DESC) = 1"


@query(sql(f"""WITH l AS (SELECT * FROM bbo {_LAST}), s AS (SELECT asset_id, bid_prices[-1] AS best_bid, ask_prices[-1] AS best_ask, bid_sizes[-1] AS bid_size FROM snaps {_LAST})
SELECT count(*) AS assets, count_if(abs(lb - sb) / greatest(abs(lb), abs(sb), 1e-9) > 0.01) AS bid_drift, count_if(abs(la - sa) / greatest(abs(la), abs(sa), 1e-9) > 0.01) AS ask_drift, count_if(abs(lz - sz) / greatest(abs(lz), abs(sz), 1e-9) > 0.25) AS depth_drift,
 count_if(sided AND off <= 5) AS spread_match, count_if(sided AND off > 5) AS spread_drift, count_if(NOT coalesce(sided AND off IS NOT NULL, false)) AS spread_skipped
FROM (SELECT *, lb > 0 AND la > 0 AND sb > 0 AND sa > 0 AS sided, abs(p - (sa - sb) / ((sa + sb) / 2) * 10000) AS off FROM (SELECT l.best_bid AS lb, s.best_bid AS sb, l.best_ask AS la, s.best_ask AS sa, l.bid_size AS lz, s.bid_size AS sz, l.spread_bps AS p FROM l JOIN s USING (asset_id)))""", "bbo", "snaps"))
def dq_table_drift(spark, d):
    snaps = tables.snapshots(spark, d).select("asset_id", "source_us", "event_id", F.element_at("bid_prices", -1).alias("best_bid"), F.element_at("ask_prices", -1).alias("best_ask"), F.element_at("bid_sizes", -1).alias("bid_size"), F.element_at("ask_sizes", -1).alias("ask_size"))
    quotes = tables.quotes(spark, d).select(*snaps.columns, "spread_bps")
    newest = ["source_us", "event_id"]
    return qc.table_drift(latest_by(quotes, ["asset_id"], newest), latest_by(snaps, ["asset_id"], newest))


# --- the shapes used as latency probes


#: The as-of time of the probes: one hour after the feed's first row.
PROBE_AT = tables.START_US + 3_600_000_000


@query(sql(f"SELECT count(*) AS n FROM bbo WHERE source_us > {PROBE_AT} - 3600000000 AND source_us <= {PROBE_AT}", "bbo"))
def perf_count(spark, d):
    return tables.quotes(spark, d).where(F.col("source_us").between(PROBE_AT - 3_600_000_000 + 1, PROBE_AT)).agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT asset_id, count(*) AS n, round(avg(spread_bps), 6) AS avg_bps FROM bbo GROUP BY 1 ORDER BY n DESC, asset_id LIMIT 100", "bbo"))
def perf_by_asset(spark, d):
    return rounded(tables.quotes(spark, d).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.avg("spread_bps").alias("avg_bps")).orderBy(F.desc("n"), "asset_id").limit(100))


@query(sql("SELECT source_us // 60000000 AS minute, count(*) AS n, count(DISTINCT asset_id) AS assets FROM bbo GROUP BY 1", "bbo"))
def perf_by_minute(spark, d):
    return tables.quotes(spark, d).groupBy(F.floor(F.col("source_us") / 60_000_000).alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("asset_id").alias("assets"))


@query(sql("SELECT t.asset_id, count(*) AS pairs FROM trades t JOIN bbo b ON b.asset_id = t.asset_id AND b.source_us BETWEEN t.source_us - 60000000 AND t.source_us + 60000000 GROUP BY 1", "trades", "bbo"))
def perf_interval_join(spark, d):
    from tidebook.functions.temporal import interval_join

    t = tables.trades(spark, d).select("asset_id", F.col("source_us").alias("t_us"))
    b = tables.quotes(spark, d).select("asset_id", "source_us")
    return interval_join(t, b, ["asset_id"], "source_us", F.col("t_us") - 60_000_000, F.col("t_us") + 60_000_000, 120_000_000).groupBy("l.asset_id").agg(F.count(F.lit(1)).alias("pairs"))


# --- single checks of full snapshots, and value domains


def _shape(*columns):
    return lambda spark, d: qc.l2_shape(tables.snapshots(spark, d)).select("n", *columns)


for _name, _cols, _exprs in (
    ("dq_l2_crossed", ("crossed",), "count_if(ask_prices[-1] < bid_prices[-1]) AS crossed"),
    ("dq_l2_array_lengths", ("length", "one_sided"), "count_if(len(bid_prices) <> len(bid_sizes)) AS length, count_if(len(ask_prices) = 0) AS one_sided"),
    ("dq_l2_ordering", ("bid_order", "ask_order", "repeats"), "count_if(bid_prices <> list_sort(list_distinct(bid_prices))) AS bid_order, count_if(ask_prices <> list_reverse_sort(list_distinct(ask_prices))) AS ask_order, count_if(len(list_distinct(bid_prices)) < len(bid_prices)) AS repeats"),
):
    query(sql(f"SELECT count(*) AS n, {_exprs} FROM snaps", "snaps"), _name)(_shape(*_cols))


@query(sql("SELECT count(*) AS n, count_if(list_min(bid_sizes) < 0 OR list_min(ask_sizes) < 0) AS negative, count_if(abs((list_sum(bid_sizes) - list_sum(ask_sizes)) / (list_sum(bid_sizes) + list_sum(ask_sizes))) > 1) AS bad_imbalance, max(list_sum(bid_sizes) + list_sum(ask_sizes)) AS max_depth FROM snaps", "snaps"))
def dq_l2_depth(spark, d):
    rows = ingest.derive_l2_columns(tables.snapshots(spark, d))
    negative = F.exists(F.concat("bid_sizes", "ask_sizes"), lambda x: x < 0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(negative).alias("negative"), F.count_if(F.abs("book_imbalance") > 1).alias("bad_imbalance"), F.max(F.col("bid_depth") + F.col("ask_depth")).alias("max_depth"))


#: Allowed values of each domain (fixed values).
DOMAINS = {"side": ("BUY", "SELL"), "change_type": ("ADD", "REMOVE", "UPDATE"), "resolution": ("PENDING", "RESOLVED", "FAILED")}
_DOMAIN_SQL = " UNION ALL ".join(f"SELECT '{c}' AS domain, {c} AS v, count(*) AS n, {c} IN {v} AS allowed FROM {t} GROUP BY {c}" for (c, v), t in zip(DOMAINS.items(), ("trades", "levels", "gaps"), strict=True))


_TICK_SQL = "SELECT 'tick_size' AS domain, format('{:.3f}', tick_size) AS v, count(*) AS n, tick_size > 0 AND tick_size <= 0.1 AS allowed FROM bbo GROUP BY tick_size"


@query(sql(f"{_DOMAIN_SQL} UNION ALL {_TICK_SQL}", "trades", "levels", "gaps", "bbo"))
def dq_domains(spark, d):
    parts = [t(spark, d).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("domain"), "v", "n", F.col("v").isin(list(v)).alias("allowed")) for (c, v), t in zip(DOMAINS.items(), (tables.trades, _levels, _gaps), strict=True)]
    sizes = tables.quotes(spark, d).groupBy("tick_size").agg(F.count(F.lit(1)).alias("n"))
    parts.append(sizes.select(F.lit("tick_size").alias("domain"), F.format_string("%.3f", "tick_size").alias("v"), "n", ((F.col("tick_size") > 0) & (F.col("tick_size") <= 0.1)).alias("allowed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: Columns and types that the tables must have (fixed values).
CONTRACT = {
    "bbo": {"asset_id": "string", "condition_id": "string", "source_us": "bigint", "ingestion_us": "bigint", "book_hash": "string", "best_bid": "double", "best_ask": "double", "bid_size": "double", "ask_size": "double", "spread_bps": "double", "is_resync": "boolean", "sequence_number": "bigint"},
    "trades": {"asset_id": "string", "trade_id": "string", "price": "double", "size": "double", "side": "string", "source_us": "bigint"},
    "snaps": {"asset_id": "string", "condition_id": "string", "source_us": "bigint", "book_hash": "string", "bid_prices": "array<double>", "bid_sizes": "array<double>", "ask_prices": "array<double>", "ask_sizes": "array<double>"},
    "levels": {"asset_id": "string", "side": "string", "price": "double", "old_size": "double", "new_size": "double", "size_delta": "double", "change_type": "string"},
    "gaps": {"asset_id": "string", "detected_us": "bigint", "last_known_hash": "string", "new_hash": "string", "gap_duration_ms": "double", "resolution": "string"},
    "signals": {"market_a": "string", "market_b": "string", "edge_type": "string", "signal_source": "string", "user_id": "string", "strength": "double", "created_us": "bigint"},
}
#: How the other engine names the types (fixed values).
TYPE_NAMES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "HUGEINT": "decimal(38,0)", "DOUBLE": "double", "BOOLEAN": "boolean", "DOUBLE[]": "array<double>"}
_NAMED = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_NAMES.items()) + " ELSE k END"


def _contract_sql(table: str, columns: dict[str, str]) -> str:
    """Types as the engine finds them in the table; a column that isn't there has none."""
    found = ", ".join(f"any_value(typeof({c})) AS {c}" for c in columns)
    each = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS expected, {c} AS k FROM f" for c, k in columns.items())
    return f"SELECT '{table}' AS t, (SELECT count(*) FROM {table}) AS n, \"column\", expected, {_NAMED} AS found, expected = {_NAMED} AS passed FROM (WITH f AS (SELECT {found} FROM {table}) {each})"


@query(sql(" UNION ALL ".join(_contract_sql(t, c) for t, c in CONTRACT.items()), "bbo", "trades", "snaps", "levels", "gaps", "signals"))
def dq_schema_contract(spark, d):
    table = {"bbo": tables.quotes, "trades": tables.trades, "snaps": tables.snapshots, "levels": _levels, "gaps": _gaps, "signals": tables.edge_signals}
    out = None
    for name, columns in CONTRACT.items():
        one = qc.schema_contract(table[name](spark, d), name, columns)
        out = one if out is None else out.unionByName(one)
    return out
