"""Queries that run a streaming operator over a table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions.storage import new_path, worker_imports
from tidebook.operators import signals
from tidebook.plans.base_sql import sql
from tidebook.plans.ingest_plans import greedy_sql
from tidebook.plans.registry import query, rounded
from tidebook.plans.signal_plans import PAIRS, _rules_sql
from tidebook.sources import tables
from tidebook.streaming import feeds


#: Slices of a table by time; a micro-batch takes one.
SLICES = 3


def _feed(spark, table, order="source_us", cuts=None):
    """A table as a file stream: slices by time, written one after the other,
    each by all tasks into as many files as a micro-batch takes. A row of padding
    gives every task a file, so a batch never takes files of the next slice."""
    worker_imports(spark)
    path = new_path(spark, "feed")
    files = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    cuts = cuts or table.agg(F.expr(f"percentile_approx({order}, array({', '.join(str(i / SLICES) for i in range(1, SLICES))}))")).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    dealt = table.withColumns({"_to": F.pmod(F.xxhash64(order), F.lit(files)).cast("int"), "_pad": F.lit(False)})
    padding = spark.range(files).select(F.col("id").cast("int").alias("_to"), F.lit(True).alias("_pad"))
    for low, high in zip(edges, edges[1:], strict=False):
        part = dealt if low is None else dealt.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part = part.unionByName(padding, allowMissingColumns=True).repartitionById(files, "_to")
        part.write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    feed = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", files).parquet(path)
    return feed.where(~F.col("_pad")).select(*table.columns)


@query(sql("SELECT day::VARCHAR AS day, count(*) AS n FROM (SELECT strftime(make_timestamp(source_us), '%Y-%m-%d') AS day FROM bbo) GROUP BY 1", "bbo"))
def stream_ingest(spark, d):
    path = new_path(spark, "ingest")
    feeds.stream_ingest(_feed(spark, tables.quotes(spark, d)), path, new_path(spark, "ckpt"), availableNow=True).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("""SELECT asset_id, source_us // 60000000 * 60000000 AS bar_us, round(min_by((best_bid + best_ask) / 2, (source_us, event_id)), 6) AS open_mid, round(max_by((best_bid + best_ask) / 2, (source_us, event_id)), 6) AS close_mid, count(*) AS ticks FROM bbo
GROUP BY 1, 2 HAVING bar_us + 60000000 <= (SELECT max(source_us) // 1000 * 1000 - 60000000 FROM bbo)""", "bbo"))
def stream_bars(spark, d):
    """Bars whose window the watermark has passed."""
    return rounded(feeds.run_to_end(feeds.stream_bars(_feed(spark, tables.quotes(spark, d))), "bars", spark, new_path(spark, "ckpt")))


@query(sql("SELECT event_id, asset_id, book_hash, CASE WHEN dt > 30000000 AND dt <= 86400000000 THEN dt END AS gap_us FROM (SELECT *, source_us - lag(source_us) OVER (PARTITION BY asset_id ORDER BY source_us, event_id) AS dt FROM accepted)", "accepted"))
def stream_hash_chain(spark, d):
    out = feeds.run_to_end(feeds.stream_hash_chain(_feed(spark, tables.quotes(spark, d))), "chain", spark, new_path(spark, "ckpt"))
    return out.select("event_id", "asset_id", "book_hash", "gap_us")


#: Rows of the feed that come after their time, and the ends of what arrives together.
_DELAYED = "CASE WHEN event_id % 50 = 7 THEN 150000000 ELSE 0 END"
_ARRIVALS = [tables.START_US + s * 1_000_000 for s in (40, 100, 200)]
_BATCH = "CASE " + " ".join(f"WHEN source_us + {_DELAYED} <= {t} THEN {i}" for i, t in enumerate(_ARRIVALS)) + f" ELSE {len(_ARRIVALS)} END"


@query(sql(f"""WITH r AS (SELECT *, {_BATCH} AS batch FROM bbo), b AS (SELECT DISTINCT batch FROM r), n AS (SELECT b.batch, max(source_us) - 60000000 AS bound_us FROM b JOIN r ON r.batch < b.batch GROUP BY 1)
SELECT event_id, asset_id, source_us, coalesce(source_us < bound_us, false) AS late, CASE WHEN source_us < bound_us THEN bound_us END AS bound_us FROM r LEFT JOIN n USING (batch)""", "bbo"))
def stream_late_rows(spark, d):
    """All quotes, in a feed where every 50th comes 150 s after its time: late ones
    are kept beside the others, with the bound that they missed."""
    quotes = tables.quotes(spark, d).select("event_id", "asset_id", "source_us").withColumn("arrival_us", F.expr(f"source_us + {_DELAYED}"))
    kept, late = new_path(spark, "on-time"), new_path(spark, "late")
    feeds.stream_keeping_late(_feed(spark, quotes, "arrival_us", _ARRIVALS), kept, late, new_path(spark, "ckpt"), 60_000_000, availableNow=True).awaitTermination()
    columns = ["event_id", "asset_id", "source_us"]
    told = spark.read.parquet(late).select(*columns, F.lit(True).alias("late"), "bound_us")
    return spark.read.parquet(kept).select(*columns, F.lit(False).alias("late"), F.lit(None).cast("long").alias("bound_us")).unionByName(told)


_STREAMED = [r for r in signals.production_rules() if r[1] in signals.COMPARE]


@query(sql(greedy_sql(f"WITH {_rules_sql(_STREAMED)} SELECT rule_id, asset_id, source_us, event_id, wait FROM fired", "asset_id, rule_id, wait", "p.wait", "rule_id, asset_id, source_us, event_id"), "bbo"))
def stream_signals(spark, d):
    """The wildcard rules over the stream, each with its cooldown per asset."""
    rules = [(i, k, t, s, w, cd) for i, k, t, s, w, cd, _ in _STREAMED]
    return feeds.run_to_end(feeds.stream_signals(_feed(spark, tables.quotes(spark, d)), rules), "signals", spark, new_path(spark, "ckpt")).select("rule_id", "asset_id", "source_us", "event_id")


@query(sql(f"WITH {PAIRS} SELECT condition_id, event_id, source_us, round(best_ask + o.a, 6) AS total FROM y WHERE best_ask + o.a < 0.99", "bbo"))
def stream_pair_arbitrage(spark, d):
    return rounded(feeds.run_to_end(feeds.stream_pair_arbitrage(_feed(spark, tables.quotes(spark, d)), 0.99), "pairs", spark, new_path(spark, "ckpt")))


_SILENCE = 12_345_000
_QUIET = f"NOT (cast(asset_id AS int) % 10 = 3 AND source_us > {tables.START_US + 30_000_000})"


@query(sql(f"""WITH q AS (SELECT *, lead(source_us) OVER (PARTITION BY asset_id ORDER BY source_us, event_id) AS nxt FROM bbo WHERE {_QUIET})
SELECT asset_id, source_us AS last_us FROM q WHERE nxt - source_us > {_SILENCE} OR (nxt IS NULL AND (source_us + {_SILENCE}) // 1000 < (SELECT max(source_us) // 1000 - 60000 FROM q))""", "bbo"))
def stream_stale_quotes(spark, d):
    """Silences of over 12 s; every tenth asset says nothing after half a minute."""
    heard = tables.quotes(spark, d).where(_QUIET)
    return feeds.run_to_end(feeds.stream_stale_quotes(_feed(spark, heard), _SILENCE), "stale", spark, new_path(spark, "ckpt"))


@query(sql("SELECT DISTINCT trade_id FROM trades", "trades"))
def stream_dedupe(spark, d):
    out = feeds.stream_dedupe(_feed(spark, tables.trades(spark, d)), ["trade_id"])
    return feeds.run_to_end(out, "dedupe", spark, new_path(spark, "ckpt")).select("trade_id")


@query(sql("SELECT signal_source, count(*) AS n FROM signals GROUP BY 1", "signals"))
def stream_edge_signals(spark, d):
    path = new_path(spark, "signals")
    feeds.stream_edge_signals(_feed(spark, tables.edge_signals(spark, d), "created_us"), path, new_path(spark, "ckpt"), availableNow=True).awaitTermination()
    return spark.read.parquet(path).groupBy("signal_source").agg(F.count(F.lit(1)).alias("n"))
