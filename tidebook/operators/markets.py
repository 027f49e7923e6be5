"""Market listings, quotes, bars and quality profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.quantiles import percentiles

DAY_US = 86_400_000_000


def market_tokens(meta: DataFrame) -> DataFrame:
    """A row for each token of a market; text that isn't a list is one token."""
    ids = F.coalesce(F.from_json("clob_token_ids", "array<string>"), F.array("clob_token_ids"))
    return meta.select("*", F.posexplode(ids).alias("pos", "asset_id"))


def activity(ticks: DataFrame, as_of: int, window_us: int = DAY_US) -> DataFrame:
    return ticks.where(F.col("source_us") > as_of - window_us).groupBy("asset_id").agg(F.count(F.lit(1)).alias("tick_count"), F.max("best_bid").alias("high"), F.min("best_bid").alias("low"))


def list_markets(tokens: DataFrame, ticks: DataFrame, as_of: int, limit: int, offset: int = 0, active: bool | None = None) -> DataFrame:
    """A page of tokens by activity, with the total and whether more follow."""
    rows = tokens.join(activity(ticks, as_of).select("asset_id", "tick_count"), "asset_id", "left").withColumn("tick_count", F.coalesce("tick_count", F.lit(0)))
    if active is not None:
        rows = rows.where((F.col("end_us") > as_of) == F.lit(active))
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    page = rows.orderBy(F.desc("tick_count"), "end_us", "asset_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def search_markets(tokens: DataFrame, query: str, as_of: int, limit: int) -> DataFrame:
    hit = F.instr(F.lower("question"), query.lower()) > 0
    return tokens.where(hit & (F.col("end_us") > as_of)).orderBy("end_us", "asset_id").limit(limit)


def top_activity_market(tokens: DataFrame, ticks: DataFrame, as_of: int, window_us: int = 600_000_000) -> DataFrame:
    counts = activity(ticks, as_of, window_us).select("asset_id", "tick_count")
    return tokens.where(F.col("end_us") > as_of).join(counts, "asset_id").orderBy(F.desc("tick_count"), "asset_id").limit(1)


def latest_bbo(ticks: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("source_us", "best_bid", "best_ask", "bid_size", "ask_size"), F.struct("source_us", "event_id")).alias("l")
    return ticks.groupBy("asset_id").agg(last).select("asset_id", "l.*")


def market_detail(tokens: DataFrame, ticks: DataFrame, as_of: int) -> DataFrame:
    """Metadata, latest quote and a day's count, high and low, in one pass."""
    recent = F.col("source_us") > as_of - DAY_US
    last = F.max_by(F.struct("best_bid", "best_ask"), F.struct("source_us", "event_id")).alias("l")
    stats = ticks.groupBy("asset_id").agg(last, F.count_if(recent).alias("ticks_24h"), F.max(F.when(recent, F.col("best_bid"))).alias("high_24h"), F.min(F.when(recent, F.col("best_bid"))).alias("low_24h"))
    return tokens.join(stats, "asset_id").select("asset_id", "condition_id", "question", "category", "end_us", "l.best_bid", "l.best_ask", "ticks_24h", "high_24h", "low_24h")


def export_ticks(ticks: DataFrame, asset: str, start: int, end: int, limit: int) -> DataFrame:
    return ticks.where((F.col("asset_id") == asset) & F.col("source_us").between(start, end)).orderBy("source_us", "sequence_number").limit(limit)


def ohlc_bars(ticks: DataFrame, width_us: int = 60_000_000) -> DataFrame:
    """Open and close of bid, ask and mid, average spread, ticks and sequence."""
    at = F.struct("source_us", "event_id")
    bucket = (F.floor(F.col("source_us") / width_us) * width_us).alias("bar_us")
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    edge = lambda c, n: [F.min_by(c, at).alias(f"open_{n}"), F.max_by(c, at).alias(f"close_{n}")]
    return ticks.groupBy("asset_id", bucket).agg(
        *edge(F.col("best_bid"), "bid"), *edge(F.col("best_ask"), "ask"), *edge(mid, "mid"),
        F.avg("spread_bps").alias("avg_spread_bps"), F.count(F.lit(1)).alias("ticks"), F.min("sequence_number").alias("seq_start"), F.max("sequence_number").alias("seq_end"),
    )


def ohlc_high_low(ticks: DataFrame, width_us: int) -> DataFrame:
    return ticks.groupBy("asset_id", (F.floor(F.col("source_us") / width_us) * width_us).alias("bar_us")).agg(F.max("best_bid").alias("high"), F.min("best_bid").alias("low"))


def backtest_assets(ticks: DataFrame, min_ticks: int, limit: int) -> DataFrame:
    rows = ticks.groupBy("asset_id").agg(F.count(F.lit(1)).alias("ticks"), F.min("source_us").alias("first_us"), F.max("source_us").alias("last_us"), F.countDistinct(F.floor(F.col("source_us") / DAY_US)).alias("days"))
    return rows.where(F.col("ticks") >= min_ticks).orderBy(F.desc("ticks"), "asset_id").limit(limit)


def latency_ms() -> Column:
    return (F.col("ingestion_us") - F.col("source_us")) / 1000


def _with_percentiles(stats: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of groups with their latency percentiles beside them."""
    q = percentiles(rows, keys, latency_ms(), [0.5, 0.95, 0.99])
    q = q.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return stats.join(q, on, "left").drop(*[f"_{k}" for k in keys])


def asset_quality(ticks: DataFrame) -> DataFrame:
    rows = ticks.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("ticks"), F.min("source_us").alias("first_us"), F.max("source_us").alias("last_us"), F.count_if("is_resync").alias("resyncs"),
        F.min("sequence_number").alias("seq_min"), F.max("sequence_number").alias("seq_max"), F.countDistinct("sequence_number").alias("seq_unique"),
    )
    gap = 1 - F.col("seq_unique") / (F.col("seq_max") - F.col("seq_min") + 1)
    return _with_percentiles(rows, ticks, ["asset_id"]).select("asset_id", "ticks", "first_us", "last_us", "p50", "p95", "p99", "resyncs", "seq_min", "seq_max", "seq_unique", gap.alias("gap_ratio"))


def hourly_latency_stats(rows: DataFrame) -> DataFrame:
    """Percentiles by hour and kind, from (source_us, ingestion_us, kind)."""
    rows = rows.withColumn("hour_us", F.floor(F.col("source_us") / 3_600_000_000) * 3_600_000_000)
    counts = rows.groupBy("hour_us", "kind").agg(F.count(F.lit(1)).alias("n"))
    return _with_percentiles(counts, rows, ["hour_us", "kind"]).select("hour_us", "kind", "n", "p50", "p95", "p99")


def ended_markets(tokens: DataFrame, as_of: int) -> DataFrame:
    return tokens.select("asset_id", "condition_id", F.coalesce(F.col("end_us") < as_of, F.lit(False)).alias("ended"), F.coalesce("neg_risk", F.lit(False)).alias("neg_risk"), F.lit(0.01).alias("tick_size"))


def lifecycle_events(meta: DataFrame, notified: DataFrame, as_of: int) -> DataFrame:
    """New and resolved markets that weren't told of within 7 days or 1 day."""
    new = meta.where("active and not closed").select("id", "condition_id", F.lit("NEW_MARKET").alias("event"), F.lit(7 * DAY_US).alias("ttl"))
    done = meta.where("closed").select("id", "condition_id", F.lit("RESOLVED").alias("event"), F.lit(DAY_US).alias("ttl"))
    told = notified.select(F.col("id").alias("_id"), F.col("event").alias("_event"), "notified_us")
    same = (F.col("id") == F.col("_id")) & (F.col("event") == F.col("_event")) & (F.col("notified_us") > F.lit(as_of) - F.col("ttl"))
    return new.unionByName(done).join(told, same, "left_anti").drop("ttl")


def upsert_metadata(versions: DataFrame) -> DataFrame:
    """The newest version of each market, text blanks and flags made regular."""
    rows = versions.withColumns({"question": F.substring(F.coalesce(F.trim("question"), F.lit("")), 1, 10_000), "category": F.coalesce("category", F.lit("")), "neg_risk": F.col("neg_risk").cast("int"), "active": F.col("active").cast("int"), "closed": F.col("closed").cast("int")})
    from tidebook.functions.temporal import latest_by

    return latest_by(rows, ["condition_id", "id"], ["inserted_us"])


def explode_market_events(markets: DataFrame) -> DataFrame:
    """(id, events array, inserted_us) to the newest row of each (event, market)."""
    rows = markets.select(F.col("id").alias("market_id"), "inserted_us", F.explode("events").alias("e")).select("market_id", "inserted_us", "e.*")
    from tidebook.functions.temporal import latest_by

    return latest_by(rows, ["event_id", "market_id"], ["inserted_us"])
