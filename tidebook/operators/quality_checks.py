"""Data-quality checks: metrics of a table held against limits.

A check is a row set and named aggregates. Row checks name only expressions, so
one scan serves all checks of a table; ordered ones add lag columns first;
checks across tables join or group before they count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.temporal import asof_join, interval_join

_MID = "((best_bid + best_ask) / 2)"


@dataclass(frozen=True)
class Check:
    """Aggregates over a table; ``passed`` is a condition on them."""

    table: str
    metrics: dict[str, str]
    passed: str
    group: tuple[str, ...] = ()


#: Aggregates that need no more than one row at a time.
CHECKS = {
    "dq_spread_formula": Check("bbo", {"n": "count(spread_bps)", "bad": f"count_if(best_bid > 0 AND best_ask > 0 AND abs(spread_bps - (best_ask - best_bid) / {_MID} * 10000) > 1)"}, "bad = 0"),
    "dq_book_state": Check("bbo", {"n": "count(*)", "two_sided": "count_if(best_bid > 0 AND best_ask > 0)", "crossed": "count_if(best_bid > best_ask)", "locked": "count_if(best_bid = best_ask)", "worst": "max(best_bid - best_ask)"}, "crossed * 100 < two_sided OR two_sided = 0"),
    "dq_price_range": Check("bbo", {"n": "count(*)", "bad_bid": "count_if(best_bid < 0 OR best_bid > 1)", "bad_ask": "count_if(best_ask < 0 OR best_ask > 1)", "min_bid": "min(best_bid)", "max_ask": "max(best_ask)"}, "bad_bid = 0 AND bad_ask = 0"),
    "dq_negative_spread": Check("bbo", {"n": "count(*)", "bad": "count_if(best_bid <= best_ask AND spread_bps < 0)"}, "bad = 0"),
    "dq_positive_size": Check("bbo", {"n": "count(*)", "bad_bid": "count_if(best_bid > 0 AND bid_size <= 0)", "bad_ask": "count_if(best_ask > 0 AND ask_size <= 0)"}, "bad_bid = 0 AND bad_ask = 0"),
    "dq_trade_fields": Check("sales", {"n": "count(*)", "bad_price": "count_if(price <= 0 OR price >= 1)", "bad_size": "count_if(size <= 0)", "bad_side": "count_if(side NOT IN ('BUY', 'SELL'))", "bad_notional": "count_if(abs(notional - price * size) > 0.0001)", "bad_latency": "count_if(abs(latency_ms - (ingestion_us - source_us) / 1000) > 1)", "volume": "sum(size)", "max_latency": "max(latency_ms)"}, "bad_price = 0 AND bad_size = 0 AND bad_side = 0 AND bad_notional = 0 AND bad_latency = 0"),
    "dq_time_travel": Check("times", {"n": "count(*)", "early": "count_if(ingestion_us < source_us)", "early_pct": "count_if(ingestion_us < source_us) * 100 / count(*)", "min_us": "min(ingestion_us - source_us)", "max_us": "max(ingestion_us - source_us)"}, "early = 0", ("t",)),
    "dq_ts_precision": Check("bbo", {"n": "count(*)", "whole_ms": "count_if(source_us % 1000 = 0)", "whole_s": "count_if(source_us % 1000000 = 0)"}, "whole_s < n OR n = 0"),
    "dq_level_changes": Check("levels", {"n": "count(*)", "bad_delta": "count_if(abs(size_delta - (new_size - old_size)) > 0.000001)", "bad_add": "count_if(change_type = 'ADD' AND (old_size <> 0 OR new_size <= 0))", "bad_remove": "count_if(change_type = 'REMOVE' AND new_size <> 0)", "bad_update": "count_if(change_type = 'UPDATE' AND (old_size <= 0 OR new_size <= 0))", "bad_side": "count_if(side NOT IN ('BUY', 'SELL'))"}, "bad_delta = 0 AND bad_add = 0 AND bad_remove = 0 AND bad_update = 0 AND bad_side = 0"),
    "dq_required_fields": Check("hashed", {"n": "count(*)", "blank": "count_if(asset_id IS NULL OR asset_id = '' OR condition_id IS NULL OR condition_id = '' OR book_hash IS NULL OR book_hash = '')", "bad_asset": "count_if(NOT regexp_like(asset_id, '^[0-9]+$'))", "short_hash": "count_if(length(book_hash) < 10)", "bad_hash": "count_if(NOT regexp_like(book_hash, '^[a-f0-9]+$'))"}, "blank = 0 AND bad_asset = 0 AND short_hash = 0 AND bad_hash = 0", ("t",)),
    "dq_coverage_by_asset": Check("bbo", {"n": "count(*)", "first_us": "min(source_us)", "last_us": "max(source_us)"}, "n > 1 AND last_us > first_us", ("asset_id",)),
    "dq_side_domain": Check("trades", {"n": "count(*)"}, "side IN ('BUY', 'SELL')", ("side",)),
    "dq_change_domain": Check("levels", {"n": "count(*)"}, "side IN ('BUY', 'SELL') AND change_type IN ('ADD', 'REMOVE', 'UPDATE')", ("side", "change_type")),
    "dq_resolution_domain": Check("gaps", {"n": "count(*)"}, "resolution IN ('PENDING', 'RESOLVED', 'FAILED')", ("resolution",)),
    "dq_duplicate_trades": Check("trades", {"n": "count(*)", "unique_ids": "count(DISTINCT trade_id)"}, "n = unique_ids"),
}


def run_check(table: DataFrame, check: Check) -> DataFrame:
    got = table.groupBy(*check.group).agg(*[F.expr(e).alias(k) for k, e in check.metrics.items()])
    return got.withColumn("passed", F.coalesce(F.expr(check.passed), F.lit(True)))


def l2_shape(snaps: DataFrame) -> DataFrame:
    """Array lengths, order, repeats, crossing and depth of full snapshots."""
    up = lambda c, sign: F.forall(F.sequence(F.lit(1), F.size(c) - 1), lambda i: (F.get(c, i) - F.get(c, i - 1)) * sign > 0)
    rows = snaps.select(
        (F.size("bid_prices") != F.size("bid_sizes")).alias("length"), (F.size("ask_prices") == 0).alias("one_sided"), (~up("bid_prices", 1)).alias("bid_order"), (~up("ask_prices", -1)).alias("ask_order"),
        (F.size(F.array_distinct("bid_prices")) < F.size("bid_prices")).alias("repeats"), (F.element_at("ask_prices", -1) < F.element_at("bid_prices", -1)).alias("crossed"),
        F.exists(F.concat("bid_sizes", "ask_sizes"), lambda x: x < 0).alias("negative"),
    )
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in rows.columns])


def lags(ticks: DataFrame) -> DataFrame:
    """Time and sequence steps of each asset's feed."""
    w = Window.partitionBy("asset_id").orderBy("source_us", "event_id")
    return ticks.withColumn("dt", F.col("source_us") - F.lag("source_us").over(w)).withColumn("ds", F.col("sequence_number") - F.lag("sequence_number").over(w))


def time_gaps(ticks: DataFrame, low_us: int = 30_000_000, high_us: int = 3_600_000_000) -> DataFrame:
    """Gaps over ``low_us`` and over ``high_us`` between rows of an asset. Quotes
    are looked at from 30 s and 1 h, trades from 30 and 60 minutes."""
    w = Window.partitionBy("asset_id").orderBy("source_us", "event_id")
    rows = ticks.withColumn("dt", F.col("source_us") - F.lag("source_us").over(w))
    return rows.groupBy("asset_id").agg(F.count_if((F.col("dt") > low_us) & (F.col("dt") <= high_us)).alias("gaps"), F.count_if(F.col("dt") > high_us).alias("long_gaps"), F.max("dt").alias("max_us"), F.avg("dt").alias("avg_us"))


def sequence_steps(ticks: DataFrame) -> DataFrame:
    return lags(ticks).groupBy("asset_id").agg(F.count_if(F.col("ds") > 1).alias("jumps"), F.count_if(F.col("ds") < 0).alias("back"), F.count_if(F.col("ds") > 1000).alias("far"), F.avg("ds").alias("mean_step"), F.count_if(F.col("sequence_number") <= 0).alias("not_positive"))


def monotonic(ticks: DataFrame) -> DataFrame:
    """Times that go back when rows are taken by sequence number."""
    w = Window.partitionBy("asset_id").orderBy("sequence_number", "event_id")
    rows = ticks.withColumn("back", F.col("ingestion_us") - F.lag("ingestion_us").over(w) < 0)
    return rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("regressions"))


def chronological(trades: DataFrame, arrival: str = "event_id") -> DataFrame:
    """Trades whose time lies before that of the trade that came before them."""
    w = Window.partitionBy("asset_id").orderBy(arrival)
    rows = trades.withColumn("back", F.col("source_us") < F.lag("source_us").over(w))
    return rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("back").alias("regressions"))


def hash_change_rate(ticks: DataFrame, min_rows: int = 5) -> DataFrame:
    each = ticks.groupBy("asset_id").agg(F.countDistinct("book_hash").alias("h"), F.count(F.lit(1)).alias("n")).where(F.col("n") > min_rows)
    return each.agg(F.count(F.lit(1)).alias("assets"), F.avg(F.col("h") / F.col("n")).alias("avg_rate"), F.min(F.col("h") / F.col("n")).alias("min_rate"))


def hash_duplicates(ticks: DataFrame) -> DataFrame:
    """Hashes that repeat in an asset, and how many quotes they stand for."""
    quote = F.concat_ws("|", F.coalesce(F.col("best_bid").cast("string"), F.lit("-")), F.coalesce(F.col("best_ask").cast("string"), F.lit("-")))
    return ticks.groupBy("asset_id", "book_hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(quote).alias("quotes")).where("n > 1")


def referential(children: DataFrame, *parents: DataFrame) -> DataFrame:
    """Children by asset with and without a row of the asset in any parent."""
    known = None
    for p in parents:
        known = p.select("asset_id") if known is None else known.unionByName(p.select("asset_id"))
    known = known.distinct().withColumn("known", F.lit(True))
    return children.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).join(known, "asset_id", "left").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("known").isNull()).alias("orphans"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"))


def condition_mapping(left: DataFrame, right: DataFrame) -> DataFrame:
    pick = lambda t: t.groupBy("asset_id").agg(F.countDistinct("condition_id").alias("c"), F.min("condition_id").alias("one"))
    l, r = pick(left).withColumnsRenamed({"c": "lc", "one": "lo"}), pick(right).withColumnsRenamed({"c": "rc", "one": "ro"})
    return l.join(r, "asset_id", "full").agg(F.count_if(F.col("lc") > 1).alias("several"), F.count_if(F.col("lo") != F.col("ro")).alias("mismatch"), F.count_if(F.col("lo").isNull() | F.col("ro").isNull()).alias("one_table_only"))


def bbo_vs_l2(ticks: DataFrame, snaps: DataFrame) -> DataFrame:
    """Quotes against snapshots of the same asset and second."""
    sec = F.floor(F.col("source_us") / 1_000_000).alias("sec")
    l = ticks.select("asset_id", sec, "best_bid", "best_ask", F.col("source_us").alias("t"))
    r = snaps.select("asset_id", sec, F.element_at("bid_prices", -1).alias("b"), F.element_at("ask_prices", -1).alias("a"), F.col("source_us").alias("u"))
    return l.join(r, ["asset_id", "sec"]).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.abs(F.col("best_bid") - F.col("b")) > 1e-9).alias("bid_differs"), F.count_if(F.abs(F.col("best_ask") - F.col("a")) > 1e-9).alias("ask_differs"), F.avg(F.abs(F.col("t") - F.col("u"))).alias("avg_us"))


def trade_vs_quote(trades: DataFrame, ticks: DataFrame, slack: float = 0.01, side_slack: float = 0.001) -> DataFrame:
    """Trades outside the quote that was in force: beyond either side by ``slack``,
    buys below the bid and sells above the ask by ``side_slack``. Quotes of one
    side only aren't held against."""
    rows = asof_join(trades.select("asset_id", "source_us", "event_id", "price", "side"), ticks.where("best_bid is not null"), ["asset_id"], "source_us", ["best_bid", "best_ask"])
    bid, ask, price, edge = F.col("asof_best_bid"), F.col("asof_best_ask"), F.col("price"), 1e-9
    held = (bid > 0) & (ask > 0)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(held).alias("quoted"), F.count_if(held & (price > ask + slack + edge)).alias("above"), F.count_if(held & (price < bid - slack - edge)).alias("below"),
        F.count_if(held & (F.col("side") == "BUY") & (price < bid - side_slack - edge)).alias("buy_below_bid"), F.count_if(held & (F.col("side") == "SELL") & (price > ask + side_slack + edge)).alias("sell_above_ask"),
    )


def depth_vs_deltas(snaps: DataFrame, changes: DataFrame) -> DataFrame:
    minute = F.floor(F.col("source_us") / 60_000_000).alias("minute")
    total = F.aggregate(F.concat("bid_sizes", "ask_sizes"), F.lit(0.0), lambda s, x: s + x)
    d = snaps.groupBy("asset_id", minute).agg(F.min(total).alias("low"), F.max(total).alias("high"), F.count(F.lit(1)).alias("snaps"))
    c = changes.groupBy("asset_id", minute).agg(F.count(F.lit(1)).alias("deltas"), F.sum("size_delta").alias("net"))
    return d.join(c, ["asset_id", "minute"], "left").withColumns({"deltas": F.coalesce("deltas", F.lit(0)), "net": F.coalesce("net", F.lit(0.0))})


def deltas_in_depth(snaps: DataFrame, changes: DataFrame) -> DataFrame:
    """Minutes of an asset that have changes and snapshots: how much changed, and
    by how much the depth of either side moved."""
    minute = F.floor(F.col("source_us") / 60_000_000).alias("minute")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    moved = lambda c: F.max(total(c)) - F.min(total(c))
    d = snaps.groupBy("asset_id", minute).agg(moved("bid_sizes").alias("bid_range"), moved("ask_sizes").alias("ask_range"), F.count(F.lit(1)).alias("snaps"))
    c = changes.groupBy("asset_id", minute).agg(F.count(F.lit(1)).alias("changes"), F.sum(F.abs("size_delta")).alias("changed"))
    both = c.join(d, ["asset_id", "minute"])
    moves = (F.col("bid_range") > 0) | (F.col("ask_range") > 0)
    return both.agg(F.count(F.lit(1)).alias("minutes"), F.count_if((F.col("changed") > 0) & (F.col("snaps") > 0)).alias("active"), F.avg("changes").alias("avg_changes"), F.count_if((F.col("changed") > 0) & moves).alias("reflected"))


def snapshot_pairs(snaps: DataFrame, changes: DataFrame, width: int = 60_000_000) -> DataFrame:
    """Neighbouring snapshots at most a minute apart, and changes in between."""
    w = Window.partitionBy("asset_id").orderBy("source_us", "event_id")
    pairs = snaps.select("asset_id", "event_id", F.lag("source_us").over(w).alias("from_us"), F.col("source_us").alias("to_us"), (F.lag("book_hash").over(w) != F.col("book_hash")).alias("changed"))
    pairs = pairs.where(F.col("to_us") - F.col("from_us") <= width)
    joined = interval_join(pairs, changes.select("asset_id", "source_us"), ["asset_id"], "source_us", F.col("from_us") + 1, F.col("to_us"), width, "left")
    each = joined.groupBy("l.asset_id", "l.event_id").agg(F.count("r.source_us").alias("deltas"), F.max("l.changed").alias("changed"))
    return each.agg(F.count(F.lit(1)).alias("pairs"), F.sum("deltas").alias("deltas"), F.count_if("changed").alias("changed"), F.count_if(F.col("changed") & (F.col("deltas") > 0)).alias("explained"))


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    l, r = left.select("asset_id").distinct().withColumn("l", F.lit(True)), right.select("asset_id").distinct().withColumn("r", F.lit(True))
    return l.join(r, "asset_id", "full").agg(F.count_if(F.col("l") & F.col("r")).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def snapshot_frequency(snaps: DataFrame, min_minutes: int = 60, worst: int = 20) -> DataFrame:
    """Minutes a snapshot of the assets that were watched for over an hour, the
    least often seen first. Minutes are those of the clock that were crossed."""
    minute = lambda c: F.floor(c / 60_000_000)
    rows = snaps.groupBy("asset_id").agg(F.count(F.lit(1)).alias("snapshots"), F.min("source_us").alias("first_us"), F.max("source_us").alias("last_us"))
    rows = rows.withColumn("minutes", minute(F.col("last_us")) - minute(F.col("first_us"))).where(F.col("minutes") > min_minutes)
    rows = rows.withColumn("minutes_per_snapshot", F.col("minutes") / F.col("snapshots"))
    return rows.orderBy(F.desc("minutes_per_snapshot"), "asset_id").limit(worst)


def table_drift(left: DataFrame, right: DataFrame, tolerance: float = 0.01, spread_bps: float = 5.0) -> DataFrame:
    """Latest quotes of two copies: relative drift, and spreads (the stored one of
    the left, that of the right's mid) that differ by over ``spread_bps``."""
    rel = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.greatest(F.abs(F.col(a)), F.abs(F.col(b)), F.lit(1e-9))
    both = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns if c != "asset_id"}).join(right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c != "asset_id"}), "asset_id")
    live = (F.col("r_best_ask") - F.col("r_best_bid")) / ((F.col("r_best_ask") + F.col("r_best_bid")) / 2) * 10_000
    sided = (F.col("l_best_bid") > 0) & (F.col("l_best_ask") > 0) & (F.col("r_best_bid") > 0) & (F.col("r_best_ask") > 0)
    off = F.abs(F.col("l_spread_bps") - live)
    return both.agg(
        F.count(F.lit(1)).alias("assets"), F.count_if(rel("l_best_bid", "r_best_bid") > tolerance).alias("bid_drift"), F.count_if(rel("l_best_ask", "r_best_ask") > tolerance).alias("ask_drift"), F.count_if(rel("l_bid_size", "r_bid_size") > 0.25).alias("depth_drift"),
        F.count_if(sided & (off <= spread_bps)).alias("spread_match"), F.count_if(sided & (off > spread_bps)).alias("spread_drift"), F.count_if(~F.coalesce(sided & off.isNotNull(), F.lit(False))).alias("spread_skipped"),
    )


def schema_contract(table: DataFrame, name: str, contract: dict[str, str]) -> DataFrame:
    """A row for each contracted column: its type there, none if it is missing,
    and the table's rows. Only the table's schema is compared; rows are counted."""
    found = dict(table.dtypes)
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("expected"), F.lit(found.get(c)).cast("string").alias("found")) for c, t in contract.items()]))
    each = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n", rows)
    return each.withColumn("passed", F.col("expected").eqNullSafe(F.col("found")))
