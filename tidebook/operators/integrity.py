"""Hash chains, feed gaps and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _order():
    return Window.partitionBy("asset_id").orderBy("source_us", "event_id")

DAY_US = 86_400_000_000


def hash_chain_dedupe(ticks: DataFrame) -> DataFrame:
    """Ticks whose hash differs from the last accepted one; resyncs pass.

    Among ticks that aren't resyncs the last accepted hash is the last hash, as
    equal ones in a row leave it as it is.
    """
    rows = ticks.withColumn("_last", F.lag("book_hash").over(Window.partitionBy("asset_id", "is_resync").orderBy("source_us", "event_id")))
    return rows.where(F.col("is_resync") | ~F.col("_last").eqNullSafe(F.col("book_hash"))).drop("_last")


def hash_chain_gaps(accepted: DataFrame, min_us: int = 30_000_000, forget_us: int = DAY_US) -> DataFrame:
    rows = accepted.withColumn("last_known_hash", F.lag("book_hash").over(_order())).withColumn("dt", F.col("source_us") - F.lag("source_us").over(_order()))
    gaps = rows.where((F.col("dt") > min_us) & (F.col("dt") <= forget_us))
    return gaps.select("asset_id", F.col("source_us").alias("detected_us"), "last_known_hash", F.col("book_hash").alias("new_hash"), (F.col("dt") / 1000).alias("gap_duration_ms"), "event_id")


def with_resolution(gaps: DataFrame) -> DataFrame:
    """A state for each gap, as an audit log would have it."""
    states = F.array(*[F.lit(x) for x in ("PENDING", "RESOLVED", "FAILED")])
    return gaps.withColumn("resolution", F.element_at(states, (F.col("event_id") % 3 + 1).cast("int")))


def chain_sequence(accepted: DataFrame) -> DataFrame:
    return accepted.withColumn("chain_seq", F.row_number().over(_order()))


def gap_resolution_summary(gaps: DataFrame, as_of: int) -> DataFrame:
    """Gaps by resolution, and the share of all gaps that are resolved (100 of none)."""
    stale = (F.col("resolution") == "PENDING") & (F.col("detected_us") < as_of - 3_600_000_000)
    each = gaps.groupBy("resolution").agg(F.count(F.lit(1)).alias("gaps"), F.avg("gap_duration_ms").alias("avg_ms"), F.max("gap_duration_ms").alias("max_ms"), F.count_if(stale).alias("stale_pending"))
    fixed = F.coalesce(F.sum(F.when(F.col("resolution") == "RESOLVED", F.col("gaps"))), F.lit(0))
    # one row of two numbers
    rate = each.agg((fixed * 100 / F.sum("gaps")).alias("resolution_rate"))
    return each.join(F.broadcast(rate))


def _with_resyncs(gaps: DataFrame, ticks: DataFrame, until) -> DataFrame:
    """Resolved gaps with the number of resyncs from their detection to ``until``."""
    from tidebook.functions.temporal import interval_join

    fixed = gaps.where("resolution = 'RESOLVED'").select("asset_id", "detected_us", "event_id", until.alias("until_us"))
    resync = ticks.where("is_resync").select("asset_id", "source_us")
    joined = interval_join(fixed, resync, ["asset_id"], "source_us", F.col("detected_us"), F.col("until_us"), 300_000_000, "left")
    return joined.groupBy("l.asset_id", "l.event_id").agg(F.count("r.source_us").alias("n"))


def gap_resync_match(gaps: DataFrame, ticks: DataFrame) -> DataFrame:
    """Resolved gaps with and without a resync tick in the 5 minutes after."""
    each = _with_resyncs(gaps, ticks, F.col("detected_us") + 300_000_000)
    return each.groupBy("asset_id").agg(F.count(F.lit(1)).alias("resolved"), F.count_if(F.col("n") == 0).alias("without_resync"))


def gap_resync_windows(gaps: DataFrame, ticks: DataFrame, slack_us: int = 60_000_000) -> DataFrame:
    """Each resolved gap with the resyncs from its detection to a minute after it
    would have ended (detection and its length), and whether there is one."""
    end = (F.col("detected_us") + F.col("gap_duration_ms") * 1000).cast("long")
    each = _with_resyncs(gaps, ticks, end + slack_us)
    return each.select("asset_id", "event_id", F.col("n").alias("resyncs"), (F.col("n") > 0).alias("resynced"))


def gap_resync_totals(windows: DataFrame) -> DataFrame:
    """Assets with gaps and with resyncs, gaps, and gaps with a resync."""
    by_asset = windows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("gaps"), F.count_if("resynced").alias("fixed"))
    return by_asset.agg(F.count(F.lit(1)).alias("gap_assets"), F.count_if(F.col("fixed") > 0).alias("resync_assets"), F.sum("gaps").alias("total_gaps"), F.sum("fixed").alias("gaps_with_resync"))


def stale_assets(ticks: DataFrame, as_of: int, min_rows: int = 10) -> DataFrame:
    recent = ticks.where(F.col("source_us") > as_of - 7 * DAY_US)
    rows = recent.groupBy("asset_id").agg(F.max("source_us").alias("last_us"), F.count(F.lit(1)).alias("n")).where(F.col("n") > min_rows)
    age = F.lit(as_of) - F.col("last_us")
    return rows.select("asset_id", "n", age.alias("age_us"), (age > 60_000_000).alias("stale_book"), (age > 21_600_000_000).alias("stale_6h"), (age > DAY_US).alias("stale_1d"))
