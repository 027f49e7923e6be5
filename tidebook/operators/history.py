"""Quotes with what their past tells, by slices of time.

No window reads an asset's whole history: rows are dealt by asset and slice, so an
asset with a third of all rows spreads over its slices. A slice holds its own rows, a
halo with the end of the slice before, as long as the longest trailing window, and one
first row that carries what was true before the halo: the last mid, the last sizes, the
run of moves, and the time of the first quote after the slice. These come from a row for
each asset and slice, combined before the shuffle and scanned in order.

Rows without a time are a slice of their own before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.storage import spread

#: The length of a slice; a longer trailing window makes longer slices.
SLICE_US = 3_600_000_000
#: The slice of rows without a time.
NO_TIME = -(1 << 40)
_KEY = ("asset_id", "_slice")


def order():
    return Window.partitionBy(*_KEY).orderBy("source_us", "event_id")


def trailing(window_us: int):
    return Window.partitionBy(*_KEY).orderBy("source_us").rangeBetween(-window_us, 0)


def plain(ticks: DataFrame) -> DataFrame:
    """Quotes with what they tell by themselves; nothing is shuffled."""
    c = F.col
    total = c("bid_size") + c("ask_size")
    return ticks.withColumns({"mid": (c("best_bid") + c("best_ask")) / 2, "imb": F.when(total > 0, (c("bid_size") - c("ask_size")) / total), "micro": F.when(total > 0, (c("best_bid") * c("ask_size") + c("best_ask") * c("bid_size")) / total), "_own": F.lit(True)})


def _moves(rows: DataFrame) -> DataFrame:
    """The last mid before each row of a slice, and which way the mid went."""
    rows = rows.withColumn("mid_before", F.last("mid", ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1)))
    step = F.col("mid") - F.col("mid_before")
    return rows.withColumns({"ret": F.when(F.col("mid_before") > 0, step / F.col("mid_before")), "move": F.when(F.col("mid") != F.col("mid_before"), F.signum(step).cast("int"))})


def _runs(rows: DataFrame) -> DataFrame:
    """Moves in a row in one direction, up to each row; before the slice's first turn
    the run that its carried row tells goes on."""
    before = F.last(F.coalesce("move", "_direction"), ignorenulls=True).over(order().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_turn", (F.col("move").isNotNull() & ~F.col("move").eqNullSafe(before)).cast("int"))
    rows = rows.withColumns({"island": F.sum("_turn").over(order()), "_direction0": F.first("_direction").over(order()), "_run0": F.first("_run").over(order())})
    run = Window.partitionBy(*_KEY, "island").orderBy("source_us", "event_id")
    counted, ahead = F.count("move").over(run), F.col("island") == 0
    rows = rows.withColumn("direction", F.when(ahead, F.col("_direction0")).otherwise(F.first("move", ignorenulls=True).over(run)))
    return rows.withColumn("run", F.when(F.col("direction").isNotNull(), counted + F.when(ahead, F.col("_run0")).otherwise(0)))


def _trends(rows: DataFrame, carried: DataFrame, n: int) -> DataFrame:
    """The run at the end of each slice that has moves, halo included.

    A slice whose moves all go one way lengthens the run of the slices before it; any
    other one starts a run of its own."""
    own = ["asset_id", "_slice", "source_us", "event_id", "mid"]
    blank = {"_direction": F.lit(None).cast("int"), "_run": F.lit(None).cast("long")}
    both = rows.withColumn("_slice", F.col("_reach")).select(*own).unionByName(carried.select(*own)).withColumns(blank)
    last = F.max_by(F.struct("island", "run", "direction"), F.struct("source_us", "event_id"))
    ends = _runs(_moves(spread(both, _KEY, n))).groupBy(*_KEY).agg(last.alias("_e")).select(*_KEY, "_e.*").where("island > 0")
    by = Window.partitionBy("asset_id").orderBy("_slice")
    goes_on = (F.col("island") == 1) & F.col("direction").eqNullSafe(F.lag("direction").over(by))
    ends = ends.withColumn("_turn", (~goes_on).cast("int")).withColumn("_turns", F.sum("_turn").over(by))
    total = F.sum("run").over(Window.partitionBy("asset_id", "_turns").orderBy("_slice"))
    return ends.select(F.col("asset_id").alias("_asset"), F.col("_slice").alias("_at"), F.struct(total.alias("run"), "direction").alias("_trend"))


def prepare(ticks: DataFrame, window_ms: int = 0, runs: bool = True, slice_us: int = SLICE_US) -> DataFrame:
    """Quotes with what several signals need, in slices with a halo of ``window_ms``.

    Windows by ``order`` and ``trailing`` are right on rows with ``_own``; the others
    (halo and carried rows) are there for them and go once the values are columns.
    ``run`` and ``direction`` are there only if ``runs``.
    """
    halo = window_ms * 1000
    width = max(slice_us, halo)

    def part(at: Column) -> Column:
        return F.coalesce(((at - F.pmod(at, F.lit(width))) / width).cast("long"), F.lit(NO_TIME))

    at, n = F.col("source_us"), ticks.count()
    rows = plain(ticks).drop("_own").withColumns({"_home": part(at), "_reach": part(at + halo)})
    near = rows.withColumn("_slice", F.explode(F.array_distinct(F.array("_home", "_reach"))) if halo else F.col("_home"))

    # what each slice adds: up to the halo of the next one, and where its own rows begin
    seen = F.when(F.col("_reach") == F.col("_slice"), F.struct("source_us", "event_id"))
    ends = near.groupBy(*_KEY).agg(
        F.max_by("mid", F.when(F.col("mid").isNotNull(), seen)).alias("mid"), F.max_by(F.struct("bid_size", "ask_size"), seen).alias("_sizes"),
        F.min(F.when(F.col("_home") == F.col("_slice"), at)).alias("_began"),
    )
    past = Window.partitionBy("asset_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("asset_id").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w=past: F.last(c, ignorenulls=True).over(w)
    carried = ends.withColumns({"mid": before("mid"), "_sizes": before("_sizes"), "_next_us": before("_began", later)})
    starts, timed = F.when(F.col("_slice") != NO_TIME, F.col("_slice")) * width - halo - 1, F.col("_slice") != NO_TIME
    carried = carried.select(*_KEY, starts.alias("source_us"), F.lit(None).cast(ticks.schema["event_id"].dataType).alias("event_id"), "mid", "_sizes.bid_size", "_sizes.ask_size", "_next_us")
    if runs:
        trends = _trends(rows, carried.where(timed), n)
        carried = carried.join(trends, F.col("asset_id").eqNullSafe(F.col("_asset")) & (F.col("_slice") == F.col("_at")), "left").drop("_asset", "_at")
        carried = carried.withColumn("_trend", before("_trend")).select("*", F.col("_trend.run").alias("_run"), F.col("_trend.direction").alias("_direction")).drop("_trend")

    # nothing comes before the slice of rows without a time
    both = _moves(spread(near.unionByName(carried.where(timed), allowMissingColumns=True), _KEY, n))
    both = _runs(both) if runs else both
    next_us = F.coalesce(F.lead("source_us").over(order()), F.first("_next_us").over(order()))
    both = both.withColumns({"bid_before": F.lag("bid_size").over(order()), "ask_before": F.lag("ask_size").over(order()), "silence_us": next_us - at})
    return both.withColumn("_own", F.coalesce(F.col("_home") == F.col("_slice"), F.lit(False)))
