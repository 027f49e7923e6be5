"""Rules over several markets."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.storage import broadcast_if_small
from tidebook.functions.temporal import asof_join
from tidebook.operators.graph import pair_signals
from tidebook.operators.history import plain
from tidebook.operators.signals import COMPARE, holds, value

IDLE_US = 60_000_000
STATELESS = ("PRICE_ABOVE", "PRICE_BELOW", "SPREAD_NARROW", "SPREAD_WIDE", "IMBALANCE_BID", "IMBALANCE_ASK", "SIZE_SPIKE", "CROSSED_BOOK", "EMPTY_BOOK")


def condition_states(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each tick of a market that a rule's condition watches, with
    whether the condition holds. ``rules`` has trigger_id, mode, needed and
    ``conditions``: array of (asset_id, type, threshold, side)."""
    each = rules.select("trigger_id", "mode", "needed", F.size("conditions").alias("n"), F.posexplode("conditions").alias("pos", "c"))
    rows = plain(ticks).join(broadcast_if_small(each), F.col("asset_id") == F.col("c.asset_id"))
    actual = F.coalesce(*[F.when((F.col("c.type") == k) & F.col("c.side").eqNullSafe(F.lit(s)), value(k, s).cast("double")) for k in STATELESS for s in (None, "BID", "ASK")])
    met = F.coalesce(*[F.when(F.col("c.type") == k, holds(k, F.col("_actual"), F.col("c.threshold"))) for k in STATELESS if k in COMPARE], F.lit(False))
    return rows.withColumn("_actual", actual).select("trigger_id", "mode", "needed", "n", "pos", "source_us", "event_id", F.coalesce(met, F.lit(False)).alias("met"))


def required(mode: str, needed, n):
    return n if mode == "ALL_OF" else 1 if mode == "ANY_OF" else needed


#: The length of the slices in which a rule's states are read.
SLICE_US = 3_600_000_000


class _Slice:
    """What a slice of a rule's states does to any conditions that hold at its start.

    Conditions are bits. Those that hold at the start count until their own first row,
    so between first rows only their number matters: ``fires`` tells, by stretch and
    number, what holds at the slice's end if the rule first fires in that stretch with
    so many. After a firing or an idle minute nothing holds, whatever the start was, so
    these courses are followed together and merge when they agree. At most a course for
    each pair of conditions is kept, and no rows.
    """

    def __init__(self, row):
        self.need, self.first, self.last = required(row.mode, row.needed, row.n), row.source_us, None
        self.own, self.untouched, self.idle = 0, (1 << row.n) - 1, False
        self.stretches, self.lowest = [], 0
        self.courses = {}  # what holds now -> the starts that came to it

    def add(self, row) -> None:
        bit = 1 << row.pos
        if self.last is not None and row.source_us - self.last > IDLE_US:
            merged = [k for starts in self.courses.values() for k in starts]
            self.courses = {0: merged if self.idle else [*merged, "idle"]}
            self.idle = True
        self.last = row.source_us
        moved = {}
        for holds_now, starts in self.courses.items():
            after = _with(holds_now, bit, row.met)
            after = 0 if after.bit_count() >= self.need else after
            moved[after] = [*moved[after], *starts] if after in moved else starts
        self.courses = moved
        if self.idle:
            return
        if self.untouched & bit or not self.stretches:
            self.untouched &= ~bit
            self.stretches.append(self.untouched)
            self.lowest = self.untouched.bit_count() + 1
        self.own = _with(self.own, bit, row.met)
        enough = max(self.need - self.own.bit_count(), 0)
        if enough < self.lowest:
            fired = [f"{len(self.stretches) - 1}:{k}" for k in range(enough, self.lowest)]
            self.courses[0] = [*self.courses.get(0, []), *fired]
            self.lowest = enough

    def summary(self) -> str:
        ends = {start: holds_now for holds_now, starts in self.courses.items() for start in starts}
        return json.dumps({"first": self.first, "last": self.last, "own": self.own, "stretches": self.stretches, "ends": ends})


def _with(holds_now: int, bit: int, met: bool) -> int:
    return holds_now | bit if met else holds_now & ~bit


def _after(summary: dict, start: int) -> int:
    """What holds at a slice's end, from what holds at its start."""
    ends = summary["ends"]
    for i, untouched in enumerate(summary["stretches"]):
        end = ends.get(f"{i}:{(start & untouched).bit_count()}")
        if end is not None:
            return end
    return ends["idle"] if "idle" in ends else summary["own"] | (start & summary["stretches"][-1])


def compound_eval(states: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Firings of each rule: the latest state of each condition is carried on,
    forgotten after a minute without a tick, and cleared when the rule fires.
    Rows without a time take no part.

    Clearing makes each firing depend on the last, so a rule's states are cut into
    slices of time. What a slice does to the conditions that hold before it is a small
    function (``_Slice``); a stream over a rule's slices, a row a slice, applies one
    after the other and tells what each starts with; then every slice is read alone.
    """
    rows = states.where("source_us IS NOT NULL").withColumn("_slice", F.floor(F.col("source_us") / slice_us))

    def summarize(batches):
        key, now = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name="Row"):
                if now is None or (r.trigger_id, r.slice) != key:
                    if now is not None:
                        out.append((*key, now.summary()))
                    key, now = (r.trigger_id, r.slice), _Slice(r)
                now.add(r)
            yield pd.DataFrame(out, columns=["trigger_id", "slice", "does"])
        if now is not None:
            yield pd.DataFrame([(*key, now.summary())], columns=["trigger_id", "slice", "does"])

    named = rows.withColumnRenamed("_slice", "slice")
    order = ["trigger_id", "slice", "source_us", "event_id", "pos"]
    done = named.repartition("trigger_id", "slice").sortWithinPartitions(*order).mapInPandas(summarize, "trigger_id string, slice long, does string")

    def chain(batches):
        rule, holds_now, last = None, 0, None
        for pdf in batches:
            out = []
            for trigger, at, does in pdf[["trigger_id", "slice", "does"]].itertuples(index=False, name=None):
                does = json.loads(does)
                if trigger != rule or (last is not None and does["first"] - last > IDLE_US):
                    rule, holds_now = trigger, 0
                out.append((trigger, at, f"{holds_now:x}", does["first"]))
                holds_now, last = _after(does, holds_now), does["last"]
            yield pd.DataFrame(out, columns=["trigger_id", "slice", "start", "source_us"])

    starts = done.repartition("trigger_id").sortWithinPartitions("trigger_id", "slice").mapInPandas(chain, "trigger_id string, slice long, start string, source_us long")

    def fold(batches):
        holds_now, last = 0, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name="Row"):
                if r.opens:
                    holds_now, last = int(r.start, 16), r.source_us
                    continue
                if r.source_us - last > IDLE_US:
                    holds_now = 0
                last = r.source_us
                holds_now = _with(holds_now, 1 << int(r.pos), r.met)
                if holds_now.bit_count() >= required(r.mode, r.needed, r.n):
                    out.append((r.trigger_id, r.source_us, r.event_id, holds_now.bit_count()))
                    holds_now = 0
            yield pd.DataFrame(out, columns=["trigger_id", "source_us", "event_id", "held"])

    blank = {c: F.lit(0).cast(states.schema[c].dataType) for c in ("needed", "n", "pos", "event_id")}
    opened = starts.withColumns({"opens": F.lit(True), "met": F.lit(False), "mode": F.lit(""), **blank})
    both = named.withColumns({"opens": F.lit(False), "start": F.lit("")}).unionByName(opened)
    ordered = both.repartition("trigger_id", "slice").sortWithinPartitions("trigger_id", "slice", F.desc("opens"), "source_us", "event_id", "pos")
    return ordered.mapInPandas(fold, "trigger_id string, source_us long, event_id long, held int")


def compound_eval_stateless(states: DataFrame, at: int) -> DataFrame:
    """Rules that hold on each market's latest quote at a time."""
    last = states.where(F.col("source_us") <= at).groupBy("trigger_id", "mode", "needed", "n", "pos").agg(F.max_by("met", F.struct("source_us", "event_id")).alias("met"))
    rows = last.groupBy("trigger_id", "mode", "needed", "n").agg(F.count_if("met").alias("held"))
    want = F.when(F.col("mode") == "ALL_OF", F.col("n")).when(F.col("mode") == "ANY_OF", F.lit(1)).otherwise(F.col("needed"))
    return rows.select("trigger_id", "held", (F.col("held") >= want).alias("fires"))


def trigger_miss_decay(states: DataFrame, fired: DataFrame, rules: DataFrame, every: int = 100) -> DataFrame:
    """Negative edge signals for all pairs of a rule's markets, on each
    ``every``-th evaluation in a row without a firing. ``rules`` has trigger_id,
    user_id, edge_type and ``markets``; a rule of one market gives none."""
    hit = fired.select("trigger_id", "source_us", "event_id", F.lit(1).alias("hit"))
    evals = states.select("trigger_id", "source_us", "event_id").distinct()
    rows = evals.join(hit, ["trigger_id", "source_us", "event_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("trigger_id").orderBy("source_us", "event_id")
    rows = rows.withColumn("island", F.sum("hit").over(w))
    run = Window.partitionBy("trigger_id", "island").orderBy("source_us", "event_id")
    rows = rows.withColumn("misses", F.sum(1 - F.col("hit")).over(run))
    due = rows.where((F.col("hit") == 0) & (F.col("misses") % every == 0)).select("trigger_id", "source_us", "misses")
    named = due.join(rules.select("trigger_id", "user_id", "edge_type", "markets"), "trigger_id").withColumn("signal_source", F.lit("trigger_miss"))
    return pair_signals(named)


def quotes_at(ticks: DataFrame, moments: DataFrame) -> DataFrame:
    """Quotes in force at given (asset_id, source_us) moments."""
    return asof_join(moments, ticks, ["asset_id"], "source_us", ["best_bid", "best_ask"])
