"""Time-series helpers: latest rows, as-of and interval joins, cooldowns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; of several one that a hash of them picks, so
    that reruns agree. An aggregate, so it combines before the shuffle and a hot key
    costs no more than a row from each task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, carry: list[str], strict: bool = False, tie: str | None = None) -> DataFrame:
    """Each left row with ``carry`` of the last right row at or before it.

    Both sides are stacked and ordered together, so a key is read once and the
    result needs one shuffle; right rows come before left ones at equal time
    (after them if ``strict``). Keys with very long histories can be cut by
    adding a time bucket to ``keys`` when the right side has a row in each.
    """
    first, second = (1, 0) if strict else (0, 1)
    ties = [tie] if tie else []
    packed = F.struct(F.col(order).alias("_at"), *carry)
    rows = left.withColumn("_side", F.lit(second)).withColumn("_r", F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType))
    feed = right.select(*keys, order, *ties, F.lit(first).alias("_side"), packed.alias("_r"))
    both = rows.unionByName(feed, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == second)
    return found.select(*left.columns, *[F.col(f"_f.{c}").alias(f"asof_{c}") for c in ["_at", *carry]]).withColumnRenamed("asof__at", "asof_at")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: Column, high: Column, width: int, how: str = "inner") -> DataFrame:
    """Left rows with right rows whose ``at`` lies in [low, high] of the left.

    Time is cut into buckets of ``width``; a left row is copied to the buckets
    its interval touches, so the join is an equi-join on key and bucket.
    """
    spans = left.withColumn("_low", low).withColumn("_high", high)
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    dated = right.withColumn("_bucket", F.floor(F.col(at) / width))
    l, r = spans.alias("l"), dated.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_bucket"]]
    on.append(F.col(f"r.{at}").between(F.col("l._low"), F.col("l._high")))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return l.join(r, cond, how)


#: The length of the slices in which a cooldown is worked out.
SLICE_US = 3_600_000_000


def _exits(at: np.ndarray, wait: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How a slice maps the last kept time before it to the last kept one in it.

    ``at`` is in order. The first row kept after time L is the first whose time less
    its wait is L or later, so the running maximum of these differences tells every
    row's successor; following successors, two, four, ... steps at once, tells the
    last row of each chain. The result is a step function: up to ``upto[i]`` as the
    last time the slice leaves ``left[i]``; beyond all it leaves that time as it is.
    """
    due = np.maximum.accumulate(at - wait)
    after = np.searchsorted(due, at)
    # only rows without a wait can find themselves or one of their time before them
    for i in np.flatnonzero(after <= np.arange(len(at))):
        after[i] = next((j for j in range(i + 1, len(at)) if at[j] - wait[j] >= at[i]), len(at))
    after = np.append(after, len(at))
    last = np.append(np.where(after[:-1] == len(at), np.arange(len(at)), after[:-1]), len(at))
    while (last[last] != last).any():
        last = last[last]
    left = at[last[:-1]]
    seen = np.searchsorted(due, at[0]) + 1
    due, left = due[:seen], left[:seen]
    ends = np.flatnonzero(np.append(left[1:] != left[:-1], True))
    return due[ends], left[ends]


def _edges(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where runs of rows that are equal in some columns begin."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = table.column(c).combine_chunks().dictionary_encode()
        codes = codes.indices if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks().indices
        codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _slices(table: pa.Table, edges: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """``_exits`` of each run of rows."""
    at, wait = (table.column(c).to_numpy() for c in ("_at", "_wait"))
    found = [_exits(at[a:b], wait[a:b]) for a, b in zip(edges, np.append(edges[1:], len(at)), strict=True)]
    lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (0, 1)]
    firsts = table.select(columns).take(pa.array(edges)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in firsts.columns), *lists], [*columns, "upto", "left"])


def cooldown(df: DataFrame, keys: list[str], at: str, tie: str, wait: str, slice_us: int = SLICE_US) -> DataFrame:
    """Rows kept greedily: each at least ``wait`` after the last kept of its key.

    A greedy choice depends on all earlier ones, so it isn't a window function. A
    key's rows are cut into slices of time instead. What a slice does to the last kept
    time is a step function of few steps (``_exits``); a stream over a key's slices
    applies one after the other, a row a slice, and tells the time each starts with;
    then every slice is read alone, as a sorted stream that holds one time. So a key
    of very many rows spreads over its slices.
    """
    number = lambda c: F.col(c).cast("bigint")
    rows = df.withColumns({"_at": number(at), "_wait": number(wait)}).withColumn("_slice", F.floor(F.col("_at") / slice_us))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    group = [*keys, "_slice"]

    def step(batches):
        held = None  # rows of the slice that the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            edges = _edges(table, group)
            if len(edges) > 1:
                yield _slices(table.slice(0, edges[-1]), edges[:-1], group)
            held = table.slice(edges[-1]) if len(edges) else None
        if held is not None and held.num_rows:
            yield _slices(held, np.zeros(1, np.int64), group)

    each = rows.select(*group, "_at", "_wait", F.col(tie).alias("_tie")).repartition(*group).sortWithinPartitions(*group, "_at", "_tie")
    steps = each.drop("_tie").mapInArrow(step, f"{kinds}, _slice long, upto array<long>, left array<long>")

    def chain(batches):
        now, last = None, None
        for pdf in batches:
            entry = []
            for *key, upto, left in pdf[[*keys, "upto", "left"]].itertuples(index=False, name=None):
                if now is None or any(a != b and not (a != a and b != b) for a, b in zip(now, key, strict=True)):
                    now, last = key, None
                entry.append(last)
                i = 0 if last is None else int(np.searchsorted(upto, last))
                last = int(left[i]) if i < len(left) else last
            yield pdf[[*keys, "_slice"]].assign(_at=pd.array(entry, "Int64"))

    starts = steps.repartition(*keys).sortWithinPartitions(*keys, "_slice").mapInPandas(chain, f"{kinds}, _slice long, _at long")
    both = rows.withColumn("_starts", F.lit(False)).unionByName(starts.withColumn("_starts", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", F.desc("_starts"), "_at", tie)

    def fold(batches):
        last = None
        for batch in batches:
            keep = []
            for first, t, w in zip(*(batch.column(c).to_pylist() for c in ("_starts", "_at", "_wait")), strict=True):
                kept = not first and (last is None or t - last >= w)
                last = t if kept or first else last
                keep.append(kept)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(fold, dealt.schema).select(*df.columns)
