"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column) -> Column:
    """A number that never falls as the value grows; 64 to each doubling, NaN last."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * 64) + 131_072
    return F.when(F.isnan(value), F.lit(1 << 40)).when(value == 0, F.lit(0)).otherwise((F.signum(value) * size).cast("long")).cast("long")


def percentiles(df: DataFrame, keys: list[str], value: Column, points: list[float]) -> DataFrame:
    """``q``: the interpolated percentiles of a value in each group (null keys are a
    group; null values don't count, and a group without others has no row).

    ``percentile`` keeps every distinct value of a group in one buffer. Here equal
    values are counted, combining before the shuffle; counts are summed by buckets of
    near values, at most some 270,000 a group; running sums over a group's buckets tell
    which hold the wanted ranks; and only those buckets' counts are put in order.
    """
    counts = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _bucket(F.col("_v")))
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy("_b"))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n")).withColumns({"_from": upto - F.col("_n"), "_upto": upto, "_total": F.sum("_n").over(group)})
    spots = [F.lit(p) * (F.col("_total") - 1) for p in points]
    ranks = F.array_distinct(F.array(*[f(s).cast("long") for s in spots for f in (F.floor, F.ceil)]))
    inside = lambda r: (r >= F.col("_from")) & (r < F.col("_upto"))
    hit = buckets.withColumn("_ranks", F.filter(ranks, inside)).where(F.size("_ranks") > 0)
    hit = hit.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_hb"), F.col("_from").alias("_start"), "_total", "_ranks")
    on = F.col("_b") == F.col("_hb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    found = counts.join(hit, on).withColumns({"_from": upto - F.col("_n"), "_upto": upto}).withColumn("_at", F.filter("_ranks", inside)).where(F.size("_at") > 0)
    pairs = F.flatten(F.collect_list(F.transform("_at", lambda r: F.struct(r.alias("k"), F.col("_v").alias("v")))))
    each = found.groupBy(*keys).agg(F.first("_total").alias("_total"), F.map_from_entries(pairs).alias("_m"))

    def point(spot: Column) -> Column:
        low, high = (F.element_at("_m", f(spot).cast("long")) for f in (F.floor, F.ceil))
        return F.when(F.floor(spot) == F.ceil(spot), low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    return each.select(*keys, F.array(*[point(s) for s in spots]).alias("q"))
