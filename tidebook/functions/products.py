"""Correlations of many series by products of blocks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.storage import worker_imports

#: Series and steps of time in a block.
SERIES, STEPS = 256, 1800
#: A variance below this share of the mean square is rounding: the series stands still.
FLAT = 1e-11


def _dense(part: pd.DataFrame, steps: np.ndarray, names: list[bytes], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """A block as values and presence, series by steps."""
    value, there = np.zeros((len(names), len(steps))), np.zeros((len(names), len(steps)))
    at = np.searchsorted(steps, part["step"].to_numpy())
    row = np.fromiter((place[n] for n in part["series"]), np.int64, len(part))
    value[row, at], there[row, at] = part["value"], 1.0
    return value, there


class _Sums:
    """Counts and moments of all pairs of two blocks' series over their common steps."""

    def __init__(self):
        self.names: tuple[list, list] = ([], [])
        self.place: tuple[dict, dict] = ({}, {})
        self.total = np.zeros((6, 0, 0))

    def add(self, left: pd.DataFrame, right: pd.DataFrame) -> None:
        for side, part in enumerate((left, right)):
            for name in part["series"].unique():
                if name not in self.place[side]:
                    self.place[side][name] = len(self.names[side])
                    self.names[side].append(name)
        rows, cols = len(self.names[0]), len(self.names[1])
        if self.total.shape[1:] != (rows, cols):
            self.total = np.pad(self.total, ((0, 0), (0, rows - self.total.shape[1]), (0, cols - self.total.shape[2])))
        steps = np.intersect1d(left["step"], right["step"])
        left, right = left[left["step"].isin(steps)], right[right["step"].isin(steps)]
        x, p = _dense(left, steps, self.names[0], self.place[0])
        y, q = _dense(right, steps, self.names[1], self.place[1])
        for k, (a, b) in enumerate(((p, q), (x, q), (p, y), (x * x, q), (p, y * y), (x, y))):
            self.total[k] += a @ b.T

    def result(self, same: bool, min_common: int) -> pd.DataFrame:
        n, sx, sy, sxx, syy, sxy = self.total
        keep = n >= min_common
        keep &= np.tri(*n.shape, -1, bool).T if same else True
        i, j = np.nonzero(keep)
        n, sx, sy, sxx, syy, sxy = (t[i, j] for t in (n, sx, sy, sxx, syy, sxy))
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        flat = (vx <= FLAT * n * sxx) | (vy <= FLAT * n * syy)
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.where(flat, np.nan, (n * sxy - sx * sy) / np.sqrt(vx * vy))
        a, b = np.array(self.names[0], object)[i], np.array(self.names[1], object)[j]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "r": np.clip(r, -1, 1), "n": n.astype(np.int64)})


def correlations(rows: DataFrame, min_common: int, shift: float = 0.0, series: int = SERIES, steps: int = STEPS) -> DataFrame:
    """(series, step, value), one row for each, to (a, b, r, n): the correlation of
    each pair of series over the steps that both have, if those are enough (no r where
    one of them stands still).

    Series are dealt to blocks by hash and time is cut into slices. A block of a
    slice goes to all blocks as one packed row, so a value is copied once for
    each ``series`` series there are, not for each series that shares its step; a
    task then takes all slices of a pair of blocks one after the other and adds up six
    matrix products of each. It holds two packed blocks and the sums of one pair of
    blocks. ``shift`` is taken from the values first, against rounding.
    """
    worker_imports(rows.sparkSession)
    spark = rows.sparkSession
    blocks = max(1, -(-rows.select("series").distinct().count() // series))
    dealt = rows.where("value is not null").select(F.pmod(F.xxhash64("series"), F.lit(blocks)).cast("int").alias("block"), F.floor(F.col("step") / steps).alias("slice"), "series", F.col("step").cast("long").alias("step"), (F.col("value") - shift).alias("value"))
    # a block of a slice has at most so many values as it has series and steps
    packed = dealt.groupBy("block", "slice").agg(F.collect_list("series").alias("names"), F.collect_list("step").alias("at"), F.collect_list("value").alias("values"))
    as_left = packed.withColumns({"i": F.col("block"), "j": F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))), "side": F.lit(0)})
    as_right = packed.where("block > 0").withColumns({"j": F.col("block"), "i": F.explode(F.sequence(F.lit(0), F.col("block") - 1)), "side": F.lit(1)})
    cells = as_left.unionByName(as_right).select("i", "j", "slice", "side", "names", "at", "values")
    cells = cells.repartition(max(1, min(blocks * (blocks + 1) // 2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))), "i", "j").sortWithinPartitions("i", "j", "slice", "side")

    def run(batches):
        now, sums, held = None, None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if now != (r.i, r.j):
                    if sums is not None:
                        yield sums.result(now[0] == now[1], min_common)
                    now, sums, held = (r.i, r.j), _Sums(), None
                part = pd.DataFrame({"series": r.names, "step": np.asarray(r.at, np.int64), "value": np.asarray(r.values, np.float64)})
                if r.i == r.j:
                    sums.add(part, part)
                elif r.side == 0:
                    held = (r.slice, part)
                elif held is not None and held[0] == r.slice:
                    sums.add(held[1], part)
        if sums is not None:
            yield sums.result(now[0] == now[1], min_common)

    return cells.mapInPandas(run, "a string, b string, r double, n long")
