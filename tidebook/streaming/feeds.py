"""Streaming forms of the operators, on the same kernels as the batch ones.

Event time is a timestamp column ``ts``; rows later than the watermark are left
to the batch checks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.operators.signals import COMPARE, WINDOWED

WATERMARK = "60 seconds"
WATERMARK_US = 60_000_000
DAY_US = 86_400_000_000


def with_time(df: DataFrame, column: str = "source_us") -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(column))


def stream_ingest(feed: DataFrame, path: str, checkpoint: str, **trigger):
    """Append a feed to a table partitioned by day, in micro-batches."""
    rows = with_time(feed).withColumn("day", F.to_date("ts"))

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").partitionBy("day").parquet(path)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(append).start()


def stream_bars(feed: DataFrame, width: str = "1 minute") -> DataFrame:
    """Tumbling bars of the mid."""
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    at = F.when(mid.isNotNull(), F.struct("source_us", "event_id"))
    bars = with_time(feed).withWatermark("ts", WATERMARK).groupBy("asset_id", F.window("ts", width).alias("w"))
    return bars.agg(F.min_by(mid, at).alias("open_mid"), F.max_by(mid, at).alias("close_mid"), F.count(F.lit(1)).alias("ticks")).select("asset_id", F.unix_micros("w.start").alias("bar_us"), "open_mid", "close_mid", "ticks")


def stream_dedupe(feed: DataFrame, keys: list[str]) -> DataFrame:
    return with_time(feed).withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(keys)


def stream_hash_chain(feed: DataFrame) -> DataFrame:
    """Accepted ticks with the gap before them; state is a hash and a time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_hash, last_any, last_us = state.get if state.exists else (None, None, None)
        out = []
        for r in pd.concat(list(batches)).sort_values(["source_us", "event_id"]).itertuples(index=False):
            if not r.is_resync and r.book_hash == last_hash:
                continue
            gap = r.source_us - last_us if last_us is not None else None
            out.append((key[0], r.event_id, r.source_us, r.book_hash, last_any, gap if gap is not None and 30_000_000 < gap <= DAY_US else None))
            if not r.is_resync:
                last_hash = r.book_hash
            last_any, last_us = r.book_hash, r.source_us
        if last_us is not None:
            state.update((last_hash, last_any, last_us))
            state.setTimeoutTimestamp(max(last_us // 1000 + 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["asset_id", "event_id", "source_us", "book_hash", "last_hash", "gap_us"]).astype({"gap_us": "Int64"})

    rows = with_time(feed).withWatermark("ts", WATERMARK).select("asset_id", "event_id", "source_us", "book_hash", "is_resync", "ts")
    out = "asset_id string, event_id long, source_us long, book_hash string, last_hash string, gap_us long"
    return rows.groupBy("asset_id").applyInPandasWithState(step, out, "last_hash string, last_any string, last_us long", "append", GroupStateTimeout.EventTimeTimeout)


#: Trailing quotes that an asset's state holds: age and number, and those of its imbalances.
KEPT_US, KEPT_ROWS, KEPT_SHIFT = 60_000_000, 1000, 100
_STATE = "at array<long>, mid array<double>, imb array<double>, ret array<double>, bid double, ask double, last_mid double, run int, direction int, last_us long, last_event long, fired array<long>"


class _Quotes:
    """An asset's trailing quotes, and the value of each signal on the newest."""

    def __init__(self, state: tuple | None, rules: int):
        empty = ([], [], [], [], None, None, None, 0, 0, None, None, [None] * rules)
        self.at, self.mid, self.imb, self.ret, self.bid, self.ask, self.last_mid, self.run, self.direction, self.last_us, self.last_event, self.fired = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in (state or empty))

    def state(self) -> tuple:
        return (self.at, self.mid, self.imb, self.ret, self.bid, self.ask, self.last_mid, self.run, self.direction, self.last_us, self.last_event, self.fired)

    def take(self, r) -> None:
        """Move on to the next quote; ``before`` keeps what it replaces."""
        self.before = (self.bid, self.ask, self.last_us, self.last_event)
        bid, ask, self.bid, self.ask = *((None if pd.isna(x) else float(x)) for x in (r.best_bid, r.best_ask, r.bid_size, r.ask_size)),
        self.best_bid, self.best_ask, self.spread = bid, ask, None if pd.isna(r.spread_bps) else float(r.spread_bps)
        mid = (bid + ask) / 2 if bid is not None and ask is not None else None
        total = self.bid + self.ask if self.bid is not None and self.ask is not None else 0
        imb = (self.bid - self.ask) / total if total > 0 else None
        self.micro = (bid * self.ask + ask * self.bid) / total if total > 0 and mid is not None else None
        ret = (mid - self.last_mid) / self.last_mid if mid is not None and self.last_mid and self.last_mid > 0 else None
        if mid is not None and self.last_mid is not None and mid != self.last_mid:
            way = 1 if mid > self.last_mid else -1
            self.run, self.direction = (self.run + 1 if way == self.direction else 1), way
        self.last_mid = mid if mid is not None else self.last_mid
        self.last_us, self.last_event = int(r.source_us), int(r.event_id)
        for kept, x in ((self.at, self.last_us), (self.mid, mid), (self.imb, imb), (self.ret, ret)):
            kept.append(x)
        drop = max(sum(t < self.last_us - KEPT_US for t in self.at), len(self.at) - KEPT_ROWS)
        if drop:
            self.at, self.mid, self.imb, self.ret = self.at[drop:], self.mid[drop:], self.imb[drop:], self.ret[drop:]

    def value(self, kind: str, side: str | None, window_ms: int) -> float | None:
        mid, imb = self.mid[-1], self.imb[-1]
        inside = [i for i, t in enumerate(self.at) if t >= self.last_us - window_ms * 1000] if window_ms else []
        if kind in ("PRICE_ABOVE", "PRICE_BELOW"):
            return self.best_ask if side == "ASK" else self.best_bid
        if kind in ("SPREAD_NARROW", "SPREAD_WIDE"):
            return self.spread
        if kind in ("IMBALANCE_BID", "IMBALANCE_ASK"):
            return imb if kind.endswith("BID") or imb is None else -imb
        if kind == "SIZE_SPIKE":
            return self.ask if side == "ASK" else self.bid
        if kind == "CROSSED_BOOK":
            return self.best_bid - self.best_ask if mid is not None and self.best_bid >= self.best_ask else None
        if kind == "EMPTY_BOOK":
            return None if self.bid or self.ask else 0.0
        if kind == "MICROPRICE_DIVERGENCE":
            return abs(self.micro - mid) / mid * 10_000 if mid and mid > 0 and self.micro is not None else None
        if kind == "MID_PRICE_TREND":
            return float(self.run) if self.run and (side is None or self.direction == (1 if side == "ASK" else -1)) else None
        if kind == "STALE_QUOTE":
            return (self.last_us - self.before[2]) / 1000 if self.before[2] is not None else None
        if kind == "LARGE_FILL":
            fills = {s: (was - now) * price for s, was, now, price in (("BID", self.before[0], self.bid, self.best_bid), ("ASK", self.before[1], self.ask, self.best_ask)) if was is not None and now is not None and price is not None and now < was}
            return fills.get(side) if side else max(fills.values(), default=None)
        if kind == "PRICE_MOVE":
            first = next((self.mid[i] for i in inside if self.mid[i] is not None), None)
            return abs(mid - first) / first * 100 if mid is not None and first and first > 0 else None
        if kind == "IMBALANCE_SHIFT":
            seen = [self.imb[i] for i in inside if self.imb[i] is not None]
            first = self.imb[-KEPT_SHIFT] if len(seen) > KEPT_SHIFT else next(iter(seen), None)
            return abs(imb - first) if imb is not None and first is not None else None
        if kind == "QUOTE_VELOCITY":
            return len(inside) / (window_ms / 1000)
        if kind == "VOLATILITY_SPIKE":
            # the first quote in the window has its return from outside: it doesn't count
            got = [self.ret[i] for i in inside[1:] if self.ret[i] is not None]
            mean = sum(got) / len(got) if got else 0.0
            return (sum((x - mean) ** 2 for x in got) / len(got)) ** 0.5 * 100 if len(got) >= 2 and mid is not None else None
        raise ValueError(f"no such signal: {kind}")


def stream_signals(feed: DataFrame, rules: list[tuple]) -> DataFrame:
    """Firings of wildcard rules (rule_id, type, threshold, side, window_ms,
    cooldown_ms), after their cooldowns. An asset's state holds its quotes of the
    last minute, the trend, and when each rule last fired; idle for an hour it goes.

    A silence is seen when the next quote comes, and reported for the quote before.
    """
    for r in rules:
        if r[1] not in COMPARE:
            raise ValueError(f"no such signal on one asset: {r[1]}")
        if r[1] in WINDOWED and not 0 < (r[4] or 0) * 1000 <= KEPT_US:
            raise ValueError(f"{r[1]} needs a window of at most {KEPT_US // 1000} ms")
    holds = {">": lambda a, t: a > t, "<": lambda a, t: a < t, ">=": lambda a, t: a >= t, "any": lambda a, t: True}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, out = _Quotes(state.get if state.exists else None, len(rules)), []
        for r in pd.concat(list(batches)).sort_values(["source_us", "event_id"]).itertuples(index=False):
            now.take(r)
            for i, (name, kind, threshold, side, window, wait) in enumerate(rules):
                actual = now.value(kind, side, window or 0)
                if actual is None or not holds[COMPARE[kind]](actual, threshold):
                    continue
                us, event = (now.before[2], now.before[3]) if kind == "STALE_QUOTE" else (now.last_us, now.last_event)
                if now.fired[i] is None or us - now.fired[i] >= wait * 1000:
                    now.fired[i] = us
                    out.append((name, key[0], event, us, float(actual)))
        state.update(now.state())
        state.setTimeoutTimestamp(max(now.last_us // 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["rule_id", "asset_id", "event_id", "source_us", "actual_value"])

    rows = with_time(feed).withWatermark("ts", WATERMARK).select("asset_id", "event_id", "source_us", "best_bid", "best_ask", "bid_size", "ask_size", "spread_bps", "ts")
    return rows.groupBy("asset_id").applyInPandasWithState(step, "rule_id string, asset_id string, event_id long, source_us long, actual_value double", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_pair_arbitrage(feed: DataFrame, threshold: float, fresh_us: int = 5_000_000) -> DataFrame:
    """Both asks under the threshold: state is each outcome's last quote."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(("e_us", "e_ask", "o_us", "o_ask"), state.get, strict=True)) if state.exists else dict.fromkeys(("e_us", "e_ask", "o_us", "o_ask"))
        out, seen = [], 0
        for r in pd.concat(list(batches)).sort_values(["source_us", "event_id"]).itertuples(index=False):
            seen = r.source_us
            mine, other = ("e", "o") if int(r.asset_id) % 2 == 0 else ("o", "e")
            if last[f"{other}_us"] is not None and r.source_us - last[f"{other}_us"] <= fresh_us and r.best_ask + last[f"{other}_ask"] < threshold:
                out.append((key[0], r.event_id, r.source_us, r.best_ask + last[f"{other}_ask"]))
            last[f"{mine}_us"], last[f"{mine}_ask"] = r.source_us, r.best_ask
        state.update(tuple(last.values()))
        state.setTimeoutTimestamp(max(seen // 1000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["condition_id", "event_id", "source_us", "total"])

    rows = with_time(feed).withWatermark("ts", WATERMARK).select("condition_id", "asset_id", "event_id", "source_us", "best_ask", "ts")
    return rows.groupBy("condition_id").applyInPandasWithState(step, "condition_id string, event_id long, source_us long, total double", "e_us long, e_ask double, o_us long, o_ask double", "append", GroupStateTimeout.EventTimeTimeout)


def stream_stale_quotes(feed: DataFrame, silence_us: int = 60_000_000) -> DataFrame:
    """Assets that were silent for longer than ``silence_us``, and since when.

    A timer on event time reports a silence once the watermark has passed its
    end; one that ends sooner is reported by the quote that ends it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"asset_id": [key[0]], "last_us": [last]})
            return
        times = sorted(int(t) for b in batches for t in b["source_us"])
        times = [*(state.get if state.exists else ()), *times]
        silent = [a for a, b in zip(times, times[1:], strict=False) if b - a > silence_us]
        state.update((max(times),))
        state.setTimeoutTimestamp(max((max(times) + silence_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"asset_id": [key[0]] * len(silent), "last_us": silent})

    rows = with_time(feed).withWatermark("ts", WATERMARK).select("asset_id", "source_us", "ts")
    return rows.groupBy("asset_id").applyInPandasWithState(step, "asset_id string, last_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_edge_signals(feed: DataFrame, path: str, checkpoint: str, **trigger):
    """Append signals; weights are aggregated from the table."""
    return feed.writeStream.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(lambda b, _: b.write.mode("append").parquet(path)).start()


def stream_keeping_late(feed: DataFrame, path: str, late_path: str, checkpoint: str, delay_us: int, **trigger):
    """Rows to a table, those that come too late to a table of their own.

    A row is late if it lies more than ``delay_us`` before the newest row of all earlier
    batches, as a watermark has it; late ones keep that bound. A batch is written under
    its number, and so is its newest time, so a batch that runs again replaces what it
    wrote and reads the same bound.
    """
    bounds = f"{checkpoint}/newest"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("newest long, batch int").parquet(bounds).where(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        bound = F.lit(None if before is None else before - delay_us).cast("long")
        rows = batch.withColumn("bound_us", bound).persist()
        late = F.coalesce(F.col("source_us") < F.col("bound_us"), F.lit(False))
        rows.where(~late).drop("bound_us").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.where(late).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        newest = rows.agg(F.max("source_us").alias("newest")).withColumn("newest", F.greatest("newest", F.lit(before).cast("long")))
        newest.write.mode("overwrite").parquet(f"{bounds}/batch={number}")
        rows.unpersist()

    return feed.writeStream.option("checkpointLocation", f"{checkpoint}/late").trigger(**trigger).foreachBatch(step).start()


def run_to_end(out: DataFrame, name: str, spark: SparkSession, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all files now there; its output as a table."""
    path = f"{checkpoint}/{name}-out"
    q = out.writeStream.option("checkpointLocation", f"{checkpoint}/{name}").outputMode(mode).trigger(availableNow=True).format("parquet").option("path", path).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
