"""Signals on quotes: features, predicates, rules and cooldowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.temporal import asof_join, cooldown
from tidebook.operators import history

FRESH_US = 5_000_000
#: How a value is held against a rule's threshold (fixed values).
COMPARE = {
    "PRICE_ABOVE": ">", "PRICE_BELOW": "<", "SPREAD_NARROW": "<", "SPREAD_WIDE": ">", "IMBALANCE_BID": ">", "IMBALANCE_ASK": ">", "SIZE_SPIKE": ">", "PRICE_MOVE": ">=", "CROSSED_BOOK": "any", "EMPTY_BOOK": "any",
    "VOLATILITY_SPIKE": ">", "MICROPRICE_DIVERGENCE": ">", "IMBALANCE_SHIFT": ">", "MID_PRICE_TREND": ">=", "QUOTE_VELOCITY": ">", "STALE_QUOTE": ">", "LARGE_FILL": ">",
}
#: Signals of several assets together, by how the total is held against the threshold (fixed values).
TOTALS = {"ARBITRAGE_BUY": "<", "ARBITRAGE_SELL": ">", "MULTI_OUTCOME_ARBITRAGE": "<"}
#: Market types that those work on (fixed values).
TOTALS_ON = ("prediction",)
#: Wildcard rules that are evaluated as columns; more of them are joined.
WILDCARDS = 200
#: Distinct (type, side, window) triples evaluated in one pass over the quotes.
TRIPLES = 100
WINDOWED = ("PRICE_MOVE", "VOLATILITY_SPIKE", "IMBALANCE_SHIFT", "QUOTE_VELOCITY")
#: Types whose value depends on other quotes of the asset.
PAST = (*WINDOWED, "MID_PRICE_TREND", "LARGE_FILL", "STALE_QUOTE")
#: Always-on rules: type, threshold, side, window in ms (fixed values).
ALWAYS_ON = [
    ("SPREAD_WIDE", 200.0, None, 0), ("SPREAD_NARROW", 20.0, None, 0), ("IMBALANCE_BID", 0.6, None, 0), ("IMBALANCE_ASK", 0.6, None, 0), ("CROSSED_BOOK", 0.0, None, 0),
    ("EMPTY_BOOK", 0.0, None, 0), ("MICROPRICE_DIVERGENCE", 50.0, None, 0), ("MID_PRICE_TREND", 3.0, None, 0), ("LARGE_FILL", 1000.0, None, 0), ("VOLATILITY_SPIKE", 2.0, None, 10_000),
]
ALWAYS_ON_COOLDOWN_MS = 500
#: Wildcard rules of the service: type, threshold, side, window, cooldown in ms (fixed values).
PRODUCTION = [
    ("PRICE_ABOVE", 0.90, "BID", 0, 10_000), ("PRICE_BELOW", 0.10, "BID", 0, 10_000), ("SPREAD_WIDE", 300.0, None, 0, 30_000), ("SPREAD_NARROW", 50.0, None, 0, 15_000), ("IMBALANCE_BID", 0.6, None, 0, 15_000),
    ("IMBALANCE_ASK", 0.6, None, 0, 15_000), ("IMBALANCE_SHIFT", 0.4, None, 30_000, 20_000), ("SIZE_SPIKE", 10_000.0, "BID", 0, 20_000), ("SIZE_SPIKE", 10_000.0, "ASK", 0, 20_000), ("LARGE_FILL", 1000.0, None, 0, 15_000),
    ("PRICE_MOVE", 3.0, None, 60_000, 30_000), ("MID_PRICE_TREND", 3.0, None, 0, 30_000), ("MICROPRICE_DIVERGENCE", 50.0, None, 0, 20_000), ("QUOTE_VELOCITY", 3.0, None, 5_000, 30_000), ("STALE_QUOTE", 60_000.0, None, 0, 120_000),
]
RULE = "rule_id string, type string, threshold double, side string, window_ms long, cooldown_ms long, asset_id string, counterpart_asset_id string, outcome_asset_ids array<string>, enabled boolean"


def prepare(ticks: DataFrame, wanted: list[tuple[str, str | None, int]], window_ms: int = 0) -> DataFrame:
    """Quotes with what the wanted (type, side, window) triples need. Only types that
    look back are dealt by slices (``history``); the others cost no shuffle."""
    if not any(kind in PAST for kind, _, _ in wanted) and not window_ms:
        return history.plain(ticks)
    longest = max([window_ms, *[ms for kind, _, ms in wanted if kind in WINDOWED]])
    return history.prepare(ticks, longest, any(kind == "MID_PRICE_TREND" for kind, _, _ in wanted))


def value(kind: str, side: str | None = None, window_ms: int = 0) -> Column:
    """The value of a signal on prepared quotes; null where it can't fire."""
    w = history.trailing(window_ms * 1000)
    c = F.col
    if kind in ("PRICE_ABOVE", "PRICE_BELOW"):
        return c("best_ask") if side == "ASK" else c("best_bid")
    if kind in ("SPREAD_NARROW", "SPREAD_WIDE"):
        return c("spread_bps")
    if kind == "IMBALANCE_BID":
        return c("imb")
    if kind == "IMBALANCE_ASK":
        return -c("imb")
    if kind == "SIZE_SPIKE":
        return c("ask_size") if side == "ASK" else c("bid_size")
    if kind == "CROSSED_BOOK":
        return F.when(c("best_bid") >= c("best_ask"), c("best_bid") - c("best_ask"))
    if kind == "EMPTY_BOOK":
        return F.when((F.coalesce(c("bid_size"), F.lit(0.0)) == 0) & (F.coalesce(c("ask_size"), F.lit(0.0)) == 0), F.lit(0.0))
    if kind == "MICROPRICE_DIVERGENCE":
        return F.when(c("mid") > 0, F.abs(c("micro") - c("mid")) / c("mid") * 10000)
    if kind == "MID_PRICE_TREND":
        rising = F.lit(True) if side is None else c("direction") == (1 if side == "ASK" else -1)
        return F.when(rising, c("run").cast("double"))
    if kind == "STALE_QUOTE":
        return c("silence_us") / 1000
    if kind == "LARGE_FILL":
        bid = F.when(c("bid_size") < c("bid_before"), (c("bid_before") - c("bid_size")) * c("best_bid"))
        ask = F.when(c("ask_size") < c("ask_before"), (c("ask_before") - c("ask_size")) * c("best_ask"))
        return bid if side == "BID" else ask if side == "ASK" else F.greatest(bid, ask)
    if kind == "PRICE_MOVE":
        first = F.first("mid", ignorenulls=True).over(w)
        return F.when(first > 0, F.abs(c("mid") - first) / first * 100)
    if kind == "IMBALANCE_SHIFT":
        first = F.when(F.count("imb").over(w) > 100, F.lag("imb", 99).over(history.order())).otherwise(F.first("imb", ignorenulls=True).over(w))
        return F.abs(c("imb") - first)
    if kind == "QUOTE_VELOCITY":
        return F.count(F.lit(1)).over(w) / (window_ms / 1000)
    if kind == "VOLATILITY_SPIKE":
        # the first row in the window has its return from outside: it doesn't count
        edge = F.first("ret").over(w)
        n = F.count("ret").over(w) - edge.isNotNull().cast("int")
        total = F.sum("ret").over(w) - F.coalesce(edge, F.lit(0.0))
        square = F.sum(c("ret") * c("ret")).over(w) - F.coalesce(edge * edge, F.lit(0.0))
        return F.when((n >= 2) & c("mid").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), square / n - (total / n) * (total / n))) * 100)
    raise ValueError(f"no such signal: {kind}")


def holds(kind: str, actual: Column, threshold: Column) -> Column:
    op = COMPARE[kind]
    return actual.isNotNull() if op == "any" else actual > threshold if op == ">" else actual < threshold if op == "<" else actual >= threshold


def signal(ticks: DataFrame, kind: str, threshold: float, side: str | None = None, window_ms: int = 0) -> DataFrame:
    """Quotes on which one rule fires, with the value."""
    rows = prepare(ticks, [(kind, side, window_ms)]).withColumn("actual_value", value(kind, side, window_ms))
    return rows.where("_own").where(holds(kind, F.col("actual_value"), F.lit(threshold))).select("event_id", "asset_id", "source_us", "actual_value")


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """Rules as a table; counterpart, outcomes and enabled may be left out."""
    return spark.createDataFrame([(*r, *(None, None, True)[len(r) - 7 :]) for r in rules], RULE)


def production_rules() -> list[tuple]:
    return [(f"prod_{i:02d}", k, t, s, w, cd, "*") for i, (k, t, s, w, cd) in enumerate(PRODUCTION)]


def always_on_rules() -> list[tuple]:
    return [(f"global_{k.lower()}", k, t, s, w, ALWAYS_ON_COOLDOWN_MS, "*") for k, t, s, w in ALWAYS_ON]


_QUOTE = ["event_id", "asset_id", "condition_id", "source_us", "ingestion_us", "best_bid", "best_ask"]


def features(ticks: DataFrame, wanted: list[tuple[str, str | None, int]]) -> DataFrame:
    """A row for each quote and wanted (type, side, window) that has a value.

    All windows share one partitioning and order, so the whole set costs one
    shuffle of the quotes, and a narrow one for runs of moves.
    """
    rows = prepare(ticks, wanted).select("_own", *_QUOTE, *[value(*w).cast("double").alias(f"_v{i}") for i, w in enumerate(wanted)]).where("_own")
    each = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(s).cast("string").alias("side"), F.lit(w).cast("long").alias("window_ms"), F.col(f"_v{i}").alias("actual_value")) for i, (k, s, w) in enumerate(wanted)])
    return rows.select(*_QUOTE, F.inline(F.filter(each, lambda x: x["actual_value"].isNotNull())))


def _every_quote(ticks: DataFrame, rules: list) -> DataFrame:
    """Firings of wildcard rules: only those that hold leave a quote's row."""
    wanted = sorted({(r.type, r.side, r.window_ms or 0) for r in rules}, key=str)
    rows = prepare(ticks, wanted).select("_own", *_QUOTE, *[value(*w).cast("double").alias(f"_v{i}") for i, w in enumerate(wanted)]).where("_own")
    each = []
    for r in rules:
        actual = F.col(f"_v{wanted.index((r.type, r.side, r.window_ms or 0))}")
        said = {"type": r.type, "side": r.side, "window_ms": r.window_ms, "rule_id": r.rule_id, "threshold": r.threshold, "cooldown_ms": r.cooldown_ms}
        fields = [F.lit(v).cast({"window_ms": "long", "threshold": "double", "cooldown_ms": "long"}.get(k, "string")).alias(k) for k, v in said.items()]
        each.append(F.when(holds(r.type, actual, F.lit(r.threshold)), F.struct(*fields, actual.alias("actual_value"))))
    return rows.select(*_QUOTE, F.inline(F.array_compact(F.array(*each))))


def _joined(ticks: DataFrame, rules: DataFrame, own: bool) -> DataFrame:
    """Firings of rules that are joined to the values, a pass for each
    ``TRIPLES`` distinct (type, side, window)."""
    triples = [(r.type, r.side, r.window_ms) for r in rules.select("type", "side", F.coalesce("window_ms", F.lit(0)).alias("window_ms")).distinct().orderBy("type", "side", "window_ms").collect()]
    r = rules.select("rule_id", F.col("type").alias("rt"), "threshold", F.col("side").alias("rs"), F.coalesce("window_ms", F.lit(0)).alias("rw"), "cooldown_ms", F.col("asset_id").alias("ra"))
    fires = F.coalesce(*[F.when(F.col("type") == k, holds(k, F.col("actual_value"), F.col("threshold"))) for k in COMPARE])
    same = (F.col("type") == F.col("rt")) & F.col("side").eqNullSafe(F.col("rs")) & (F.col("window_ms") == F.col("rw"))
    out = None
    for at in range(0, len(triples), TRIPLES):
        part = features(ticks, triples[at : at + TRIPLES]).join(r, same & (F.col("asset_id") == F.col("ra")) if own else same).where(fires)
        out = part if out is None else out.unionByName(part)
    return out.drop("rt", "rs", "rw", "ra") if out is not None else None


def _arbitrage_rules(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Totals of a rule's asset with its counterpart's last fresh quote."""
    r = rules.select("rule_id", "type", "side", "window_ms", "threshold", "cooldown_ms", F.col("asset_id").alias("ra"), F.col("counterpart_asset_id").alias("rc"))
    left = ticks.select(*_QUOTE).join(r, F.col("asset_id") == F.col("ra"))
    right = ticks.join(r.select("rule_id", "rc"), F.col("asset_id") == F.col("rc")).select("rule_id", "source_us", "event_id", F.struct("best_bid", "best_ask").alias("q"))
    rows = asof_join(left, right, ["rule_id"], "source_us", ["q"], tie="event_id").where(F.col("source_us") - F.col("asof_at") <= FRESH_US)
    total = F.when(F.col("type") == "ARBITRAGE_BUY", F.col("best_ask") + F.col("asof_q.best_ask")).otherwise(F.col("best_bid") + F.col("asof_q.best_bid"))
    return rows.withColumn("actual_value", total)


def _outcome_rules(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Totals over a rule's outcomes on the quotes of the rule's own asset."""
    groups = rules.select(F.col("rule_id").alias("group_id"), F.explode("outcome_asset_ids").alias("asset_id"))
    totals = outcome_totals(ticks, groups).select("group_id", "event_id", F.col("total").alias("actual_value"))
    r = rules.select("rule_id", "type", "side", "window_ms", "threshold", "cooldown_ms", F.col("asset_id").alias("ra"))
    own = ticks.select(*_QUOTE).join(r, F.col("asset_id") == F.col("ra"))
    return own.join(totals, (F.col("rule_id") == totals.group_id) & (own.event_id == totals.event_id)).drop(totals.event_id).drop("group_id")


def evaluate_rules(ticks: DataFrame, rules: DataFrame) -> DataFrame:
    """Every firing of every enabled rule of any type, before cooldowns.

    Few wildcard rules become columns of the quotes and only firings leave a
    row; rules for one asset meet their asset's values by an equi-join; rules
    over several assets meet the other assets' last quotes by as-of joins.
    """
    rules = rules.where(F.coalesce("enabled", F.lit(True)))
    single = rules.where(F.col("type").isin(list(COMPARE)))
    every = single.where("asset_id = '*'")
    few = every.orderBy("rule_id").limit(WILDCARDS + 1).collect()
    parts = [_joined(ticks, every, False) if len(few) > WILDCARDS else _every_quote(ticks, few) if few else None, _joined(ticks, single.where("asset_id <> '*'"), True)]
    pairs = rules.where(F.col("type").isin("ARBITRAGE_BUY", "ARBITRAGE_SELL") & F.col("counterpart_asset_id").isNotNull())
    sets = rules.where((F.col("type") == "MULTI_OUTCOME_ARBITRAGE") & (F.size("outcome_asset_ids") >= 2))
    fires = F.when(F.col("type") == "ARBITRAGE_SELL", F.col("actual_value") > F.col("threshold")).otherwise(F.col("actual_value") < F.col("threshold"))
    columns = [*_QUOTE, "type", "side", "window_ms", "rule_id", "threshold", "cooldown_ms", "actual_value"]
    # branches without rules aren't read for nothing
    parts += [build(ticks, some).where(fires) for build, some in ((_arbitrage_rules, pairs), (_outcome_rules, sets)) if not some.isEmpty()]
    if not any(part is not None for part in parts):
        parts.append(_arbitrage_rules(ticks, pairs).where(fires))
    out = None
    for part in parts:
        if part is not None:
            out = part.select(columns) if out is None else out.unionByName(part.select(columns))
    return out


def global_signals(ticks: DataFrame) -> DataFrame:
    """The always-on signals, each at most every 500 ms for an asset and type.
    Volatility needs five mids in the last minute and three in its window."""
    rows = prepare(ticks, [(k, s, w) for k, _, s, w in ALWAYS_ON], 60_000)
    rows = rows.withColumn("_seen", (F.count("mid").over(history.trailing(60_000_000)) >= 5) & (F.count("mid").over(history.trailing(10_000_000)) >= 3))
    wanted = {f"_v{i}": F.when(F.col("_seen"), value(k, s, w)) if k == "VOLATILITY_SPIKE" else value(k, s, w).cast("double") for i, (k, _, s, w) in enumerate(ALWAYS_ON)}
    rows = rows.withColumns(wanted).where("_own")
    each = [F.when(holds(k, F.col(f"_v{i}"), F.lit(t)), F.struct(F.lit(f"global_{k.lower()}").alias("rule_id"), F.lit(k).alias("type"), F.col(f"_v{i}").alias("actual_value"))) for i, (k, t, _, _) in enumerate(ALWAYS_ON)]
    fired = rows.select(*_QUOTE, F.inline(F.array_compact(F.array(*each)))).withColumn("cooldown_ms", F.lit(ALWAYS_ON_COOLDOWN_MS))
    return apply_cooldown(fired, ("asset_id", "type"))


def apply_cooldown(fired: DataFrame, scope: tuple[str, ...] = ("rule_id", "asset_id")) -> DataFrame:
    """Firings that come at least the rule's cooldown after the last kept one."""
    return cooldown(fired.withColumn("wait_us", F.col("cooldown_ms") * 1000), list(scope), "source_us", "event_id", "wait_us").drop("wait_us")


def rule_prefilter(ticks: DataFrame, bounds: DataFrame) -> DataFrame:
    """(rule, tick) pairs inside a rule's bid and ask bounds; a missing side
    fails a bound. Rules of an asset come by an equi-join; wildcard rules are
    columns, ``WILDCARDS`` of them in a pass, and only pairs that hold leave a row."""
    inside = lambda c, lo, hi: (lo.isNull() | (F.col(c) >= lo)) & (hi.isNull() | (F.col(c) <= hi))
    holds_ = lambda r: F.coalesce(inside("best_bid", r("min_bid"), r("max_bid")) & inside("best_ask", r("min_ask"), r("max_ask")), F.lit(False))
    fields = [c for c in bounds.columns if c != "asset_id"]
    own = ticks.join(bounds.where("asset_id <> '*'").withColumnRenamed("asset_id", "_ra"), F.col("asset_id") == F.col("_ra")).where(holds_(F.col))
    out = own.select(*ticks.columns, *fields)
    every = bounds.where("asset_id = '*'").select(*fields).orderBy("rule_id").collect()
    for at in range(0, len(every), WILDCARDS):
        said = [{c: F.lit(r[c]).cast(bounds.schema[c].dataType) for c in fields} for r in every[at : at + WILDCARDS]]
        each = [F.when(holds_(r.get), F.struct(*[v.alias(c) for c, v in r.items()])) for r in said]
        out = out.unionByName(ticks.select("*", F.inline(F.array_compact(F.array(*each)))))
    return out


def pair_quotes(ticks: DataFrame) -> DataFrame:
    """Each quote with the other outcome's last quote before it."""
    seen = lambda odd: F.last(F.when(F.col("asset_id").cast("long") % 2 == odd, F.struct("asset_id", "source_us", "best_bid", "best_ask", "bid_size", "ask_size")), ignorenulls=True)
    w = Window.partitionBy("condition_id").orderBy("source_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("asset_id").cast("long") % 2 == 0, seen(1).over(w)).otherwise(seen(0).over(w))
    rows = ticks.withColumn("other", other)
    return rows.where((F.col("source_us") - F.col("other.source_us")) <= FRESH_US)


def arbitrage(ticks: DataFrame, buy: bool, threshold: float) -> DataFrame:
    """Both asks together under, or both bids over, the threshold, with sizes."""
    price, size = ("best_ask", "ask_size") if buy else ("best_bid", "bid_size")
    rows = pair_quotes(ticks).withColumn("total", F.col(price) + F.col(f"other.{price}"))
    gain = (1 - F.col("total")) if buy else (F.col("total") - 1)
    lot = F.least(F.coalesce(size, F.lit(0.0)), F.coalesce(f"other.{size}", F.lit(0.0)))
    rows = rows.where(F.col("total") < threshold if buy else F.col("total") > threshold)
    return rows.select("event_id", "asset_id", "condition_id", "source_us", "total", (gain * 10000).alias("profit_bps"), lot.alias("size"), (lot * F.col("total")).alias("notional"), (lot * gain).alias("profit"))


def outcome_totals(ticks: DataFrame, groups: DataFrame) -> DataFrame:
    """For each quote of a set's member, the last asks of all its members
    together, if all are there and fresh. ``groups`` is (group_id, asset_id).

    An as-of join of all members at once: a quote asks for each member of its set,
    and the members' own quotes, in the same sort, carry their last one on. The work is
    quotes times members, and a set spreads over its members.
    """
    n = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    members = groups.select("group_id", F.col("asset_id").alias("member")).join(n, "group_id")
    rows = ticks.select("event_id", "asset_id", "source_us", "best_ask", "ask_size").join(groups, "asset_id").join(members, "group_id")
    w = Window.partitionBy("group_id", "member").orderBy("source_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("asset_id") == F.col("member"), F.struct("source_us", "best_ask", "ask_size"))
    rows = rows.withColumn("seen", F.last(own, ignorenulls=True).over(w))
    fresh = (F.col("seen.source_us") >= F.col("source_us") - FRESH_US) & F.col("seen.best_ask").isNotNull()
    # a quote's members in order, so that their sum doesn't depend on the deal
    asks = F.sort_array(F.collect_list(F.when(fresh, F.struct("member", "seen.best_ask", F.coalesce("seen.ask_size", F.lit(0.0)).alias("lot")))))
    each = rows.groupBy("group_id", "event_id", "asset_id", "source_us", "n").agg(asks.alias("asks")).where(F.size("asks") == F.col("n"))
    total = F.aggregate("asks", F.lit(0.0), lambda s, x: s + x["best_ask"])
    return each.select("group_id", "event_id", "asset_id", "source_us", "n", total.alias("total"), F.array_min(F.transform("asks", lambda x: x["lot"])).alias("size"))


def multi_outcome_arbitrage(ticks: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Sets of N outcomes whose last asks are all fresh and together under a threshold."""
    return outcome_totals(ticks, groups).where(F.col("total") < threshold)


def event_feed(fired: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """The last ``limit`` events, of one type if asked, newest first, with how
    many events of their type and in all there are."""
    counts = fired.groupBy("type").agg(F.count(F.lit(1)).alias("of_type"))
    total = counts.agg(F.sum("of_type").alias("buffered"))
    last = fired.orderBy(F.desc("source_us"), F.desc("event_id"), "rule_id").limit(limit)
    last = last.where(F.col("type") == kind) if kind else last
    return last.join(F.broadcast(counts), "type").join(F.broadcast(total))


def event_latency(fired: DataFrame, shard: Column, last: int = 1000) -> DataFrame:
    """Nearest-rank latency percentiles of each shard's last events."""
    rank = Window.partitionBy("shard").orderBy(F.desc("source_us"), F.desc("event_id"))
    rows = fired.withColumn("shard", shard).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= last)
    got = rows.groupBy("shard").agg(F.sort_array(F.collect_list("latency_us")).alias("l"), F.avg("latency_us").alias("mean"))
    at = lambda p: F.element_at("l", F.least(F.size("l"), F.floor(F.size("l") * p).cast("int") + 1))
    return got.select("shard", F.size("l").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "mean", F.array_min("l").alias("low"), F.array_max("l").alias("high"))


def fleet_rollup(shards: DataFrame, expected: int = 25) -> DataFrame:
    """Sample-weighted percentiles of all shards, and a status."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    rows = shards.agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n"), mean("p50"), mean("p95"), mean("p99"))
    bad = (F.col("p95") > 15_000) | (F.col("shards") < 20)
    warn = (F.col("p95") > 5_000) | (F.col("shards") < expected - 1)
    return rows.withColumn("status", F.when(bad, "critical").when(warn, "degraded").otherwise("healthy"))


#: The shortest and the longest cooldown of a rule (fixed values).
COOLDOWN_MS = (100, 3_600_000)


def validate_rules(rules: DataFrame, per_asset: int = 50) -> DataFrame:
    """Rules with the list of what is wrong with each; empty for good ones.

    An asset's rules past the first ``per_asset``, by rule_id, are too many.
    """
    kind, side, window = F.col("type"), F.col("side"), F.col("window_ms")
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy("rule_id"))
    sided = F.coalesce(side.isin("BID", "ASK"), F.lit(False))
    errors = F.array_compact(
        F.array(
            F.when(kind.isNull() | ~kind.isin([*COMPARE, *TOTALS]), "unknown type"),
            F.when(kind.isin(list(TOTALS)) & ~F.coalesce(F.col("market_type").isin(*TOTALS_ON), F.lit(False)), "not for this market type"),
            F.when(F.col("threshold").isNull(), "threshold missing"),
            F.when(kind.isin("PRICE_ABOVE", "PRICE_BELOW", "SIZE_SPIKE") & ~sided, "side must be BID or ASK"),
            F.when(kind.isin("MID_PRICE_TREND", "LARGE_FILL") & side.isNotNull() & ~sided, "side must be BID or ASK if given"),
            F.when(kind.isin(list(WINDOWED)) & (F.coalesce(window, F.lit(0)) <= 0), "window missing"),
            F.when(kind.isin("PRICE_MOVE", "VOLATILITY_SPIKE") & (window > 60_000), "window over 60 s"),
            F.when(kind.isin("ARBITRAGE_BUY", "ARBITRAGE_SELL") & F.coalesce(F.col("counterpart_asset_id") == "", F.lit(True)), "counterpart missing"),
            F.when((kind == "MULTI_OUTCOME_ARBITRAGE") & (F.coalesce(F.size("outcome_asset_ids"), F.lit(0)) < 2), "outcomes missing"),
            F.when(~F.col("cooldown_ms").between(*COOLDOWN_MS), "cooldown out of bounds"),
            F.when(rank > per_asset, "too many rules for the asset"),
        )
    )
    return rules.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
