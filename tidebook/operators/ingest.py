"""Raw messages to canonical tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.temporal import asof_join, cooldown

_LEVELS = T.ArrayType(T.StructType([T.StructField("price", T.StringType()), T.StructField("size", T.StringType())]))
_CHANGES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("asset_id", "side", "price", "size", "hash", "best_bid", "best_ask")]))
#: Every field of the four message kinds; all scalars are text in the feed.
MESSAGE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("event_type", "asset_id", "market", "timestamp", "hash", "price", "size", "side", "old_tick_size", "new_tick_size")]
    + [T.StructField("bids", _LEVELS), T.StructField("asks", _LEVELS), T.StructField("price_changes", _CHANGES)]
)
#: The feed's names for its kinds, and ours (fixed values).
KINDS = {"book": "book", "price_change": "price_change", "last_trade_price": "trade", "tick_size_change": "tick_size"}


def parse_raw_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Messages as a struct ``msg`` with their ``kind``; noise is left out.

    A kind that isn't named follows from the fields. An array wraps one message.
    """
    body = F.when(F.col(text).startswith("["), F.from_json(text, T.ArrayType(MESSAGE))[0]).otherwise(F.from_json(text, MESSAGE))
    parsed = lines.where(F.col(text).rlike(r"^\s*[\[{]")).withColumn("msg", body)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("msg.event_type"))
    guess = F.when(F.col("msg.bids").isNotNull() & F.col("msg.asks").isNotNull(), "book").when(F.col("msg.price_changes").isNotNull(), "price_change")
    known = F.col("msg.event_type").isNotNull() | F.col("msg.market").isNotNull()
    return parsed.withColumn("kind", F.when(F.col("msg.event_type").isNotNull(), F.coalesce(named, F.lit("unknown"))).otherwise(F.coalesce(guess, F.lit("unknown")))).where(known)


def classify_raw(lines: DataFrame, text: str = "value") -> DataFrame:
    """Each line with ``origin``: ok, control (not JSON) or malformed."""
    json = F.col(text).rlike(r"^\s*[\[{]")
    parses = F.try_parse_json(text).isNotNull()
    return lines.withColumn("origin", F.when(~json, "control").when(parses, "ok").otherwise("malformed"))


def dead_letters(classified: DataFrame, at: str, text: str = "value") -> DataFrame:
    """Rows that can't be used: where they failed, why, and their text."""
    error = F.when(F.col("origin") == "control", "not a JSON message").otherwise("JSON does not parse")
    return classified.where("origin <> 'ok'").select("event_id", "origin", F.col(text).alias("payload"), error.alias("error"), F.col(at).alias("failed_us"))


def write_routed(lines: DataFrame, path: str, text: str = "value") -> None:
    """The feed in two tables below ``path``: ``good`` and ``dead``."""
    rows = classify_raw(lines, text)
    rows.where("origin = 'ok'").drop("origin").write.mode("append").parquet(f"{path}/good")
    rows.where("origin <> 'ok'").write.mode("append").parquet(f"{path}/dead")


def book_to_bbo(parsed: DataFrame) -> DataFrame:
    """Best levels of book messages, whatever the order of their levels."""
    books = parsed.where("kind = 'book'")
    side = lambda c: F.transform(f"msg.{c}", lambda x: F.struct(x["price"].cast("double").alias("price"), x["size"].cast("double").alias("size")))
    rows = books.withColumn("bid", F.array_max(side("bids"))).withColumn("ask", F.array_min(side("asks")))
    mid = (F.col("bid.price") + F.col("ask.price")) / 2
    bps = F.when(mid > 0, (F.col("ask.price") - F.col("bid.price")) / mid * 10000)
    return rows.select(
        "event_id", F.col("msg.asset_id").alias("asset_id"), F.col("msg.market").alias("condition_id"), (F.col("msg.timestamp").cast("long") * 1000).alias("source_us"), F.col("msg.hash").alias("book_hash"),
        F.col("bid.price").alias("best_bid"), F.col("ask.price").alias("best_ask"), F.col("bid.size").alias("bid_size"), F.col("ask.size").alias("ask_size"), bps.alias("spread_bps"),
    )


def book_to_l2(parsed: DataFrame) -> DataFrame:
    """Book messages as parallel arrays, bids ascending and asks descending."""
    books = parsed.where("kind = 'book'")
    level = lambda c: F.array_sort(F.transform(f"msg.{c}", lambda x: F.struct(x["price"].cast("double").alias("p"), x["size"].cast("double").alias("s"))))
    rows = books.withColumn("b", level("bids")).withColumn("a", F.reverse(level("asks")))
    part = lambda c, f: F.transform(c, lambda x: x[f])
    return rows.select("event_id", F.col("msg.asset_id").alias("asset_id"), F.coalesce("msg.market", F.lit("")).alias("condition_id"), part("b", "p").alias("bid_prices"), part("b", "s").alias("bid_sizes"), part("a", "p").alias("ask_prices"), part("a", "s").alias("ask_sizes"))


def explode_price_changes(parsed: DataFrame) -> DataFrame:
    """A row for each change of a price_change message."""
    rows = parsed.where("kind = 'price_change'").select("event_id", F.col("msg.market").alias("condition_id"), (F.col("msg.timestamp").cast("long") * 1000).alias("source_us"), F.posexplode("msg.price_changes").alias("pos", "c"))
    size = F.col("c.size").cast("double")
    return rows.select("event_id", "pos", "condition_id", "source_us", F.col("c.asset_id").alias("asset_id"), F.col("c.side").alias("side"), F.col("c.price").cast("double").alias("price"), size.alias("new_size"), F.when(size == 0, "REMOVE").otherwise("ADD").alias("change_type"))


def classify_level_changes(levels: DataFrame) -> DataFrame:
    """Old size, difference and kind of each change of a price level."""
    w = Window.partitionBy("asset_id", "side", "price").orderBy("source_us", "event_id")
    rows = levels.withColumn("old_size", F.lag("new_size", 1, 0.0).over(w))
    kind = F.when(F.col("new_size") == 0, "REMOVE").when(F.col("old_size") == 0, "ADD").otherwise("UPDATE")
    return rows.withColumn("size_delta", F.col("new_size") - F.col("old_size")).withColumn("change_type", kind)


def normalize_trades(parsed: DataFrame) -> DataFrame:
    rows = parsed.where("kind = 'trade'")
    price, size = F.col("msg.price").cast("double"), F.col("msg.size").cast("double")
    us = F.col("msg.timestamp").cast("long") * 1000
    key = F.md5(F.concat_ws("|", "msg.asset_id", "msg.timestamp", "msg.price", "msg.size", "msg.side"))
    return rows.select("event_id", key.alias("trade_id"), F.col("msg.asset_id").alias("asset_id"), F.coalesce("msg.market", F.lit("")).alias("condition_id"), us.alias("source_us"), price.alias("price"), size.alias("size"), F.col("msg.side").alias("side"), (price * size).alias("notional"))


def tick_size_asof(ticks: DataFrame, changes: DataFrame, default: float = 0.01) -> DataFrame:
    """Each tick with the tick size in force when it came."""
    found = asof_join(ticks, changes, ["asset_id"], "source_us", ["new_tick_size"])
    return found.withColumn("effective_tick_size", F.coalesce("asof_new_tick_size", F.lit(default))).drop("asof_new_tick_size", "asof_at")


def book_levels_at(snaps: DataFrame, changes: DataFrame, at: int) -> DataFrame:
    """Live price levels of every asset at a time: the newest snapshot's levels
    with later changes applied. Latest rows are aggregates, so they combine
    before the shuffle."""
    last = snaps.where(F.col("source_us") <= at).groupBy("asset_id").agg(F.max_by(F.struct("source_us", "bid_prices", "bid_sizes", "ask_prices", "ask_sizes"), F.struct("source_us", "event_id")).alias("s"))
    zipped = lambda s, p, q: F.transform(F.arrays_zip(F.col(f"s.{p}").alias("p"), F.col(f"s.{q}").alias("q")), lambda x: F.struct(F.lit(s).alias("side"), x["p"].alias("price"), x["q"].alias("size")))
    base = last.select("asset_id", F.col("s.source_us").alias("base_us"), F.explode(F.concat(zipped("BUY", "bid_prices", "bid_sizes"), zipped("SELL", "ask_prices", "ask_sizes"))).alias("l"))
    base = base.select("asset_id", "base_us", "l.*").groupBy("asset_id", "base_us", "side", "price").agg(F.max("size").alias("size")).withColumn("source_us", F.col("base_us")).withColumn("event_id", F.lit(-1).cast("long"))
    later = changes.where(F.col("source_us") <= at).join(last.select("asset_id", F.col("s.source_us").alias("base_us")), "asset_id").where("source_us > base_us")
    both = base.select("asset_id", "side", "price", "size", "source_us", "event_id").unionByName(later.select("asset_id", "side", "price", F.col("new_size").alias("size"), "source_us", "event_id"))
    live = both.groupBy("asset_id", "side", "price").agg(F.max_by("size", F.struct("source_us", "event_id")).alias("size"))
    return live.where("size > 0")


def book_snapshot(levels: DataFrame) -> DataFrame:
    """Live levels to one row an asset: both sides' (price, size) from the best
    on, and the rounded spread, null unless both sides are there."""
    one = F.struct("price", "size")
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, one)))
    rows = levels.groupBy("asset_id").agg(F.reverse(side("BUY")).alias("bids"), side("SELL").alias("asks"), F.sum("size").alias("depth"))
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    mid = (bid + ask) / 2
    return rows.withColumn("spread_bps", F.when(mid > 0, F.round((ask - bid) / mid * 10000)).when(mid.isNotNull(), 0.0))


SERIES = "asset_id string, source_us long, event_id long, best_bid double, best_ask double, bid_size double, ask_size double"


#: The length of the time slices that an asset's book is rebuilt in.
SLICE_US = 600_000_000


def _slice_starts(snaps: DataFrame, deltas: DataFrame) -> DataFrame:
    """The book with which each slice of an asset starts, where one is known.

    A slice does two things to a book: its last snapshot replaces it, and the last
    write of each level since then stands. Both are aggregates that combine before
    the shuffle; what is left, a row for each level a slice writes, is read in order
    of the slices by a stream that holds one book.
    """
    import pandas as pd

    at = F.struct("source_us", "event_id")
    reset = snaps.groupBy("asset_id", "slice").agg(F.max(at).alias("reset_at"), F.max_by(F.struct("bid_prices", "bid_sizes", "ask_prices", "ask_sizes"), at).alias("book"))
    last = deltas.groupBy("asset_id", "slice", "side", "price").agg(F.max(at).alias("at"), F.max_by("new_size", at).alias("new_size"))
    last = last.join(reset.select("asset_id", "slice", "reset_at"), ["asset_id", "slice"], "left").where("reset_at is null or at > reset_at")
    events = reset.select("asset_id", "slice", "book.*").unionByName(last.select("asset_id", "slice", "side", "price", "new_size"), allowMissingColumns=True)
    # slices that write nothing that stands start with a book too
    present = snaps.select("asset_id", "slice").union(deltas.select("asset_id", "slice")).distinct().withColumn("begins", F.lit(True))
    events = events.withColumn("begins", F.lit(False)).unionByName(present, allowMissingColumns=True)
    dealt = events.repartition("asset_id").sortWithinPartitions("asset_id", "slice", F.desc("begins"), F.col("side").isNotNull())
    columns = ["asset_id", "slice", "bid_prices", "bid_sizes", "ask_prices", "ask_sizes"]

    def chain(batches):
        now, book, known = None, {}, False
        for pdf in batches:
            out = []
            for asset, slice_, begins, side, price, size, bp, bs, ap, as_ in pdf[["asset_id", "slice", "begins", "side", "price", "new_size", *columns[2:]]].itertuples(index=False, name=None):
                if asset != now:
                    now, book, known = asset, {}, False
                if begins:
                    if known:
                        sides = [[(p, n) for (s, p), n in book.items() if s == side] for side in ("BUY", "SELL")]
                        out.append((asset, slice_, *(list(x) for side in sides for x in (zip(*side, strict=True) if side else ((), ())))))
                elif side is None:
                    book, known = {("BUY", p): n for p, n in zip(bp, bs, strict=True) if n > 0} | {("SELL", p): n for p, n in zip(ap, as_, strict=True) if n > 0}, True
                elif size > 0:
                    book[side, price] = size
                else:
                    book.pop((side, price), None)
            yield pd.DataFrame(out, columns=columns)

    lists = ", ".join(f"{c} array<double>" for c in columns[2:])
    return dealt.mapInPandas(chain, f"asset_id string, slice long, {lists}")


def reconstruct_bbo_series(snaps: DataFrame, changes: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Best levels after every change, from each asset's first snapshot on.

    A parallel scan over book states: an asset's history is cut into time slices,
    the book at the start of each comes from what the slices before it left
    (``_slice_starts``), and each slice is then folded alone, as a sorted stream that
    holds one book. Nothing is partitioned by the asset alone but a row for each
    level that a slice writes, so an asset of very many rows spreads over its slices.
    """
    import pandas as pd

    cut = F.floor(F.col("source_us") / slice_us).alias("slice")
    snaps = snaps.select("asset_id", "source_us", "event_id", "bid_prices", "bid_sizes", "ask_prices", "ask_sizes", cut)
    deltas = changes.select("asset_id", "source_us", "event_id", "side", "price", "new_size", cut)
    starts = _slice_starts(snaps, deltas).withColumn("starts", F.lit(True))
    rows = snaps.unionByName(deltas, allowMissingColumns=True).withColumn("starts", F.lit(False))
    both = rows.unionByName(starts, allowMissingColumns=True)
    fields = ["asset_id", "slice", "starts", "source_us", "event_id", "side", "price", "new_size", "bid_prices", "bid_sizes", "ask_prices", "ask_sizes"]

    def fold(batches):
        now, known = None, False
        book: dict[str, dict] = {"BUY": {}, "SELL": {}}
        best: dict[str, float | None] = {"BUY": None, "SELL": None}
        pick = {"BUY": max, "SELL": min}
        for pdf in batches:
            out = []
            for asset, slice_, starts, at, event, side, price, size, bp, bs, ap, as_ in pdf.itertuples(index=False, name=None):
                if (asset, slice_) != now:
                    now, known = (asset, slice_), False
                if side is None:
                    book = {"BUY": {p: n for p, n in zip(bp, bs, strict=True) if n > 0}, "SELL": {p: n for p, n in zip(ap, as_, strict=True) if n > 0}}
                    best, known = {s: pick[s](book[s], default=None) for s in book}, True
                    if starts:
                        continue
                elif not known:
                    continue
                elif size > 0:
                    book[side][price] = size
                    best[side] = price if best[side] is None else pick[side](price, best[side])
                elif book[side].pop(price, None) is not None and price == best[side]:
                    # only the loss of the best level needs a look at the others
                    best[side] = pick[side](book[side], default=None)
                bid, ask = best["BUY"], best["SELL"]
                out.append((asset, int(at), int(event), bid, ask, book["BUY"].get(bid), book["SELL"].get(ask)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SERIES.split(", ")])

    dealt = both.select(*fields).repartition("asset_id", "slice").sortWithinPartitions("asset_id", "slice", F.desc("starts"), "source_us", "event_id")
    return dealt.mapInPandas(fold, SERIES)


def missing_initial_book(snaps: DataFrame, changes: DataFrame, wait_us: int = 30_000_000) -> DataFrame:
    """Assets whose changes come before any book; ``missing`` if none in time."""
    first = changes.groupBy("asset_id").agg(F.min("source_us").alias("first_delta"), F.count(F.lit(1)).alias("n"))
    book = snaps.groupBy("asset_id").agg(F.min("source_us").alias("first_book"))
    rows = first.join(book, "asset_id", "left").where("first_book is null or first_delta < first_book")
    return rows.withColumn("missing", F.col("first_book").isNull() | (F.col("first_book") - F.col("first_delta") > wait_us))


def suppress_unchanged_quotes(ticks: DataFrame) -> DataFrame:
    w = Window.partitionBy("asset_id").orderBy("source_us", "event_id")
    same = F.lag("best_bid").over(w).eqNullSafe(F.col("best_bid")) & F.lag("best_ask").over(w).eqNullSafe(F.col("best_ask"))
    return ticks.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def detect_resync(books: DataFrame) -> DataFrame:
    """Books whose hash is another than the book's before."""
    w = Window.partitionBy("asset_id").orderBy("source_us", "event_id")
    rows = books.withColumn("old_hash", F.lag("book_hash").over(w)).withColumn("gap_us", F.col("source_us") - F.lag("source_us").over(w))
    return rows.where("old_hash is not null and old_hash <> book_hash").select("asset_id", "source_us", "event_id", "old_hash", F.col("book_hash").alias("new_hash"), "gap_us")


def periodic_sample(snaps: DataFrame, every_us: int = 1_800_000_000) -> DataFrame:
    return cooldown(snaps.withColumn("wait", F.lit(every_us)), ["asset_id"], "source_us", "event_id", "wait").drop("wait")


def derive_bbo_columns(ticks: DataFrame) -> DataFrame:
    bid, ask, b, a = (F.col(c) for c in ("best_bid", "best_ask", "bid_size", "ask_size"))
    total = b + a
    return ticks.withColumns({"mid": (bid + ask) / 2, "spread": ask - bid, "imbalance": F.when(total > 0, (b - a) / total), "microprice": F.when(total > 0, (bid * a + ask * b) / total), "latency_ms": (F.col("ingestion_us") - F.col("source_us")) / 1000})


def derive_l2_columns(snaps: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = snaps.withColumns({"bid_depth": total("bid_sizes"), "ask_depth": total("ask_sizes"), "bid_levels": F.size("bid_prices"), "ask_levels": F.size("ask_prices")})
    depth = F.col("bid_depth") + F.col("ask_depth")
    return rows.withColumn("book_imbalance", F.when(depth > 0, (F.col("bid_depth") - F.col("ask_depth")) / depth).otherwise(0.0))


def normalize_market_info(rows: DataFrame, sources: list[str], kinds: list[str], default_source: str, default_kind: str) -> DataFrame:
    pick = lambda c, allowed, other: F.when(F.col(c).isin(allowed), F.col(c)).otherwise(F.lit(other))
    return rows.withColumn("market_source", pick("market_source", sources, default_source)).withColumn("market_type", pick("market_type", kinds, default_kind))


def normalize_condition_id(ids: Column) -> Column:
    """0x hex text of up to 256 bits as decimal text; other text as it is. Wider than
    any numeric type of the engine, so batches go through Python's integers."""

    @F.pandas_udf("string")
    def decimal(hexed: pd.Series) -> pd.Series:
        return hexed.map(lambda x: str(int(x, 16)), na_action="ignore")

    fits = ids.rlike(r"^0[xX][0-9a-fA-F]{1,64}\z")
    return F.when(fits, decimal(F.when(fits, ids))).otherwise(ids)


def retention_filter(rows: DataFrame, at: str, as_of: int, days: int) -> DataFrame:
    return rows.where(F.col(at) > as_of - days * 86_400_000_000)


# The steps of this hash are fixed: results depend on them.
def shard_of(key: Column, shards: int = 25) -> Column:
    """A string hash kept as the feed's consumers compute it: each step takes
    h * 31 plus the character's code and place, but only h * 32 wraps at 32 bits."""
    wrap = lambda x: F.pmod(x + 2_147_483_648, F.lit(4_294_967_296)) - 2_147_483_648
    code = lambda i: F.ascii(F.substring(key, i + 1, F.lit(1)))
    places = F.when(F.char_length(key) > 0, F.sequence(F.lit(0), F.char_length(key) - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(places, F.lit(0).cast("long"), lambda h, i: wrap(h * 32) - h + code(i) + i)
    return F.abs(total) % shards


def assign_shard(rows: DataFrame, limit: int = 450) -> DataFrame:
    spread = rows.select("condition_id", "asset_id").distinct().withColumn("shard", shard_of(F.col("condition_id")))
    return spread.groupBy("shard").agg(F.count(F.lit(1)).alias("assets"), F.countDistinct("condition_id").alias("conditions")).withColumn("over", F.col("assets") > limit)
