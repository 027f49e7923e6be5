"""The market graph: signals to edges, and queries over edges by joins.

Edges are undirected pairs with market_a < market_b; traversals go both ways.
Iterative queries keep their frontier or labels in the shared folder and give
only counts to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.products import correlations
from tidebook.functions.rings import NUMBER, NUMBER_BITS, blocks_of, ring_batch, ring_columns, ring_schema, short_rings, slack
from tidebook.functions.storage import broadcast_if_small, discard, materialize, new_path, own_session, reopened, spread, spread_session, worker_imports

#: Weight of each signal source (fixed values).
SOURCE_WEIGHTS = {"trigger_fire": 2.0, "user_trigger": 1.5, "user_analysis": 1.0, "trigger_miss": 0.5, "cron_correlation": 1.0, "metadata_tag": 0.8, "bellman_ford_cycle": 2.5}
DAY_US = 86_400_000_000


#: How strongly an event links all markets it names (fixed values).
STRENGTHS = {"user_trigger": 1.5, "trigger_fire": 1.0, "user_analysis": 1.0, "trigger_miss": -0.1}


def all_pairs(lists: DataFrame, members: str = "markets") -> DataFrame:
    """A list of markets to all its unordered pairs, each once."""
    ids = F.array_sort(F.array_distinct(members))
    rows = lists.withColumn("_ids", ids).withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_ids") - 1))))
    rows = rows.withColumn("market_a", F.get("_ids", F.col("_i") - 1)).withColumn("market_b", F.explode(F.slice("_ids", F.col("_i") + 1, F.size("_ids"))))
    return rows.drop("_ids", "_i", members)


def pair_signals(lists: DataFrame, members: str = "markets") -> DataFrame:
    """Signal rows for all pairs of each event's markets: ``lists`` has the
    event's ``signal_source``, which sets the strength."""
    strength = F.coalesce(*[F.when(F.col("signal_source") == s, w) for s, w in STRENGTHS.items()], F.lit(1.0))
    return all_pairs(lists, members).withColumn("strength", strength)


# The two rules below, their words and their order are fixed: results depend on them.
def infer_edge_type(kinds: Column) -> Column:
    has = lambda *k: F.exists(kinds, lambda x: x.isin(*k))
    return F.when(has("PRICE_ABOVE") & has("PRICE_BELOW"), "hedge").when(has("SIZE_SPIKE", "IMBALANCE_BID", "IMBALANCE_ASK"), "causal").otherwise("correlation")


def infer_edge_type_from_text(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("hedge|inverse"), "hedge").when(t.rlike("caus|depend|trigger"), "causal").otherwise("correlation")


def market_correlations(ticks: DataFrame, as_of: int, days: int = 7, bucket_us: int = 1_000_000, min_common: int = 3) -> DataFrame:
    """Pearson correlation of the mids of market pairs over the last days, in
    the buckets that both have (1: equal timestamps), by products of blocks of
    markets and time: no two rows meet for sharing a bucket. All pairs are exact."""
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    recent = ticks.where((F.col("asset_id").cast("long") % 2 == 0) & (F.col("source_us") > as_of - days * DAY_US))
    yes = recent.groupBy(F.col("condition_id").alias("series"), F.floor(F.col("source_us") / bucket_us).alias("step")).agg(F.avg(mid).alias("value")).where("value is not null")
    # mids lie between 0 and 1
    return correlations(materialize(yes, "mids"), min_common, shift=0.5).withColumnsRenamed({"a": "market_a", "b": "market_b"})


def _decay(age: Column, days: int) -> Column:
    """2 ** (-age / 30). Up to ``days`` from a table of the nearest doubles: the JVM's
    pow is off by one unit at some ages, which splits weights that are equal."""
    table = F.array(*[F.lit(2.0 ** (-a / 30)) for a in range(days + 1)])
    return F.coalesce(F.get(table, age.cast("int")), F.pow(F.lit(2.0), -age / 30))


def _log(x: Column) -> Column:
    """The C library's logarithm. The JVM's is off by one unit at one value in twenty,
    which splits weights that are equal and levels others."""

    @F.pandas_udf("double")
    def log(values: pd.Series) -> pd.Series:
        return pd.Series([math.log(v) for v in values], dtype="float64")

    return log(x)


#: What tells edges apart.
EDGE = ["market_a", "market_b", "edge_type"]


def _source_weight() -> Column:
    return F.coalesce(*[F.when(F.col("signal_source") == s, w) for s, w in SOURCE_WEIGHTS.items()], F.lit(1.0))


def _parts(signals: DataFrame, as_of: int, days: int) -> DataFrame:
    """Signals of the last days with what each adds to its edge, ``s``."""
    age = F.floor(F.lit(as_of) / DAY_US) - F.floor(F.col("created_us") / DAY_US)
    return signals.withColumn("age", age).where(F.col("age") <= days).withColumn("s", F.col("strength") * _source_weight() * _decay(F.col("age"), days))


def edge_weights(signals: DataFrame, as_of: int, days: int = 90, order: str | None = None, by: list[str] = EDGE) -> DataFrame:
    """Decayed weight, users and signals of each edge.

    Sums of doubles depend on their order, and weights that differ by a unit rank
    otherwise than equal ones, so an edge's signals are added one by one: as ``order``
    tells, else by time and size. Each user counts at the first signal. An edge's
    signals are in one task, as sorted streams; ``by`` are the columns that they are
    dealt by.
    """
    at = F.col(order) if order else F.struct("created_us", F.col("strength") * _source_weight())
    rows = _parts(signals, as_of, days).select(*EDGE, F.nullif("user_id", F.lit("")).alias("user"), "s", "created_us", at.alias("at"))
    rows = spread(rows, by, signals.count())
    first = F.row_number().over(Window.partitionBy(*EDGE, "user").orderBy("at")) == 1
    rows = rows.withColumn("new", (first & F.col("user").isNotNull()).cast("long")).sortWithinPartitions(*EDGE, "at")
    return rows.groupBy(*EDGE).agg(F.greatest(F.lit(0.001), 1 + F.sum("s")).alias("weight"), F.sum("new").alias("user_count"), F.count(F.lit(1)).alias("signal_count"), F.max("created_us").alias("last_us")).withColumn("weight", _log(F.col("weight")))


def edges_above(signals: DataFrame, as_of: int, min_weight: float, days: int = 90, order: str | None = None, rows: int | None = None) -> DataFrame:
    """The edges whose weight is above a bar, as ``edge_weights`` has it, without the weights.

    A sum in any order tells on which side of the bar an edge is, unless it is so close
    that the order may matter; only the signals of such edges are added one by one.
    ``rows``: about how many signals there are, if counting them is dear.
    """
    parts = spread(_parts(signals, as_of, days).select(*EDGE, "s"), EDGE, signals.count() if rows is None else rows)
    sums = parts.groupBy(*EDGE).agg(F.sum("s").alias("s"), F.coalesce(F.sum(F.abs("s")), F.lit(0.0)).alias("size"), F.count(F.lit(1)).alias("n"))
    total, bar = F.greatest(F.lit(0.001), 1 + F.col("s")), math.exp(min_weight)
    # more than the sums' rounding, the logarithm's and that of the bar together
    off = (F.col("n") + 8) * (1 + F.col("size") + bar) * 2.0**-52
    near = ((total <= bar + off) | F.isnan(total)).alias("near")
    found = materialize(sums.where((total > bar) | (total >= bar - off)).select(*EDGE, near), "above")
    close = found.where("near").select(*EDGE)
    if close.isEmpty():
        return found.select(*EDGE)
    few = broadcast_if_small(close)
    same = reduce(Column.__and__, [signals[c].eqNullSafe(few[c]) for c in EDGE])
    exact = edge_weights(signals.join(few, same, "left_semi"), as_of, days, order).where(F.col("weight") > min_weight)
    return found.where("not near").select(*EDGE).unionByName(exact.select(*EDGE))


def latest_edges(versions: DataFrame, rows: int | None = None) -> DataFrame:
    """The newest version of each edge. ``rows``: about how many versions there are,
    if counting them is dear; they are dealt so that a task sorts no more at any size."""
    from tidebook.functions.temporal import latest_by

    key = ["market_a", "market_b", "edge_type"]
    return latest_by(spread(versions, key, versions.count() if rows is None else rows), key, ["updated_us"])


def reverse_edges(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("market_a", "market_b")]
    return edges.select(F.col("market_b").alias("market_a"), F.col("market_a").alias("market_b"), *rest)


def directed(edges: DataFrame) -> DataFrame:
    """src, dst, edge_type, weight in both directions."""
    cols = lambda a, b: edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), "edge_type", "weight")
    return cols("market_a", "market_b").unionByName(cols("market_b", "market_a"))


def adjacency(edges: DataFrame, min_weight: float = 0.1, top: int = 100_000) -> DataFrame:
    kept = edges.where(F.col("weight") > min_weight).orderBy(F.desc("weight"), "market_a", "market_b", "edge_type").limit(top)
    near = F.sort_array(F.collect_list(F.struct("dst", "edge_type", "weight")))
    return directed(kept).groupBy("src").agg(near.alias("neighbors"), F.count(F.lit(1)).alias("degree"))


def neighbors(edges: DataFrame, market: str | None, min_weight: float, limit: int, types: list[str] | None = None) -> DataFrame:
    """Strongest neighbours of a market, or of every market."""
    rows = directed(edges).where(F.abs("weight") >= min_weight)
    rows = rows.where(F.col("edge_type").isin(types)) if types else rows
    rows = rows.where(F.col("src") == market) if market else rows
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.abs("weight")), "dst", "edge_type"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def suggestions(edges: DataFrame, markets: DataFrame, limit: int, min_users: int, min_weight: float = 0.3) -> DataFrame:
    """Markets to look at from each market, with what is known of them and the
    users behind all of a market's suggestions. ``markets``: market, question, end_us."""
    near = edges.select("*", F.col("market_a").alias("src"), F.col("market_b").alias("dst")).unionByName(edges.select("*", F.col("market_b").alias("src"), F.col("market_a").alias("dst")))
    near = near.where((F.abs("weight") >= min_weight) & (F.col("user_count") >= min_users))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("user_count"), F.desc(F.abs("weight")), "dst", "edge_type"))
    reason = F.format_string("%d users linked these markets (%s)", "user_count", "edge_type")
    kept = near.withColumn("rank", rank).where(F.col("rank") <= limit)
    kept = kept.withColumn("users_total", F.sum("user_count").over(Window.partitionBy("src")))
    found = kept.select("src", "rank", "dst", "edge_type", "weight", "user_count", "users_total", reason.alias("reason"))
    return found.join(markets.select(F.col("market").alias("dst"), "question", "end_us"), "dst", "left")


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("signal_source", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("created_us").alias("oldest_us"), F.max("created_us").alias("newest_us"))


def simple_pairs(edges: DataFrame, min_weight: float) -> DataFrame:
    """One directed link per pair, the strongest."""
    return directed(edges.where(F.abs("weight") >= min_weight)).groupBy("src", "dst").agg(F.max(F.abs("weight")).alias("weight"))


def n_hop(edges: DataFrame, market: str, hops: int, min_weight: float) -> DataFrame:
    """Distance of every market within some hops, with one shortest path: the
    one of smallest markets in order."""
    links = simple_pairs(edges, min_weight).select("src", "dst")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(market, 0, [market])], "market string, dist int, path array<string>")
    front = seen
    for h in range(1, hops + 1):
        step = front.join(links, front.market == links.src).select(F.col("dst").alias("market"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen.select("market"), "market", "left_anti").groupBy("market").agg(F.min("path").alias("path")).select("market", F.lit(h).alias("dist"), "path")
        front = materialize(step, "front")
        seen = seen.unionByName(front)
    return seen


def shortest_distances(edges: DataFrame, start: str, min_weight: float, types: list[str] | None = None) -> DataFrame:
    """Least sum of 1 / (1 + |weight|) from one market to all, with the path and
    the edge types along it, over edges of some types if asked.

    Only markets whose distance fell in a round send in the next one, until none
    falls; costs are above zero, so that comes after as many rounds as the longest
    of the cheapest paths has links.
    """
    kept = edges.where(F.abs("weight") >= min_weight)
    kept = kept.where(F.col("edge_type").isin(types)) if types else kept
    links = spread(directed(kept), ["src", "dst"], 2 * edges.count()).groupBy("src", "dst").agg(F.max(F.struct(F.abs("weight").alias("w"), "edge_type")).alias("l"))
    links = materialize(links.select("src", "dst", (1 / (1 + F.col("l.w"))).alias("cost"), F.col("l.edge_type").alias("kind")), "links")
    # no round sends more than a row for each link; rows hold whole paths
    spark, most = edges.sparkSession, links.count()
    best = materialize(spark.createDataFrame([(start, 0.0, [start], [], True)], "market string, dist double, path array<string>, types array<string>, fresh boolean"), "dist")
    while not best.where("fresh").isEmpty():
        sent = best.where("fresh").join(links, F.col("market") == F.col("src")).select(F.col("dst").alias("market"), (F.col("dist") + F.col("cost")).alias("dist"), F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("kind")).alias("types"), F.lit(True).alias("fresh"))
        every = spread(best.withColumn("fresh", F.lit(False)).unionByName(sent), ["market"], most)
        new = materialize(every.groupBy("market").agg(F.min(F.struct(F.round("dist", 12).alias("d"), "path", "fresh", "types", "dist")).alias("b")).select("market", "b.dist", "b.path", "b.types", "b.fresh"), "dist")
        discard(best)
        best = new
    discard(links)
    return best.drop("fresh")


def shortest_path(edges: DataFrame, start: str, end: str, min_weight: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """The cheapest path between two markets: distance, markets and types; no
    row if there is none."""
    return shortest_distances(edges, start, min_weight, types).where(F.col("market") == end)


def _reach(links: DataFrame, steps: int) -> DataFrame:
    """market, reach: the most that walks of up to 0, 1, 2, ... links from it gain."""
    found = links.groupBy(F.col("src").alias("market")).agg(F.array(F.lit(0.0), F.greatest(F.max("gain"), F.lit(0.0))).alias("reach"))
    for _ in range(steps - 1):
        more = links.join(found, F.col("dst") == F.col("market")).groupBy("src").agg(F.max(F.col("gain") + F.element_at("reach", -1)).alias("more"))
        found = found.join(more, F.col("market") == F.col("src")).select("market", F.concat("reach", F.array(F.greatest(F.element_at("reach", -1), F.col("more")))).alias("reach"))
    return found


def arbitrage_paths(edges: DataFrame, market: str, depth: int, min_weight: float, limit: int, beam: int = 4) -> DataFrame:
    """The ``limit`` simple paths of two to ``depth`` arbitrage and correlation links
    from a market with the greatest opportunity.

    Branch and bound: what the links left could gain at most from a path's end
    (a max-plus table) bounds the path. A search that keeps the ``beam`` times
    ``limit`` most promising paths of each length finds a bar that the last of the
    answer reaches at least; then all paths that can reach the bar are followed.
    """
    links = directed(edges.where(F.col("edge_type").isin("arbitrage", "correlation") & (F.col("weight") >= min_weight)))
    strength = F.exp("weight") - 1
    gain = F.when(F.col("edge_type") == "arbitrage", F.greatest(F.lit(0.0), strength) * 10_000).otherwise(F.greatest(F.lit(0.0), strength - 0.8) * 1_000)
    links = materialize(links.select("src", "dst", "edge_type", gain.alias("gain")), "links")
    reach = materialize(_reach(links, depth), "reach")

    def follow(bar: float, width: int | None) -> DataFrame:
        front = edges.sparkSession.createDataFrame([(market, [market], [], 0.0)], "at string, path array<string>, types array<string>, bps double")
        found = None
        for left in range(depth - 1, -1, -1):
            front = front.join(links, (front.at == links.src) & ~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("edge_type")).alias("types"), (F.col("bps") + F.col("gain")).alias("bps"))
            bound = front.join(reach, F.col("at") == F.col("market")).withColumn("most", F.round(F.col("bps") + F.get("reach", F.lit(left)))).where(F.col("most") >= bar)
            bound = bound.orderBy(F.desc("most"), "path", "types").limit(width) if width else bound
            front = materialize(bound.select("at", "path", "types", "bps"), "routes")
            long = front.where(F.size("path") >= 3)
            found = long if found is None else found.unionByName(long)
        ranked = found.select(F.array_join("path", "->").alias("path"), F.array_join("types", ",").alias("types"), F.round("bps").alias("bps"))
        return ranked.where("bps > 0").orderBy(F.desc("bps"), "path", "types").limit(limit)

    tried = follow(1.0, beam * limit).agg(F.count(F.lit(1)).alias("n"), F.min("bps").alias("bar")).first()
    return follow(tried.bar if tried.n == limit else 1.0, None)


def signed_links(edges: DataFrame, min_weight: float) -> DataFrame:
    """One link each way per pair, hedges negated, the least weight of several."""
    signed = F.when(F.col("edge_type") == "hedge", -F.abs("weight")).otherwise(F.col("weight"))
    links = directed(edges.where(F.col("weight") > min_weight)).groupBy("src", "dst").agg(F.min(F.struct(signed.alias("w"), "edge_type")).alias("l"))
    return links.select("src", "dst", "l.w", (F.col("l.edge_type") == "hedge").cast("int").alias("hedge"))


def _least_walks(links: DataFrame, steps: int) -> DataFrame:
    """market, least: the least sum of 1, 2, ... links in a row from each market."""
    found = links.groupBy(F.col("src").alias("market")).agg(F.array(F.min("w")).alias("least"))
    for _ in range(steps - 1):
        after = links.join(found, F.col("dst") == F.col("market")).groupBy("src").agg(F.min(F.col("w") + F.element_at("least", -1)).alias("more"))
        found = found.join(after, F.col("market") == F.col("src")).select("market", F.concat("least", F.array("more")).alias("least"))
    return found


def _half_paths(links: DataFrame, steps: DataFrame, longest: int, lengths: list[int], below: float) -> list[DataFrame]:
    """Paths of 1, 2, ... links from the least market of a cycle, in order of
    degree: start, end, head (the market after the start), the markets in between,
    total and hedges. A path stays while some walk back could close it below.
    Begins with ``links``, goes on with ``steps``."""

    def can(n_links: int):
        back = lambda n: F.greatest(F.get("start_least", n - n_links - 1), F.get("end_least", n - n_links - 1))
        one = [F.col("total") + back(n) < below for n in lengths if n_links <= n - n // 2]
        return reduce(Column.__or__, one)

    step = steps.select(F.col("src").alias("end"), "dst", "dst_degree", "w", "hedge", F.col("dst_least").alias("end_least"))
    above = lambda degree, market: (F.col(degree) > F.col("start_degree")) | ((F.col(degree) == F.col("start_degree")) & (F.col(market) > F.col("start")))
    path = links.select(F.col("src").alias("start"), F.col("src_degree").alias("start_degree"), F.col("dst").alias("end"), "dst_degree", F.col("dst").alias("head"), F.array().cast("array<string>").alias("between"), F.col("w").alias("total"), F.col("hedge").alias("hedges"), F.col("src_least").alias("start_least"), F.col("dst_least").alias("end_least"))
    path = path.where(above("dst_degree", "end")).drop("dst_degree")
    out = []
    for k in range(1, longest + 1):
        if k > 1:
            path = path.drop("end_least").join(step, "end").where(above("dst_degree", "dst") & ~F.array_contains("between", F.col("dst")))
            path = path.select("start", "start_degree", F.col("dst").alias("end"), "head", F.concat("between", F.array("end")).alias("between"), (F.col("total") + F.col("w")).alias("total"), (F.col("hedges") + F.col("hedge")).alias("hedges"), "start_least", "end_least")
        path = path.where(can(k))
        # paths that none goes on from don't need the bounds
        path = materialize(path if k < longest else path.select("start", "end", "head", "between", "total", "hedges"), f"paths-{k}")
        out.append(path)
    return out


#: Half paths that are held at once, and the parts that the starts are dealt to.
PASS_PATHS, START_PARTS = 8_000_000, 1 << 16


#: Copies of links that a pass over short cycles shuffles, if a block needs no more.
PASS_LINKS = 200_000_000


def _numbers(pairs: DataFrame) -> DataFrame:
    """market, number: the names of pairs (a, b) by their place in order."""
    markets = pairs.select(F.explode(F.array("a", "b")).alias("market")).distinct()
    placed = materialize(markets.sort("market").withColumn("at", F.monotonically_increasing_id()), "names")
    # the number holds a part's place and the row in it; the driver sees the parts' sizes
    sizes = {r.part: r.n for r in placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0) + 1))]
    part = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.shiftright("at", 33).cast("int"))
    return placed.select("market", (part + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"))


def _pairs(edges: DataFrame, min_weight: float, ordered: bool) -> DataFrame:
    """``signed_links`` once for each pair: a, b, w, hedge. ``ordered``: no pair
    stands in both orders."""
    a, b = (F.col("market_a"), F.col("market_b")) if ordered else (F.least("market_a", "market_b"), F.greatest("market_a", "market_b"))
    kept = edges.where((F.col("weight") > min_weight) & (F.col("market_a") != F.col("market_b")))
    hedge = F.col("edge_type") == "hedge"
    w = F.when(hedge, -F.abs("weight")).otherwise(F.col("weight"))
    least = lambda c: F.min(F.when(c, w))
    found = kept.groupBy(a.alias("a"), b.alias("b")).agg(F.min(w).alias("w"), least(hedge).alias("hedged"), least(F.col("edge_type") < "hedge").alias("other"))
    # of types with equal weights the least counts
    as_hedge = F.col("hedged").eqNullSafe(F.col("w")) & ~F.col("other").eqNullSafe(F.col("w"))
    return found.select("a", "b", "w", as_hedge.cast("int").alias("hedge"))


def _ordered_links(edges: DataFrame, min_weight: float, ordered: bool) -> tuple[DataFrame, DataFrame | None, int]:
    """low, high, w, hedge, a row for each pair: its markets in order of degree, a
    market's degree above its number. Beside them the names of the numbers, if the
    edges have names, and how many pairs there are."""
    pairs, names = materialize(_pairs(edges, min_weight, ordered), "pairs"), None
    if dict(edges.dtypes)["market_a"] == "string":
        names, named = materialize(_numbers(pairs), "numbers"), pairs
        of = lambda c: broadcast_if_small(names).select(F.col("market").alias(c), F.col("number").alias(f"{c}_number"))
        pairs = materialize(named.join(of("a"), "a").join(of("b"), "b").select(F.col("a_number").alias("a"), F.col("b_number").alias("b"), "w", "hedge"), "pairs")
        discard(named)
    n = pairs.count()
    there = spread_session(edges.sparkSession, n)
    pairs = reopened(pairs, there)
    degree = F.least(F.count(F.lit(1)), F.lit((1 << 63 - NUMBER_BITS) - 1)).alias("degree")
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("market")).groupBy("market").agg(degree)
    ends = materialize(degrees.select("market", F.shiftleft("degree", NUMBER_BITS).bitwiseOR(F.col("market")).alias("end")), "ends")
    few = broadcast_if_small(ends)
    of = lambda c: few.select(F.col("market").alias(c), F.col("end").alias(f"{c}_end"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    links = materialize(both.select(F.least("a_end", "b_end").alias("low"), F.greatest("a_end", "b_end").alias("high"), "w", "hedge"), "links", edges.sparkSession)
    for used in (pairs, ends):
        discard(used)
    return links, names, n


def _named(rings: DataFrame, names: DataFrame | None, name: Callable[[str], str] | None, longest: int) -> DataFrame:
    """Rings of numbers as cycles of names."""
    if names is None:
        parts = [F.expr(name(c)) if name else F.col(c).cast("string") for c in ring_columns(longest)]
    else:
        few = broadcast_if_small(names)
        for c in ring_columns(longest):
            rings = rings.join(few.select(F.col("number").alias(c), F.col("market").alias(f"{c}_name")), c, "left")
        parts = [F.col(f"{c}_name") for c in ring_columns(longest)]
    kind = F.when(F.col("hedges") * 2 > F.col("n"), "hedge_loop").otherwise("inverse_correlation")
    return rings.select(F.concat_ws("->", *parts).alias("cycle"), "n", "total", kind.alias("kind"))


def negative_cycles(edges: DataFrame, max_len: int, min_weight: float, below: float = 0.0, min_len: int = 3, pass_paths: int = PASS_PATHS, name: Callable[[str], str] | None = None, pass_links: int = PASS_LINKS, blocks: int | None = None) -> DataFrame:
    """Cycles of ``min_len`` (three at least) to ``max_len`` markets whose weights,
    hedges negated, sum below ``below``; each once, from its smallest market
    towards its smaller neighbour. ``name``: where markets are whole numbers below
    2 ** 40, SQL that names the one in a column, in the order of the numbers.

    Up to four markets, a cycle is found from its greatest market (by degree, then
    name, so that few paths go through hubs) as two paths of two links that meet, or one
    and a link, by blocks of the links (``short_rings``). A pass takes the blocks of some
    greatest markets, writes their cycles, and its shuffles go: disk holds the links, the
    cycles and one pass. Longer ones go by ``_deep_rings`` if the bar is low, else by
    ``_long_cycles``.
    """
    lengths = list(range(max(3, min_len), max_len + 1))
    short, long = [n for n in lengths if n <= 4], [n for n in lengths if n > 4]
    if not lengths:
        return _no_cycles(edges)
    worker_imports(edges.sparkSession)
    links, names, n = _ordered_links(edges, min_weight, name is not None)
    spark = own_session(edges.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)})
    links, path = reopened(links, spark), new_path(spark, "rings")
    blocks = blocks or blocks_of(n, least=4)
    each = max(1, min(blocks, pass_links // max(1, 3 * n)))
    for low in range(0, blocks if short else 0, each):
        short_rings(links, blocks, low, min(blocks, low + each), short, below, max_len).write.mode("append").parquet(path)
    deep = [m for m in long if links.where(F.col("w") < below / m).count() <= n / DEEP_SHARE]
    if deep:
        _deep_rings(links, n, deep, below, max_len, pass_paths, path)
    discard(links)
    rings = edges.sparkSession.read.schema(ring_schema(max_len)).parquet(path) if short or deep else edges.sparkSession.createDataFrame([], ring_schema(max_len))
    # a deep ring may be found from several of its markets
    found = _named(rings.dropDuplicates(ring_columns(max_len)) if deep else rings, names, name, max_len)
    rest = [m for m in long if m not in deep]
    if rest and name is not None:
        edges = edges.withColumns({c: F.expr(name(c)) for c in ("market_a", "market_b")})
    return found.unionByName(_long_cycles(edges, rest, min_weight, below, pass_paths)) if rest else found


#: Long cycles are deep if at most one link in so many is below their mean.
DEEP_SHARE = 8


def _deep_rings(links: DataFrame, n: int, lengths: list[int], below: float, longest: int, pass_paths: int, path: str) -> None:
    """Rings of five markets and more whose mean is lower than that of most links.

    Two paths with the same ends make a ring. Of an odd length: there is a market from
    which all sums of the first links are below as many times the bar's mean (turn
    the ring to after the greatest of its sums less their means); the longer half goes
    from there. Of an even length: of the halves of a ring, as they move on by a
    link, one is at most half its sum and the next one at least. The two change by
    the link that comes less the one that goes, so one of the two splits has a half at
    most at the bar's half and another above it by at most half that change. The link
    that comes is at an end of that other half, the one that goes meets its other end.

    Markets take their turn as starts, with about ``pass_paths`` links a pass.
    """
    each_way = links.select(F.col("low").alias("src"), F.col("high").alias("dst"), "w", "hedge").unionByName(links.select(F.col("high").alias("src"), F.col("low").alias("dst"), "w", "hedge"))
    half = max(lengths) - max(lengths) // 2
    there = spread_session(links.sparkSession, 2 * n)
    each_way = materialize(each_way, "steps", there)
    walks = materialize(_least_walks(each_way, half - 1), "walks", there)
    least = [F.get("least", i).alias(f"least_{i + 1}") for i in range(half - 1)]
    few = broadcast_if_small(walks)
    steps = materialize(each_way.join(few.select(F.col("market").alias("dst"), *least), "dst").select("src", "dst", "w", "hedge", *[f"least_{i}" for i in range(1, half)]), "steps", there)
    firsts = materialize(steps.join(few.select(F.col("market").alias("src"), F.get("least", 0).alias("start_least")), "src"), "firsts", there)
    for used in (each_way, walks):
        discard(used)
    lowest, most = links.agg(F.min("w"), F.max(F.abs("w"))).first()
    off = slack(below, np.array([most or 0.0]), longest)
    parts = max(1, -(-2 * n // pass_paths))
    for part in range(parts):
        begin = firsts.where(F.pmod(F.xxhash64("src"), F.lit(parts)) == part)
        for m in lengths:
            _deep_pass(begin, steps, m, below + off, lowest or 0.0).mapInArrow(_ring_rows(m, below, longest), ring_schema(longest)).write.mode("append").parquet(path)
    for used in (steps, firsts):
        discard(used)


def _deep_pass(begin: DataFrame, steps: DataFrame, n: int, bar: float, lowest: float) -> DataFrame:
    """Rings of ``n`` over paths from the links ``begin``: their markets m, weights w, hedges."""
    ahead, back, even = n - n // 2, n // 2, n % 2 == 0
    left = lambda k, of: F.col(f"least_{of - k}") if k < of else F.lit(0.0)

    def is_ahead(k: int, total: Column) -> Column:
        if not even:
            return total < k * bar / n
        return (total + left(k, ahead) < bar / 2) & (F.col("end") > F.col("m0") if k == ahead else F.lit(True))

    one = _paths(begin, steps, ahead, is_ahead)
    one = materialize(one, "paths-ahead", one.sparkSession)
    by_start = one.groupBy("m0").agg(F.min("total").alias("start_sum"))
    by_end = one.groupBy(F.col("end").alias("last")).agg(F.min("total").alias("end_sum"))

    def is_back(k: int, total: Column) -> Column:
        fits = total + left(k, back) + F.col("start_sum") < bar
        if not even:
            return fits
        if k < back:
            before = F.col(f"least_{back - k - 1}") if back - k > 1 else F.lit(0.0)
            return fits & ((total - F.col("w0") / 2 + left(k, back) + lowest / 2 < bar / 2) | (total + before + lowest / 2 + F.col("start_least") / 2 < bar / 2))
        near = (total - F.col("w0") / 2 + F.col("end_least") / 2 < bar / 2) | (total - F.col(f"w{k - 1}") / 2 + F.col("start_least") / 2 < bar / 2)
        return fits & near & (F.col("end") > F.col("m0"))

    two = _paths(begin.join(by_start.withColumnRenamed("m0", "src"), "src"), steps, back, is_back)
    two = two.join(by_end, two["end"] == by_end["last"]).where(F.col("total") + F.col("end_sum") < bar)
    two = two.select("m0", "end", F.col("total").alias("rest"), F.col("hedges").alias("more"), *[F.col(f"m{i}").alias(f"b{i}") for i in range(1, back)], *[F.col(f"w{i}").alias(f"v{i}") for i in range(back)])
    apart = reduce(Column.__and__, [F.col(f"m{i}") != F.col(f"b{j}") for i in range(1, ahead) for j in range(1, back)])
    met = one.join(two, ["m0", "end"]).where((F.col("total") + F.col("rest") < bar) & apart)
    ring = [F.col(f"m{i}") for i in range(ahead)] + [F.col("end").alias(f"m{ahead}")] + [F.col(f"b{j}").alias(f"m{n - j}") for j in range(back - 1, 0, -1)]
    return met.select(*ring, *[f"w{i}" for i in range(ahead)], *[F.col(f"v{j}").alias(f"w{n - 1 - j}") for j in range(back - 1, -1, -1)], (F.col("hedges") + F.col("more")).alias("hedges"))


def _paths(begin: DataFrame, steps: DataFrame, longest: int, keep: Callable[[int, Column], Column]) -> DataFrame:
    """Simple paths from the links ``begin``, of which each beginning is kept: markets
    m0 to the last but one, end, weights w0 and on, total and hedges."""
    aside = [c for c in begin.columns if c in ("start_least", "start_sum")]
    bounds = [c for c in steps.columns if c.startswith("least_")]
    path = begin.select(F.col("src").alias("m0"), F.col("dst").alias("end"), F.col("w").alias("w0"), F.col("w").alias("total"), F.col("hedge").alias("hedges"), *aside, *bounds)
    path = path.withColumn("end_least", F.col("least_1")).where(keep(1, F.col("total")))
    step = steps.select(F.col("src").alias("end"), F.col("dst").alias("to"), F.col("w").alias("next"), "hedge", *bounds)
    for k in range(1, longest):
        known = [*[f"m{i}" for i in range(k)], *[f"w{i}" for i in range(k)], *aside]
        grown = path.drop(*bounds, "end_least").join(step, "end")
        grown = grown.where(reduce(Column.__and__, [F.col("to") != F.col(f"m{i}") for i in range(k)]))
        grown = grown.select(*known, F.col("end").alias(f"m{k}"), F.col("to").alias("end"), F.col("next").alias(f"w{k}"), (F.col("total") + F.col("next")).alias("total"), (F.col("hedges") + F.col("hedge")).alias("hedges"), *bounds, F.col("least_1").alias("end_least"))
        path = grown.where(keep(k + 1, F.col("total")))
    return path


def _ring_rows(n: int, below: float, longest: int):
    def run(batches):
        for batch in batches:
            ends = np.stack([batch.column(f"m{i}").to_numpy() for i in range(n)], 1) & NUMBER
            weights = np.stack([batch.column(f"w{i}").to_numpy() for i in range(n)], 1)
            yield ring_batch(ends, weights, batch.column("hedges").to_numpy(), below, longest)

    return run


def _long_cycles(edges: DataFrame, lengths: list[int], min_weight: float, below: float, pass_paths: int) -> DataFrame:
    """Cycles of five markets and more.

    Meeting halfway: a cycle is two paths from its least market (by degree, then
    name, so that few paths start at hubs) to the market opposite, half as long
    as it. Only the half paths are written; they meet in one join on both ends.

    Both halves start at one market, so markets take their turn as starts: a pass takes
    as many as have about ``pass_paths`` half paths, going by the passes before, writes
    its cycles, and then its half paths and shuffles go. So disk holds the cycles and
    one pass, however large the graph is.
    """
    max_len = max(lengths)
    alone = own_session(edges.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
    signed = materialize(signed_links(edges, min_weight), "signed", alone)
    degree = materialize(signed.groupBy(F.col("src").alias("market")).agg(F.count(F.lit(1)).alias("degree")), "degree")
    walks = materialize(_least_walks(signed, max_len - 1), "walks")
    known = materialize(degree.join(walks, "market"), "known")
    of = lambda c: known.select(F.col("market").alias(c), F.col("degree").alias(f"{c}_degree"), F.col("least").alias(f"{c}_least"))
    part = F.pmod(F.xxhash64("src"), F.lit(START_PARTS)).alias("part")
    links = materialize(signed.join(of("src"), "src").join(of("dst"), "dst").select("*", part), "links")
    for used in (signed, degree, walks, known):
        discard(used)
    longest = max_len - max_len // 2
    # walks of two or three links bound the half paths of the first pass
    bound = links.agg(F.sum(F.col("dst_degree") * (F.col("src_degree") if longest > 2 else 1)).cast("double")).first()[0] or 0.0
    path = new_path(edges.sparkSession, "cycles")
    low, width = 0, START_PARTS if bound <= pass_paths else max(1, int(START_PARTS * pass_paths / bound))
    while low < START_PARTS:
        half = _half_paths(links.where(F.col("part").between(low, low + width - 1)), links, longest, lengths, below)
        _closed(half, lengths, below).write.mode("append").parquet(path)
        rows = max(1, sum(h.count() for h in half))
        for used in half:
            discard(used)
        low, width = low + width, max(1, min(8 * width, int(width * pass_paths / rows)))
    discard(links)
    return edges.sparkSession.read.schema(_no_cycles(edges).schema).parquet(path)


def _closed(half: list[DataFrame], lengths: list[int], below: float) -> DataFrame:
    """Cycles of two half paths each."""
    out = _no_cycles(half[0])
    for n in lengths:
        one = half[n - n // 2 - 1].select("start", "end", "head", "between", "total", "hedges")
        two = half[n // 2 - 1].select("start", "end", F.col("head").alias("tail"), F.reverse("between").alias("back"), F.col("total").alias("rest"), F.col("hedges").alias("more"))
        met = one.join(two, ["start", "end"]).where((F.col("head") < F.col("tail")) & (F.col("total") + F.col("rest") < below) & ~F.arrays_overlap("between", "back"))
        ring = F.concat(F.array("start"), F.col("between"), F.array("end"), F.col("back"))
        met = met.select(ring.alias("ring"), (F.col("total") + F.col("rest")).alias("total"), (F.col("hedges") + F.col("more")).alias("hedges"))
        # from the smallest market on, in the direction of its smaller neighbour
        first = F.array_position("ring", F.array_min("ring")).cast("int")
        turned = met.withColumn("ring", F.concat(F.slice("ring", first, n), F.slice("ring", F.lit(1), first - 1)))
        turned = turned.withColumn("ring", F.when(F.get("ring", 1) < F.element_at("ring", -1), F.col("ring")).otherwise(F.concat(F.slice("ring", 1, 1), F.reverse(F.slice("ring", 2, n - 1)))))
        kind = F.when(F.col("hedges") * 2 > n, "hedge_loop").otherwise("inverse_correlation")
        out = out.unionByName(turned.select(F.array_join("ring", "->").alias("cycle"), F.lit(n).alias("n"), "total", kind.alias("kind")))
    return out


def _no_cycles(edges: DataFrame) -> DataFrame:
    return edges.sparkSession.createDataFrame([], "cycle string, n int, total double, kind string")


def has_negative_cycle(edges: DataFrame, min_weight: float = 0.1) -> DataFrame:
    """Whether distances from a virtual source, at cost zero to every market,
    would still fall after as many rounds as there are markets.

    They do exactly if a closed walk has a negative sum. Every link runs both
    ways at one weight, so a link below zero is such a walk by itself, there and
    back; and without one no sum is negative. The fixed point of the relaxation
    is thus known from its first round: some distance falls below zero or none
    ever does. ``pairs`` counts the links below zero.
    """
    first = signed_links(edges, min_weight).groupBy("dst").agg(F.min("w").alias("dist"), F.count_if(F.col("w") < 0).alias("n"))
    return first.agg(F.coalesce(F.min("dist") < 0, F.lit(False)).alias("found"), F.coalesce(F.sum("n") / 2, F.lit(0)).cast("long").alias("pairs"))


def cycle_alerts(cycles: DataFrame, at: int) -> DataFrame:
    return cycles.select(F.md5("cycle").alias("cycle_id"), "cycle", "kind", F.when(F.col("total") < -2, "high").otherwise("normal").alias("severity"), F.lit(at).alias("detected_us"))


def graph_stats(edges: DataFrame) -> DataFrame:
    degree = directed(edges).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    whole = degree.agg(F.count(F.lit(1)).alias("vertices"), F.sum("d").alias("directed_edges"), F.avg("d").alias("avg_degree"), F.max("d").alias("max_degree"))
    kinds = edges.agg(*[F.count_if(F.col("edge_type") == t).alias(t) for t in ("correlation", "hedge", "causal", "arbitrage")])
    return whole.join(F.broadcast(kinds))
