"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.storage import discard, materialize, reopened, spread, spread_session


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable.

    Large and small stars in turn: each vertex links its larger neighbours to the
    smallest of its neighbourhood, then its smaller neighbours and itself to the
    smallest of them. Links never leave their component, most of them become equal
    and go, and after about as many rounds as a component's size has binary digits
    every vertex is linked with its smallest alone. Links are written to the shared
    folder each round, in place of the last ones; the driver sees whether one is left.
    """
    larger = F.when(F.col("a") > F.col("b"), F.col("a")).otherwise(F.col("b"))
    links = edges.where("a <> b").select(larger.alias("hi"), _less("a", "b").alias("lo"))
    links = materialize(links.distinct(), "links")
    while not _stars(links):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", _less("u", "v").alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(own, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(own.select("hi", "m")).distinct()
        new = materialize(small, "links")
        for used in (links, least, large):
            discard(used)
        links = new
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(links.select("lo", "lo").distinct())


def dense_components(edges: DataFrame) -> DataFrame:
    """The same for graphs of many more links than vertices, cheap to read.

    Each vertex first keeps the links to its smallest and largest neighbour alone, which
    stars settle. Then all links take their ends' components, and those between two
    components are the links of the next turn. Each turn joins every vertex that has a
    link to another, so their number halves at least. Links, and the few that go through
    the stars, are dealt by their number, and joins hold only labels.
    """
    spark, links, labels = edges.sparkSession, edges.where("a <> b").select("a", "b"), None
    while True:
        rows = (edges if labels is None else links).count()
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        ends = spread(both, ["u"], 2 * rows).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        few = materialize(ends.select(F.col("u").alias("a"), F.explode(F.array("low", "high")).alias("b")), "few")
        found = reopened(materialize(components(reopened(few, spread_session(spark, few.count()))), "found"), spark)
        discard(few)
        of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"in_{end}")).hint("shuffle_hash")  # noqa: E731, B023
        one = spread(links, ["a"], rows).join(of("a"), "a")
        two = spread(one.select("in_a", "b"), ["b"], rows).join(of("b"), "b")
        between = materialize(two.where("in_a <> in_b").select(F.col("in_a").alias("a"), F.col("in_b").alias("b")).distinct(), "between")
        if labels is None:
            labels = found
        else:
            now = found.select(F.col("id").alias("component"), F.col("component").alias("least"))
            labels = materialize(labels.join(now, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "labels")
            discard(links)
        links = between
        if links.isEmpty():
            return labels


def _less(a: str, b: str) -> Column:
    return F.when(F.col(a) < F.col(b), F.col(a)).otherwise(F.col(b))


def _stars(links: DataFrame) -> bool:
    """Whether each vertex has one link at most, or only such that come to it."""
    ends = links.select(F.col("hi").alias("id"), F.lit(1).alias("out")).union(links.select("lo", F.lit(0)))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("least")).where("out > 1 or (out = 1 and least = 0)").isEmpty()
