"""Mixing sources to target weights, with DataFrame functions only.

Each source gets a share of all words by its weight, at most ``max_epochs``
times what it holds; what a capped source can't take is shared again among the
others by weight. Inside a source, documents are ordered by a hash of their id.
The leading hex digits of that hash range-partition each source into buckets,
so a source with a third of all rows is spread over ``16 ** digits`` groups.
Words before a document are then the total of the earlier buckets plus a
running sum inside its own bucket: a distributed prefix sum. A source takes
whole epochs first and then cuts at the exact word.

Defined cases: a null text has no words; null sources form one source, which
comes last; documents without words take nothing; rows that repeat a doc_id are
ordered by the hash of their text; an empty table gives an empty result; other
columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.tables import WORD, apart, read, together

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
DIGITS = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    A level L solves sum(least(cap, L * weight)) = total: with sources ordered
    by cap / weight, those before some point are capped and L follows from the
    rest. One row for each source, of a name and three numbers, goes through
    this in one task, never one per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w.cast("long")).withColumn("_cap", max_epochs * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward)
    solved = ranked.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= F.col("_cap"))
    final = solved.withColumn("_l", F.min(F.when(F.col("_fits"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))).over(everything)["_level"])
    target = F.when(F.col("_l").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_l") * F.col("_w")))
    return final.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, digits: int = DIGITS, seed: str = SEED) -> DataFrame:
    """Every document with ``size, source_size, target, taken`` added.

    ``taken`` is the number of its words in the mix, repeats counted.
    """
    extra = ["size", "source_size", "target", "taken"]
    rows, names = apart(docs.drop(*extra))
    keyed = (
        rows.withColumns({c: F.col(names[c]) for c in ("doc_id", "text", "source")})
        .withColumn("size", n_words(F.col("text")))
        .withColumn("_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))))
        .withColumns({"_bucket": F.substring("_key", 1, digits), "_text": F.xxhash64("text")})
        .drop("doc_id", "text")
    )
    spread = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    targets = source_targets(spread.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    plan = offsets.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "_text", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = running.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_offset") - F.col("_inside")))
    return together(joined.withColumn("taken", (epochs * F.col("size") + part).cast("long")), names, *extra)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy taken; the last one of a document
    that the budget cuts holds its first words only, as they stand."""
    rows, names = apart(mix(docs, **options).where("taken > 0"))
    own = {c: n for c, n in names.items() if c in docs.columns}
    size, taken = (F.col(names[c]) for c in ("size", "taken"))
    copies = rows.withColumns({"_whole": (taken / size).cast("int"), "_more": taken % size})
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_whole") + (F.col("_more") > 0).cast("int"))))
    pieces = F.regexp_extract_all(names["text"], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_more").cast("int")), "")
    partial = F.col("_copy") > F.col("_whole")
    copies = copies.withColumn("text", F.when(partial, cut).otherwise(F.col(names["text"])))
    new = {"text": F.col("text")}
    if "n_chars" in own:
        new["n_chars"] = F.when(partial, F.char_length("text").cast("long")).otherwise(F.col(names["n_chars"]))
    return together(copies, own, **new)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || 'mix-1') AS k, text FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, 1 + i % 3 AS w FROM
    (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s)
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
     / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), f AS (SELECT min_by(lev, (cap / w, i)) AS lev FROM l WHERE lev * w <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(f.lev, cap) * w) AS target FROM r, f),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN (budget // source_size) * size
     + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM c
""",
}
