"""Document fingerprints by winnowing, with DataFrame functions only.

A k-gram is ``K`` tokens in a row. A token is a word; in scripts that put no
spaces between words each character is one. A k-gram's hash (``K`` is small, so
each is hashed outright) is packed with its position into one long, high bits from
the hash and low bits from the position counted backwards. The minimum of each
window of ``WINDOW`` neighbouring k-grams is then the smallest hash and, among
equal ones, the rightmost. Window minima come from doubling: minima of 1, 2, 4,
... neighbours, each from two of the one before. Two texts that share
``K + WINDOW - 1`` tokens in a row share a fingerprint.

The next document's text is a lead() inside ranges of doc_id. Ranges are cut at
sampled quantiles, a few for each shuffle partition and without a limit; each also
gets a copy of the first document of the following range, so text is shuffled
once and no window holds more than one range. Which range follows which is
settled on ids alone.

Defined cases: a null text is empty; a text with fewer than ``K`` tokens is one
k-gram of all its tokens; a text without tokens has an empty fingerprint, and two
empty ones have likeness 1; fewer k-grams than a window make one window; rows
that repeat a doc_id come in the order of their text's hash, each followed by
the next row; one document alone is its own next; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm.tables import let, partitions, read

K = 5
DOUBLINGS = 4
WINDOW = 1 << DOUBLINGS
#: Bits of a packed value that hold the position.
POSITION_BITS = 24
_SPAN = 1 << POSITION_BITS
#: Thai, Lao, Tibetan, Myanmar, Khmer; kana; ideographs and their marks (fixed values).
SPACELESS = "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"


def words(text: Column) -> Column:
    apart = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(text, f"({SPACELESS})", " $1 "))
    return F.filter(F.split(apart, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def winnow(text: Column, k: int = K, doublings: int = DOUBLINGS) -> Column:
    """Selected k-grams of a text as packed longs, in order of position.

    Positions count modulo ``2 ** POSITION_BITS``; ties in the hash are broken
    rightmost within any window that doesn't straddle such a wrap.
    """
    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.shiftleft(F.shiftright(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), POSITION_BITS), POSITION_BITS).bitwiseOR(F.lit(_SPAN - 1) - F.pmod(i, F.lit(_SPAN))))
        one = F.array(F.shiftleft(F.shiftright(F.xxhash64(w), POSITION_BITS), POSITION_BITS).bitwiseOR(F.lit(_SPAN - 1)).cast("long"))
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<long>"))

    def minima(g: Column) -> Column:
        steps = F.array(*[F.lit(1 << i) for i in range(doublings)])
        return F.aggregate(steps, g, lambda m, d: F.when(F.size(m) > d, F.transform(F.sequence(F.lit(0), F.size(m) - d - 1), lambda i: F.least(F.get(m, i), F.get(m, i + d)))).otherwise(m))

    def chosen(g: Column) -> Column:
        few = F.size(g) <= 1 << doublings
        return F.when(few & (F.size(g) > 0), F.array(F.array_min(g))).otherwise(F.array_distinct(minima(g)))

    return let(words(text), lambda w: let(grams(w), chosen))


def rendered(marks: Column) -> Column:
    """``position:hash`` of each selected k-gram, in order, as one string."""
    one = lambda m: F.concat(
        (F.lit(_SPAN - 1) - m.bitwiseAND(F.lit(_SPAN - 1))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftrightunsigned(m, POSITION_BITS)))
    )
    return F.array_join(F.transform(marks, one), " ")


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, POSITION_BITS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below a key; two short searches."""
    step = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda some: F.size(F.filter(some, lambda c: c < key))
    longs = lambda some: F.array(*[F.lit(c).cast("long") for c in some]).cast("array<long>")
    # the last block whose first cut lies below the key, and its cuts below the key
    block = below(longs([f[0] for f in fine]))
    inside = let(F.get(F.array(*map(longs, fine)), block - 1), below)
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside) if cuts else F.lit(0)


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, Window]:
    """``docs`` (doc_id, text) with ``next_text``; the last wraps to the first."""
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges + 10_000).alias("c")).first()["c"] if ranges > 1 else []
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ranged = keyed.withColumn("_range", _range_of(key, sorted(set(cuts or []))))
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_h")).alias("f"))
    order = Window.orderBy("_range")  # two ids for each range, no texts
    every = Window.partitionBy(F.lit(1))
    before = F.lag("_range").over(order)
    follows = firsts.select(F.col("_range").alias("_of"), F.col("f.doc_id").alias("_id"), F.col("f._h").alias("_hash"), F.coalesce(before, F.max("_range").over(every)).alias("_to"), F.when(before.isNull(), 2).otherwise(1).alias("_ghost"))
    # repeated rows give equal ghosts; the first of them is enough
    met = (F.col("_range") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))
    ghosts = ranged.join(F.broadcast(follows), met).select(F.col("_to").alias("_range"), "doc_id", "_h", "text", "_ghost")
    rows = ranged.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    inside = Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_h")
    return rows.withColumn("next_text", F.lead("text").over(inside)), inside


def edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, the text, its edited text, and the marks of both and of the next."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, inside = with_next(base, ranges or 4 * partitions(spark))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("marks", winnow(F.col("text")))
    rows = rows.withColumn("next_marks", F.lead("marks").over(inside)).where("_ghost = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    return rows.withColumn("edited", edited).withColumn("edited_marks", winnow(F.col("edited"))).select("doc_id", "n_chars", "text", "edited", "marks", "edited_marks", "next_marks")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(read(spark, sf_dir, "documents"))
    own, other, after = (hashes(F.col(c)) for c in ("marks", "edited_marks", "next_marks"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("marks")).alias("fingerprint"),
        rendered(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )
