"""Line dedup by deletion neighbourhoods, with DataFrame functions only.

A line is its words; two lines are near if one word inserted, deleted or
replaced turns one into the other (edit distance 1 over words) and both have at
least ``MIN_WORDS`` words, so that three words in four stay. Lines of the same
words in the same order are equal at any length. A line goes if any line before
it is equal or near; the earliest stays. Order is doc_id, then a hash of the
text (for rows that share a doc_id), then line number. Every line that isn't
blank takes part.

1. Equal lines collapse to their earliest place, by two hashes of their words.
2. Near lines share their first or their last half, whichever the edit is not
   in. Lines whose halves no other line has can't be near to any and go no
   further (an exact filter).
3. The others emit a key for each variant with one word deleted, and for
   themselves. A variant's key is a sum over neighbouring word pairs, so each
   deletion costs three additions. Lines under one variant key with the same
   deleted position differ in that word only; the minimum of their places under
   that key is the earliest of them, and the minimum over lines that are the
   variant itself is the earliest shorter one. Nothing lists pairs.
4. Each line with an earlier partner is compared with it word by word; only a
   verified line goes.

Keys are 96 bits of sums over 64- and 32-bit pair hashes, so that a collision
that could hide a partner from step 4 has odds of 2**-96 for each two variants.
Sums stay inside a long for lines of up to 2**31 words.

Defined cases: a null text stays null; blank lines stay; a document whose lines
all go becomes an empty text; rows of one doc_id with different texts are
documents of their own; rows of one doc_id and one text are one document, whose
lines don't drop each other; rows with a null doc_id pass unchanged; an empty
table gives an empty result; other columns pass, except that n_chars follows the
text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize
from tidebook.llm.tables import apart, let, read, small_side, together

MIN_WORDS = 4
_SPACES = r"[\x20\x09-\x0D]+"
_ROW = ["doc_id", "_row"]


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_row", F.xxhash64("text"))


def _plain(line: Column) -> Column:
    """The words of a line with one space between them."""
    odd = [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")] + [F.startswith(line, F.lit(" ")), F.endswith(line, F.lit(" "))]
    return F.when(reduce(Column.__or__, odd), F.trim(F.regexp_replace(line, _SPACES, " "))).otherwise(line)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, _row, line number, words and their number of lines that can go."""
    rows = _with_row(docs).select(*_ROW, F.posexplode(F.split("text", "\n")).alias("line", "said"))
    rows = rows.select(*_ROW, "line", _plain(F.col("said")).alias("plain")).where("plain <> ''")
    return rows.withColumn("n", F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "))) + 1)


def _halves() -> Column:
    """Hashes of the first and last half of a line, for partners of its own
    length and of one word more or less; null for the shortest lines."""
    a, b = F.expr("cast(n div 2 as int)"), F.expr("cast((n - 1) div 2 as int)")
    # of an odd number of words both lengths are the same; the shortest have no shorter partner
    one = F.array(_half(0, a), _half(1, a))
    two = F.array(_half(0, a), _half(1, a), _half(0, b), _half(1, b))
    return F.when(F.col("n") < MIN_WORDS, None).when((a == b) | (F.col("n") == MIN_WORDS), one).otherwise(two)


def _half(side: int, h: Column) -> Column:
    part = F.call_function("substring_index", F.col("plain"), F.lit(" "), h if side == 0 else -h)
    return F.xxhash64(F.lit(side), h, part)


def _variants(rows: DataFrame) -> DataFrame:
    """place, v, u, at: the key of each line (at = -1) and of each deletion."""
    # a sentinel at either end gives every word two neighbours
    framed = rows.withColumn("w", F.concat(F.array(F.lit("\n")), F.col("words"), F.array(F.lit("\n"))))
    low = 0xFFFFFFFF

    def pair(i, j) -> Column:
        both = F.get("w", i), F.get("w", j)
        return let(F.xxhash64(*both), lambda h: F.struct(F.shiftrightunsigned(h, 32).alias("a"), h.bitwiseAND(F.lit(low)).alias("b"), F.hash(*both).cast("long").alias("c")))

    links = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: pair(i, i + 1))
    summed = framed.withColumn("g", links)
    total = lambda k: F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x[k])
    summed = summed.withColumns({"_a": total("a"), "_b": total("b"), "_c": total("c")})
    n = F.size("words")

    def without(i) -> Column:
        part = lambda k, new: F.col(f"_{k}") - F.get("g", i - 1)[k] - F.get("g", i)[k] + new[k]
        return let(pair(i - 1, i + 1), lambda new: F.struct(F.xxhash64(part("a", new), part("b", new), n - 1).alias("v"), part("c", new).alias("u"), i.alias("at")))

    deleted = F.transform(F.sequence(F.lit(1), n), without)
    own = F.array(F.struct(F.xxhash64("_a", "_b", n).alias("v"), F.col("_c").alias("u"), F.lit(-1).alias("at")))
    return summed.select("place", F.explode(F.concat(own, deleted)).alias("x")).select("place", "x.*")


def _near(a: Column, b: Column) -> Column:
    """Word edit distance of at most one."""
    m, n = F.size(a), F.size(b)
    long, short = F.when(m >= n, a).otherwise(b), F.when(m >= n, b).otherwise(a)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    head = F.array_position(F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    without = F.concat(F.slice(long, F.lit(1), head - 1), F.slice(long, head + 1, F.size(long)))
    return F.when(m == n, differ <= 1).when(F.abs(m - n) == 1, without == short).otherwise(False)


def _said(docs: DataFrame, places: DataFrame) -> DataFrame:
    """place and words of some lines; ``places`` has doc_id, _row, line."""
    wanted = materialize(places.groupBy(*_ROW).agg(F.collect_set("line").alias("_lines")), "wanted")
    rows = _with_row(docs.select("doc_id", "text")).join(small_side(wanted), _ROW)
    lines = let(F.split("text", "\n"), lambda p: F.transform("_lines", lambda i: F.struct(i.alias("line"), F.get(p, i).alias("said"))))
    each = rows.select(*_ROW, F.explode(lines).alias("x")).select(F.struct(*_ROW, "x.line").alias("place"), _plain(F.col("x.said")).alias("plain"))
    return each.select("place", F.split("plain", " ").alias("words")).dropDuplicates(["place"])


def _near_places(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The places, among the earliest ones of their kind, of lines that an
    earlier line is near to."""
    half = kinds.where("halves is not null").select("place", F.explode("halves").alias("half"))
    met = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    live = materialize(half.join(met, "half", "left_semi").select("place.*").distinct(), "live")
    words = materialize(_said(docs, live), "live-lines")
    variants = materialize(_variants(words), "variants")
    key = ["v", "u"]
    replaced = variants.where("at > 0").groupBy(*key, "at").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").drop("hi")
    by_place = variants.where("at > 0").join(replaced, [*key, "at"]).where("lo < place").select("place", "lo")
    ends = variants.groupBy(*key).agg(F.min(F.when(F.col("at") < 0, F.col("place"))).alias("own"), F.min(F.when(F.col("at") > 0, F.col("place"))).alias("longer"))
    ends = materialize(ends.where("own is not null and longer is not null"), "ends")
    shorter = variants.where("at > 0").join(ends, key).where("own < place").select("place", F.col("own").alias("lo"))
    longer = variants.where("at < 0").join(ends, key).where("longer < place").select("place", F.col("longer").alias("lo"))
    # a partner from each relation, so that one that fails hides no other
    pairs = by_place.union(shorter).union(longer).distinct()
    other = words.select(F.col("place").alias("lo"), F.col("words").alias("before"))
    return pairs.join(words, "place").join(other, "lo").where(_near(F.col("words"), F.col("before"))).select("place").distinct()


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, line) of every line that an earlier one equals or nearly does."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    keyed = numbered(docs).select(*_ROW, "line", F.xxhash64("plain").alias("h1"), F.xxhash64(F.lit(1), "plain").alias("h2"), _halves().alias("halves"))
    keyed = materialize(keyed, "lines")
    place = F.struct(*_ROW, "line")
    # equal lines have equal halves, so they ride along in the minimum
    kinds = keyed.groupBy("h1", "h2").agg(F.min(F.struct(*_ROW, "line", "halves")).alias("p"), F.count(F.lit(1)).alias("n"))
    kinds = kinds.select("h1", "h2", "n", F.struct("p.doc_id", "p._row", "p.line").alias("place"), "p.halves")
    kinds = materialize(kinds, "kinds")
    gone = _near_places(docs, kinds).withColumn("near", F.lit(True))
    # a kind whose earliest line goes takes all its lines along
    some = kinds.join(gone, "place", "left").where("n > 1 or near").select("h1", "h2", F.col("place").alias("lo"), F.coalesce("near", F.lit(False)).alias("near"))
    return keyed.select(place.alias("place"), "h1", "h2").join(small_side(materialize(some, "repeated")), ["h1", "h2"]).where("near or lo < place").select("place.*")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with those lines taken out of the text; ``dropped`` counts them."""
    docs = docs.drop("dropped")
    gone = duplicates(docs).groupBy(*_ROW).agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    rows, names = apart(docs)
    rows = rows.withColumns({"doc_id": F.col(names["doc_id"]), "_row": F.xxhash64(names["text"])})
    joined = rows.join(small_side(materialize(gone, "gone")), _ROW, "left")

    def kept(parts: Column) -> Column:
        # runs of lines between the places that go
        edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(parts)))
        runs = let(edges, lambda g: F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda j: F.slice(parts, F.get(g, j) + 2, F.get(g, j + 1) - F.get(g, j) - 1)))
        return F.array_join(F.flatten(runs), "\n")

    was = F.col(names["text"])
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), was).otherwise(let(F.split(was, "\n"), kept)))
    out = out.withColumn("dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_gone").isNull(), F.col(names["n_chars"])).otherwise(F.char_length("text").cast("long"))
    return together(out, names, "dropped", **new)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_duplicates(docs).select("doc_id", "dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
