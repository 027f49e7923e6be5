"""Substring dedup on a de Bruijn graph of word windows.

A word is covered if it lies in a window of ``WINDOW`` words whose sequence also
starts in a document of a smaller doc_id. Windows are the edges of a de Bruijn graph
(from their first ``WINDOW`` - 1 words to their last). Only edges that more than one
document has matter, and they come in long paths, so the graph is kept as paths.

1. Copies. Rows of equal text are known by a 256-bit digest. The one of the smallest
   doc_id stands for all; the others are covered by it if they have a window at all.
2. Candidates. A window's least ``ANCHOR``-word hash is the same wherever the
   window occurs. Each document names these values once for each run of windows;
   those of more than one document go, hashed, into a bitmap of at most
   ``MOST_BITS`` bits. A window whose value isn't in it occurs in one document. A full
   bitmap lets more windows pass and loses none; so does the one that tells copies.
   Nothing else is broadcast but tables whose bytes were summed.
3. Edges. Candidate windows are grouped by a 128-bit digest of their words to their first
   place (the smallest doc_id, and there a word's place), which is joined back to all places.
4. Paths. In a document two windows in a row are two edges that meet at a node. Where
   the first places of both follow each other too, the edges are one path, so each
   document is a row of segments of the documents that had its windows first:
   (document, place, windows, first document, its place). Places where segments begin
   or end are the only possible branches. They cut the first places into pieces, and
   ``paths`` joins each piece to the next wherever the node between them has one way
   in and one way out.
5. Places verify: a segment holds only windows whose words were met, in a row, from
   its first place on. ``unlike`` reads the words at both places of each segment and
   gives those that differ; it is a check of its own, as it reads all texts again.

Grouping and joins by window spread a passage over as many keys as it has windows;
a passage that a third of all documents share leaves its keys hot, which the groups
meet by combining first and the join by AQE's split of the many-rowed side (both
sides are exchanges). Long texts are hashed piece by piece.

Defined cases: null and wordless texts have no windows; documents of one doc_id take
nothing from each other; a null doc_id has no order, so such rows neither lose nor
take; equal rows fare alike; an empty table gives an empty result; other columns pass
with their rows, but for ``n_words`` and ``n_removed``, which are computed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.functions.graphs import components
from tidebook.functions.storage import materialize, worker_imports
from tidebook.llm import grams
from tidebook.llm.tables import apart, read, small_side, together

WINDOW, ANCHOR = 50, 25
#: Bits a repeated value gets in the bitmap, and the most of all (16 MB).
BITS_EACH, MOST_BITS = 64, 1 << 27
#: Words of a long text that are hashed at a time.
CHUNK = 1 << 18
#: A place is its row's hash (rows may share a doc_id) above the number of the word.
WORD_BITS = 31
#: The windows of a row that is a copy: more than a text can have.
WHOLE = 1 << 30
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_PAGE = 1 << 15


def _place(text: str):
    """Where the places of a row with this text begin."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)), WORD_BITS)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, at (where the row's places begin), a key of both and the text's bytes."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _place("text").alias("at"), F.col("text").cast("binary").alias("text"))
    return rows.select("doc_id", "at", F.xxhash64("doc_id", "at").alias("key"), "text")


def copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc, at, key and lo of rows whose text a smaller doc_id ``lo`` has; keys of the others."""
    told = materialize(rows.select("doc_id", "at", "key", F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    lowest = materialize(told.groupBy("sha").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "copied")
    both = told.join(small_side(lowest), "sha", "left")
    later = both.where("lo < doc_id").select(F.col("doc_id").alias("doc"), "at", "key", "lo").distinct()
    return materialize(later, "copies"), both.where("lo is null or lo = doc_id").select(F.col("key").alias("value"))


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words in a row."""
    n = len(h) - width + 1
    total = np.empty(len(h) + 1, _U)
    total[0] = 0
    np.cumsum(h * grams._power(_BASE, len(h)), out=total[1:])
    return grams.mixed((total[width:] - total[:-width]) * grams._power(_INVERSE, n))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return np.minimum(x[:n], x[width - have :][:n])


def windows(texts, window: int, anchor: int):
    """(text, word, anchor value) of all windows, as arrays, part by part."""
    for a, _, part in grams.blocks(texts):
        h, first = grams.hashed_words(part, fold=False)
        sizes = np.diff(first)
        text = np.repeat(np.arange(a, a + len(part)), sizes)
        word = np.arange(len(h)) - np.repeat(first[:-1], sizes)
        for at in range(0, len(h), CHUNK):
            some = h[at : at + CHUNK + window - 1]
            n = len(some) - window + 1
            if n <= 0:
                continue
            own = text[at : at + n]
            inside = np.flatnonzero(own == text[at + window - 1 : at + window - 1 + n])
            if len(inside):
                yield own[inside], word[at : at + n][inside], _least(_rolling(some, anchor), window - anchor + 1)[inside]


def _digests(text: bytes, words: np.ndarray, window: int) -> np.ndarray:
    """The 128-bit digests, as two numbers each, of the windows at some words."""
    parts = text.split()
    plain = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    lo, hi = (ends - np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))[words].tolist(), (ends - 1)[words + window - 1].tolist()
    return np.frombuffer(b"".join([hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(lo, hi, strict=True)]), np.int64).reshape(-1, 2)


def _held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & _U(8 * len(bits) - 1)
    return (bits[low >> _U(3)] >> (low & _U(7)).astype(np.uint8) & 1).astype(bool)


def _known(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """The rows that stand for their text."""
    return batch.filter(pa.array(_held(bits, batch.column("key").to_numpy().view(_U))))


def _arrow(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False) if c.dtype != _U else c.view(np.int64)) for c in columns], names)


def repeated_anchors(rows: DataFrame, first, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The anchor values that windows of more than one document have; ``first``
    is the broadcast bitmap of the rows that stand for their text."""

    def name(batches):
        for batch in batches:
            batch = _known(batch, first.value)
            ids = batch.column("doc_id").to_numpy()
            for text, _, least in windows(batch.column("text").to_pylist(), window, anchor):
                new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
                yield _arrow(["value", "doc"], least[new], ids[text[new]])

    named = rows.select("doc_id", "key", "text").mapInArrow(name, "value long, doc long")
    return named.groupBy("value").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("value")


def bitmap(values: DataFrame) -> np.ndarray:
    """The values' lowest bits as a bitmap whose size their count sets, up to ``MOST_BITS``."""
    bits = _PAGE
    while bits < min(MOST_BITS, BITS_EACH * values.count()):
        bits *= 2
    low = F.col("value").bitwiseAND(F.lit(bits - 1)) + 1
    pages = values.select(F.bitmap_bucket_number(low).alias("page"), F.bitmap_bit_position(low).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pages.collect():  # at most MOST_BITS / 2**15 pages of 4 KB
        out[(r.page - 1) * _PAGE // 8 : r.page * _PAGE // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def occurrences(rows: DataFrame, first, sent, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """k1, k2 (a digest), doc and place of each window whose anchor value is in the bitmap."""

    def candidates(batches):
        for batch in batches:
            batch = _known(batch, first.value)
            ids, base, texts = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy(), batch.column("text").to_pylist()
            for text, word, least in windows(texts, window, anchor):
                hit = np.flatnonzero(_held(sent.value, least))
                cuts = np.flatnonzero(np.diff(text[hit], prepend=-1))
                for some in np.split(hit, cuts[1:]) if len(hit) else ():
                    one = int(text[some[0]])
                    keys = _digests(texts[one], word[some], window)
                    yield _arrow(["k1", "k2", "doc", "at"], keys[:, 0], keys[:, 1], np.full(len(some), ids[one]), base[one] + word[some])

    return rows.mapInArrow(_gathered(candidates), "k1 long, k2 long, doc long, at long")


def _gathered(each, rows: int = 1 << 16):
    """``each``'s batches, joined to larger ones."""

    def run(batches):
        held, n = [], 0
        for batch in each(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def segments(rows: DataFrame, again: DataFrame, firsts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc, at, n, lo, lp: n windows in a row from a place on, which document
    ``lo`` had first, in a row from its place ``lp`` on. Windows of one document are
    left out, as are copies (``again``); ``firsts`` are the keys of the rows that count."""
    spark = rows.sparkSession
    first = spark.sparkContext.broadcast(bitmap(firsts))
    sent = spark.sparkContext.broadcast(bitmap(materialize(repeated_anchors(rows, first, window, anchor), "anchors")))
    # copies that share a bit with a row that counts went through
    low = lambda c: F.col(c).bitwiseAND(F.lit(8 * len(first.value) - 1))
    slipped = again.join(firsts.select(low("value").alias("bit")).distinct(), low("key") == F.col("bit"), "left_semi")
    slipped = small_side(materialize(slipped.select(F.col("doc").alias("_doc"), F.shiftright("at", WORD_BITS).alias("_row")), "slipped"))
    places = occurrences(rows, first, sent, window, anchor)
    places = places.join(slipped, (F.col("doc") == F.col("_doc")) & (F.shiftright("at", WORD_BITS) == F.col("_row")), "left_anti")
    edges = places.groupBy("k1", "k2").agg(F.min("doc").alias("lo"), F.min_by("at", "doc").alias("lp"), F.max("doc").alias("hi")).where("lo < hi").drop("hi")
    # written, so that the join has an exchange on either side and splits a hot edge
    edges = materialize(edges, "edges")
    met = places.join(edges, ["k1", "k2"]).select("doc", "at", "lo", "lp")
    walks = met.repartition("doc", F.shiftright("at", WORD_BITS)).sortWithinPartitions("doc", "at")
    names = ["doc", "at", "n", "lo", "lp"]

    def runs(batches):
        left = None  # the segment that may go on in the next batch
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("doc", "at", "lo", "lp")]
            if not len(cols[0]):
                continue
            n = np.ones(len(cols[0]), np.int64)
            if left is not None:
                cols, n = [np.append(x, y) for x, y in zip(left[0], cols, strict=True)], np.append(left[1], n)
            doc, at, lo, lp = cols
            after = at[:-1] + n[:-1]
            on = (doc[1:] == doc[:-1]) & (at[1:] == after) & (lo[1:] == lo[:-1]) & (lp[1:] == lp[:-1] + n[:-1])
            first = np.flatnonzero(np.append(True, ~on))
            size = np.add.reduceat(n, first)
            left = [c[first[-1:]] for c in cols], size[-1:]
            yield _arrow(names, doc[first[:-1]], at[first[:-1]], size[:-1], lo[first[:-1]], lp[first[:-1]])
        if left is not None:
            doc, at, lo, lp = left[0]
            yield _arrow(names, doc, at, left[1], lo, lp)

    return walks.mapInArrow(runs, "doc long, at long, n long, lo long, lp long")


def _by_row(spans: DataFrame) -> DataFrame:
    """_doc, _row and all the row's (word, n) as a list."""
    word = F.col("at").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int").alias("word")
    return spans.groupBy(F.col("doc").alias("_doc"), F.shiftright("at", WORD_BITS).alias("_row")).agg(F.collect_list(F.struct(word, F.col("n").cast("int").alias("n"))).alias("spans"))


def unlike(docs: DataFrame, later: DataFrame, window: int = WINDOW) -> DataFrame:
    """The segments under whose windows the words at both places differ: none."""
    rows = _rows(docs).dropDuplicates(["doc_id", "at"]).withColumn("row", F.shiftright("at", WORD_BITS))
    asked = _by_row(later.select("doc", "at", "n").union(later.select("lo", "lp", "n")).distinct())
    both = rows.join(asked, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")))

    def run(batches):
        for batch in batches:
            for doc, at, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "text", "spans")), strict=True):
                words = text.split()
                out = [(doc, at + s["word"], s["n"], hashlib.sha256(b" ".join(words[s["word"] : s["word"] + s["n"] + window - 1])).digest()) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "at", "n", "sha"])

    told = materialize(both.select("doc_id", "at", "text", "spans").mapInArrow(run, "doc long, at long, n long, sha binary"), "digests")
    first = told.select(F.col("doc").alias("lo"), F.col("at").alias("lp"), "n", F.col("sha").alias("first"))
    checked = later.join(told, ["doc", "at", "n"], "left").join(first, ["lo", "lp", "n"], "left")
    return checked.where(~F.coalesce(F.col("sha") == F.col("first"), F.lit(False))).select(*later.columns)


def spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """The segments of all documents of different texts, written; and what of each
    row an earlier document had: doc, at, n (``WHOLE``: all windows), lo, lp."""
    worker_imports(docs.sparkSession)
    rows = _rows(docs)
    again, firsts = copies(rows)
    found = materialize(segments(rows, again, firsts, window, anchor), "segments")
    whole = again.select("doc", "at", F.lit(WHOLE).cast("long").alias("n"), "lo", F.col("at").alias("lp"))
    return found, found.where("lo < doc").unionByName(whole)


def paths(found: DataFrame) -> DataFrame:
    """The repeated windows as pieces of nonbranching paths: lo, lp (the first place
    of a piece), windows (of the piece), path (the least of its pieces' places) and
    path_windows. ``found`` is ``segments``.

    Segments begin and end where documents part or meet; these cuts, put on the
    first places, give the pieces. Two pieces in a row in some document are
    linked; where a link is the only one out of its one piece and the only one into
    its other, both are of one path.
    """
    own = found.where("doc = lo and at = lp")
    cuts = found.select("lo", F.explode(F.array(F.col("lp"), F.col("lp") + F.col("n"))).alias("cut")).distinct()
    ends = own.select("lo", (F.col("lp") + F.col("n")).alias("cut"), F.lit(True).alias("end"))
    after = F.lead("cut").over(Window.partitionBy("lo").orderBy("cut"))
    pieces = cuts.join(ends, ["lo", "cut"], "left").withColumn("to", after).where("end is null")
    pieces = materialize(pieces.select("lo", F.col("cut").alias("lp"), (F.col("to") - F.col("cut")).alias("windows"), "to"), "pieces")
    piece = lambda a, b: F.struct(F.col(a).alias("doc"), F.col(b).alias("at"))
    # along the first places, and from the end of a segment to the start of the next one
    along = pieces.select(piece("lo", "lp").alias("a"), piece("lo", "to").alias("b")).join(pieces.select(piece("lo", "lp").alias("b")), "b")
    last = pieces.select("lo", "to", F.col("lp").alias("last"))
    tails = found.select("doc", (F.col("at") + F.col("n")).alias("at"), "lo", (F.col("lp") + F.col("n")).alias("to")).join(last, ["lo", "to"])
    jumps = tails.select("doc", "at", piece("lo", "last").alias("a")).join(found.select("doc", "at", piece("lo", "lp").alias("b")), ["doc", "at"])
    links = materialize(along.select("a", "b").union(jumps.select("a", "b")).distinct(), "links")
    one_out = links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a")
    one_in = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("b")
    chains = materialize(components(links.join(one_out, "a").join(one_in, "b").select("a", "b")), "chains")
    named = materialize(pieces.withColumn("id", piece("lo", "lp")).join(chains, "id", "left").select("lo", "lp", "windows", F.coalesce("component", "id").alias("path")), "named")
    whole = named.groupBy("path").agg(F.sum("windows").alias("path_windows"))
    return named.join(whole, "path")


def without_repeats(docs: DataFrame, later: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """``docs`` with the covered words taken out of the text (the others joined by one
    space), their number before (``n_words``) and how many went (``n_removed``)."""
    later = spans(docs, window)[1] if later is None else later
    by_row = small_side(materialize(_by_row(later), "spans"))
    rows, names = apart(docs.drop("n_words", "n_removed"))
    rows = rows.withColumns({"_doc": F.col(names["doc_id"]).cast("long"), "_row": F.shiftright(_place(names["text"]), WORD_BITS)})
    both = rows.join(by_row, ["_doc", "_row"], "left").select(*names.values(), "spans")
    where = list(names).index("text")

    def cut(batches):
        for batch in batches:
            kept, words_n, gone_n = [], [], []
            for text, spans in zip(batch.column(where).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                for one in spans or () if len(words) >= window else ():
                    gone[one["word"] : one["word"] + one["n"] + window - 1] = True
                words_n.append(len(words))
                gone_n.append(int(gone.sum()))
                kept.append(None if text is None else b" ".join([words[i] for i in np.flatnonzero(~gone)] if gone_n[-1] else words))
            cols = [batch.column(n) for n in names.values()]
            cols[where] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words_n, pa.int64()), pa.array(gone_n, pa.int64())], [*names.values(), "n_words", "n_removed"])

    kinds = T.StructType([*(both.schema[n] for n in names.values()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return together(both.mapInArrow(cut, kinds), names, "n_words", "n_removed")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and how many windows the nonbranching path has on
    which the document's first window lies that one of another text has too."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, later = spans(docs)
    copied = later.where(F.col("n") == WHOLE).select("doc", F.shiftright("at", WORD_BITS).alias("row"), "lo")
    first = found.groupBy("doc", F.shiftright("at", WORD_BITS).alias("row")).agg(F.min_by(F.struct("lo", "lp"), "at").alias("f")).select("doc", "row", "f.*")
    first = materialize(first.join(paths(found), ["lo", "lp"]).select("doc", "row", F.col("path_windows").alias("first_path")), "first")
    # a copy runs through the paths of the row that stands for it
    more = copied.join(first.withColumnRenamed("doc", "lo"), ["lo", "row"]).select("doc", "row", "first_path")
    first = small_side(materialize(first.unionByName(more), "all-first")).withColumnsRenamed({"doc": "_doc", "row": "_row"})
    kept = without_repeats(docs.withColumn("row", F.shiftright(_place("text"), WORD_BITS)), later)
    kept = kept.join(first, (F.col("doc_id") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_words", "n_removed", sha, F.coalesce("first_path", F.lit(0)).cast("long").alias("first_path"))


ORACLE = {
    "op11_repeats": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::VARCHAR[]) AS w FROM documents),
p AS MATERIALIZED (SELECT r, doc_id, rep, text, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM d, range(1, len(w) - {WINDOW - 2}) t(i) WHERE doc_id IS NOT NULL),
m AS MATERIALIZED (SELECT k, min(doc_id) AS lo FROM p GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM p JOIN m USING (k) WHERE lo < doc_id),
m2 AS MATERIALIZED (SELECT k FROM p WHERE doc_id = rep GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
q AS MATERIALIZED (SELECT r, doc_id, text, i, k FROM p JOIN m2 USING (k) WHERE doc_id = rep),
x AS (SELECT r, i, w[i] AS word FROM d, range(1, len(w) + 1) t(i)),
s AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN g USING (r, i) GROUP BY 1),
l AS MATERIALIZED (SELECT DISTINCT a.k AS a, b.k AS b FROM q a JOIN q b ON a.r = b.r AND b.i = a.i + 1),
u AS MATERIALIZED (SELECT a, b FROM l WHERE a <> b AND a IN (SELECT a FROM l GROUP BY a HAVING count(*) = 1) AND b IN (SELECT b FROM l GROUP BY b HAVING count(*) = 1)),
c(s, k, n) AS (SELECT k, k, 1 FROM m2 WHERE k NOT IN (SELECT b FROM u) UNION ALL SELECT s, b, n + 1 FROM c JOIN u ON k = a),
f AS (SELECT text, any_value(z.n) AS first_path FROM (SELECT r, text, arg_min(k, i) AS k FROM q GROUP BY 1, 2) JOIN c USING (k) JOIN (SELECT s, max(n) AS n FROM c GROUP BY 1) z USING (s) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(s.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(first_path, 0)::BIGINT AS first_path FROM d LEFT JOIN s USING (r) LEFT JOIN f ON f.text = d.text AND d.doc_id IS NOT NULL""",
}
