"""Exact self-join of documents by the Jaccard similarity of their shingles.

Two sets with similarity of at least 3/4 differ in at most (|R| + |S|) / 7
elements. Sets are put in size bands; each band splits the universe of shingle
hashes into about half as many segments as its sets have elements. Every set
indexes its filled segments in its own band, and asks in the bands that partners
of its size or up to 4/3 of it can be in. By the pigeonhole principle two similar
sets agree on one of any U + 1 filled segments of the asking set, U being the most
that they can differ by. Which ones it asks is an allocation by cost: the U + 1
segments that the fewest sets index, as counted over all sets in a sketch of
``SLOTS`` counters. A set with too few filled segments asks them all, and both
indexes and asks their one-deletion neighbourhoods, which raises each segment of
two or more elements to two; if that is short as well, every element alone.
Candidates are verified on the whole sets. Sets hold 64-bit hashes of shingles, and
likeness is decided on those: two different shingles are taken for one with odds
of 2**-64.

Before that, sets that can't have a partner are dropped exactly: a set with less
than 3/4 of its elements in any other set is alone. Elements are counted in
packed blocks (``LOW`` bytes of each hash, dealt by its leading bits); a chance
collision there only keeps a set in, it never drops one.

Documents with equal sets are one class with one representative. Chains of
signatures that some set asks for tie representatives to families; linked ones
are always in one family. A family of up to ``FAMILY`` members is compared in one task. In a
larger one every member is compared with one hub, the least edited member, and
those that don't link with it with all members, block by block. No list of pairs
is made, and pairs that are already in one component aren't compared.

Defined cases: null, empty and blank texts have no shingles and link with
nothing; fewer than five words are one shingle, which only an equal sequence
has; null ids get a null component and link with nothing; rows that repeat a
doc_id are one document for links; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.graphs import components
from tidebook.functions.storage import discard, materialize, own_session, reopened, worker_imports
from tidebook.llm.grams import blocks, hashed_words, mixed, shingles, slices
from tidebook.llm.tables import apart, partitions, read, small_side, together

WIDTH = 5
LOW = 5
GATHER = 1 << 19
FAMILY = 200
#: Ratio of the sizes at the ends of a size class; more than 4/3.
CLASS = 1.34
#: Arrow bytes at a time where rows are whole blocks of sets.
ARROW_BYTES = 16 << 20
#: Counters of how many sets index a signature; text bytes for a bucket of elements.
SLOTS = 1 << 18
BUCKET_BYTES, BUCKETS = 8 << 20, 1 << 20
#: Elements in a block of a family's members, and of those still open.
MANY, FEW = 2_000_000, 300_000
_U = np.uint64
_BLOCK = "uid long, bucket int, kind int, a binary, b binary, c binary"
_PACKED = pa.schema([("uid", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abc"]])


def sets_of(texts):
    """(first row, end row, sorted distinct shingle hashes of each text)."""
    for a, b, part in blocks(texts):
        yield a, b, shingles(*hashed_words(part), WIDTH)


def _narrow(x: np.ndarray) -> bytes:
    kind = np.uint8 if x.max(initial=0) < 256 else np.uint32
    return bytes([kind().itemsize]) + x.astype(kind).tobytes()


def _widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if blob[0] == 1 else np.uint32, offset=1).astype(np.int64)


def _pack(uid: int, ids: list, sets: list[np.ndarray], deal: int) -> pd.DataFrame:
    """A directory row for some sets and a row of their hashes for each bucket."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.empty(0, _U)
    scrambled = mixed(flat ^ _U(0xA5A5A5A5DEADBEEF))
    with np.errstate(over="ignore"):
        cuts = np.append(0, np.cumsum(n))
        sums = [np.append(_U(0), np.cumsum(x, dtype=_U)) for x in (flat, scrambled)]
        prints = np.stack([s[cuts[1:]] - s[cuts[:-1]] for s in sums], 1)
    rows = [(uid, uid % deal, 0, np.array(ids, np.int64).tobytes(), n.tobytes(), prints.tobytes())]
    bucket = ((flat >> _U(32)) * _U(deal) >> _U(32)).astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    owner = np.repeat(np.arange(len(sets)), n)[order]
    low = flat[order].view(np.uint8).reshape(-1, 8)[:, :LOW]
    edges = np.searchsorted(bucket[order], np.arange(deal + 1))
    for k in range(deal):
        i, j = edges[k], edges[k + 1]
        if j > i:
            rows.append((uid, k, 1, _narrow(np.bincount(owner[i:j], minlength=len(sets))), low[i:j].tobytes(), None))
    return pd.DataFrame(rows, columns=["uid", "bucket", "kind", "a", "b", "c"])


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    """How many of each set's hashes in a bucket occur in other sets too."""
    some = pdf[pdf["kind"] == 1]
    out = [pdf[pdf["kind"] == 0]]
    if len(some):
        raw = np.frombuffer(b"".join(some["b"]), np.uint8).reshape(-1, LOW)
        values = np.zeros((len(raw), 8), np.uint8)
        values[:, :LOW] = raw
        values = values.view(np.uint64).ravel()
        order = np.argsort(values)
        ranked = values[order]
        twice = np.zeros(len(values), bool)
        same = ranked[1:] == ranked[:-1]
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        held, at = [], 0
        for blob in some["a"]:
            n = _widen(blob)
            total = np.append(0, np.cumsum(twice[at : at + n.sum()]))
            cuts = np.append(0, np.cumsum(n))
            held.append(_narrow(total[cuts[1:]] - total[cuts[:-1]]))
            at += int(n.sum())
        out.append(some.assign(a=held, b=None))
    return pd.concat(out)


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    head = pdf[pdf["kind"] == 0].iloc[0]
    ids, n = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64)
    prints = np.frombuffer(head["c"], np.int64).reshape(-1, 2)
    shared = np.zeros(len(ids), np.int64)
    for blob in pdf.loc[pdf["kind"] == 1, "a"]:
        shared += _widen(blob)
    return pd.DataFrame({"doc_id": ids, "n": n, "shared": shared, "h1": prints[:, 0], "h2": prints[:, 1]})


def shared_counts(rows: DataFrame, deal: int) -> DataFrame:
    """(doc_id, text) or (doc_id, elements) to doc_id, size n, how many of its
    elements are in another row too (at least), and two fingerprints."""
    has_text = "text" in rows.columns
    at = rows.columns.index("text" if has_text else "elements")

    def pack(batches):
        base, serial = TaskContext.get().partitionId() << 32, 0
        ids, sets, held = [], [], 0
        for part in slices(batches):
            named, values = part.column(0).to_pylist(), part.column(at).to_pylist()
            for a, b, some in sets_of(values) if has_text else [(0, len(values), [np.frombuffer(e, _U) for e in values])]:
                ids += named[a:b]
                sets += some
                held += sum(map(len, some))
                if held >= GATHER:
                    yield pa.RecordBatch.from_pandas(_pack(base + serial, ids, sets, deal), _PACKED)
                    ids, sets, held, serial = [], [], 0, serial + 1
        if ids:
            yield pa.RecordBatch.from_pandas(_pack(base + serial, ids, sets, deal), _PACKED)

    blocks_ = rows.mapInArrow(pack, _BLOCK)
    marked = blocks_.groupBy("bucket").applyInPandas(_mark, _BLOCK)
    return marked.groupBy("uid").applyInPandas(_total, "doc_id long, n long, shared long, h1 long, h2 long")


#: Lower ends of the size bands; each is twice the one before.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(2 * BANDS[-1])


def band(n: int) -> int:
    return int(np.searchsorted(BANDS, n, side="right")) - 1


def segments(g: int) -> int:
    return max(8, BANDS[g + 1] // 2)


def _slot(sigs: np.ndarray) -> np.ndarray:
    return (sigs >> _U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def signatures(elements: np.ndarray, costs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What a set indexes or asks for, and which of it it asks for.

    Of two similar sets, one of the signatures that the one of fewer elements
    asks for is indexed by the other.
    """
    n = len(elements)
    out, asked = [], []
    values = mixed(elements ^ _U(0x5851F42D4C957F2D))
    need = (n + 4 * n // 3) // 7 + 1
    for g in range(band(n), band(4 * n // 3) + 1):
        m = segments(g)
        place = (elements >> _U(32)) * _U(m) >> _U(32)
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sizes = np.diff(np.append(starts, n))
        name = (place[starts] + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(g)
        sums = np.add.reduceat(values, starts)
        sigs = mixed(sums ^ mixed(name))
        if len(starts) >= need:
            cheap = np.zeros(len(sigs), bool)
            cost = costs[_slot(sigs)] if costs is not None else np.zeros(len(sigs), np.int64)
            cheap[np.lexsort((sigs, cost))[:need]] = True
            own = g == band(n)
            out.append(sigs if own else sigs[cheap])
            asked.append(cheap if own else cheap[cheap])
            continue
        several = np.repeat(sizes >= 2, sizes)
        less = (np.repeat(sums, sizes) - values)[several]
        sigs = np.append(sigs, mixed(less ^ mixed(np.repeat(name, sizes)[several])))
        if len(starts) + int((sizes >= 2).sum()) < need:
            sigs = np.append(sigs, mixed(values + _U(g)))
        out.append(sigs)
        asked.append(np.ones(len(sigs), bool))
    sigs, asked = np.concatenate(out), np.concatenate(asked)
    order = np.lexsort((~asked, sigs))
    first = np.append(True, sigs[order][1:] != sigs[order][:-1])
    return sigs[order][first].view(np.int64), asked[order][first]


def _index_counts(sets: DataFrame) -> np.ndarray:
    """How many sets index a signature of each slot, in their own bands."""

    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for part in slices(batches):
            for e in part.column(0).to_pylist():
                x = np.frombuffer(e, _U)
                g = band(len(x))
                place = (x >> _U(32)) * _U(segments(g)) >> _U(32)
                starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                name = (place[starts] + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(g)
                sums = np.add.reduceat(mixed(x ^ _U(0x5851F42D4C957F2D)), starts)
                total += np.bincount(_slot(mixed(sums ^ mixed(name))), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    got = sets.select("elements").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    costs = np.zeros(SLOTS, np.int64)
    costs[got["slot"].to_numpy(np.int64)] = got["n"]
    return costs


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 75 * (len(x) + len(y) - inter)


def _families(sets: DataFrame) -> DataFrame:
    """(id, family): documents joined by chains of shared signatures.

    Linked documents are always in one family. Tasks tie the documents that they
    read together under a signature that one of them asks for to the first one,
    and pass on that one only; the rest meets by a minimum over each signature
    that is asked for, joined back, so a very common one is split like any join.
    """
    sent = sets.sparkSession.sparkContext.broadcast(_index_counts(sets))

    def tied(sets_: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        each = [signatures(x, sent.value) for x in sets_]
        sig, asks = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
        doc = np.repeat(np.array(ids, np.int64), [len(x[0]) for x in each])
        order = np.lexsort((doc, sig))
        sig, doc, asks = sig[order], doc[order], asks[order]
        first = np.append(True, sig[1:] != sig[:-1])
        group = np.cumsum(first) - 1
        asked = np.bincount(group, asks) > 0
        lead = doc[first][group]
        # under a signature that is asked for here, the first document stands for all
        ties = np.unique(np.stack((lead, doc), 1)[asked[group] & ~first], axis=0)
        on = first | ~asked[group]
        nothing = pa.nulls(len(ties), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(sig[on]), nothing]), pa.concat_arrays([pa.nulls(int(on.sum()), pa.int64()), pa.array(ties[:, 0])]), pa.array(np.append(doc[on], ties[:, 1])), pa.array(np.append(asked[group][on], np.ones(len(ties), bool)))],
            names=["sig", "a", "b", "asked"],
        )

    def emit(batches):
        sets_, ids, held = [], [], 0
        for part in slices(batches):
            for one, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sets_.append(np.frombuffer(e, _U))
                ids.append(one)
                held += len(e) // 8
                if held >= GATHER:
                    yield tied(sets_, ids)
                    sets_, ids, held = [], [], 0
        if ids:
            yield tied(sets_, ids)

    rows = materialize(sets.select("doc_id", "elements").mapInArrow(emit, "sig long, a long, b long, asked boolean"), "signatures")
    named = rows.where("sig is not null")
    met = named.groupBy("sig").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.max("asked").alias("any")).where("any and lo < hi")
    edges = named.join(met.select("sig", "lo"), "sig").select(F.col("lo").alias("a"), "b")
    edges = edges.unionByName(rows.where("sig is null").select("a", "b")).where("a <> b").distinct()
    found = components(edges).withColumnRenamed("component", "family")
    discard(rows)
    return found


def _small_family(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of a family of bounded size, every open pair compared."""
    ids = pdf["doc_id"].to_numpy()
    order = np.argsort([len(e) for e in pdf["elements"]], kind="stable")
    sets = [np.frombuffer(pdf["elements"].iloc[i], _U) for i in order]
    label = list(range(len(sets)))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if 3 * len(sets[j]) > 4 * len(sets[i]):
                break
            a, b = root(i), root(j)
            if a != b and _similar(sets[i], sets[j]):
                label[b] = a
    roots = np.array([root(i) for i in range(len(sets))])
    named = pd.DataFrame({"id": ids[order], "r": roots})
    named["component"] = named.groupby("r")["id"].transform("min")
    return named[["id", "component"]]


def _hub_links(large: DataFrame) -> DataFrame:
    """(a, b, linked) of every member with its family's hub, the member with the
    largest share of elements that others have as well: the least edited one."""
    hub = large.groupBy("family").agg(F.max_by("doc_id", F.struct("share", -F.col("doc_id"))).alias("hub"))
    with_set = small_side(materialize(large.select(F.col("doc_id").alias("hub"), F.col("elements").alias("y")).join(small_side(materialize(hub, "hub-ids")), "hub"), "hubs"))

    def check(batches):
        for pdf in batches:
            near = [_similar(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(pdf["elements"], pdf["y"], strict=True)]
            yield pd.DataFrame({"a": pdf["hub"], "b": pdf["doc_id"], "linked": near})

    return large.join(with_set, "family").select("hub", "doc_id", "elements", "y").mapInPandas(check, "a long, b long, linked boolean")


def _block_links(rest: DataFrame, large: DataFrame) -> DataFrame:
    """Links of the members that aren't linked with their hub to any member.

    Both sides are packed: a row is a block of sets, and a task compares blocks
    through an inverted index. A link of each member to each component found in
    a block is enough, so no pair list leaves a task.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "ids": [pdf["doc_id"].to_numpy(np.int64).tobytes()], "comps": [pdf["comp"].to_numpy(np.int64).tobytes()], "sizes": [np.array([len(e) // 8 for e in pdf["elements"]], np.int64).tobytes()], "flat": [b"".join(pdf["elements"])]})

    keys = ["family", "class", "block"]
    kind = "family long, class int, block long, ids binary, comps binary, sizes binary, flat binary"
    size = F.octet_length("elements") / 8
    # linked sets differ in size by at most 4/3, so by at most one class
    sized = lambda t: t.withColumn("class", F.floor(F.log(size) / math.log(CLASS)).cast("int"))
    counted = lambda t, n, name: small_side(materialize(sized(t).groupBy("family", "class").agg(F.ceil(F.sum(size) / n).cast("long").alias(name)), name))
    dealt = lambda t, plan, n: sized(t).join(plan, ["family", "class"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col(n))).groupBy(*keys).applyInPandas(pack, kind)
    plan = counted(large, MANY, "blocks")
    right = dealt(large, plan, "blocks")
    # the members still open are fewer: their blocks go to every block of the classes they can link with
    left = dealt(rest, counted(rest, FEW, "open_blocks"), "open_blocks").drop("block")
    left = left.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))).join(plan, ["family", "class"])
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = left.select(*keys, *[F.col(c).alias(f"x_{c}") for c in ("ids", "comps", "sizes", "flat")])

    def compare(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, comps, n, flat = np.frombuffer(r.ids, np.int64), np.frombuffer(r.comps, np.int64), np.frombuffer(r.sizes, np.int64), np.frombuffer(r.flat, _U)
                order = np.argsort(flat)
                ranked, owner = flat[order], np.repeat(np.arange(len(ids)), n)[order]
                at, found = 0, []
                xs = np.frombuffer(r.x_flat, _U)
                for one, comp, m in zip(np.frombuffer(r.x_ids, np.int64), np.frombuffer(r.x_comps, np.int64), np.frombuffer(r.x_sizes, np.int64), strict=True):
                    x = xs[at : at + m]
                    at += m
                    lo, hi = np.searchsorted(ranked, x), np.searchsorted(ranked, x, side="right")
                    inter = np.zeros(len(ids), np.int64)
                    for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                        inter[owner[a:b]] += 1  # a set holds an element once
                    near = np.flatnonzero((100 * inter >= 75 * (n + m - inter)) & (comps != comp))
                    _, first = np.unique(comps[near], return_index=True)
                    found += [(int(one), int(ids[near[f]])) for f in first]
                yield pd.DataFrame(found, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    return left.join(right, keys).select("x_ids", "x_comps", "x_sizes", "x_flat", "ids", "comps", "sizes", "flat").mapInPandas(compare, "a long, b long")


def _link(sets: DataFrame, partners: DataFrame) -> DataFrame:
    """(id, component) of the sets that share a signature with another one.
    ``partners`` names those to look at; both are written tables."""
    families = materialize(_families(_of(sets, partners)), "families")
    sizes = materialize(families.groupBy("family").agg(F.count(F.lit(1)).alias("members")), "family-sizes")
    joined = _of(sets, partners).join(small_side(families).withColumnRenamed("id", "doc_id"), "doc_id")
    big = sizes.where(F.col("members") > FAMILY)
    small = sizes.where(F.col("members") <= FAMILY).select("family")
    labels = joined.join(small_side(small), "family").select("family", "doc_id", "elements").groupBy("family").applyInPandas(_small_family, "id long, component long")
    if big.isEmpty():
        return labels
    tried = materialize(_hub_links(joined.join(small_side(big), "family")), "hub-links")
    # rows are blocks of megabytes from here on: a session of its own hands few at a time to Python
    alone = own_session(sets.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)})
    sets_, partners_, families_, sizes_, tried_ = (reopened(t, alone) for t in (sets, partners, families, sizes, tried))
    large = _of(sets_, partners_).join(small_side(families_).withColumnRenamed("id", "doc_id"), "doc_id").join(small_side(sizes_.where(F.col("members") > FAMILY)), "family")
    rest = large.join(small_side(tried_.where("not linked").select(F.col("b").alias("doc_id"))), "doc_id", "left_semi").withColumn("comp", F.col("doc_id"))
    hubs = tried_.where("linked").select(F.col("b").alias("doc_id"), F.col("a").alias("comp"))
    known = large.join(small_side(hubs), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    more = materialize(_block_links(rest, known), "block-links", sets.sparkSession)
    found = components(tried.where("linked").select("a", "b").unionByName(more))
    return labels.unionByName(found)


def _of(sets: DataFrame, partners: DataFrame) -> DataFrame:
    return sets.join(small_side(partners), "doc_id")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row with an id."""
    spark = docs.sparkSession
    worker_imports(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    held = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deal = min(BUCKETS, max(partitions(spark), held // BUCKET_BYTES))
    meta = materialize(shared_counts(named, deal), "sizes")
    alike = meta.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared"))
    alike = materialize(alike, "classes")
    reps = materialize(alike.where("100 * shared >= 75 * n").select(F.col("rep").alias("doc_id")).distinct(), "reps")

    def read_sets(batches):
        for part in slices(batches):
            for a, b, some in sets_of(part.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array([s.tobytes() for s in some], pa.binary())], names=["doc_id", "elements"])

    sets = named.join(small_side(reps), "doc_id").select("doc_id", "text").mapInArrow(read_sets, "doc_id long, elements binary").where(F.octet_length("elements") > 0)
    sets = materialize(sets, "sets")
    again = shared_counts(sets, deal).where("100 * shared >= 75 * n").groupBy("doc_id").agg(F.max(F.col("shared") / F.col("n")).alias("share"))
    again = materialize(again, "partners")
    labels = _link(sets, again)
    final = alike.select("h1", "h2", "n", "rep")
    labels = materialize(labels.groupBy(F.col("id").alias("rep")).agg(F.min("component").alias("component")), "components")
    final = final.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    final = final.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("g"), "component")
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") == F.col("g"))
    return meta.join(final, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def nameless(docs: DataFrame) -> DataFrame:
    """Rows without an id: their set sizes, and no component."""

    def run(batches):
        for pdf in batches:
            for _, _, some in sets_of(pdf["text"]):
                yield pd.DataFrame({"n_shingles": [len(s) for s in some]})

    return docs.where("doc_id is null").select("text").mapInPandas(run, "n_shingles long").select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))


def join_documents(docs: DataFrame) -> DataFrame:
    return classes(docs).unionByName(nameless(docs))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without those that link to one of a smaller id."""
    found = join_documents(docs.select("doc_id", "text")).where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"))
    rows, names = apart(docs)
    kept = rows.withColumn("doc_id", F.col(names["doc_id"])).join(small_side(materialize(found, "kept")), "doc_id")
    once = kept.where("_rows = 1").unionByName(kept.where("_rows > 1").dropDuplicates(["doc_id"]))
    return together(once, names).unionByName(docs.where("doc_id is null"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
