"""Approximate nearest neighbours with score-aware four-bit codes.

Vectors are scaled to length one, so the largest cosine is the largest inner
product. Codes come from a product quantiser whose loss weighs the part of the
residual that is parallel to the vector ``eta`` times as much as the rest
(anisotropic loss): that part moves the inner products that matter. Each
subspace has 16 codewords, two codes to a byte.

Rows of one vector are one kind: the row of the smallest vec_id stands for
all, is coded, asked and ranked once, and each kind that wins gives its ``k`` + 1
smallest vec_ids, so copies take one candidate place however many there are.

Kinds are put in lists by their nearest centre, about as many lists as the root
of their number, and a query scans the lists nearest to it. How many, and how many
rows of them by their codes, is measured at the table's own size: the true
neighbours of ``PROBES_FROM`` of the queries are found by one exact pass in double
precision; enough lists are taken to hold ``COVER`` of them, and twice as many rows
as come before ``COVER`` of them by code. Clustered tables need few lists; vectors
without clusters need nearly all, and get them. Clusters so tight that their rows
share codes need few lists but many rows, and get these.

Small lists share a cell and large ones are cut into cells, of about ``CELL``
rows; queries are sent to cells in blocks. In a cell a table of the query's inner
products with the codewords is summed over the codes of the lists it asked for; the
best rows by code, ``KEEP`` at least, are ranked again there by the cosine of the
original vectors in double precision, and only the nearest leave the cell.

Centres and codebooks are fitted on a sample (smallest hash of vec_id) of at most
``SAMPLE`` rows and ``SAMPLE_VALUES`` components; every row is indexed.

Defined cases: vectors that are null, zero, of another length than the most of
the sample or hold null or non-finite components take no part, as query or
candidate; very large and very small components neither overflow nor vanish;
fewer candidates than asked for are all returned; equal scores go to the smaller
vec_id, so copies of one vector come in order; a vec_id that repeats counts once,
with its smallest vector; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize, worker_imports
from tidebook.llm.tables import read, small_side

SAMPLE, SAMPLE_VALUES = 65_536, 1 << 22
SUBSPACE = 2
WORDS = 16
PARTS = 32
LIST_ROWS, MOST_LISTS = 2048, 4096
PROBES_FROM, COVER = 100, 0.99
CELL, CELL_VALUES = 65_536, 1 << 22
QUERY_BLOCK = 4096
KEEP = 600
THRESHOLD = 0.2


def scaled(vector: Column) -> Column:
    """A vector of the same direction whose squares stay in range."""
    most = F.array_max(F.transform(vector, F.abs))
    return F.when(most.between(1e-100, 1e100), vector).otherwise(F.transform(vector, lambda x: x / most))


def usable(vector: Column) -> Column:
    """True for a vector that can take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(1)
    return np.concatenate([(y @ centres.T - half).argmax(1) for y in np.array_split(x, max(1, len(x) * len(centres) >> 22))])


def assign(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes of unit vectors: nearest codewords first, then coordinate descent
    on |r|^2 + (eta - 1) (r . x)^2 with r the residual."""
    m, _, width = books.shape
    parts = x.reshape(len(x), m, width)
    square = np.empty((len(x), m, WORDS), np.float32)
    along = np.empty_like(square)
    for j in range(m):
        diff = parts[:, j, None, :] - books[j]
        square[:, j] = (diff**2).sum(2)
        along[:, j] = (diff * parts[:, j, None, :]).sum(2)
    codes = square.argmin(2)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    rows = np.arange(len(x))
    for _ in range(rounds):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            best = (square[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
            codes[:, j] = best
            total = rest + along[rows, j, best]
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, lists: int = 1, seed: int = 11, rounds: int = 4) -> dict:
    """List centres and codebooks from the sampled rows (not zero)."""
    rng = np.random.default_rng(seed)
    x = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    centres = _kmeans(x, lists, rng) if lists > 1 else x[:1].copy()
    x = x[rng.permutation(len(x))[:8192]]
    d = x.shape[1]
    pad = -d % (2 * SUBSPACE)
    x = np.pad(x, ((0, 0), (0, pad)))
    m = x.shape[1] // SUBSPACE
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    parts = x.reshape(len(x), m, SUBSPACE)
    books = np.stack([_kmeans(parts[:, j], WORDS, rng) for j in range(m)])
    for _ in range(rounds):
        codes = assign(x, books, eta, 1)
        for j in range(m):
            residual = parts - books[np.arange(m), codes]
            total = (residual * parts).sum((1, 2))
            own = parts[:, j]
            rest = total - (residual[:, j] * own).sum(1)
            for c in np.unique(codes[:, j]):
                p, s = own[codes[:, j] == c], rest[codes[:, j] == c]
                left = len(p) * np.eye(SUBSPACE) + (eta - 1) * p.T @ p
                right = p.sum(0) + (eta - 1) * (p * (s + (p**2).sum(1))[:, None]).sum(0)
                books[j, c] = np.linalg.lstsq(left, right)[0]
    return {"dims": d, "pad": pad, "books": books.astype(np.float32), "eta": eta, "centres": centres}


def _unit(column: pd.Series, model: dict, kind=np.float32) -> np.ndarray:
    """Rows of length one from scaled vectors."""
    x = np.array(column.tolist(), np.float64).reshape(len(column), model["dims"])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(kind)


def _sampled(kinds: DataFrame, rows: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vec_ids and vectors of ``rows`` kinds with the smallest hash."""

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [np.asarray(v, np.float64).tobytes() for v in pdf["embedding"]]})

    got = kinds.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("vec_id", "embedding").mapInPandas(pack, "vec_id long, v binary").toPandas()
    return got["vec_id"].to_numpy(), np.frombuffer(b"".join(got["v"]), np.float64).reshape(-1, dims)


def true_neighbours(kinds: DataFrame, sent, ids: np.ndarray, asked: np.ndarray, k: int) -> pd.DataFrame:
    """q, vec_id and list of the ``k`` kinds nearest to each of some others, in one
    pass over all kinds."""
    q = asked / np.linalg.norm(asked, axis=1, keepdims=True)

    def best(batches):
        held = [np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int32)]
        for pdf in batches:
            if len(pdf):
                own = pdf["vec_id"].to_numpy()
                near = np.where(own == ids[:, None], -np.inf, q @ _unit(pdf["embedding"], sent.value, np.float64).T)
                lists = _nearest(_unit(pdf["embedding"], sent.value), sent.value["centres"]).astype(np.int32)
                held = [np.hstack((h, np.broadcast_to(x, near.shape))) for h, x in zip(held, (near, own, lists), strict=True)]
                top = np.argsort(-held[0], axis=1, kind="stable")[:, :k]
                held = [np.take_along_axis(h, top, 1) for h in held]
        rows, take = held[0].shape
        yield pd.DataFrame({"q": np.repeat(np.arange(rows, dtype=np.int32), take), "near": held[0].ravel(), "vec_id": held[1].ravel(), "list": held[2].ravel()})

    order = Window.partitionBy("q").orderBy(F.desc("near"), "vec_id")
    found = kinds.select("vec_id", "embedding").mapInPandas(best, "q int, near double, vec_id long, list int").where("near > -2")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).select("q", "vec_id", "list").toPandas()


def _covering(places: np.ndarray) -> int:
    """The place that ``COVER`` of them don't exceed."""
    places = np.sort(places)
    return int(places[min(len(places) - 1, int(np.ceil(COVER * len(places))))])


def probes_needed(found: pd.DataFrame, asked: np.ndarray, model: dict) -> int:
    """How many nearest lists hold ``COVER`` of the true neighbours ``found``."""
    if found.empty:
        return len(model["centres"])
    q = (asked / np.linalg.norm(asked, axis=1, keepdims=True)).astype(np.float32)
    rank = np.argsort(np.argsort(-_to_lists(q, model), axis=1), axis=1)
    return _covering(rank[found["q"], found["list"]]) + 1


def rows_needed(coded: DataFrame, found: pd.DataFrame, asked: np.ndarray, model: dict, sent, probes: int) -> int:
    """Twice as many rows as, by code, come before ``COVER`` of the true neighbours
    ``found`` in the lists that a query scans (one pass over all codes)."""
    if found.empty:
        return 0
    q = (asked / np.linalg.norm(asked, axis=1, keepdims=True)).astype(np.float32)
    codes = dict(coded.where(F.col("vec_id").isin(found["vec_id"].unique().tolist())).select("vec_id", "codes").collect())
    bars = [np.array([_by_code(_pairs(v, model), _packed([codes[i]]))[0] for i in found["vec_id"][found["q"] == at]], np.float32) for at, v in enumerate(q)]
    scanned = np.argsort(-_to_lists(q, model), axis=1, kind="stable")[:, :probes]

    def before(batches):
        ranks = [np.zeros(len(b), np.int64) for b in bars]
        tables = [_pairs(v, sent.value) for v in q]
        for pdf in batches:
            own, held = pdf["list"].to_numpy(), _packed(pdf["codes"])
            for at, bar in enumerate(bars):
                near = _by_code(tables[at], held[:, np.isin(own, scanned[at])])
                ranks[at] += (near[:, None] >= bar).sum(0)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(bars)), [len(b) for b in bars]), "n": np.concatenate([np.arange(len(b)) for b in bars]), "rows": np.concatenate(ranks)})

    ranks = coded.select("list", "codes").mapInPandas(before, "q long, n long, rows long").groupBy("q", "n").agg(F.sum("rows").alias("rows")).toPandas()
    return 2 * _covering(ranks["rows"].to_numpy())


def _packed(codes) -> np.ndarray:
    """Codes as bytes, a row for each two subspaces."""
    return np.ascontiguousarray(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1).T) if len(codes) else np.empty((0, 0), np.uint8)


def _pairs(vector: np.ndarray, model: dict) -> np.ndarray:
    """A query's inner products with the codewords of each two subspaces."""
    books = model["books"]
    inner = np.einsum("mw,mcw->mc", np.pad(vector, (0, model["pad"])).reshape(len(books), SUBSPACE), books)
    return (inner[0::2, :, None] + inner[1::2, None, :]).reshape(len(books) // 2, WORDS * WORDS)


def _by_code(pairs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    near = np.zeros(codes.shape[1], np.float32)
    for table, code in zip(pairs, codes, strict=False):
        near += table[code]
    return near


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, added up one component after the other."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def _to_lists(q: np.ndarray, model: dict) -> np.ndarray:
    """Nearness of queries to lists, as lists are assigned."""
    return q @ model["centres"].T - 0.5 * (model["centres"] ** 2).sum(1)


def _runs(lists: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of some lists in rows sorted by list, neighbours joined."""
    lo, hi = np.searchsorted(own, lists), np.searchsorted(own, lists, side="right")
    new = np.flatnonzero(np.append(True, lo[1:] != hi[:-1]))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:] - 1, len(lists) - 1)].tolist(), strict=True))


def _kinds(valid: DataFrame, members: int) -> DataFrame:
    """One row for each vector: its smallest vec_id, its ``members`` smallest."""
    first = lambda df, *by: df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("_r") <= members).drop("_r")
    # in two steps, so that a vector that many rows have isn't one task
    some = first(valid.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))), "h1", "h2", "_part")
    some = first(some, "h1", "h2")
    return some.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.array_sort(F.collect_list("vec_id")).alias("members"), F.min_by("embedding", "vec_id").alias("embedding"))


def search(vectors: DataFrame, queries: Column, k: int = 5, keep: int = KEEP) -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``queries`` holds.

    ``vectors`` has vec_id and embedding; gives query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    worker_imports(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    typed = typed.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    valid = materialize(typed.select("vec_id", scaled(F.col("embedding")).alias("embedding")), "vectors")
    lengths = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return empty
    dims = lengths["n"]
    valid = valid.where(F.size("embedding") == dims)
    valid = valid.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    kinds = materialize(_kinds(valid, k + 1), "kinds")
    n = kinds.count()
    lists = max(1, min(MOST_LISTS, n // LIST_ROWS, int(n**0.5)))
    model = fit(_sampled(kinds, max(1024, min(SAMPLE, SAMPLE_VALUES // dims)), dims)[1], lists)
    sent = spark.sparkContext.broadcast(model)
    seekers = valid.where(queries).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    asked = kinds.join(seekers.select("h1", "h2").distinct(), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "h1", "h2", "members", "embedding")
    asked = materialize(asked, "asked")
    some_ids, some = _sampled(asked.select(F.col("query_id").alias("vec_id"), "embedding"), PROBES_FROM, dims)
    if not len(some_ids):
        return empty
    nearest = true_neighbours(kinds, sent, some_ids, some, k)
    probes = probes_needed(nearest, some, model) if lists > 1 else 1

    def encode(batches):
        m = sent.value
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["embedding"], m)
                codes = np.concatenate([assign(np.pad(y, ((0, 0), (0, m["pad"]))), m["books"], m["eta"]) for y in np.array_split(x, max(1, len(x) // 2048))])
                packed = codes[:, 0::2] << 4 | codes[:, 1::2]
                exact = [np.asarray(v, np.float64).tobytes() for v in pdf["embedding"]]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "list": _nearest(x, m["centres"]).astype(np.int32), "codes": [r.tobytes() for r in packed], "exact": exact})

    coded = materialize(kinds.select("vec_id", "embedding").mapInPandas(encode, "vec_id long, list int, codes binary, exact binary"), "codes")
    keep = max(keep, rows_needed(coded, nearest, some, model, sent, probes))
    held = dict(coded.groupBy("list").count().collect())  # at most MOST_LISTS rows
    # list -> its first cell and how many; small lists share one
    most = max(1, min(CELL, CELL_VALUES // dims))
    first, cells, filled, at = [0] * lists, [1] * lists, 0, 0
    for one in range(lists):
        size = held.get(one, 0)
        if filled and filled + size > most:
            at, filled = at + 1, 0
        first[one], cells[one] = at, max(1, -(-size // most))
        filled += size
        if cells[one] > 1:
            at, filled = at + cells[one], 0
    plan = F.broadcast(spark.createDataFrame(list(zip(range(lists), first, cells, strict=True)), "list int, first int, cells int"))

    def probe(batches):
        m = sent.value
        for pdf in batches:
            q = _unit(pdf["embedding"], m)
            near = np.argsort(-_to_lists(q, m), axis=1, kind="stable")[:, :probes]
            rows = []
            for one, vector, some in zip(pdf["query_id"], pdf["embedding"], near, strict=True):
                by_cell: dict = {}
                for x in some.tolist():
                    for c in range(first[x], first[x] + cells[x]):
                        by_cell.setdefault(c, []).append(x)
                blob = np.asarray(vector, np.float64).tobytes()
                rows += [(one, blob, c, xs) for c, xs in by_cell.items()]
            yield pd.DataFrame(rows, columns=["query_id", "exact", "cell", "lists"])

    asking = materialize(asked.select("query_id", "embedding").mapInPandas(probe, "query_id long, exact binary, cell int, lists array<int>"), "asking")
    blocks = small_side(materialize(asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")), "blocks"))
    asking = asking.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
    cell = (F.col("first") + F.pmod(F.xxhash64("vec_id"), "cells")).cast("int").alias("cell")
    candidates = coded.join(plan, "list").select("vec_id", "list", "codes", "exact", cell).join(blocks, "cell")
    candidates = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def scan(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        m = sent.value
        kept, scores, asked_by = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)]
        if len(rows) and len(asks):
            rows = rows.sort_values(["list", "vec_id"])
            ids, own, codes = rows["vec_id"].to_numpy(), rows["list"].to_numpy(), _packed(rows["codes"])
            x = np.frombuffer(b"".join(rows["exact"]), np.float64).reshape(len(rows), -1)
            # in parts, as all products of a cell would be a copy of it
            length = np.sqrt(np.concatenate([_dots(y, y) for y in np.array_split(x, max(1, len(x) // 4096))]))
            q = np.frombuffer(b"".join(asks["exact"]), np.float64).reshape(len(asks), -1)
        for one, vector, some in zip(asks["query_id"].to_numpy(), q, asks["lists"], strict=True) if len(rows) and len(asks) else ():
            pairs = _pairs((vector / np.linalg.norm(vector)).astype(np.float32), m)
            runs = _runs(np.sort(np.asarray(some)), own)
            near = np.concatenate([_by_code(pairs, codes[:, a:b]) for a, b in runs])
            place = np.concatenate([np.arange(a, b) for a, b in runs])
            take = min(keep + 1, len(near))
            if take:
                # all rows of the last one's code, as none of them is before another
                best = place[near >= np.partition(near, len(near) - take)[len(near) - take]]
                best = best[ids[best] != one]
                score = np.concatenate([_dots(x[p], vector) for p in np.array_split(best, max(1, len(best) // 4096))])
                score = score / (np.sqrt(_dots(vector, vector)) * length[best])
                best, score = (y[np.lexsort((ids[best], -score))[: k + 1]] for y in (best, score))
                kept.append(ids[best])
                scores.append(score)
                asked_by.append(np.full(len(best), one))
        return pd.DataFrame({"query_id": np.concatenate(asked_by), "vec_id": np.concatenate(kept), "score": np.concatenate(scores)})

    keys = ["cell", "block"]
    found = candidates.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    square = dot("embedding", "embedding")
    own = asked.select("query_id", F.col("query_id").alias("vec_id"), (square / (F.sqrt(square) * F.sqrt(square))).alias("score"))
    # the first k + 1 rows are of the first k + 1 kinds, as each kind has a row
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.union(own).withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k + 1)
    best = best.join(kinds.select("vec_id", "members"), "vec_id").join(asked.select("query_id", "h1", "h2"), "query_id")
    rows = F.transform("members", lambda v: F.struct((-F.col("score")).alias("away"), v.alias("vec_id")))
    best = best.groupBy("query_id", "h1", "h2").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("rows"))
    best = materialize(best.select("h1", "h2", F.slice("rows", 1, k + 1).alias("rows")), "nearest")
    out = seekers.join(small_side(best), ["h1", "h2"])
    out = out.select("query_id", F.posexplode(F.slice(F.filter("rows", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "row"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("row.vec_id").alias("vec_id"), (-F.col("row.away")).alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 50 == 0)
