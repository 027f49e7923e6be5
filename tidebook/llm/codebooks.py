"""Vector code compression: product codes whose nearest entries Orchard search finds.

A vector's components become integers, floor(``SCALE`` x), and it is cut into
``PARTS`` consecutive parts. Each part has a codebook of up to ``ENTRIES``
entries, which starts as that part of the vectors of smallest vec_id; ``ROUNDS``
rounds assign every part to its nearest entry and move each entry to the floor of
its parts' mean. A vector's code is the place of the nearest entry of each part.

Orchard search finds that entry. Each entry has a list of all entries by distance
from it. The search walks the list of the best entry found so far; at a better one
it goes on in that entry's list from the start, with a mark on every entry that was
measured. An entry more than twice as far from the best one as the query is can't
be nearer than it, so there the search ends. Equal distances go on, so ties fall to
the smaller place. A batch of rows walks in step, some list places at a time.

Distances are whole numbers, in doubles where all of them stay below 2**53 and as
Python integers where not, so no result depends on the order of a sum. A task sums
the parts of each entry, Spark adds the sums up, and the driver holds the codebooks
alone: ``ENTRIES`` times the dimensions.

Defined cases: vectors that are null, empty, or hold a null or a component that isn't finite
or reaches 2**50 (whose integers no long could sum) drop out, as do those of another
length than most (ties to the longer). A length that isn't a multiple of ``PARTS``
is cut at floor(j length / PARTS). Of fewer vectors than entries each is one. Rows
of one vec_id give one starting entry, that of the smallest vector; a null vec_id
counts as the largest. Repeated rows are coded alike and each count. Errors beyond
a long are the largest long. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize, worker_imports
from tidebook.llm.tables import read, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 2.0**50
MOST = 2**63 - 1
#: Rows that walk in step, and list places that they take at a time.
ROWS, STEP = 4096, 8


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))


def bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    edges = [j * dims // parts for j in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as doubles, or as Python integers where a squared
    distance could pass 2**53."""
    out = np.floor(x.astype(np.float64) * scale)
    return out if _short(out) else np.array([int(v) for v in out.ravel()], object).reshape(out.shape)


def _short(x: np.ndarray) -> bool:
    top = float(np.abs(x).max()) if x.size else 0.0
    return x.shape[-1] * (2 * top + 2) ** 2 < 2.0**53


class Entries:
    """One part's entries with the distance-sorted list of each."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.gaps = np.array([_squared(values - v) for v in values], values.dtype)
        self.lists = np.argsort(self.gaps, axis=1, kind="stable")
        self.by_first = np.argsort(values[:, 0], kind="stable") if values.shape[1] else np.arange(len(values))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and squared distance of each row's nearest entry."""
        if x.dtype != self.values.dtype:
            return Entries(self.values.astype(object)).nearest(x.astype(object))
        found = [self._walk(x[a : a + ROWS]) for a in range(0, len(x), ROWS)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _start(self, x: np.ndarray) -> np.ndarray:
        """An entry whose first component is about the row's."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64)
        at = np.searchsorted(self.values[self.by_first, 0], x[:, 0])
        return self.by_first[np.minimum(at, len(self.values) - 1)]

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries = len(self.values)
        at = self._start(x)
        best = _squared(x - self.values[at])
        marked = np.zeros((len(x), entries), bool)
        marked[np.arange(len(x)), at] = True
        place, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            own = at[live]
            cols = place[live][:, None] + np.arange(STEP)
            some = self.lists[own[:, None], np.minimum(cols, entries - 1)]
            near = (cols < entries) & (self.gaps[own[:, None], some] <= 4 * best[live][:, None])
            r, k = np.nonzero(near & ~marked[live[:, None], some])
            rows, tried = live[r], some[r, k]
            marked[rows, tried] = True
            found = np.full(some.shape, np.inf, x.dtype)
            found[r, k] = _squared(x[rows] - self.values[tried])
            low = found.min(axis=1)
            who = np.where(found == low[:, None], some, entries).min(axis=1)
            better = (low < best[live]) | ((low == best[live]) & (who < own))
            to = live[better]
            at[to], best[to], place[to] = who[better], low[better], 0
            on = ~better & near[:, -1]
            place[live[on]] += STEP
            live = live[better | on]
        return at, best


def _squared(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(axis=-1) if d.dtype == object else np.einsum("...j,...j->...", d, d)


def vectors_of(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)


def _common_length(rows: DataFrame) -> int | None:
    most = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return most and most["n"]


def _first_entries(rows: DataFrame, dims: int, entries: int, scale: int) -> np.ndarray:
    """The vectors of the smallest vec_ids: ``entries`` rows at most."""
    ids = rows.select(F.col("vec_id").alias("_id")).distinct().orderBy(F.col("_id").asc_nulls_last()).limit(entries)
    some = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("embedding").alias("v"))
    held = some.orderBy(F.col("vec_id").asc_nulls_last()).collect()
    return whole(np.array([r.v for r in held], np.float64).reshape(-1, dims), scale)


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """The codebook of each part. ``rows`` has vec_id and usable embeddings of one length."""
    first = _first_entries(rows, dims, entries, scale)
    cuts = bounds(dims, parts)
    books = [first[:, a:b] for a, b in cuts]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)

        def sums(batches, sent=sent):
            found = [Entries(b) for b in sent.value]
            n = [np.zeros(len(b), np.int64) for b in sent.value]
            total = [np.zeros(b.shape, object) for b in sent.value]
            for batch in batches:
                x = vectors_of(batch.column(0), dims, scale)
                for j, (a, b) in enumerate(cuts):
                    at = found[j].nearest(x[:, a:b])[0]
                    n[j] += np.bincount(at, minlength=len(n[j]))
                    # a batch's sums are below 2**53 where its distances are
                    part = np.zeros(total[j].shape, x.dtype)
                    np.add.at(part, at, x[:, a:b])
                    total[j] += part.astype(np.int64) if x.dtype != object else part
            out = [(j, int(e), i, int(n[j][e]), str(total[j][e, i])) for j in range(parts) for e in np.flatnonzero(n[j]) for i in range(total[j].shape[1])]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["part", "entry", "at", "n", "total"])

        moved = rows.select("embedding").mapInArrow(sums, "part int, entry int, at int, n long, total string")
        moved = moved.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = [b.astype(object) for b in books]
        for r in moved.collect():
            new[r.part][r.entry, r.at] = int(r.total) // r.n
        books = [b.astype(np.float64) if _short(b.astype(np.float64)) else np.array([int(v) for v in b.ravel()], object).reshape(b.shape) for b in new]
        sent.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], dims: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (bytes, one a part) and error of usable vectors."""
    sent = rows.sparkSession.sparkContext.broadcast(books)
    cuts = bounds(dims, len(books))

    def code(batches):
        found = [Entries(b) for b in sent.value]
        for batch in batches:
            x = vectors_of(batch.column("embedding"), dims, scale)
            got = [e.nearest(x[:, a:b]) for e, (a, b) in zip(found, cuts, strict=True)]
            codes = np.stack([g[0] for g in got], axis=1).astype(np.uint8)
            error = [min(MOST, sum(int(v) for v in d)) for d in zip(*(g[1] for g in got), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)
    return rows.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id {kind['vec_id']}, label {kind['label']}, code binary, error bigint")


def decode(code: bytes, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([b[i] for b, i in zip(books, code, strict=True)]).astype(np.float64) / scale


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all usable vectors (vec_id, label, code, error), and the codebooks."""
    worker_imports(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    dims = _common_length(rows)
    if dims is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    rows = rows.where(F.size("embedding") == dims)
    books = fit(rows, dims)
    return encode(rows, books, dims), books


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    coded = materialize(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("_of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    by_label = by_label.select("_of", F.least("sum", F.lit(MOST)).cast("long").alias("label_error"))
    both = coded.join(small_side(materialize(by_label, "label-errors")), F.col("label").eqNullSafe(F.col("_of")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    near = "SELECT vec_id, part, any_value(p.v) AS v, min({d: list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), e: b.e}) AS m FROM p JOIN %s b USING (part) GROUP BY vec_id, part"
    steps = [f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < {entries})"]
    for i in range(1, rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near % f'b{i - 1}'})")
        mean = f"SELECT part, e, list(m ORDER BY i) AS v FROM (SELECT part, m.e AS e, i, floor(sum(v[i + 1]) / count(*)) AS m FROM a{i}, range(len(v)) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2"
        steps.append(f"b{i} AS MATERIALIZED (SELECT part, e, coalesce(n.v, o.v) AS v FROM b{i - 1} o LEFT JOIN ({mean}) n USING (part, e))")
    steps.append(f"f AS MATERIALIZED ({near % f'b{rounds}'})")
    return ", ".join(steps)


ORACLE = {
    "op13_codebooks": f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) t(part)), {_rounds()},
c AS (SELECT vec_id, string_agg(lower(printf('%02x', m.e)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY 1),
s AS (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda x: x::BIGINT), 'string_agg', ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), s""",
}
