"""Short cycles of a graph of numbered markets, by blocks of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a market's number; above them an end of a link has its degree.
NUMBER_BITS = 40
NUMBER = (1 << NUMBER_BITS) - 1
#: Links, each way one, that a block has at most on average; links that a packed row holds.
BLOCK_LINKS, PACKED = 5_000_000, 250_000
#: Two-link paths that are held at once.
BATCH_PATHS = 2_000_000
_LINK = np.dtype([("x", "<i8"), ("y", "<i8"), ("w", "<f8"), ("hedge", "i1")])
_CELL = "side int, block int, links binary"


def blocks_of(links: int, least: int = 1) -> int:
    """Blocks that the markets of so many links are dealt to."""
    return max(least, -(-2 * links // BLOCK_LINKS))


def ring_columns(longest: int) -> list[str]:
    return [f"m{i}" for i in range(longest)]


def ring_schema(longest: int) -> str:
    """Markets along a ring (none past its length), its length, sum and hedges."""
    return ", ".join(f"{c} long" for c in ring_columns(longest)) + ", n int, total double, hedges int"


def slack(below: float, weights: np.ndarray, n: int) -> float:
    """More than the order of a sum of ``n`` of the weights can make out."""
    return 1e-12 * (1 + abs(below) + n * float(np.abs(weights).max(initial=0.0)))


def ring_batch(ring: np.ndarray, weights: np.ndarray, hedges: np.ndarray, below: float, longest: int) -> pa.RecordBatch:
    """Rings and the weights of their links (the last leads back), from the least
    market towards its smaller neighbour, those whose sum is below. The sum is that of
    the half before the market opposite and the half after it, each from the least on."""
    n = ring.shape[1]
    turn = (ring.argmin(1)[:, None] + np.arange(n)) % n
    ring, weights = np.take_along_axis(ring, turn, 1), np.take_along_axis(weights, turn, 1)
    flip = ring[:, 1] > ring[:, -1]
    ring[flip, 1:], weights[flip] = ring[flip, :0:-1], weights[flip, ::-1]
    half = n - n // 2
    ahead, back = weights[:, 0], weights[:, -1]
    for k in range(1, half):
        ahead = ahead + weights[:, k]
    for k in range(n - 2, half - 1, -1):
        back = back + weights[:, k]
    total = ahead + back
    keep = total < below
    markets = [pa.array(ring[keep, k]) if k < n else pa.nulls(int(keep.sum()), pa.int64()) for k in range(longest)]
    rest = [pa.array(np.full(int(keep.sum()), n, np.int32)), pa.array(total[keep]), pa.array(hedges[keep].astype(np.int32))]
    return pa.RecordBatch.from_arrays(markets + rest, ring_columns(longest) + ["n", "total", "hedges"])


def _block(ends: np.ndarray, blocks: int) -> np.ndarray:
    mixed = (ends & NUMBER).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.uint16 if blocks < 1 << 16 else np.int64)


def _packed(links: DataFrame, blocks: int) -> DataFrame:
    """Links (low, high, w, hedge) as rows of many: on side 0 from the greater end,
    in its block; on side 1 both ways, in the block of the end they lead to."""

    def rows(side: int, held: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(at, kind="stable")
        held, at = held[order], at[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for part, block in zip(np.split(held, cuts), at[np.r_[0, cuts]]):
            yield side, int(block), part.tobytes()

    def flush(held: np.ndarray) -> pa.RecordBatch:
        turned = held.copy()
        turned["x"], turned["y"] = held["y"], held["x"]
        out = [*rows(0, held, _block(held["x"], blocks)), *rows(1, held, _block(held["y"], blocks)), *rows(1, turned, _block(turned["y"], blocks))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["side", "block", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            part = np.empty(batch.num_rows, _LINK)
            for to, c in (("x", "high"), ("y", "low"), ("w", "w"), ("hedge", "hedge")):
                part[to] = batch.column(c).to_numpy(zero_copy_only=False)
            held, n = [*held, part], n + len(part)
            if n >= PACKED:
                yield flush(np.concatenate(held))
                held, n = [], 0
        if n:
            yield flush(np.concatenate(held))

    return links.select("high", "low", "w", "hedge").mapInArrow(run, _CELL)


def _ranks(*ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ends by their place in order, and the markets' numbers by it."""
    top = max(int((e & NUMBER).max()) for e in ends)
    if top > 4 * sum(map(len, ends)) + (1 << 20):
        every, place = np.unique(np.concatenate(ends), return_inverse=True)
        return np.split(place.astype(np.int32), np.cumsum([len(e) for e in ends])[:-1]), every & NUMBER
    known = np.zeros(top + 1, np.int64)
    for e in ends:
        known[e & NUMBER] = e
    numbers = np.flatnonzero(known)
    numbers = numbers[np.argsort(known[numbers])]
    place = np.zeros(top + 1, np.int32)
    place[numbers] = np.arange(len(numbers))
    return [place[e & NUMBER] for e in ends], numbers


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, and which range each is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) + np.repeat(start - np.cumsum(count) + count, count), of


def _sorted(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys from zero to ``top`` in order, and where each was."""
    bits = max(1, (len(key) - 1).bit_length())
    if top.bit_length() + bits > 62:
        order = np.argsort(key, kind="stable")
        return key[order], order
    both = np.sort((key << bits) | np.arange(len(key)))
    return both >> bits, both & ((1 << bits) - 1)


def meet(legs: np.ndarray, steps: np.ndarray, lengths: list[int], below: float, longest: int) -> Iterator[pa.RecordBatch]:
    """Rings of three and four from their greatest market v, whose links are ``legs``,
    over two links to a smaller market w that ``steps`` lead to: two such paths with the
    same ends make a ring of four, one and a link between its ends a ring of three."""
    if not len(legs) or not len(steps):
        return
    (v, u, x, y), numbers = _ranks(legs["x"], legs["y"], steps["x"], steps["y"])
    v, order = _sorted(v.astype(np.int64), len(numbers))
    u, leg_w, leg_hedge = u[order], legs["w"][order], legs["hedge"][order].astype(np.int64)
    _, order = _sorted(x.astype(np.int64), len(numbers))
    y, step_w, step_hedge = y[order], steps["w"][order], steps["hedge"][order].astype(np.int64)
    counts = np.bincount(x, minlength=len(numbers))
    # markets that steps lead to, by their place among them
    led = np.zeros(len(numbers), np.int64)
    led[y] = 1
    ends, before = np.flatnonzero(led), np.cumsum(led) - led
    end, bound, direct = before[y], before[v], np.where(led[u] > 0, before[u], -1)
    count, start = counts[u], (np.cumsum(counts) - counts)[u]
    begins = np.r_[True, v[1:] != v[:-1]]
    first, turn = np.flatnonzero(begins), np.cumsum(begins) - 1
    bar = below + slack(below, np.r_[leg_w, step_w], 4)
    # markets in turn, as many as begin within a batch of paths
    paths = np.r_[0, np.cumsum(count)][first] // BATCH_PATHS
    cuts = np.r_[first[np.r_[True, paths[1:] > paths[:-1]]], len(v)]
    for lo, hi in zip(cuts, cuts[1:]):
        step, leg = _ranges(start[lo:hi], count[lo:hi])
        leg += lo
        less = end[step] < bound[leg]
        step, leg = step[less], leg[less]
        if not len(leg):
            continue
        key, order = _sorted((turn[leg] - turn[lo]) * len(ends) + end[step], int(turn[hi - 1] - turn[lo] + 1) * len(ends))

        if 3 in lengths:
            mine = lo + np.flatnonzero(direct[lo:hi] >= 0)
            wanted = (turn[mine] - turn[lo]) * len(ends) + direct[mine]
            begin = np.searchsorted(key, wanted)
            place, of = _ranges(begin, np.searchsorted(key, wanted, "right") - begin)
            a, b, c = leg[order[place]], step[order[place]], mine[of]
            # once, not from both of the smaller markets
            keep = (u[a] < u[c]) & (leg_w[a] + step_w[b] + leg_w[c] < bar)
            a, b, c = a[keep], b[keep], c[keep]
            if len(a):
                ring = numbers[np.stack([v[a], u[a], u[c]], 1)]
                yield ring_batch(ring, np.stack([leg_w[a], step_w[b], leg_w[c]], 1), leg_hedge[a] + step_hedge[b] + leg_hedge[c], below, longest)

        if 4 in lengths:
            same = key[1:] == key[:-1]
            several = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
            key, a, b = key[several], leg[order[several]], step[order[several]]
            total = leg_w[a] + step_w[b]
            # from the least sum on, so that a path that is too much with another is too much with all after it
            order = np.lexsort((total, key))
            key, a, b, total = key[order], a[order], b[order], total[order]
            one, apart = np.arange(len(key)), 0
            while len(one):
                apart += 1
                one = one[one + apart < len(key)]
                two = one + apart
                keep = (key[one] == key[two]) & (total[one] + total[two] < bar)
                one, two = one[keep], two[keep]
                if len(one):
                    out, back, to, fro = a[one], a[two], b[one], b[two]
                    ring = numbers[np.stack([v[out], u[out], y[to], u[back]], 1)]
                    hedges = leg_hedge[out] + step_hedge[to] + step_hedge[fro] + leg_hedge[back]
                    yield ring_batch(ring, np.stack([leg_w[out], step_w[to], step_w[fro], leg_w[back]], 1), hedges, below, longest)


def short_rings(links: DataFrame, blocks: int, low: int, high: int, lengths: list[int], below: float, longest: int) -> DataFrame:
    """Rings of three and four markets whose greatest market is in the blocks from
    ``low`` up to ``high``. ``links``: low, high (a market's degree above its number),
    w, hedge, each pair once.

    A task has the links from the greatest markets of one block and those to the markets
    of another, so that two paths that meet are in one task; a link goes to as many tasks
    as there are blocks. It holds a block's links and one batch of paths.
    """
    packed = _packed(links, blocks)
    wanted = packed.where((F.col("side") == 1) | F.col("block").between(low, high - 1))
    others = F.when(F.col("side") == 0, F.sequence(F.lit(0), F.lit(blocks - 1))).otherwise(F.sequence(F.lit(low), F.lit(high - 1)))
    cells = wanted.withColumn("other", F.explode(others))
    task = F.when(F.col("side") == 0, (F.col("block") - low) * blocks + F.col("other")).otherwise((F.col("other") - low) * blocks + F.col("block"))
    cells = cells.select(task.alias("task"), "side", "links").repartitionById((high - low) * blocks, "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])
        for batch in batches:
            for task, side, part in zip(*(batch.column(c) for c in ("task", "side", "links"))):
                if now != task.as_py():
                    yield from done(held)
                    now, held = task.as_py(), ([], [])
                held[side.as_py()].append(np.frombuffer(part.as_buffer(), _LINK).copy())
        yield from done(held)

    def done(held: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if held[0] and held[1]:
            yield from meet(np.concatenate(held[0]), np.concatenate(held[1]), lengths, below, longest)

    return cells.mapInArrow(run, ring_schema(longest))
