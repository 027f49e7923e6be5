"""Numpy kernels over batches of texts, used inside mapInPandas tasks.

Texts are taken in blocks of ``BLOCK`` bytes, so memory in a task does not
depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
ROWS = 256
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_NEXT_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[int, np.ndarray] = {}


def slices(batches, rows: int = ROWS):
    """Arrow batches in parts of few rows, so that few texts at a time become
    Python strings. What Arrow keeps of freed memory is given back after each batch,
    as a worker outlives its task."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def blocks(texts, size: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) of runs of rows of about ``size``
    bytes; a null text is empty, one of bytes is taken as it is."""
    start, held, part = 0, 0, []
    for i, text in enumerate(texts):
        part.append(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
        held += len(part[-1]) + 1
        if held >= size:
            yield start, i + 1, part
            start, held, part = i + 1, 0, []
    if part:
        yield start, start + len(part), part


def cut(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end before white space, so
    no word is cut (a longer word is, at ``size``)."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(c, at + 1, at + size) for c in (b" ", b"\n", b"\t", b"\r"))
        end = end if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:]


def cut_blocks(texts, size: int = BLOCK) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Like ``blocks``, but long texts are cut: (row of each piece, pieces).
    What a task holds is bounded by ``size``, however long a text is."""
    rows, part, held = [], [], 0
    for i, text in enumerate(texts):
        for piece in cut(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", size):
            rows.append(i)
            part.append(piece)
            held += len(piece) + 1
            if held >= size:
                yield np.array(rows), part
                rows, part, held = [], [], 0
    if part:
        yield np.array(rows), part


def joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with a line end after each text, and where each text starts."""
    data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
    lengths = np.fromiter((len(x) + 1 for x in part), np.int64, len(part))
    return data, np.concatenate(([0], np.cumsum(lengths)[:-1]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * BLOCK), base, _U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z taken as a-z if ``fold``) and each text's first word.

    The second array has one more entry than there are texts.
    """
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    first, last = edge[0::2], edge[1::2]
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum(((_LOWER[data] if fold else data) + _U(1)) * _power(_BASE, len(data)), out=total[1:])
    h = (total[last] - total[first]) * _power(_INVERSE, len(data) + 1)[first]
    h = mixed(h + (last - first).astype(_U))
    return h, np.append(np.searchsorted(first, starts), len(first))


def hashed_words(part: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of some texts; one that is much longer than a block is
    hashed piece by piece, which gives the same words unless one alone is longer."""
    if len(part[-1]) <= 4 * BLOCK:
        return word_hashes(*joined(part), fold)
    some = [word_hashes(*joined(part[:-1]), fold)] if len(part) > 1 else [(np.empty(0, _U), np.zeros(1, np.int64))]
    long = _whole_words(part[-1], fold)
    return np.concatenate((some[0][0], long)), np.append(some[0][1], len(some[0][0]) + len(long))


def _whole_words(text: bytes, fold: bool) -> np.ndarray:
    """Word hashes of a long text, in pieces that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            found = _NEXT_SPACE.search(text, end)
            end = found.start() if found else len(text)
        out.append(word_hashes(*joined([text[at:end]]), fold)[0])
        at = end
    return np.concatenate(out)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit values."""
    size = max(0, len(h) - width + 1)
    whole = np.zeros(size, _U)
    for j in range(width):
        whole = (whole + h[j : j + size]) * _U(0xD6E8FEB86659FD93)
    whole = mixed(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            x = _U(b - a)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = (x * _U(0xD6E8FEB86659FD93)) + v
            out.append(mixed(np.array([x], _U)))
        else:
            out.append(np.empty(0, _U))
    return out


def byte_grams(data: np.ndarray, starts: np.ndarray, n: int, dims: int) -> np.ndarray:
    """Counts of hashed n-byte windows that lie inside one text: texts x dims."""
    code = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for j in range(n):
        code = code * np.uint32(0x01000193) + data[j : len(data) - n + 1 + j]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(13)
    slot = (code & np.uint32(dims - 1)).astype(np.int64)
    ends = np.append(starts[1:], len(data)) - n
    out = np.zeros((len(starts), dims), np.float32)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if b > a:
            out[i] = np.bincount(slot[a:b], minlength=dims)
    return out
