"""SentencePiece encoding and decoding as a max-plus parallel scan.

The best segmentation of a text is the path of greatest total score through the
lattice of vocabulary pieces (Viterbi). A piece that crosses a cut between two
chunks reaches less than ``reach`` characters into the second one, so a chunk
meets its past only through the number of its leading characters that are
already taken: its entry state. For each chunk a task computes the matrix of
best scores from every entry state to every exit state. Matrices combine by the
max-plus product, which is associative: first inside groups of ``FAN`` chunks,
then over the groups of a document, then back down, which fixes every chunk's
entry and exit state. Each chunk is then traced back on its own.

White space becomes U+2581 and one is put in front, as the model file says.
Where no piece of the vocabulary has the two characters on either side of a
place inside it, all paths meet there: ``_TOKEN`` splits at such places (checked
against every piece when a vocabulary is loaded; a vocabulary that doesn't fit
is split at word starts only). What lies between two of them is solved alone and
remembered. A chunk's matrix needs only what comes before its first and after
its last such place; the score of the middle is the same for all states, so it
is left out, which shifts a matrix by a constant and changes no best path.

Piece scores: the vocabulary file ranks its pieces (it was made by merging), so
a piece of rank r scores ``-log(r + RANK_SHIFT)``, a Zipf estimate of its log
probability; characters without a piece become byte pieces at the score of the
worst piece less ``UNKNOWN``. ``scores="file"`` takes the file's numbers. Scores
are rounded to single precision, as model files hold them.

Defined cases: a null text is empty and has no ids; U+2581 in a text can't be
told from a space and decodes as one; lone surrogates become question marks;
rows that repeat a doc_id are each encoded; a text of any length is encoded
whole, in one row; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize, worker_imports
from tidebook.llm.grams import slices
from tidebook.llm.tables import apart, quoted, read, together

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = 1 << 15
FAN = 256
RANK_SHIFT = 100.0
UNKNOWN = 10.0
#: Strings in each of two generations of the memo, and the longest one kept.
REMEMBERED = 75_000
LONGEST = 48
BATCH = 128
_TOKEN = regex.compile(rf"{MARK}*[\p{{L}}\p{{M}}]+|{MARK}*[^\p{{L}}\p{{M}}{MARK}\n]+|{MARK}+|\n")
_WORD = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _file(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


@lru_cache(maxsize=2)
def longest_piece(path: str = MODEL) -> int:
    """``reach`` of a vocabulary, which is all that the driver needs of it."""
    proto = _file(path)
    kinds = proto.SentencePiece
    return max(len(p.piece) for p in proto.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED))


class Vocabulary:
    """Pieces with scores, byte pieces, and the solver for strings."""

    def __init__(self, path: str = MODEL, scores: str = "rank"):
        proto = _file(path)
        kinds = proto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.text = [p.piece for p in proto.pieces]
        self.parts = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode() for p in proto.pieces]
        first = min(self.ids.values())
        score = (lambda i: -math.log(i - first + RANK_SHIFT)) if scores == "rank" else (lambda i: proto.pieces[i].score)
        self.score = {s: float(np.float32(score(i))) for s, i in self.ids.items()}
        self.unknown = min(self.score.values()) - UNKNOWN
        self.reach = max(map(len, self.ids))
        self.chars = {s for s in self.ids if len(s) == 1}
        finder = ahocorasick.Automaton()
        for s, i in self.ids.items():
            finder.add_word(s, (len(s), self.score[s], i))
        finder.make_automaton()
        #: (last position, (length, score, id)) of every piece in a string, by end
        self.matches = finder.iter
        self.token = _TOKEN if all(len(_TOKEN.findall(s)) == 1 for s in self.ids) else _WORD
        self.sizes = [len(s) for s in self.text]
        # when the young half of the memo is full it becomes the old half
        self.young, self.old = {}, {}

    def forward(self, text: str, start: int, stop: int) -> tuple[list[float], list[int], list[int]]:
        """Best score to each position from ``start``, where the last piece
        began and its id (-1: bytes). Pieces start before ``stop`` and may end
        up to ``reach`` - 1 after it."""
        size = len(text) + 1
        best, since, piece = [-math.inf] * size, [0] * size, [-1] * size
        best[start] = 0.0
        odd = [] if self.chars.issuperset(text) else [i for i in range(start, stop) if text[i] not in self.chars]
        at = 0
        for end, (n, score, one) in self.matches(text, start):
            while at < len(odd) and odd[at] <= end:
                self._by_bytes(best, since, odd[at])
                at += 1
            end += 1
            begin = end - n
            if begin < stop:
                total = best[begin] + score
                if total > best[end]:
                    best[end], since[end], piece[end] = total, begin, one
        for i in odd[at:]:
            self._by_bytes(best, since, i)
        return best, since, piece

    def _by_bytes(self, best: list[float], since: list[int], i: int) -> None:
        best[i + 1], since[i + 1] = best[i] + self.unknown, i

    def forward_all(self, text: str, stop: int) -> np.ndarray:
        """Best scores to each position from every entry state: positions x states."""
        k = self.reach
        best = np.full((len(text) + 1, k), -np.inf)
        for s in range(min(k, stop + 1)):
            best[s, s] = 0.0
        odd = [i for i in range(stop) if text[i] not in self.chars]
        at = 0
        for end, (n, score, _) in self.matches(text):
            while at < len(odd) and odd[at] <= end:
                np.maximum(best[odd[at] + 1], best[odd[at]] + self.unknown, out=best[odd[at] + 1])
                at += 1
            begin = end + 1 - n
            if begin < stop:
                np.maximum(best[end + 1], best[begin] + score, out=best[end + 1])
        for i in odd[at:]:
            np.maximum(best[i + 1], best[i] + self.unknown, out=best[i + 1])
        return best

    def trace(self, text: str, found: tuple, start: int, end: int) -> list[int]:
        _, since, piece = found
        out: list[int] = []
        while end > start:
            if piece[end] >= 0:
                out.append(piece[end])
            else:
                out.extend([self.byte[b] for b in reversed(text[since[end] : end].encode("utf-8", "replace"))])
            end = since[end]
        return out[::-1]

    def solve(self, token: str) -> bytes:
        """Packed ids of a string between two meeting places."""
        known = self.old.get(token)
        if known is None:
            ids = self._path(token) if self.chars.issuperset(token) else self.trace(token, self.forward(token, 0, len(token)), 0, len(token))
            known = struct.pack(f"={len(ids)}i", *ids)
        if len(token) <= LONGEST:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[token] = known
        return known

    def _path(self, token: str) -> list[int]:
        """The best ids of a string whose characters are all pieces."""
        size = len(token)
        best, piece = [-math.inf] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        for end, (n, score, one) in self.matches(token):
            total = best[end + 1 - n] + score
            if total > best[end + 1]:
                best[end + 1], piece[end + 1] = total, one
        out = []
        while size:
            out.append(piece[size])
            size -= self.sizes[piece[size]]
        out.reverse()
        return out

    def pack(self, text: str) -> bytes:
        """Packed ids of a text whose spaces are made visible."""
        tokens = self.token.findall(text)
        found = list(map(self.young.get, tokens))
        if None in found:
            found = [self.solve(t) if x is None else x for t, x in zip(tokens, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.pack(marked(text)), np.int32)

    def meeting(self, text: str, stop: int) -> tuple[int, int]:
        """First and last meeting place in text[:stop]; equal to stop if none."""
        first = self.token.match(text).end()
        if first >= stop:
            return stop, stop
        width = LONGEST
        while True:
            since = max(0, stop - width)
            # the first token of a window may begin anywhere, the others at meeting places
            starts = [m.start() for m in self.token.finditer(text, since, stop)][1:]
            if starts:
                return first, max(first, starts[-1])
            width *= 2

    def matrix(self, text: str, stop: int) -> np.ndarray:
        """Best scores from each entry state to each exit state of a chunk, but
        for the part between its first and last meeting place.

        ``text`` holds the chunk's ``stop`` characters and what follows, up to
        ``reach`` - 1 more; states are numbers of characters past the edge.
        """
        k = self.reach
        out = np.full((k, k), -np.inf)
        first, last = self.meeting(text, stop)
        if first >= stop:
            rows = self.forward_all(text, stop)[stop : stop + k]
            out[:, : len(rows)] = rows.T
        else:
            head = self.forward_all(text[:first], first)[first]
            tail = self.forward(text[last:], 0, stop - last)[0][stop - last :][:k]
            out[:, : len(tail)] = head[:, None] + np.array(tail)[None, :]
        # a piece from before may pass over a whole chunk that is very short
        for s in range(stop, k):
            out[s, :] = -np.inf
            out[s, s - stop] = 0.0
        return out

    def backtrace(self, text: str, stop: int, entry: int, leave: int) -> bytes:
        """Packed ids of the pieces that start in a chunk, for known states."""
        if entry >= stop:
            return b""
        first, last = self.meeting(text, stop)
        if first >= stop:
            ids = self.trace(text, self.forward(text, entry, stop), entry, stop + leave)
            return struct.pack(f"={len(ids)}i", *ids)
        head, end = text[:first], text[last:]
        before = self.trace(head, self.forward(head, entry, first), entry, first)
        after = self.trace(end, self.forward(end, 0, stop - last), 0, stop - last + leave)
        return struct.pack(f"={len(before)}i", *before) + self.pack(text[first:last]) + struct.pack(f"={len(after)}i", *after)

    def decode(self, ids) -> str:
        """The text of a sequence of ids: byte pieces join to characters."""
        return b"".join([self.parts[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL, scores: str = "rank") -> Vocabulary:
    return Vocabulary(path, scores)


def marked(text: str) -> str:
    """What is segmented: spaces made visible and one put in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def _load(blob: bytes, k: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(k, k)


def _slices(batches, rows: int):
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as an array of lists."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _encode_short(docs: DataFrame, text: str, path: str, scores: str, decoded: bool) -> DataFrame:
    """Texts of at most a chunk. Arrow batches are taken ``BATCH`` rows at a
    time, so a task holds few texts, ids and decoded texts as Python objects."""
    at = docs.columns.index(text)
    names = [*docs.columns, "ids", *["decoded"] * decoded]

    def run(batches):
        v = vocabulary(path, scores)
        for part in slices(batches, BATCH):
            packed = [v.pack(marked(t)) if t else b"" for t in part.column(at).to_pylist()]
            more = [_lists(packed)]
            if decoded:
                more.append(pa.array([v.decode(np.frombuffer(x, np.int32).tolist()) for x in packed], pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=names)

    return docs.mapInArrow(run, f"{_fields(docs)}, ids array<int>" + ", decoded string" * decoded)


def _fields(docs: DataFrame) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema)


def _encode_long(docs: DataFrame, text: str, path: str, scores: str, chunk: int, fan: int) -> DataFrame:
    """The scan over chunks. ``docs`` has a unique _row, and the texts in one column."""
    k = longest_piece(path)

    def cut(batches):
        for pdf in batches:
            for row, text in zip(pdf["_row"], pdf["text"], strict=True):
                text = marked(text)
                for base in range(0, len(text), 64 * chunk):
                    starts = range(base, min(len(text), base + 64 * chunk), chunk)
                    yield pd.DataFrame({"_row": row, "part": [s // chunk for s in starts], "size": [min(chunk, len(text) - s) for s in starts], "piece": [text[s : s + chunk + k - 1] for s in starts]})

    pieces = materialize(docs.select("_row", F.col(text).alias("text")).mapInPandas(cut, "_row long, part int, size int, piece string").repartition("_row", "part"), "chunks")

    def matrices(batches):
        v = vocabulary(path, scores)
        for pdf in _slices(batches, 64):
            yield pdf[["_row", "part"]].assign(m=[v.matrix(t, n).tobytes() for t, n in zip(pdf["piece"], pdf["size"], strict=True)])

    single = materialize(pieces.mapInPandas(matrices, "_row long, part int, m binary").withColumn("team", F.floor(F.col("part") / fan).cast("int")), "matrices")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = None
        for blob in pdf["m"]:
            total = _load(blob, k) if total is None else times(total, _load(blob, k))
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "team": pdf["team"].iloc[:1], "m": [total.tobytes()]})

    teams = single.groupBy("_row", "team").applyInPandas(product, "_row long, team int, m binary")

    def states(mats: list[np.ndarray], entry: int, leave: int) -> list[int]:
        """Entry states of each step and the last exit, on a best path."""
        scores = [np.full(k, -np.inf)]
        scores[0][entry] = 0.0
        for m in mats:
            scores.append((scores[-1][:, None] + m).max(0))
        path = [leave]
        for m, s in zip(mats[::-1], scores[-2::-1], strict=True):
            path.append(int((s + m[:, path[-1]]).argmax()))
        return path[::-1]

    def over_teams(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("team")
        path = states([_load(b, k) for b in pdf["m"]], 0, 0)
        return pd.DataFrame({"_row": pdf["_row"].to_numpy(), "team": pdf["team"].to_numpy(), "enter": path[:-1], "leave": path[1:]})

    edges = teams.groupBy("_row").applyInPandas(over_teams, "_row long, team int, enter int, leave int")

    def over_chunks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("part")
        path = states([_load(b, k) for b in left["m"]], int(right["enter"].iloc[0]), int(right["leave"].iloc[0]))
        return pd.DataFrame({"_row": left["_row"].to_numpy(), "part": left["part"].to_numpy(), "enter": path[:-1], "leave": path[1:]})

    fixed = single.groupBy("_row", "team").cogroup(edges.groupBy("_row", "team")).applyInPandas(over_chunks, "_row long, part int, enter int, leave int")

    def back(batches):
        v = vocabulary(path, scores)
        for pdf in _slices(batches, 64):
            yield pdf[["_row", "part"]].assign(ids=[np.frombuffer(v.backtrace(t, n, e, x), np.int32) for t, n, e, x in zip(pdf["piece"], pdf["size"], pdf["enter"], pdf["leave"], strict=True)])

    traced = pieces.join(fixed, ["_row", "part"]).mapInPandas(back, "_row long, part int, ids array<int>")
    whole = traced.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"])).alias("ids"))
    return docs.join(whole, "_row").drop("_row")


def encode(docs: DataFrame, path: str = MODEL, scores: str = "rank", chunk: int = CHUNK, fan: int = FAN, decoded: bool = False) -> DataFrame:
    """``docs`` with the column ``ids`` added, and ``decoded`` if asked for.

    A text that fits one chunk has no states to combine and is solved at once.
    """
    spark = docs.sparkSession
    worker_imports(spark)
    rows, names = apart(docs.drop("ids", "decoded"))
    text = names["text"]
    long = F.coalesce(F.char_length(text), F.lit(0)) >= chunk
    wide = materialize(rows.where(long).withColumn("_row", F.monotonically_increasing_id()), "giants")
    scanned = _encode_long(wide, text, path, scores, chunk, fan)
    found = _encode_short(rows.where(~long), text, path, scores, decoded).unionByName(decode(scanned, path) if decoded else scanned)
    return together(found, names, "ids", *["decoded"] * decoded)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with the column ``decoded`` added."""
    worker_imports(encoded.sparkSession)
    kept = encoded.drop("decoded")

    def run(batches):
        v = vocabulary(path)
        for pdf in batches:
            yield pdf.assign(decoded=[v.decode(ids.tolist()) if ids is not None else "" for ids in pdf["ids"]])

    return kept.mapInPandas(run, f"{_fields(kept)}, decoded string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids by digest, and whether they decode to its text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode(docs, decoded=True)
    same = F.col("decoded") == F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(MARK), F.lit(" "))
    return found.select("doc_id", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), same.alias("round_trip"))
