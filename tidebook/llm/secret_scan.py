"""Secret scans: fixed patterns, and strings that resist compression.

Three patterns give the base spans. The novelty pass then looks at strings of
``MIN_NOVEL`` or more value characters that start within ``CONTEXT`` characters
after a sensitive word, letters only or not. It compresses the surrounding text
with and without the candidate, by a Zstandard compressor primed with a
dictionary: the marginal compressed bytes for each character tell how new the
string is. The dictionary holds a short list of identifiers and what the corpus
itself says near sensitive words: the parts of identifiers and words, of
``PART_LETTERS`` letters, that stand near one in at least ``MIN_ROWS`` different
surroundings, counted over all rows; the ``LEARNED`` most frequent are kept. What
stands inside a string that is itself long enough to be measured is never learned,
so a key is found in any number of copies if it is found in one, and copies of a
document count once.
Names and paths made of known parts cost little; random keys cost nearly what
random characters must. Those above ``MIN_BYTES`` are reported as ``novel``.
Base spans stay as they are; a novel span that meets one is left out.

Defined cases: other columns are ignored; a null text is empty and has no spans; spans are counted in code
points with the end exclusive; rows that repeat are each scanned; a text of any
length is scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import worker_imports
from tidebook.llm.grams import blocks, joined
from tidebook.llm.tables import read

KINDS = ("assign", "access", "hex", "novel")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_NOVEL = 6, 20, 24, 16
CONTEXT = 64
MIN_BYTES = 0.62
PART_LETTERS = (5, 14)
MIN_ROWS = 5
LEARNED = 1000
#: Words that make what follows them sensitive.
SENSITIVE = "password passwd secret token api_key apikey credential private_key auth bearer access_key signature session".split()
#: What code and configuration say often; the compressor knows these strings.
IDENTIFIERS = " ".join(SENSITIVE) + " username client_id client_secret authorization content_type application/json https://www. http://localhost .com/ .org/ index.html function return string integer boolean default config settings environment production development example placeholder your_ changeme undefined null true false public static class import export const let var self this value key name user admin root database connection timeout version request response header data file path url uri id uuid abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
#: Parts of long words and names, so that those made of letters only cost little too.
PARTS = "Authentication Authorization Administration Organization Application Configuration Implementation Initialization Serialization Synchronization Transformation Communication Representation Specification Notification Verification Identification Management Manager Provider Filter Factory Abstract Bean Service Controller Repository Handler Listener Exception Interface Context Component Builder Adapter Processor Generator Validator Resource Credentials Username Password Token Session Access Secret Private Public Refresh Signature Encryption Certificate Internal External Invalid Missing Required Expired Available Allowed Denied Permission Security Connection Transaction Database Environment Development Production international nationalization nationality constitutionally constitutionnellement characteristically responsibilities telecommunications counterrevolutionary revolutionary misunderstanding understanding straightforwardness extraordinarily disproportionately proportionate administratively interdisciplinary electromagnetic environmental industrialization institutionalization experimentation differentiation recommendations circumstances unprecedented nevertheless notwithstanding incomprehensible indistinguishable unconditionally philosophical psychological technological geographical pharmaceutical manufacturing entrepreneurship acknowledgement accomplishment establishment entertainment correspondence superintendent transcontinental Datenschutz grundverordnung schutz verordnung Geschwindigkeit Gesellschaft wissenschaftlich Sicherheit Verantwortung Veranstaltung responsabilidad administrativo internacional extraordinario particularmente anti inter trans over under counter micro multi ability ization isation ational ically fulness lessness iveness ousness ement mente keit heit ungen lichkeit "

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")
_NOVEL = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_NOVEL},}}")
_VALUE, _OTHER = re.compile(r"[A-Za-z0-9+/_.=-]"), re.compile(r"[^A-Za-z0-9+/_.=-]")
_HINT = re.compile("(?ai:" + "|".join(SENSITIVE) + ")")
#: Runs of letters, cut where a capital follows a small letter.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def base_spans(text: str, lower: str, hexes: bool) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three fixed patterns."""
    found = []
    if "passw" in lower or "secret" in lower or "token" in lower or "key" in lower:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def parts_near(text: str) -> list[tuple[str, set[str]]]:
    """Each stretch of text around sensitive words with the parts of words in it,
    those inside measured strings left out."""
    low, high = PART_LETTERS
    out, done = [], 0
    for hint in _HINT.finditer(text):
        if hint.end() + CONTEXT > done:
            a = max(0, done, hint.start() - 4 * CONTEXT)
            done = hint.end() + 5 * CONTEXT
            # a string that the stretch cuts is taken as long as it is
            long = [m.span() for m in _NOVEL.finditer(text, _run_start(text, a), _run_end(text, done))]
            said, at = set(), a
            for start, end in [*long, (done, done)]:
                said.update(p for p in _PART.findall(text[at : max(at, start)]) if low <= len(p) <= high)
                at = max(at, end)
            out.append((text[a:done], said))
    return out


def _run_start(text: str, at: int) -> int:
    while at > 0 and _VALUE.match(text, at - 1):
        at -= 1
    return at


def _run_end(text: str, at: int) -> int:
    found = _OTHER.search(text, at)
    return found.start() if found else len(text)


def learn(docs: DataFrame) -> str:
    """The parts of words that stand near sensitive words in most surroundings,
    rarer ones first. The driver gets ``LEARNED`` of them."""
    worker_imports(docs.sparkSession)

    def near(batches):
        for pdf in batches:
            found = set()
            for text in pdf["text"]:
                if isinstance(text, str) and any(w in text.lower() for w in SENSITIVE):
                    for around, parts in parts_near(text):
                        key = hashlib.blake2b(around.encode("utf-8", "replace"), digest_size=16).digest()
                        found.update((p, key) for p in parts)
            yield pd.DataFrame(sorted(found), columns=["part", "around"]).astype("object")

    counted = docs.select("text").mapInPandas(near, "part string, around binary").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    kept = counted.where(F.col("n") >= MIN_ROWS).orderBy(F.desc("n"), "part").limit(LEARNED)
    return " ".join(r.part for r in kept.collect()[::-1])


def packer(learned: str = "") -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict((learned + " " + PARTS + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False)


def novelty(candidate: str, context: str, zip_: zstandard.ZstdCompressor) -> float:
    """Marginal compressed bytes for each character of the candidate."""
    around = context.encode("utf-8", "replace")
    return (len(zip_.compress(around + candidate.encode())) - len(zip_.compress(around))) / max(1, len(candidate))


def novel_spans(text: str, lower: str, base: list[tuple[int, int, int]], zip_) -> list[tuple[int, int, int]]:
    if not any(w in lower for w in SENSITIVE):
        return []
    found, done = [], 0
    # base spans are by start; the furthest end of those before tells whether one is met
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for hint in _HINT.finditer(text):
        for m in _NOVEL.finditer(text, max(hint.end(), done), min(len(text), hint.end() + CONTEXT + MIN_NOVEL - 1)):
            a, b = _NOVEL.match(text, m.start()).span()
            if a < done:
                continue
            done = b
            before = bisect_left(starts, b)
            if before and ends[before - 1] > a:
                continue
            around = text[max(0, a - 4 * CONTEXT) : a] + text[b : b + 4 * CONTEXT]
            if novelty(text[a:b], around, zip_) >= MIN_BYTES:
                found.append((a, 3, b))
    return found


def _with_long_hex(texts) -> np.ndarray:
    """Which texts hold a run of MIN_HEX or more hex digits."""
    out = np.zeros(len(texts), bool)
    for a, b, part in blocks(texts):
        data, starts = joined(part)
        other = np.flatnonzero(~_IS_HEX[data])
        long = other[np.flatnonzero(np.diff(other, prepend=-1) > MIN_HEX)]
        out[a + np.searchsorted(starts, long, side="right") - 1] = True
    return out


def scan(docs: DataFrame, learned: str | None = None) -> DataFrame:
    """doc_id and the list of (kind, start, end) of each text, by start.
    ``learned`` is the corpus's dictionary (None: it is counted from ``docs``)."""
    worker_imports(docs.sparkSession)
    words = learn(docs) if learned is None else learned

    def run(batches):
        zip_ = packer(words)
        for pdf in batches:
            rows = []
            for text, hexes in zip(pdf["text"], _with_long_hex(pdf["text"]), strict=True):
                text = text if isinstance(text, str) else ""
                lower = text.lower() if not text.isascii() else text.casefold()
                base = base_spans(text, lower, hexes)
                spans = sorted(base + novel_spans(text, lower, base, zip_))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": rows})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))

    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
