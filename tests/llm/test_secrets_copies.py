"""Keys in copies, and the marginal bytes recomputed plainly."""

import numpy as np
import pytest
import zstandard

from tidebook.llm import secret_scan

CONSONANTS = "bcdfghjklmnpqrstvwxz"
ALPHABETS = {
    "runs": None,  # two runs of 14 consonants joined by a digit
    "mixed": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
}


def keys(kind, n, rng):
    if kind == "runs":
        word = lambda: "".join(rng.choice(list(CONSONANTS), 14))
        return [f"{word()}{rng.integers(10)}{word()}" for _ in range(n)]
    return ["".join(rng.choice(list(ALPHABETS[kind]), 28)) for _ in range(n)]


@pytest.mark.parametrize("kind", list(ALPHABETS))
def test_copies_hide_no_key(spark, kind):
    some = keys(kind, 5, np.random.default_rng(5))
    for copies in (1, 300):
        rows = [(i * 1000 + c, f"the bearer header of host {i} is {k} here") for i, k in enumerate(some) for c in range(copies)]
        # copies in other surroundings too
        rows += [(i * 1000 + 500 + c, f"row {c} says auth {k}, {c * c}") for i, k in enumerate(some) for c in range(copies if copies > 1 else 0)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(df).collect()}
        for doc, text in rows:
            at = text.index(some[doc // 1000])
            assert got[doc] == [("novel", at, at + len(some[doc // 1000]))], text


VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def plain_novel(text, base, zip_):
    lower, done, out = text.lower(), 0, []
    for at in range(len(text)):
        for word in secret_scan.SENSITIVE:
            # the first of the words that stands here, none inside another
            if lower.startswith(word, at) and len(lower) == len(text) and not any(lower.startswith(w, s) and s < at < s + len(w) for s in range(max(0, at - 16), at) for w in secret_scan.SENSITIVE):
                h = at + len(word)
                q = max(h, done)
                while q < h + 64:
                    e = q
                    while e < len(text) and text[e] in VALUE:
                        e += 1
                    if e - q >= 16:
                        done = e
                        if not any(s < e and q < x for s, _, x in base):
                            around = (text[max(0, q - 256) : q] + text[e : e + 256]).encode()
                            more = len(zip_.compress(around + text[q:e].encode())) - len(zip_.compress(around))
                            if more / (e - q) >= secret_scan.MIN_BYTES:
                                out.append((q, e))
                    q = max(e, q + 1)
                break
    return out


def test_marginal_bytes_plainly(spark, sf_dir):
    rng = np.random.default_rng(9)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    told = [k for kind in ALPHABETS for k in keys(kind, 8, rng)] + ["QuotationLedgerEntryManager", "application/json-content-type", "a" * 40, "0123456789" * 3]
    docs += [(10_000 + i, f"some code\nheader: session {k} and more {i}") for i, k in enumerate(told)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    learned = secret_scan.learn(df)
    zip_ = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict((learned + " " + secret_scan.PARTS + secret_scan.IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
    found = {r.doc_id: r.spans for r in secret_scan.scan(df, learned).collect()}
    novel = 0
    for doc, text in docs:
        base = [(s.start, s.kind, s.end) for s in found[doc] if s.kind != "novel"]
        got = [(s.start, s.end) for s in found[doc] if s.kind == "novel"]
        assert got == plain_novel(text or "", base, zip_), text
        novel += len(got)
    assert novel >= 30


def test_many_secrets_in_one_text(spark):
    text = "\n".join(f"password = value{i:06d} and auth k{i % 7}" for i in range(20_000))
    got = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(got.spans) == 20_000 and {s.kind for s in got.spans} == {"assign"}
