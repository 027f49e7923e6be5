"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every window of one, two and three characters of every text
whose language is known and which isn't in the held-out fifth: tasks count what
they read, Spark sums by language and slot. The smoothed log-probability matrix
(``DIMS`` slots x languages, so bounded by the label set) is broadcast; tasks look
the windows of a block of texts up in it, one language at a time, and sum by text.
Texts are lower-cased and taken in pieces of at most ``BLOCK`` characters, with
the characters that the last windows need, so memory doesn't follow a text's length.

Defined cases: a null text, or one without a letter (Unicode categories L*), is
``und`` with score 0; an equal posterior goes to the language first by code
point; without training rows everything is ``und``; rows that repeat are each
predicted and each teach; an empty table gives an empty result; other columns
pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import worker_imports
from tidebook.llm.tables import held_out, read

DIMS = 1 << 14
LONGEST = 3
BLOCK = 1 << 19
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x85EBCA6B)


def _pieces(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts as code points: (row, end, code) arrays, the first two by
    piece. A piece is followed by ``LONGEST`` - 1 more code points of its text or
    zeros, which start no window of their own."""
    more = LONGEST - 1
    rows, ends, codes, held = [], [], [], 0
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not text:
            continue
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(code), BLOCK):
            own = code[at : at + BLOCK]
            after = code[at + BLOCK : at + BLOCK + more]
            codes += [own, after, np.zeros(more - len(after), np.uint32)]
            held += len(own) + more
            rows.append(i)
            ends.append(held)
            if held >= BLOCK:
                yield np.array(rows), np.array(ends), np.concatenate(codes)
                rows, ends, codes, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(ends), np.concatenate(codes)


def _slots(ends: np.ndarray, codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each window length a slot for each place; places that start no window
    (the zeros, and what follows a piece) get slot DIMS, which counts for nothing."""
    starts = np.append(0, ends[:-1])
    own = np.zeros(len(codes) + 1, np.int8)
    np.add.at(own, starts, 1)
    np.add.at(own, ends - (LONGEST - 1), -1)
    own = np.cumsum(own[:-1]) > 0
    whole = codes.astype(np.uint32)
    for n in range(LONGEST):
        if n:
            after = np.zeros_like(codes)
            after[:-n] = codes[n:]
            whole = whole * _STEP + after
            own = own & (after > 0)
        mixed = (whole ^ (whole >> np.uint32(15))) * _MIX
        slot = (mixed ^ (mixed >> np.uint32(13))) & np.uint32(DIMS - 1)
        yield np.where(own, slot, DIMS).astype(np.int32)


def train(docs: DataFrame) -> dict | None:
    """Log probabilities from all rows with a known language."""
    worker_imports(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for pdf in batches:
            names, which = np.unique(pdf["lang"].to_numpy().astype(str), return_inverse=True)
            for name, n in zip(names, np.bincount(which, minlength=len(names)), strict=True):
                texts[name] = texts.get(name, 0) + int(n)
            for rows, ends, codes in _pieces(pdf["text"]):
                at = np.repeat(which[rows], np.diff(ends, prepend=0)) * (DIMS + 1)
                for slots in _slots(ends, codes):
                    both = np.bincount(slots + at, minlength=len(names) * (DIMS + 1)).reshape(len(names), -1)
                    for i in np.unique(which[rows]):
                        sums[names[i]] = sums.get(names[i], 0) + both[i, :DIMS]
        for name in texts:
            row = sums.get(name, np.zeros(DIMS, np.int64))
            slot = np.flatnonzero(row)
            yield pd.DataFrame({"lang": name, "slot": np.append(slot, -1), "n": np.append(row[slot], texts[name])})

    got = rows.select("text", "lang").mapInPandas(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    if got.empty:
        return None
    names = sorted(got["lang"].unique())
    table = np.zeros((len(names), DIMS + 1))
    table[got["lang"].map({x: i for i, x in enumerate(names)}), got["slot"]] = got["n"]  # slot -1 is the last column
    prior = np.log(table[:, DIMS] / table[:, DIMS].sum())
    grams = table[:, :DIMS] + 0.5
    logs = np.zeros((len(names), DIMS + 1))
    logs[:, :DIMS] = np.log(grams / grams.sum(1, keepdims=True))
    return {"names": names, "logs": logs, "prior": prior}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the posterior) added."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    spark = docs.sparkSession
    worker_imports(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        names = np.array(m["names"], object)
        for pdf in batches:
            total = np.tile(m["prior"], (len(pdf), 1))
            for rows, ends, codes in _pieces(pdf["text"]):
                starts = np.append(0, ends[:-1])
                for slots in _slots(ends, codes):
                    for i, logs in enumerate(m["logs"]):
                        np.add.at(total[:, i], rows, np.add.reduceat(logs[slots], starts))
            total -= total.max(1, keepdims=True, initial=-np.inf)
            share = np.exp(total)
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            has = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in pdf["text"]], bool)
            lang = np.where(has, names[best], "und")
            score = np.where(has, share[np.arange(len(best)), best], 0.0)
            yield pdf.assign(lang_pred=lang, score=score)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{fields}, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
