"""Substring dedup, conversation repair and vector codes against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import codebooks, repair, repeats

# --- substring dedup


def plain_kept(docs, window):
    """{row: (words, kept words)} by a table of all windows."""
    words = [(t or "").encode().split() for _, t in docs]
    first = {}
    for (doc, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def passages(rng, n=60, window=12):
    """Documents that share passages of lengths about the window, cut and joined anew."""
    word = lambda: "w" + str(rng.randrange(4000))
    stock = [[word() for _ in range(rng.randrange(window - 3, 5 * window))] for _ in range(6)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.6:
                p = rng.choice(stock)
                a = rng.randrange(len(p))
                text += p[a : a + rng.randrange(2 * window)] if rng.random() < 0.5 else p
            text += [word() for _ in range(rng.randrange(window))]
        docs.append((i * 3 % n, rng.choice([" ", "\n", "\t \r"]).join(text)))
    return docs


ODD_TEXTS = [(None, "a b c d e f g h i j k l m n"), (None, None), (70, None), (71, ""), (72, " \n\x0b "), (73, "x " * 400), (74, "x " * 30), (75, "a b c d " * 20), (76, "a b c d " * 20), (76, "other words here " * 20), (76, "other words here " * 20), (77, "Other words here " * 20), (78, "other words here " * 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_plain_windows(spark, seed):
    docs = passages(random.Random(seed)) + ODD_TEXTS
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = repeats.without_repeats(df, window=12) if repeats.ANCHOR <= 12 else repeats.without_repeats(df, repeats.spans(df, 12, 6)[1], 12)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, r.text or "") for r in got.collect())
    assert got == sorted((d or -1, n, gone, kept) for d, n, gone, kept in plain_kept(docs, 12))
    assert sum(g[2] for g in got) > 100


def test_repeats_across_the_pieces_of_a_long_text(spark):
    rng = random.Random(4)
    word = lambda: f"{rng.randrange(10**7):x}"
    shared = [word() for _ in range(80)]
    long = [word() for _ in range(repeats.CHUNK + 4000)]
    for at in (17, repeats.CHUNK - 40, repeats.CHUNK + 1000):
        long[at : at + 80] = shared
    docs = [(2, " ".join(long)), (1, "before " + " ".join(shared) + " after"), (3, " ".join(long[100_000:100_060]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.without_repeats(df).collect()}
    assert got == {1: (82, 0), 2: (len(long), 240), 3: (60, 60)}


def test_paths_equal_plain_unitigs(spark):
    docs = passages(random.Random(7), 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found, _ = repeats.spans(df, 12, 6)
    named = repeats.paths(found).collect()
    got = sorted({r.path: r.path_windows for r in named}.values())
    where, walks = defaultdict(set), []
    for doc, text in docs:
        w = text.split()
        walk = [tuple(w[i : i + 12]) for i in range(len(w) - 11)]
        walks.append(walk)
        for k in walk:
            where[k].add(doc)
    edges = {k for k, d in where.items() if len(d) > 1}
    out, into = defaultdict(set), defaultdict(set)
    for walk in walks:
        for a, b in zip(walk[:-1], walk[1:], strict=True):
            if a in edges and b in edges:
                out[a].add(b)
                into[b].add(a)
    one = {a: next(iter(b)) for a, b in out.items() if len(b) == 1 and len(into[next(iter(b))]) == 1}
    lengths = []
    for k in edges - set(one.values()):
        n = 1
        while k in one:
            k, n = one[k], n + 1
        lengths.append(n)
    assert got == sorted(lengths) and len(lengths) > 5
    assert sum(r.windows for r in named) == len(edges)


def test_words_at_both_places_are_alike(spark):
    df = spark.createDataFrame(passages(random.Random(8)), "doc_id long, text string")
    found, later = repeats.spans(df, 12, 6)
    assert later.count() > 20 and repeats.unlike(df, later.where(F.col("n") < repeats.WHOLE), 12).isEmpty()
    moved = later.where(F.col("n") < repeats.WHOLE).withColumn("lp", F.col("lp") + 1)
    assert repeats.unlike(df, moved, 12).count() == moved.count()


def test_copies_that_share_a_bit_with_others_are_no_second_document(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BITS_EACH", 1)  # so that dozens of copies do
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(55)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    found, later = repeats.spans(df)
    assert found.isEmpty() and later.count() == 1500


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, n_words string")
    got = repeats.without_repeats(empty)
    assert got.count() == 0 and got.columns == ["doc_id", "text", "n_words", "n_removed"]


def test_repeats_beside_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a", 5), (2, text, "b", 6), (2, text, "c", 7)], "doc_id int, text string, row string, at int")
    got = sorted((r.doc_id, r.row, r.at, r.n_removed, r.text == text) for r in repeats.without_repeats(df).collect())
    assert got == [(1, "a", 5, 0, True), (2, "b", 6, 60, False), (2, "c", 7, 60, False)]


# --- conversation repair


def plain_repair(rows):
    """The contract for one conversation's (turn, role, text), by trying all ways row by row."""
    out = []
    for turn, role, text in rows["rows"]:
        die = zlib.crc32(f"{' ' if rows['conv'] is None else rows['conv']}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if die == 1 else "".join(c for c in text if c not in ".!?") if die == 2 else text
        role = "user" if die == 4 else role
        out += [(turn, role, text)] * (0 if die == 0 else 2 if die == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in out:
        tail = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not tail else 2 if (role, text) in seen else 3 if tail not in ".!?" else 0)
        seen.add((role, text))
    best = {"": (0, "", ())}
    names = {"u": "user", "a": "assistant"}

    def can(head, c):
        return (head + c) in ("s", "u") or (head != "" and (head[-1] + c) in ("su", "ua", "au"))

    def inserts(b):
        for _ in range(2):
            for head, (cost, audit, kept) in list(b.items()):
                for c in "ua":
                    if can(head, c):
                        new, v = (head + c)[-2:] if head[:1] != "s" or len(head) > 1 else head + c, (cost + 2, audit + "I", (*kept, f"{names[c]}:"))
                        new = new[-1:] if new != "s" else new
                        if new not in b or v[:2] < b[new][:2]:
                            b[new] = v
        return b

    for (_, role, text), fault in zip(out, faults, strict=True):
        new = {}
        for head, (cost, audit, kept) in inserts(best).items():
            ways = [(head, (cost + 3, audit + "D", kept))]
            if fault in (0, 3):
                ways += [(c, (cost + 2 + (fault == 3), audit + "R", (*kept, f"{names[c]}:{text}"))) for c in "ua" if can(head, c)]
                if role[:1] and role[:1] in "sua" and can(head, role[0]):
                    ways.append((role[0], (cost + (fault == 3), audit + "K", (*kept, f"{role}:{text}"))))
            for h, v in ways:
                if h not in new or v[:2] < new[h][:2]:
                    new[h] = v
        best = new
    best = inserts(best)
    cost, audit, kept = min(best[h] for h in ("", "a") if h in best)
    turns = [t for t, _, _ in out if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(out[:-1], out[1:], strict=True)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def conversations(rng, n, longest):
    out = []
    for conv in [None, *range(n)]:
        size = rng.randrange(1, longest)
        texts = ["Yes.", "no", "", " \n", "Why? ", "Ünïcode!\x0b", None, "a.b"]
        turns = [rng.choice([None, t, t, t, t, t // 2 * 2, -t]) for t in range(size)]
        out += [(conv, t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, "", "User"]), f"{rng.choice(texts[:3])}{t}." if rng.random() < 0.6 else rng.choice(texts)) for t in turns]
    return out


@pytest.mark.parametrize(("seed", "longest"), [(1, 14), (2, 14), (3, 160)])
def test_repair_equals_trying_all_ways(spark, seed, longest):
    rows = conversations(random.Random(seed), 60 if longest < 100 else 12, longest)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, n int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.faulty(df)).collect()}
    for conv in {r[0] for r in rows}:
        assert got.pop(conv) == plain_repair({"conv": conv, "rows": [r[1:] for r in rows if r[0] == conv]}), conv
    assert not got


def test_search_proves_its_incumbent():
    rng = random.Random(11)
    for _ in range(200):
        codes = bytes(repair.code(rng.choice([0, 1, 2, 2, 3, 3]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(6)))
        ways = {}

        def all_ways(i, state, cost, audit, left, codes=codes, ways=ways):
            if i == len(codes) and state in repair.DONE:
                ways[audit] = cost
            if left:
                all_ways(i, repair.NEXT[state], cost + 2, audit + "I", left - 1)
            if i < len(codes):
                turn, fault = divmod(codes[i], 4)
                all_ways(i + 1, state, cost + 3, audit + "D", left)
                if fault in (0, 3):
                    all_ways(i + 1, repair.NEXT[state], cost + 2 + (fault == 3), audit + "R", left)
                    if turn and (turn == repair.NEXT[state] or (turn, state) == (repair.SYSTEM, repair.START)):
                        all_ways(i + 1, turn, cost + (fault == 3), audit + "K", left)

        all_ways(0, 0, 0, "", 4)
        assert repair.search(codes)[:2] == min((c, a) for a, c in ways.items())


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, t, ("user", "assistant", "user")[t % 3], f"said {t}.") for t in range(6000)] + [(c, 0, "user", "hi.") for c in range(2, 30)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.faulty(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert len(got) == 29 and got[1][6].count("K") > 3000
    assert got[1] == plain_repair({"conv": 1, "rows": [r[1:] for r in rows if r[0] == 1]})


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert repair.repair(repair.faulty(df)).count() == 0


# --- vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    x = {i: [int(np.floor(1024 * float(v))) for v in vec] for i, vec in rows}
    ids = sorted(x)
    dims = len(x[ids[0]])
    cuts = [(j * dims // parts, (j + 1) * dims // parts) for j in range(parts)]
    books = [[x[i][a:b] for i in ids[:entries]] for a, b in cuts]
    near = lambda v, book: min((sum((p - q) ** 2 for p, q in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for (a, b), book in zip(cuts, books, strict=True):
            own = defaultdict(list)
            for i in ids:
                own[near(x[i][a:b], book)[1]].append(x[i][a:b])
            for k, vs in own.items():
                book[k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = {i: [near(x[i][a:b], book) for (a, b), book in zip(cuts, books, strict=True)] for i in ids}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, books


def vectors(kind):
    rng = np.random.default_rng(3)
    if kind == "even":
        return rng.standard_normal((400, 8)) / 3
    if kind == "ties":  # a grid, so that many entries are equally far
        return rng.integers(-2, 3, (400, 8)) / 4
    if kind == "few":
        return rng.standard_normal((20, 10))
    return rng.standard_normal((60, 8)) * 10.0 ** rng.integers(0, 13, (60, 1))


@pytest.mark.parametrize("kind", ["even", "ties", "few", "huge"])
def test_codes_equal_plain_search(spark, kind):
    x = vectors(kind)
    rows = [(int(i), v.tolist()) for i, v in zip(np.random.default_rng(1).permutation(len(x)) * 2, x, strict=True)]
    bad = [(1, None), (3, []), (5, [0.1] * (x.shape[1] - 1) + [None]), (7, [float("nan")] * x.shape[1]), (9, [float("inf")] * x.shape[1]), (11, [0.5] * (x.shape[1] + 4))]
    df = spark.createDataFrame([(i, v, i % 3 or None, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    coded, books = codebooks.compress(df)
    want, plain = plain_codes(rows)
    got = {r.vec_id: (bytes(r.code).hex(), r.error) for r in coded.collect()}
    assert [[list(map(int, e)) for e in b] for b in books] == plain
    assert got == {i: (c, min(e, 2**63 - 1)) for i, (c, e) in want.items()}
    one = rows[0]
    away = codebooks.decode(bytes.fromhex(got[one[0]][0]), books) - np.array(one[1])
    assert kind == "huge" or (1024 * away) @ (1024 * away) <= 1.1 * got[one[0]][1] + 64 * len(away)


def test_orchard_measures_fewer_entries_in_clusters():
    rng = np.random.default_rng(6)
    centres = rng.integers(-40_000, 40_000, (256, 16)).astype(float)
    x = centres[rng.integers(0, 256, 3000)] + rng.integers(-90, 90, (3000, 16))
    found = codebooks.Entries(centres)
    measured, true = 0, codebooks._squared

    def counted(d):
        nonlocal measured
        measured += d.size // 16 if d.ndim == 2 else 0
        return true(d)

    codebooks._squared = counted
    try:
        at, gap = found.nearest(x)
    finally:
        codebooks._squared = true
    every = ((x[:, None] - centres) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (gap == every.min(1)).all()
    assert measured < 3000 * 128


def test_equal_vec_ids_and_nulls(spark):
    rows = [(None, [0.25] * 4, 1), (None, [0.5] * 4, 1), (4, [1.0] * 4, None), (4, [0.75] * 4, None), (4, [0.75] * 4, None)]
    coded, books = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert coded.count() == 5 and all(len(b) == 2 for b in books)


def test_codes_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codebooks.op13_codebooks(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
