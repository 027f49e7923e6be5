"""Columns of the caller that have the names operators use inside."""

import re
from pathlib import Path

import pytest

from tidebook.llm import jaccard, language, lines, mixing, pieces, quality, repeats

HOME = Path(lines.__file__).parent
TEXTS = ["one two three four five six seven\nmore words on a line here", "one two three four five six seven\nmore words on a line here", "other text with nine words in it you know", None, "", "word " * 9000]


def inner_names():
    """Every name that the stages' modules give to a column, by their sources."""
    found = set()
    for name in ("lines", "pieces", "jaccard", "mixing", "quality", "repeats", "tables"):
        source = (HOME / f"{name}.py").read_text()
        found |= set(re.findall(r"\b_[a-z][a-z0-9_]*\b", " ".join(re.findall(r'"([^"\n]*)"', source))))
        found |= {x for pair in re.findall(r'\.alias\("([a-z_0-9]+)"\)|withColumn\("([a-z_0-9]+)"', source) for x in pair if x}
    computed = {"score", "dropped", "size", "source_size", "target", "taken", "ids", "decoded", "n_words", "n_removed"}
    return sorted(found - computed - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="module")
def clashing(spark):
    names = inner_names() + ["c0", "c1", "odd.name", "tick`ed"]
    base = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS, 1)]
    rows = [r + tuple(f"{n}:{r[0]}" for n in names) for r in base]
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    return names, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in quoted))


@pytest.mark.parametrize("stage", ["lines", "pieces", "long pieces", "jaccard", "mix", "mixed rows", "quality", "repeats"])
def test_columns_of_inner_names_come_back(spark, clashing, stage):
    names, docs = clashing
    assert {"_row", "_gone", "_rows", "_key", "_bucket", "_whole", "_s"} <= set(names)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    run = {
        "lines": lambda: lines.without_duplicates(docs),
        "pieces": lambda: pieces.encode(docs, decoded=True),
        "long pieces": lambda: pieces.encode(docs, chunk=4096, decoded=True),
        "jaccard": lambda: jaccard.one_of_each(docs),
        "mix": lambda: mixing.mix(docs),
        "mixed rows": lambda: mixing.mixed_rows(docs),
        "quality": lambda: quality.score(docs, quality.fit(docs, labels)),
        "repeats": lambda: repeats.without_repeats(docs),
    }[stage]
    got = run()
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert len(rows) >= (2 if stage in ("jaccard", "mixed rows") else len(TEXTS))
    for r in rows:
        assert [r[n] for n in names] == [f"{n}:{r.doc_id}" for n in names]


def test_language_beside_its_own_column(spark):
    docs = spark.createDataFrame([(i, "words of a language", "en", "x", 0.5) for i in range(12)], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.predict(docs, language.train(docs)).collect()
    assert len(got) == 12 and {r.lang_pred for r in got} == {"en"}
