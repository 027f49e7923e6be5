"""Each stage on its own input, held against a plain version."""

import corpus_pipeline
import pytest
from test_llm_operators import brute_components, brute_lines, split

from tidebook.llm import mixing, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        out.append(docs)
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns == [*stages[0].columns, "ids", "decoded"]


def test_quality_drops_low_scores_only(spark, sf_dir, stages):
    model = quality.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(stages[0], model)
    assert texts(stages[1]) == texts(scored.where(f"score >= {quality.THRESHOLD}"))


def test_lines(stages):
    expected = brute_lines(texts(stages[1]))
    before = dict(texts(stages[1]))
    assert texts(stages[2]) == sorted((i, t) for i, t in expected if split(t) or not split(before[i]) or t == before[i])


def test_near_duplicates(stages):
    found = brute_components(texts(stages[2]))
    assert [i for i, _ in texts(stages[3])] == [i for i in sorted(found) if found[i][1] == i]


def test_mix(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix(stages[3]).collect() if r.taken}
    found: dict = {}
    for i, t in texts(stages[4]):
        found[i] = found.get(i, 0) + len(split(t))
    assert found == taken


def test_encoding(stages):
    assert all(r.text == r.decoded for r in stages[5].collect())


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[5].count()


ODD = [
    (1, None, "en", "a", None, 0.5, 7, "x", [1]),
    (2, "", None, None, 0, None, None, None, None),
    (3, "the same words come here again and again", "en", "b", 40, 1.0, 1, "y", []),
    (3, "the same words come here again and again", "en", "b", 40, 1.0, 1, "y", []),
    (3, "another text under the same id, of other words", "en", "b", 46, 1.0, 1, "y", []),
    (4, "the same words come here again and again", "fr", "c", 40, 1.0, 1, "y", []),
    (5, "many words " * 20_000, "fr", "c", 220_000, 1.0, 1, "y", []),
    (None, "a text without an id\nin two lines", "de", "a", 33, 1.0, 1, "y", []),
]


@pytest.mark.parametrize("place", range(5))
def test_stages_take_odd_rows_and_clashing_columns(spark, sf_dir, place):
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, dropped string, ids array<int>"
    docs = spark.createDataFrame(ODD, columns)
    _, stage = corpus_pipeline.STAGES[place]
    for some in (docs, docs.limit(0)):
        out = stage(spark, some, sf_dir)
        assert set(out.columns) - {"decoded"} == set(docs.columns)
        rows = out.collect()
        assert not rows if some is not docs else len(rows) <= 3 * len(ODD)
    if place == 1:
        assert len(rows) == 0 and {r.text for r in stage(spark, docs, sf_dir).collect()} >= {None, ""}
    if place == 2:
        kept = sorted(r.doc_id or 0 for r in stage(spark, docs, sf_dir).collect())
        assert kept == [0, 1, 2, 3, 5]
    if place == 4:
        assert all((r.text or "") == r.decoded for r in stage(spark, docs, sf_dir).collect())
