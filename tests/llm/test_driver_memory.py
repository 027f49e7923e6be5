"""What the driver's Python holds for the pipeline's stages."""

import tracemalloc

from tidebook.llm import pieces, quality


def test_fit_holds_no_matrix_of_all_sampled_rows(spark):
    docs = spark.createDataFrame([(i, f"some words {i * i} of document {i} and {i % 7}") for i in range(2500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    rows = labels.where(~quality.held_out()).count()
    quality.fit(docs, labels)  # imports and first calls
    tracemalloc.start()
    model = quality.fit(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model["labels"].shape == (rows,)
    assert peak < 0.8 * rows * quality.DIMS * 4


def test_encoding_loads_no_vocabulary_on_the_driver(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "a longer text " * 4000)], "doc_id long, text string")
    pieces.vocabulary.cache_clear()
    found = pieces.encode(docs, decoded=True).select("doc_id", "decoded").collect()
    assert pieces.vocabulary.cache_info().currsize == 0
    assert {r.doc_id: r.decoded for r in found} == {1: "short", 2: "a longer text " * 4000}
    assert pieces.longest_piece() == pieces.vocabulary().reach
