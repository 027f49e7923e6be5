"""A corpus pipeline: quality, line dedup, near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents``.

Defined cases, for every stage: null, empty and blank texts stay unless the stage
decides by text and says otherwise below; rows that repeat are rows of their own
until the join keeps one of each doc_id; rows without a doc_id pass the line stage
and the join unchanged; an empty table gives an empty result; other columns pass
with their rows, except those of a name that the stage's operator computes
(``score``, ``dropped``, ``size``, ``source_size``, ``target``, ``taken``, ``ids``,
``decoded``), which hold what it computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.storage import materialize
from tidebook.llm import jaccard, lines, mixing, pieces, quality
from tidebook.llm.tables import read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a text without trigrams gets
    the share of good ones among the labelled rows, so it stays if that is enough."""
    model = quality.fit(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly does go; documents stay
    unless nothing but blank lines is left of a text that had words."""
    found = lines.without_duplicates(docs)
    return found.where((F.col("dropped") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays, in one
    row; texts without words are linked with none and all stay."""
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents in as many copies as their source's target takes; texts
    without words have nothing to give to it and go."""
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its piece ids and what they decode to."""
    return pieces.encode(docs, decoded=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: The classifier and the segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
