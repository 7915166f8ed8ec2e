"""Corpus cleaning pipeline: language, quality, repeated lines, near-duplicates, packing.

``run`` applies ``STAGES`` in order to ``documents``.  Each stage works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.  Null, empty and repeated
rows are handled as the operators' docstrings say; an empty table passes through every stage.
The stages lower the session's Arrow batches to ``BATCH_ROWS`` rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.llm import langid, line_dedup, packing, quality, simhash
from corelode.llm.common import ship, small_batches, table, written

#: A document goes if its language is undetermined or its mean word posterior is below this.
LEAST_LANGUAGE_SCORE = 0.4
#: Rows of the session's Arrow batches: workers and executors keep what a large batch took, while later stages run.
BATCH_ROWS = 1000


def _start(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark, BATCH_ROWS)


def _judged(docs: DataFrame, judge) -> DataFrame:
    """``judge`` on rows that carry all columns of ``docs`` along, so that no join by id is needed."""
    carried = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), *docs.columns)
    return judge(carried)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null texts and texts without letters go."""
    _start(spark)
    model = langid.fit(docs)
    found = _judged(docs, lambda d: langid.predict(d, model, id_col="__row", inside=True))
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(kept).select("__row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that are not toxic."""
    _start(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = _judged(docs, lambda d: quality.score(d, model, id_col="__row", inside=True))
    return found.where("kept").select("__row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are near-duplicates of earlier ones; n_chars follows the text."""
    _start(spark)
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by SimHash fingerprints (three-word shingles, 3 bits)."""
    _start(spark)
    return simhash.keep_one(docs, groups=simhash.near_duplicates(docs)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that stayed, packed into sequences."""
    _start(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Models and BPE cannot be put in SQL; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
