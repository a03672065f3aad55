"""A training corpus from ``documents`` in five stages.

Language ID (documents in no known language go), SimHash near-dedup (one
document of each group stays), benchmark decontamination (contaminated documents
go), mixing of sources to target weights (copies by Poisson replication), and
token-ID output. Each stage takes all rows that its predecessor kept, and all
but the last return the columns of ``documents``, further columns included.

Null, empty and letterless texts are in no language and go in the first stage. A
row is named by its id and text (128 bits), so rows without an id and rows that
share one are told apart; repeated rows and other ties leave one row of a group in
the second. Texts of any length are taken whole. Empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import decontam, langid, mixing, simhash, tokenpack
from arborlake.llm.common import Scratch, row_key
from arborlake.llm.queries import table, tokenizer_path

#: A document whose best language scores less than this is rejected, as is one without a letter.
LEAST_SCORE = 0.4
#: Names a row of a stage's input by its id and text, whatever repeats.
ROW = "__pipeline_row"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language that the model, learnt from this stage's input, knows."""
    found = langid.predict(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of linked fingerprints, one row of it."""
    rows = docs.withColumn(ROW, row_key())
    found = simhash.deduplicate(rows, Scratch(spark, "pipeline-dedup"), ["doc_id", ROW])
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).dropDuplicates(["component"]).select(ROW)
    return rows.join(kept, ROW, "left_semi").dropDuplicates([ROW]).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold benchmark passages by the contamination rule."""
    rows = docs.withColumn(ROW, row_key())
    index = decontam.build_index(rows, Scratch(spark, "pipeline-index"), ROW)
    found = decontam.verdict(decontam.find(index, table(spark, sf_dir, "benchmark").select("item_id", "text")))
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(ROW)), ROW, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources have their target weights, in global hash order."""
    return mixing.replicate(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the packed token ids, and reads each document's place and checksum back."""
    return tokenpack.read_documents(tokenpack.write_blocks(docs.select("doc_id", "text"), Scratch(spark, "pipeline-tokens"), tokenizer_path()))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("token_output", token_output)]

#: Language ID can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
