"""The training-data operators as queries of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import decontam, langid, mixing, pii, secretscan, simhash, substring, tiff, tokenpack, toolchat
from arborlake.llm.common import Scratch


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = decontam.build_index(docs, Scratch(spark, "op1"))
    return decontam.verdict(decontam.find(index, table(spark, sf_dir, "benchmark").select("item_id", "text")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text").withColumn("held_out", langid.held_out()), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.digest(simhash.deduplicate(docs, Scratch(spark, "op3", docs), ["doc_id"]))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secretscan.digest(secretscan.scan_twice(docs, Scratch(spark, "op4", docs)))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.deduplicate(docs, Scratch(spark, "op5", docs))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenpack.read_documents(tokenpack.write_blocks(docs, Scratch(spark, "op6"), tokenizer_path()))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, Scratch(spark, "op7")))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolchat.from_conversations(table(spark, sf_dir, "conversations"))
    return toolchat.link(calls, results, Scratch(spark, "op8"), duplicates=True)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op10_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tiff.media_digest(Scratch(spark, "op10").table(tiff.store_text(docs), "media"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_simhash_dedup, op4_secret_scan, op5_substring_dedup, op6_token_output, op7_pii, op8_tool_call_linking, op9_source_mixing, op10_tiff_media)}

ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontam.ORACLE, "op5_substring_dedup": substring.ORACLE, "op8_tool_call_linking": toolchat.ORACLE, "op9_source_mixing": mixing.ORACLE}
