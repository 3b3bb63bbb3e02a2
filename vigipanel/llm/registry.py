"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigipanel.llm import (
    bpe,
    decontaminate,
    embedding_dedup,
    filter_audit,
    hard_negatives,
    html_text,
    licenses,
    line_templates,
    minhash,
    multi_index,
    secrets,
    token_files,
    toxicity,
)
from vigipanel.llm.common import table
from vigipanel.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(work: Callable[[SparkSession, str], DataFrame]):
    QUERIES[work.__name__] = work
    return work


@query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = table(spark, sf, "documents")
    token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.summary(
        decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    )


@query
def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(tokens, ranks))


@query
def op2_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), size=3, percent=85)


@query
def op5_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit_on_labels(docs, table(spark, sf, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op10_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.summary(secrets.find_secrets(table(spark, sf, "documents")))


@query
def op1_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


ORACLES["op1_licenses"] = licenses.oracle_sql()


@query
def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_templates.drop_recurring(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_dropped", "text")


@query
def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    cells = filter_audit.document_cells(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return filter_audit.audit(cells)


ORACLES["op11_filter_audit"] = filter_audit.oracle_sql()


@query
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query
def op13_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)
