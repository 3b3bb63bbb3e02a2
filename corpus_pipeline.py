"""The training-data pipeline: stages over `documents`, each written and read again.

Every stage takes what its predecessor kept and, but for the last, returns the columns of
`documents`; n_chars follows the text.  An empty table passes every stage; null and empty texts
are kept by all but near-dedup, where equal texts without words stay as different documents;
repeated rows are treated alike, and near-dedup leaves one of them.  Columns beside those of
`documents` pass on whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigipanel.llm import bpe, decontaminate, line_templates, minhash, toxicity
from vigipanel.llm.common import set_aside, table
from vigipanel.session import materialise, scratch_path


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores as toxic go; its weights come from the labels."""
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.accept(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages go from every document; so does a document that was nothing else."""
    apart, back = set_aside(docs, "text")
    cleaned = line_templates.drop_recurring(apart)
    kept = cleaned.where("n_dropped = 0 or length(trim(text)) > 0")
    return _with_length(kept.withColumnsRenamed(back).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words, similarity 0.8."""
    return minhash.one_of_each(docs, size=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is mostly such passages goes."""
    return _with_length(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the bytes decoded from them.

    Ids are stored before they are decoded: in one job each task would hold a worker that encodes
    and one that decodes, both with all that workers keep between tasks.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = materialise(bpe.encode(docs, ranks, public_tokenizers.PATTERN))
    return bpe.digests(bpe.decode(tokens, ranks))


STAGES = [
    ("toxicity", toxic_documents),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

# Learned scores, similarity of sets and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
