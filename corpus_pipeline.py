"""A corpus pipeline of five stages, each written as Parquet into the shared folder and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import stored, table
from pulsegrid.llm.decontam import decontaminate
from pulsegrid.llm.idstore import token_files
from pulsegrid.llm.jaccard import keep_one
from pulsegrid.llm.mixing import mixed_documents
from pulsegrid.llm.quality import keep_good
from pulsegrid.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trained model reject go (so do those without a text)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights: documents repeat, are cut or go; ids repeat with them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token-id files and returns, read back from them, doc_id, start, n_tokens and ids_crc32."""
    return token_files(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: Trained models and tokenizers are beyond SQL; tests compare the operators with plain versions, not yet the composed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
