"""The corpus pipeline: documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evigraph.llm.line_dedup import line_dedup
from evigraph.llm.mixing import mixed_documents
from evigraph.llm.ngram_join import one_of_each_group
from evigraph.llm.packing import pack_powers
from evigraph.llm.quality_net import keep_good, train
from evigraph.llm.shared import Workspace, dropped_after

#: Vocabulary of the packing stage; see pack_powers for which tokenizers fit.
TOKENIZER = "word_bpe_49k.json"
#: Bytes of parts that a packing worker remembers: executors still hold what earlier stages took.
REMEMBERED = 24 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half; the network learns from labels that are not held out."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents that lose all their lines."""
    return line_dedup(docs, k=1)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sources, as often as their target weights ask."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, each of one document."""
    return pack_powers(docs, public_tokenizers.path(TOKENIZER), remembered=REMEMBERED)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", dedup_lines), ("ngram_jaccard_join", dedup_documents), ("source_mixing", mix), ("packing", pack)]

#: No SQL for a network, a permuted mix or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back by the next."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        by = ["bucket"] if name == "packing" else []  # sequences of one length lie in one folder
        with dropped_after():  # the stage's own tables
            docs = work.written(stage(spark, docs, sf_dir), f"{k}-{name}", *by)
        if k:
            work.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
