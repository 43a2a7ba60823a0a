"""From raw documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is
written as Parquet in the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessel.llm.common import delete, read_table, released, shared_dir
from tessel.llm.exact_dedup import deduplicated
from tessel.llm.mixing import mixed
from tessel.llm.near_dedup import without_near_duplicates
from tessel.llm.packing import pack, stored_order
from tessel.llm.quality_crf import accepted, trained


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts; it learns from the labels of this very input."""
    return accepted(docs, trained(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return deduplicated(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest doc_id."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens, in the training order that the files of docs hold."""
    return pack(docs, order=stored_order(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the packer learn and search; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; only the last stage's table stays in the shared folder.

    Defined cases: a null text counts as empty (quality scores it like any other);
    null and repeated ids are documents of their own, told apart by their rows;
    equal texts become one document; documents without words have no place in the
    mix; extra columns travel along, whatever their names; an empty table gives an
    empty result.
    """
    docs = read_table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            delete(spark, f"{at}/{i - 1}")
    return docs
