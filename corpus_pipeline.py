"""From raw documents to packed training sequences: quality rules, near duplicates, repeated passages, packing.

Each stage works on what the one before it left, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callgrain.llm import minhash, packing, rules, suffix
from callgrain.llm.common import shared_folder, table
from callgrain.ship import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled level of their language keep.

    Null and empty texts have no words, so the base rule rejects them. A null id or language is one like any other; rows that repeat
    an id and a text are judged alike. Texts are read whole. An empty table stays empty. All columns pass, whatever their names.
    """
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Null and empty texts, texts without words and rows with a null id are in no group and stay; of rows that repeat id and text
    one stays. Texts are compared whole. An empty table stays empty. All columns pass, whatever their names.
    """
    return minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the letters that lie in byte strings of 200 found more than once. Emptied documents stay, empty.

    Null texts become empty. Rows that repeat a text of 200 bytes or more all lose it. Texts are read whole. An empty table stays empty. All columns
    pass, whatever their names.
    """
    return suffix.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids.

    A null or empty text is one piece with its end alone; rows that repeat an id are packed each by itself; a long text is cut
    into full windows first. An empty table gives an empty result. Other columns are not carried.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: SQL can't tokenise; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
