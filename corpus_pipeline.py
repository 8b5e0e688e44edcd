"""A corpus pipeline of five stages: language, near copies, personal data, mixing, packing.

Each stage takes the documents that the one before left (as a table that was written and read again) and
calls one operator on all of them.  Documents whose language is rejected go; one document of each group of
near copies stays; personal data is masked; documents are repeated or left out so that sources come near
their target weights; what remains is packed into sequences of power-of-two lengths.

Null and letterless texts go with the first stage (all of them, and nothing else, where no row has a language to
learn from).  Null doc_ids are linked with nothing and stay; of repeated rows of one doc_id one stays; a null source
is a source; other columns, whatever their names, are carried along up to the last stage; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaitprint.llm import language, mixing, near_copies, packing, personal_data
from gaitprint.llm.common import drop_tables, ship_package, stage_table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject."""
    ship_package(spark)
    return language.keep_identified(docs, language.fit(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return near_copies.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return personal_data.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return mixing.copy_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    ship_package(spark)
    return packing.packed_digest(packing.pack(docs))


STAGES = [
    ("language", by_language),
    ("near copies", without_near_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]
#: Training, hashing of word runs and tokenizing aren't SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop_tables(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
