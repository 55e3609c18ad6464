"""A pipeline over ``documents``: toxicity filter, exact dedup, near-duplicate
dedup, mixing to target weights, BPE encoding and decoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes what each stage returns as
Parquet to the shared folder and reads it as the next one's input.

Nulls, empty texts, repeated rows and empty tables are handled as the operators
say.  Repeated rows: exact dedup leaves one of them.  Ids may repeat: rows of one id are
told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohort_spark.llm import bpe, exact_dedup, minhash, mixing, toxicity
from cohort_spark.llm.common import read_table, written
from cohort_spark.session import apply_sql_settings, ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    apply_sql_settings(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on rows that are not held out, does
    not call toxic."""
    _ready(spark)
    model = toxicity.train(docs.where(~toxicity.held_out()), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=tuple(docs.columns)).where("__predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    _ready(spark)
    return exact_dedup.keep_winners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id."""
    _ready(spark)
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document stands once for each epoch that takes it."""
    _ready(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each row."""
    _ready(spark)
    return bpe.encode_decode(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near duplicates", drop_near_copies),
          ("mixing", mix_sources), ("BPE", encode)]

#: SQL cannot train the classifier or encode; tests/llm has a plain Python version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    _ready(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
