"""A corpus pipeline of five operators: quality rules, toxicity, near-duplicates, source mixing and packing.

Each stage takes the session, the rows that its predecessor kept, and the folder of the tables, and gives the columns of
documents; the last gives packed pieces. Labels are read from the folder; scores see texts alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tideguard.llm import best_fit, line_crf, poisson_mix, simhash, toxicity
from tideguard.llm.common import discard, new_path, scratch, stored, table
from tideguard.plans.cluster import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def shipped(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose words are mostly in content lines."""
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, field).where("kept").select(docs.columns)


@shipped
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


@shipped
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return simhash.keep_one(docs)


@shipped
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's rate, in a global shuffle."""
    return poisson_mix.mix_sources(docs).select(docs.columns)


@shipped
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    import public_tokenizers

    return best_fit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


STAGES = [("quality", quality), ("toxicity", clean), ("near_dedup", distinct), ("mixing", mixed), ("packing", packed)]

#: Trained models and tokenizers can't be written in SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's own files go once its result is written, and that result once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path=path)
        discard(spark, *before)
        before = [path]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
