"""A training-data pipeline over the documents table, built from operators of crestline.llm.

Stages, each working on all that the one before kept: quality classifier (documents that it
rejects go), near duplicates (one document of each class stays, that of the least id),
benchmark decontamination (documents with a benchmark passage go), pseudonyms for
personal data, and the mix of sources to target weights. All but the last return the
columns of documents; the last adds the place of each document in the mix.

Defined results: rows with a null doc_id are judged by their text like any other, and of
copies among them one stays; texts that are null or empty are kept unless the classifier rejects them;
an empty table gives an empty result; columns beyond those of documents pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import decontaminate, forest_join, pfair, pii, quality
from crestline.llm.cut import cut, free_name
from crestline.llm.queries import MIX_DEFAULT, MIX_WEIGHTS, id_rest, pii_key, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns as in its own query."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=id_rest("doc_id", 3) != 1)
    name = free_name(docs, "score")
    return quality.score(docs, model, score_col=name).where(F.col(name) >= 0.5).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return forest_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text."""
    name = free_name(docs, "kinds")
    done = pii.pseudonymise(docs, pii_key(spark), kinds_col=name).drop(name)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in done.columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix."""
    return pfair.mix(docs, MIX_WEIGHTS, default_weight=MIX_DEFAULT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("mix", mix_sources),
]

#: SQL cannot express the learned and hashed stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is cut in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
