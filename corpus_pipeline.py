"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``, whatever they are, in their order.

Defined results, for every stage: a null text is an empty one (the classifiers judge it by their base rates, it has no
near-duplicates and no tokens); null labels are ignored; a null id, lang or source is a value of its own and
never drops a row; rows that repeat an id are judged by their own text; rows that repeat an id and a text are scored each,
and near-duplicate removal keeps one of them; ties go to the smaller id; columns may have any names beside doc_id, text,
lang and source; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bin_packing, jaccard_join, rule_quality, source_mixing, toxicity_chain
from newsloom.llm.common import delete_path, plain_names, shared_path
from newsloom.session import ship

MIX_SHARE = 0.9
"""Tokens that mixing keeps, of those it gets."""
MIX_WEIGHTS = None
"""Equal weights among siblings: domains, then languages, then sources."""


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    ship(spark)
    model = rule_quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, back = plain_names(docs)
    return rule_quality.with_quality(plain, model, "_quality").filter(F.col("_quality") >= 0.5).select(*back)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic, the chain's last category, is below 0.5."""
    ship(spark)
    model = toxicity_chain.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, back = plain_names(docs)
    return toxicity_chain.with_toxicity(plain, model).filter(F.col("_p_toxic") < 0.5).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard 0.8 or more) the smallest doc_id."""
    ship(spark)
    return jaccard_join.first_of_each(docs, num=80, den=100, width=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that equal weights over domains, languages and sources take within one epoch."""
    ship(spark)
    return source_mixing.kept_rows(docs, source_mixing.domain_of(F.col("source")), source_mixing.word_count(F.col("text")), MIX_WEIGHTS, budget=MIX_SHARE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of several lengths."""
    ship(spark)
    return bin_packing.pack_documents(docs.select("doc_id", source_mixing.word_count(F.col("text")).alias("n_tokens")))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last returns."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
