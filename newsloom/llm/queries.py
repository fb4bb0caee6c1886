"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bin_packing,
    byte_convnet,
    impact_index,
    interpolated_lm,
    jaccard_join,
    line_rules,
    rule_quality,
    source_mixing,
    sql,
    toxicity_chain,
    warc,
)
from .common import remainder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), impact_index.quantised(F.col("embedding")).alias("q"))
    return impact_index.top_k(rows, rows.filter(F.col("id") % 50 == 0), k=5)


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_frequency_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


TREE_WEIGHTS = [
    # domain, language, source, weight; a null stands for all below
    *((f"domain{k}", None, None, w) for k, w in enumerate((4.0, 3.0, 2.0, 1.0))),
    *((f"domain{k}", lang, None, w) for k in range(4) for lang, w in (("en", 2.0), ("de", 2.0), ("fr", 2.0), ("es", 4.0))),
]


def tree_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE_WEIGHTS, "domain string, lang string, source string, weight double")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", source_mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", source_mixing.word_count(F.col("text")).alias("n_tokens")
    )
    return source_mixing.mix_sources(docs, tree_weights(spark), budget=0.6, max_epochs=2)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.write_captures(_table(spark, sf_dir, "pages"))
    archives = warc.deduplicate_archives(spark, captures)
    return warc.resolved_records(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = byte_convnet.fit_languages(docs, only=remainder("doc_id", 4) != 2)
    return byte_convnet.predict_languages(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", source_mixing.word_count(F.col("text")).alias("n_tokens"))
    return bin_packing.pack_documents(docs)


def op6_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_quality.fit_quality(docs, _table(spark, sf_dir, "labels"), only=remainder("doc_id", 3) != 1)
    return rule_quality.with_quality(docs, model).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), num=90, den=100, width=3)


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.all_links(_table(spark, sf_dir, "documents"), num=90, den=100, width=3)


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities: of the kinds that are learned, then of being toxic; ``toxic``: that one is 0.5 or more."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_chain.fit_from_labels(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity_chain.with_toxicity(docs, model)
    return scored.select("doc_id", *(F.col(f"_p_{c}").alias(f"p_{c}") for c in model.categories), (F.col("_p_toxic") >= 0.5).alias("toxic"))


QUERIES: dict[str, Query] = {
    "op1_impact_search": op1_impact_search,
    "op2_line_rules": op2_line_rules,
    "op3_interpolated_lm": op3_interpolated_lm,
    "op4_byte_convnet": op4_byte_convnet,
    "op5_bin_packing": op5_bin_packing,
    "op6_rule_quality": op6_rule_quality,
    "op7_source_mixing": op7_source_mixing,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_jaccard_join": op9_jaccard_join,
    "op9_jaccard_links": op9_jaccard_links,
    "op10_toxicity_chain": op10_toxicity_chain,
}

ORACLE_SQL: dict[str, str] = {
    "op1_impact_search": sql.OP1,
    "op2_line_rules": sql.OP2,
    "op7_source_mixing": sql.op7(TREE_WEIGHTS, share=0.6, epochs=2, seed=17),
    "op8_warc_revisits": sql.OP8,
    "op9_jaccard_join": sql.OP9,
    "op9_jaccard_links": sql.OP9_LINKS,
}
