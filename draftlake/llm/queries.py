"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.common import table
from draftlake.llm import bin_packing, canonical_map, cooccurrence, quota_sample, source_mix, split_overlap, term_counts, text_quality, tokens, vector_forest


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "pairs").select(F.col("pair_id").alias("id"), F.col("query").alias("text"))
    return split_overlap.overlap_pairs(records, split_overlap.split_sides(table(spark, d, "eval_split"))).select("pair_a", "pair_b")


def p1_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(table(spark, d, "pairs"), table(spark, d, "eval_split"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_forest.found_pairs(table(spark, d, "plan_embeddings"))


def p2_topk_queries(spark: SparkSession, d: str) -> DataFrame:
    top = vector_forest.block_topk(table(spark, d, "plan_embeddings"))
    return top.select(F.col("a").alias("row_no"), "rank", F.col("b").alias("similar_row"), F.round("score", 4).alias("score"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    return vector_forest.recall_report(table(spark, d, "plan_embeddings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_term_counts(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.marked_terms(table(spark, d, "contracts"), "contract_id", term_counts.node_fields())


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.associated(cooccurrence.item_pairs(cooccurrence.plan_baskets(table(spark, d, "plan_attributes")))).select("item_a", "item_b")


def p5_item_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of items that occur together, however rare."""
    return cooccurrence.all_item_pairs(cooccurrence.plan_baskets(table(spark, d, "plan_attributes")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).where("shortfall > 0").select("request_id", "scale_bucket")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.shortfalls(table(spark, d, "pairs"), table(spark, d, "sample_targets"))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.draw_sample(table(spark, d, "pairs"), table(spark, d, "sample_targets"))


def p6_drawn_shares(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.drawn_shares(table(spark, d, "pairs"), table(spark, d, "sample_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_map.found_layers(table(spark, d, "contracts"), table(spark, d, "canonical_layers"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    found = p7_found(spark, d).where("layer_id = -1")
    return found.groupBy("layer").agg(F.count(F.lit(1)).alias("n_contracts"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.split_documents(bin_packing.packed_items(tokens.token_sizes(table(spark, d, "documents"))))


def p8_packing_report(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.packing_report(bin_packing.packed_items(tokens.token_sizes(table(spark, d, "documents"))))


def p8_search_report(spark: SparkSession, d: str) -> DataFrame:
    return bin_packing.search_report(bin_packing.packed_items(tokens.token_sizes(table(spark, d, "documents"))))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.short_sources(tokens.token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_mix_report(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.mix_report(tokens.token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_mix_members(spark: SparkSession, d: str) -> DataFrame:
    return source_mix.mix_members(tokens.token_sizes(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.not_prose(table(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.flagged_texts(text_quality.text_statistics(table(spark, d, "documents")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
