"""Entry points: ingestion, attributes, query texts, retrieval and its evaluation, each one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import text, vectors
from draftlake.operators import contracts as ct
from draftlake.operators import encoder, metrics, proximity, sampling, search
from draftlake.sources import svg

Vectoriser = Callable[[DataFrame], DataFrame]


def ingest_drawings(spark: SparkSession, folder: str, epsilon: float = 0.5, most_edges: int = 3, limit: int | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements, edges and symbols of the drawings of a folder. Failed files are rows of the first table."""
    elements = svg.read_svg(spark, folder, limit, compat=compat)
    nodes = elements.where("pos is not null")
    widest = F.greatest(F.get("viewbox", F.lit(2)), F.get("viewbox", F.lit(3)))
    points = ct.structural(nodes).select(F.col("plan_id").alias("plan"), F.col("pos").alias("i"), "layer", "start", "end", F.when(widest > 0, epsilon / widest).otherwise(F.lit(epsilon)).alias("eps"))
    kept = proximity.with_relation(proximity.capped_pairs(proximity.near_pairs(points), most_edges))
    name = lambda c: F.format_string("n%05d", F.col(c))
    edges = kept.select(F.col("plan").alias("plan_id"), F.struct("i", "j").alias("pos"), name("i").alias("source"), name("j").alias("target"), "relation", F.bround("distance", 6).alias("distance"))
    label = F.coalesce(F.get(F.array(*map(F.lit, svg.SEMANTIC_LABELS)), F.col("semantic_id")), F.concat(F.lit("class_"), F.col("semantic_id")))
    symbols = ct.symbols(nodes.withColumnRenamed("plan_id", "contract_id")).withColumnRenamed("contract_id", "plan_id").withColumn("semantic_label", label)
    return elements, edges, symbols


def plan_attributes(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """contract_id, inventory, adjacencies, density of the contracts with at least two clean labels."""
    inventory = ct.label_inventory(node_rows)
    maps = ct.inventory_maps(inventory).join(ct.low_signal(inventory).select("contract_id"), "contract_id", "left_semi")
    sentences = ct.adjacency_pairs(node_rows, edge_rows).groupBy("contract_id").agg(F.sort_array(F.collect_set("sentence")).alias("adjacencies"))
    sizes = node_rows.groupBy("contract_id").agg(vectors.density(F.count(F.lit(1))).alias("density"))
    joined = maps.join(sentences, "contract_id", "left").join(sizes, "contract_id")
    return joined.withColumn("adjacencies", F.coalesce("adjacencies", F.array().cast("array<string>")))


def query_pairs(attributes: DataFrame, plan: Column, seed: int = 42) -> DataFrame:
    """floor_plan_id, query, scale_bucket, template_type of every plan."""
    return text.with_queries(attributes, plan, seed).select(plan.alias("floor_plan_id"), "query", vectors.scale_bucket(F.try_element_at("inventory", F.lit("bed"))).alias("scale_bucket"), F.lit("dynamic").alias("template_type"))


def located(pairs: DataFrame, graphs: DataFrame) -> DataFrame:
    """pair_id, graph_path, via: the graph of each pair by its path, or by its file name where no path fits (of several the last); pairs without one are left out."""
    exact = graphs.select("graph_path").where("graph_path is not null").distinct().withColumn("x", F.col("graph_path"))
    named = graphs.where("graph_path is not null").groupBy(text.base_name("graph_path").alias("base")).agg(F.max("graph_path").alias("y"))
    asked = pairs.select("pair_id", "graph_path", text.base_name("graph_path").alias("base"))
    both = asked.join(exact, "graph_path", "left").join(named, "base", "left").select("pair_id", F.coalesce("x", "y").alias("graph_path"), F.when(F.col("x").isNotNull(), "path").otherwise("name").alias("via"))
    return both.where("graph_path is not null")


def training_batches(pairs: DataFrame, graphs: DataFrame, batch_size: int = 32, seed: int = 42) -> DataFrame:
    """batch, position, pair_id, query, category and the graph's columns: batches balanced over categories, none of a single pair.

    pairs(pair_id, query, graph_path, scale_bucket[, bedroom_count]); graphs(graph_path, ...).
    """
    category = F.coalesce("scale_bucket", *(["bedroom_count"] if "bedroom_count" in pairs.columns else []), F.lit(-1))
    held = located(pairs.where("query is not null"), graphs).select("pair_id", "graph_path")
    rows = pairs.select("pair_id", "query", category.alias("category")).join(held, "pair_id")
    batches = sampling.full_batches(sampling.balanced_batches(rows, "pair_id", F.col("category"), batch_size, seed))
    ordered = sampling.shuffled_batches(batches, seed).select(F.col("id").alias("pair_id"), "batch", "position")
    return ordered.join(rows, "pair_id").join(graphs, "graph_path")


def retrieve(queries: DataFrame, index: DataFrame, top_k: int = 5, vectoriser: Vectoriser = encoder.hashed_words) -> DataFrame:
    """query_id, rank, row, floor_plan_id, score: the plans that answer each text. queries(id, text), index(row, floor_plan_id, embedding)."""
    asked = vectoriser(queries).select(F.col("id").alias("query_id"), "embedding")
    hits = search.top_k(asked, index.select("row", vectors.unit(F.col("embedding")).alias("embedding")), top_k, drop_self=False)
    return hits.join(index.select("row", "floor_plan_id"), "row").select("query_id", "rank", "row", "floor_plan_id", "score")


def evaluate(pairs: DataFrame, index: DataFrame, n_test: int = 200, seed: int = 99, vectoriser: Vectoriser = encoder.hashed_words) -> dict[str, DataFrame]:
    """Recall, MRR, recall per bucket, coverage and random baseline over the test side of a stratified split.

    pairs(pair_id, query, floor_plan_id, scale_bucket); plans are compared without ``.svg``.
    """
    bucket = F.coalesce("scale_bucket", *(["bedroom_count"] if "bedroom_count" in pairs.columns else []), F.lit(0))
    split = sampling.stratified_split(pairs, "pair_id", bucket, n_test, seed).where("split = 'test'").select(F.col("id").alias("pair_id"), F.col("stratum").alias("bucket"))
    ids = index.select(text.strip_svg("floor_plan_id").alias("item")).distinct()
    test = pairs.join(split, "pair_id").select(F.col("pair_id").alias("query_id"), "query", text.strip_svg("floor_plan_id").alias("item"), "bucket")
    answerable = test.join(ids, "item", "left_semi")
    hits = retrieve(answerable.select(F.col("query_id").alias("id"), F.col("query").alias("text")), index, max(metrics.KS), vectoriser)
    first = metrics.first_hits(hits.select("query_id", text.strip_svg("floor_plan_id").alias("item"), "rank"), answerable.select("query_id", "item"))
    return {
        "recall": metrics.recall(first),
        "mrr": metrics.mrr(first),
        "by_bucket": metrics.recall_by(first, answerable.select("query_id", "bucket")),
        "coverage": test.join(ids.withColumn("held", F.lit(1)), "item", "left").agg(F.count(F.lit(1)).alias("n_test"), F.count("held").alias("n_answerable")),
        "random": metrics.random_recall(index.agg(F.count(F.lit(1)).alias("n"))),
    }


def qualitative(hits: DataFrame, queries: DataFrame, relevant: DataFrame, n: int = 5) -> DataFrame:
    """The first n queries with what was found, for reading (a listing, so a limit)."""
    names = F.create_map(*(F.lit(x) for kv in ((0, "commercial"), (1, "small"), (2, "medium"), (3, "large")) for x in kv))
    first = queries.orderBy("query_id").limit(n)
    shown = first.join(hits, "query_id").join(relevant.select("query_id", F.col("item").alias("correct")), "query_id")
    return shown.select("query_id", text.clipped("query").alias("query"), F.coalesce(F.try_element_at(names, F.col("bucket")), F.lit("?")).alias("bucket"), "rank", "floor_plan_id", "score", (text.strip_svg("floor_plan_id") == F.col("correct")).alias("right"))
