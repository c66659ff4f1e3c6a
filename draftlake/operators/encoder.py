"""Vectors from texts and graphs without a trained network: stand-ins, and forward passes with given weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.functions import vectors


def hashed_words(texts: DataFrame, dim: int = 256, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, embedding: unit vectors of signed word hashes. Deterministic; a stand-in for an encoder, not an equal of one.

    A text without words gets no row, as it has no direction.
    """
    words = F.regexp_extract_all(tx.normalise_query(text_col, strict=False), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    each = texts.select(F.col(id_col).alias("id"), F.explode(words).alias("w"))
    h = F.xxhash64("w")
    parts = each.select("id", F.pmod(h, F.lit(dim)).cast("int").alias("i"), F.when(F.shiftrightunsigned(h, 62) % 2 == 0, 1.0).otherwise(-1.0).alias("x"))
    summed = parts.groupBy("id", "i").agg(F.sum("x").alias("x")).where("x <> 0").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return summed.select("id", vectors.unit(dense).alias("embedding"))


def _per_dimension(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    return rows.select(*keys, F.posexplode(F.col(column).cast("array<double>")).alias("i", "x"))


def _dense(summed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Arrays of the values of each key in the order of their dimension."""
    ordered = F.array_sort(F.collect_list(F.struct("i", *values)))
    return summed.groupBy(*keys).agg(ordered.alias("d")).select(*keys, *(F.col(f"d.{v}").alias(v) for v in values))


def mean_pool(token_vectors: DataFrame, keys: list[str], column: str = "vector") -> DataFrame:
    """Mean of the token vectors of each text; tokens marked as padding (pad = true) don't count."""
    held = token_vectors.where(~F.coalesce("pad", F.lit(False))) if "pad" in token_vectors.columns else token_vectors
    return _dense(_per_dimension(held, keys, column).groupBy(*keys, "i").agg(F.avg("x").alias("mean")), keys, ["mean"])


def graph_pool(node_vectors: DataFrame, keys: list[str], column: str = "vector") -> DataFrame:
    """Mean and maximum of the node vectors of each graph, joined to one vector."""
    both = _dense(_per_dimension(node_vectors, keys, column).groupBy(*keys, "i").agg(F.avg("x").alias("mean"), F.max("x").alias("most")), keys, ["mean", "most"])
    return both.select(*keys, F.concat("mean", "most").alias("vector"))


def neighbour_mean(node_vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """contract_id, node, vector, neighbours: mean of the vectors of the nodes that point to a node (zeros without any).

    node_vectors(contract_id, node, vector), edges(contract_id, src, dst).
    """
    sent = edges.join(node_vectors.select("contract_id", F.col("node").alias("src"), "vector"), ["contract_id", "src"]).select("contract_id", F.col("dst").alias("node"), "vector")
    pooled = mean_pool(sent, ["contract_id", "node"]).withColumnRenamed("mean", "neighbours")
    out = node_vectors.join(pooled, ["contract_id", "node"], "left")
    return out.withColumn("neighbours", F.coalesce("neighbours", F.transform(F.col("vector").cast("array<double>"), lambda _: F.lit(0.0))))


def linear(v: Column, weights: list[list[float]], bias: list[float] | None = None, relu: bool = False) -> Column:
    """W v + b of given weights, one literal row per output."""
    rows = []
    for k, row in enumerate(weights):
        y = vectors.dot(v, F.array(*map(F.lit, map(float, row)))) + (float(bias[k]) if bias else 0.0)
        rows.append(F.greatest(y, F.lit(0.0)) if relu else y)
    return F.array(*rows)


def sage_layer(node_vectors: DataFrame, edges: DataFrame, own: list[list[float]], other: list[list[float]], bias: list[float], relu: bool = True) -> DataFrame:
    """One round of neighbour aggregation: relu(own v + other mean(neighbours) + bias)."""
    both = neighbour_mean(node_vectors, edges)
    summed = F.zip_with(linear(F.col("vector"), own, bias), linear(F.col("neighbours"), other), lambda a, b: a + b)
    return both.select("contract_id", "node", (F.transform(summed, lambda x: F.greatest(x, F.lit(0.0))) if relu else summed).alias("vector"))


def encode_by_halves(encode: Callable[[list], list], items: list, too_large: tuple[type[BaseException], ...] = (MemoryError,)) -> list:
    """What ``encode`` makes of the items, in their order; a batch that is too large for it is halved until it fits.

    For use inside a worker's batches. A single item that doesn't fit raises.
    """
    if not items:
        return []
    try:
        return list(encode(items))
    except too_large:
        if len(items) == 1:
            raise
        half = len(items) // 2
        return encode_by_halves(encode, items[:half], too_large) + encode_by_halves(encode, items[half:], too_large)
