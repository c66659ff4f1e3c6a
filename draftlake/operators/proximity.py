"""Edges between nodes whose endpoints lie close together, with and without a limit of edges per node."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.common import shuffle_partitions
from draftlake.functions import vectors

#: Cells are a little wider than eps, so that rounding can't put two points at exactly eps two cells apart.
WIDER = 1.0 + 1e-9


def near_pairs(nodes: DataFrame, eps: Column | str = "eps") -> DataFrame:
    """plan, i, j (i < j), distance, la, lb (their layers) of the nodes with endpoints at most eps apart.

    nodes(plan, i, layer, start, end, eps). A grid with cells of eps turns the distance
    join into an equi-join: every endpoint is put in its cell, one side also in the
    eight neighbours, so each task sees near points only. The points of a small file are
    many, which its size doesn't tell, so the join is a sort-merge join and no side is broadcast.
    """
    e = F.col(eps) if isinstance(eps, str) else eps
    kept = nodes.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (e >= 0))
    points = kept.select("plan", "i", e.alias("eps"), "layer", "start", "end", F.explode(F.array_distinct(F.array("start", "end"))).alias("p"))
    cell = lambda k: F.floor(F.get(F.col("p"), F.lit(k)) / F.greatest(F.col("eps") * WIDER, F.lit(1e-12)))
    points = points.where(F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x))).select("plan", "i", "eps", "layer", "start", "end", cell(0).alias("cx"), cell(1).alias("cy"))
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    left = points.select("plan", F.col("i"), "eps", F.col("layer").alias("la"), F.col("start").alias("s"), F.col("end").alias("e"), "cx", "cy")
    right = points.select("plan", F.col("i").alias("j"), F.col("layer").alias("lb"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(around).alias("d"), "cx", "cy")
    right = right.select("plan", "j", "lb", "s2", "e2", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    joined = left.hint("merge").join(right, ["plan", "cx", "cy"]).where("i < j")
    d = F.least(*(vectors.distance(F.col(a), F.col(b)) for a in ("s", "e") for b in ("s2", "e2")))
    near = joined.select("plan", "i", "j", "la", "lb", "eps", d.alias("distance")).where(F.col("distance") <= F.col("eps")).drop("eps")
    # two nodes may meet in several cells, with one distance and their own layers
    return near.groupBy("plan", "i", "j").agg(F.min("distance").alias("distance"), F.first("la").alias("la"), F.first("lb").alias("lb"))


def with_relation(pairs: DataFrame) -> DataFrame:
    return pairs.select("plan", "i", "j", "distance", vectors.relation(F.coalesce("la", F.lit("")), F.coalesce("lb", F.lit(""))).alias("relation"))


def capped_pairs(pairs: DataFrame, most: int = 3) -> DataFrame:
    """Of the pairs of a plan in the order (i, j), those whose nodes both have fewer than ``most`` edges so far.

    The choice depends on all earlier ones of the same plan, so a plan is one fold over
    its near pairs, in sorted batches; only the edge counts of its nodes are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, degree = object(), {}
        for pdf in batches:
            keep = []
            for p, i, j in zip(pdf["plan"], pdf["i"], pdf["j"], strict=True):
                if p != plan:
                    plan, degree = p, {}
                ok = degree.get(i, 0) < most and degree.get(j, 0) < most
                if ok:
                    degree[i], degree[j] = degree.get(i, 0) + 1, degree.get(j, 0) + 1
                keep.append(ok)
            yield pdf[keep]

    n = shuffle_partitions(pairs.sparkSession)
    ordered = pairs.select("plan", "i", "j", "distance", "la", "lb").repartition(n, "plan").sortWithinPartitions("plan", "i", "j")
    return ordered.mapInPandas(run, ordered.schema)


def contract_points(node_rows: DataFrame) -> DataFrame:
    """plan, i, layer, start, end (relative to the view box) and eps of the structural nodes of contracts.

    node_rows(contract_id, pos, layer, endpoints, viewbox, epsilon).
    """
    rows = node_rows.withColumn("b", F.col("viewbox")).withColumn("raw_eps", F.coalesce("epsilon", F.lit(0.5)))
    side = lambda k: F.coalesce(F.get("b", F.lit(k)), F.lit(100.0))
    low = lambda k: F.coalesce(F.get("b", F.lit(k)), F.lit(0.0))
    scaled = lambda p: F.array(*(F.when(side(k + 2) != 0, (F.get(F.col(p), F.lit(k)) - low(k)) / side(k + 2)).otherwise(F.get(F.col(p), F.lit(k))) for k in (0, 1)))
    widest = F.greatest(side(2), side(3))
    return rows.select(
        F.col("contract_id").alias("plan"), F.col("pos").alias("i"), "layer", scaled("endpoints.start").alias("start"), scaled("endpoints.end").alias("end"),
        F.when(widest > 0, F.col("raw_eps") / widest).otherwise(F.col("raw_eps")).alias("eps"),
    )
