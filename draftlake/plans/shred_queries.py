"""Problem 4 queries: flat tables of contracts, nodes, segments, edges and symbols, and links that lead nowhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.common import table
from draftlake.operators import shred

NODE_FIELDS = {
    "id": ("id", 0, "string"), "layer": ("layer", 0, "string"), "semantic_id": ("semantic_id", 0, "int"), "instance_id": ("instance_id", 0, "int"),
    "semantic_label": ("semantic_label", 0, "string"), "geometry_type": ("geometry_type", 0, "string"), "content": ("content", 0, "string"),
    "length": ("features.length", 0, "double"), "center_x": ("features.center", 0, "double"), "center_y": ("features.center", 1, "double"),
    "min_x": ("features.bbox", 0, "double"), "min_y": ("features.bbox", 1, "double"), "max_x": ("features.bbox", 2, "double"), "max_y": ("features.bbox", 3, "double"),
    "radius": ("features.radius", 0, "double"), "rx": ("features.rx", 0, "double"), "ry": ("features.ry", 0, "double"),
    "start_x": ("endpoints.start", 0, "double"), "start_y": ("endpoints.start", 1, "double"), "end_x": ("endpoints.end", 0, "double"), "end_y": ("endpoints.end", 1, "double"),
    **{f"onehot_{i}": ("features.geometry_type_onehot", i, "int") for i in range(7)},
}
SEGMENT_FIELDS = {
    "type": ("type", 0, "string"), "length": ("length", 0, "double"), "start_x": ("start", 0, "double"), "start_y": ("start", 1, "double"), "end_x": ("end", 0, "double"), "end_y": ("end", 1, "double"),
    **{k: (f"extra.{k}", 0, "double") for k in ("rx", "ry", "x_rotation", "large_arc", "sweep")},
}
EDGE_FIELDS = {"source": ("source", 0, "string"), "target": ("target", 0, "string"), "relation": ("relation", 0, "string"), "distance": ("distance", 0, "double")}
SYMBOL_FIELDS = {
    "symbol_id": ("symbol_id", 0, "string"), "semantic_id": ("semantic_id", 0, "int"), "instance_id": ("instance_id", 0, "int"),
    "semantic_label": ("semantic_label", 0, "string"), "node_count": ("node_count", 0, "int"),
}


NODE_PATHS = ("nodes.id", "nodes.layer", "nodes.semantic_id", "nodes.instance_id", "nodes.semantic_label", "nodes.geometry_type", "nodes.content", "nodes.endpoints", "nodes.features")
SYMBOL_PATHS = ("symbols.symbol_id", "symbols.semantic_id", "symbols.instance_id", "symbols.semantic_label", "symbols.node_count")


def _adjacency(spark: SparkSession, d: str, paths: tuple[str, ...], raw: bool = True) -> list[DataFrame]:
    return shred.contract_adjacency(table(spark, d, "contracts"), table(spark, d, "raw_contracts") if raw else None, paths)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).withColumnRenamed("record_id", "contract_id")


def _entity(spark: SparkSession, d: str, entity: str, fields: dict, paths: tuple[str, ...], raw: bool = True) -> DataFrame:
    """contract_id, key, parent, ordinal and the entity's fields; one table over both sources. The parent of a top entity is the contract, 0."""
    return _union([shred.entity_table(shred.adjacency_rows(a), entity, fields) for a in _adjacency(spark, d, paths, raw)])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([shred.dangling_references(a) for a in _adjacency(spark, d, shred.LINK_PATHS)])


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _entity(spark, d, "nodes", NODE_FIELDS, NODE_PATHS).drop("parent")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """parent is the key of the node that the segment is part of."""
    return _entity(spark, d, "segments", SEGMENT_FIELDS, ("nodes.segments",))


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    """contract_id, parent (the key of the node), name, value of the raw attributes of nodes."""
    return _union([shred.named_scalars(shred.adjacency_rows(a), "raw_attributes") for a in _adjacency(spark, d, ("nodes.raw_attributes",))])


def p4_edges(spark: SparkSession, d: str) -> DataFrame:
    return _entity(spark, d, "edges", EDGE_FIELDS, ("edges",)).drop("parent")


def p4_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _entity(spark, d, "symbols", SYMBOL_FIELDS, SYMBOL_PATHS).drop("parent")


def p4_symbol_nodes(spark: SparkSession, d: str) -> DataFrame:
    """contract_id, symbol (its ordinal), position, node_ref and node (the ordinal of the node it names, null if none)."""
    return _union([shred.symbol_members(a) for a in _adjacency(spark, d, ("nodes.id", "symbols.node_ids"))])


def p4_layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """contract_id, layer, n: the nodes per layer that the metadata states."""
    rows = _union([shred.named_scalars(shred.adjacency_rows(a), "metadata.layer_counts") for a in _adjacency(spark, d, ("metadata.layer_counts",))])
    return rows.select("contract_id", F.col("name").alias("layer"), F.col("value").try_cast("int").alias("n"))


def _contracts(spark: SparkSession, d: str, raw: bool) -> DataFrame:
    out = []
    for a in _adjacency(spark, d, ("metadata", "nodes.id", "edges.source", "symbols.symbol_id"), raw):
        rows = a.select("record_id", "readable", F.explode_outer("adjacency").alias("r")).select("record_id", "readable", "r.*")
        stated = lambda label, i=0: F.max(F.when((F.col("label") == f"metadata.{label}") & (F.col("ordinal") == i), F.col("scalar")))
        held = lambda label: F.count_if(F.col("is_object") & (F.col("label") == label))
        out.append(
            rows.groupBy("record_id").agg(
                F.max("readable").alias("readable"), stated("filename").alias("filename"), stated("epsilon").try_cast("double").alias("epsilon"),
                *(stated("viewbox", i).try_cast("double").alias(f"viewbox_{name}") for i, name in enumerate(("x", "y", "width", "height"))),
                *(stated(f"total_{e}").try_cast("int").alias(f"stated_{e}") for e in ("nodes", "edges", "symbols")), *(held(e).alias(f"held_{e}") for e in ("nodes", "edges", "symbols")),
            )
        )
    if raw:
        out[-1] = out[-1].where("readable")
    return _union(out)


def p4_contracts(spark: SparkSession, d: str) -> DataFrame:
    """contract_id, whether it is readable, what its metadata state and the objects it holds.

    Every record of ``contracts`` has a row, be it empty or unreadable; bodies of
    ``raw_contracts`` that are no JSON yield no records.
    """
    return _contracts(spark, d, True)


# The same tables of ``contracts`` alone, which SQL can express; keys are hashes of this library, so ordinals stand for them.


def p4_typed_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([shred.dangling_references(a) for a in _adjacency(spark, d, shred.LINK_PATHS, False)])


def p4_typed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _entity(spark, d, "nodes", NODE_FIELDS, NODE_PATHS, False).drop("key", "parent")


def p4_typed_segments(spark: SparkSession, d: str) -> DataFrame:
    """With the ordinal of the node instead of its key: every link of the table to p4_nodes holds."""
    segments = _entity(spark, d, "segments", SEGMENT_FIELDS, ("nodes.segments",), False).drop("key")
    nodes = _entity(spark, d, "nodes", {"id": ("id", 0, "string")}, ("nodes.id",), False).select("contract_id", F.col("key").alias("parent"), F.col("ordinal").alias("node"))
    return segments.join(nodes, ["contract_id", "parent"]).drop("parent")


def p4_typed_edges(spark: SparkSession, d: str) -> DataFrame:
    return _entity(spark, d, "edges", EDGE_FIELDS, ("edges",), False).drop("key", "parent")


def p4_typed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _entity(spark, d, "symbols", SYMBOL_FIELDS, SYMBOL_PATHS, False).drop("key", "parent")


def p4_typed_symbol_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _union([shred.symbol_members(a) for a in _adjacency(spark, d, ("nodes.id", "symbols.node_ids"), False)])


def p4_typed_contracts(spark: SparkSession, d: str) -> DataFrame:
    return _contracts(spark, d, False)


_ONE = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY _corrupt_record IS NULL DESC, ingested_at DESC) AS nth FROM contracts WHERE contract_id IS NOT NULL),
c AS (SELECT * FROM o WHERE nth = 1),
n AS (SELECT contract_id, generate_subscripts(nodes, 1) - 1 AS ordinal, unnest(nodes) AS x FROM c),
e AS (SELECT contract_id, generate_subscripts(edges, 1) - 1 AS ordinal, unnest(edges) AS x FROM c),
s AS (SELECT contract_id, generate_subscripts(symbols, 1) - 1 AS ordinal, unnest(symbols) AS x FROM c),
m AS (SELECT contract_id, ordinal, generate_subscripts(ids, 1) - 1 AS position, unnest(ids) AS ref FROM (SELECT contract_id, ordinal, x.node_ids AS ids FROM s))
"""
_NUMBER = r"CASE WHEN regexp_extract(lower(trim({0})), '^n?0*([0-9]+)(?:\.0+)?$', 1) <> '' THEN regexp_extract(lower(trim({0})), '^n?0*([0-9]+)(?:\.0+)?$', 1) ELSE lower(trim({0})) END"


def _sql(fields: dict) -> str:
    many = {label for label, i, _ in fields.values() if i}
    quoted = lambda label: ".".join(f'"{k}"' for k in label.split("."))
    return ", ".join(f"x.{quoted(label)}{f'[{i + 1}]' if label in many else ''} AS {name}" for name, (label, i, _) in fields.items())


def oracle_sql() -> dict[str, str]:
    refs = "SELECT contract_id, 'source' AS link, ordinal, trim(coalesce(x.source, '')) AS node_ref FROM e UNION ALL SELECT contract_id, 'target', ordinal, trim(coalesce(x.target, '')) FROM e UNION ALL SELECT contract_id, 'symbol', ordinal, trim(coalesce(ref, '')) FROM m"
    held = f"SELECT contract_id, {_NUMBER.format('x.id')} AS number, max(ordinal) AS node FROM n WHERE trim(coalesce(x.id, '')) <> '' GROUP BY 1, 2"
    counts = ", ".join(f"coalesce(len({e}), 0) AS held_{e}" for e in ("nodes", "edges", "symbols"))
    box = ", ".join(f"metadata.viewbox[{i}] AS viewbox_{k}" for i, k in enumerate(("x", "y", "width", "height"), 1))
    return {
        "p4_typed_nodes": _ONE + f"SELECT contract_id, ordinal, {_sql(NODE_FIELDS)} FROM n",
        "p4_typed_segments": _ONE + f", g AS (SELECT contract_id, ordinal AS node, generate_subscripts(segments, 1) - 1 AS ordinal, unnest(segments) AS x FROM (SELECT contract_id, ordinal, x.segments AS segments FROM n)) SELECT contract_id, node, ordinal, {_sql(SEGMENT_FIELDS)} FROM g",
        "p4_typed_edges": _ONE + f"SELECT contract_id, ordinal, {_sql(EDGE_FIELDS)} FROM e",
        "p4_typed_symbols": _ONE + f"SELECT contract_id, ordinal, {_sql(SYMBOL_FIELDS)} FROM s",
        "p4_typed_symbol_nodes": _ONE + f"SELECT m.contract_id, m.ordinal AS symbol, position, trim(coalesce(ref, '')) AS node_ref, h.node FROM m LEFT JOIN ({held}) h ON h.contract_id = m.contract_id AND h.number = {_NUMBER.format('ref')}",
        "p4_typed_found": _ONE + f"SELECT r.* FROM ({refs}) r LEFT JOIN ({held}) h ON h.contract_id = r.contract_id AND h.number = {_NUMBER.format('r.node_ref')} WHERE h.node IS NULL",
        "p4_typed_contracts": _ONE + f"SELECT contract_id, _corrupt_record IS NULL AS readable, metadata.filename AS filename, metadata.epsilon AS epsilon, {box}, metadata.total_nodes AS stated_nodes, metadata.total_edges AS stated_edges, metadata.total_symbols AS stated_symbols, {counts} FROM c",
    }


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("p4_") and callable(f)}
