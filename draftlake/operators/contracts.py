"""Analytics over contracts: inventories, adjacencies, symbols, geometry, features, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlake.common import numbered_in_order
from draftlake.functions import text, vectors
from draftlake.operators.shred import latest

#: Layers between whose nodes no edges are drawn; fixed values.
WITHOUT_EDGES = ["DIM_LEAD", "PUB_DIM", "AXIS", "layerAXIS", "WINDOW_TEXT", "PUB_TEXT", "PUB_HATCH"]
#: Labels that say nothing about a neighbourhood; fixed values.
NOT_ADJACENT = ["wall", "window", "dimension", "room_text"]


def usable(contracts: DataFrame) -> DataFrame:
    """Readable contracts, each contract_id once (the latest copy)."""
    return latest(contracts.where("_corrupt_record is null"), "contract_id", F.desc("ingested_at"))


def _fields(array: str, fields: tuple[str, ...]) -> Column:
    """The array of structs with these fields alone, so that the scan reads and the shuffle moves no others."""
    return F.arrays_zip(*(F.col(f"{array}.{f}").alias(f) for f in fields)).alias(array)


def narrowed(contracts: DataFrame, *columns: Column | str) -> DataFrame:
    """contract_id and ``columns`` of the readable contracts, each contract_id once."""
    return latest(contracts.where("_corrupt_record is null").select("contract_id", "ingested_at", *columns), "contract_id", F.desc("ingested_at")).drop("ingested_at")


def nodes(contracts: DataFrame, *fields: str) -> DataFrame:
    """contract_id, pos (from 0) and the given fields of every node."""
    return narrowed(contracts, _fields("nodes", fields)).select("contract_id", F.posexplode("nodes").alias("pos", "n")).select("contract_id", "pos", "n.*")


def edges(contracts: DataFrame, *fields: str) -> DataFrame:
    return narrowed(contracts, _fields("edges", fields)).select("contract_id", F.posexplode("edges").alias("pos", "e")).select("contract_id", "pos", "e.*")


def edge_ends(contracts: DataFrame, fields: tuple[str, ...], edge_fields: tuple[str, ...] = ()) -> DataFrame:
    """contract_id, pos, edge, a, b of every edge between nodes that exist: a and b hold pos and ``fields`` of its source and target.

    Nodes and edges are read in one pass and meet within the partitioning by contract, without
    another shuffle: they are rows of one table, an edge once for each end, and a
    window over an id hands the node on. Of a repeated id the last node counts.
    """
    held = narrowed(contracts, _fields("nodes", ("id", *fields)), _fields("edges", ("source", "target", *edge_fields)))
    node = lambda n, i: F.struct(i.cast("int").alias("pos"), *(n[f].alias(f) for f in fields))
    edge = lambda e: F.struct(*(e[f].alias(f) for f in ("source", "target", *edge_fields)))
    kinds = {f.name: f.dataType for f in held.schema.fields}
    node_type = ", ".join(["pos: int", *(f"{f.name}: {f.dataType.simpleString()}" for f in kinds["nodes"].elementType.fields if f.name != "id")])
    edge_type = kinds["edges"].elementType.simpleString()
    row = lambda kind, i, key, n, e: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("pos"), key.alias("id"), (F.lit(None) if n is None else n).cast(f"struct<{node_type}>").alias("node"), (F.lit(None) if e is None else e).cast(edge_type).alias("edge")
    )
    none = F.array().cast(f"array<struct<kind:string,pos:int,id:string,node:struct<{node_type}>,edge:{edge_type}>>")
    every = F.concat(
        F.coalesce(F.transform("nodes", lambda n, i: row("n", i, n["id"], node(n, i), None)), none),
        F.coalesce(F.transform("edges", lambda e, i: row("a", i, e["source"], None, edge(e))), none),
        F.coalesce(F.transform("edges", lambda e, i: row("b", i, e["target"], None, None)), none),
    )
    # explode would build the arrays twice, to filter out the empty ones beforehand
    rows = held.select("contract_id", F.explode_outer(every).alias("r")).where("r is not null").select("contract_id", "r.*").where("id is not null")
    found = rows.withColumn("at", F.max(F.when(F.col("kind") == "n", F.col("node"))).over(Window.partitionBy("contract_id", "id"))).where("kind <> 'n' and at is not null")
    end = lambda k: F.max(F.when(F.col("kind") == k, F.col("at")))
    both = found.groupBy("contract_id", "pos").agg(end("a").alias("a"), end("b").alias("b"), F.max("edge").alias("edge"))
    return both.where("a is not null and b is not null")


def label_inventory(node_rows: DataFrame) -> DataFrame:
    """contract_id, label, n: primitives per clean label. Labels as written are counted first, so each is cleaned once per contract."""
    written = node_rows.groupBy("contract_id", "semantic_label").agg(F.count(F.lit(1)).alias("n"))
    return written.select("contract_id", text.clean_label("semantic_label").alias("label"), "n").where("label is not null").groupBy("contract_id", "label").agg(F.sum("n").alias("n"))


def inventory_maps(inventory: DataFrame) -> DataFrame:
    """contract_id, inventory as a map in the order of labels."""
    return inventory.groupBy("contract_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("inventory"))


def low_signal(inventory: DataFrame, least: int = 2) -> DataFrame:
    """Contracts with at least two distinct labels."""
    return inventory.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_labels")).where(F.col("n_labels") >= least)


def adjacency_pairs(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """contract_id, label_a, label_b, sentence: distinct unordered pairs of labels joined by an edge."""
    # of a repeated id the last node counts
    labels = node_rows.groupBy("contract_id", "id").agg(F.max_by(F.struct("semantic_label"), "pos").alias("l")).select("contract_id", "id", "l.semantic_label")
    a = edge_rows.join(labels.select("contract_id", F.col("id").alias("source"), F.col("semantic_label").alias("a")), ["contract_id", "source"])
    return label_pairs(a.join(labels.select("contract_id", F.col("id").alias("target"), F.col("semantic_label").alias("b")), ["contract_id", "target"]))


def label_pairs(ends: DataFrame) -> DataFrame:
    """adjacency_pairs of edges whose ends have the labels a and b."""
    clean = ends.select("contract_id", "a", "b").distinct().select("contract_id", text.clean_label("a").alias("a"), text.clean_label("b").alias("b"))
    both = clean.where("a <> b").where(~F.col("a").isin(NOT_ADJACENT) & ~F.col("b").isin(NOT_ADJACENT))
    return both.select("contract_id", F.least("a", "b").alias("label_a"), F.greatest("a", "b").alias("label_b"), text.adjacency_sentence(F.col("a"), F.col("b")).alias("sentence")).distinct()


def layer_counts(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("contract_id", "layer").agg(F.count(F.lit(1)).alias("n"))


def graph_label(node_rows: DataFrame) -> DataFrame:
    """Most frequent semantic id + 1 (smallest on a tie), 0 without any."""
    known = F.when(F.col("semantic_id") >= 0, F.col("semantic_id"))
    return node_rows.groupBy("contract_id").agg(F.coalesce(F.mode(known, True) + 1, F.lit(0)).cast("int").alias("graph_label"))


def symbols(node_rows: DataFrame) -> DataFrame:
    """Nodes with the same semantic and instance id, neither of them -1."""
    held = node_rows.where("semantic_id <> -1 and instance_id <> -1")
    grouped = held.groupBy("contract_id", "semantic_id", "instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("node_ids"))
    return grouped.select(
        "contract_id", F.format_string("sym_%d_%d", "semantic_id", "instance_id").alias("symbol_id"), "semantic_id", "instance_id", "node_ids", F.size("node_ids").alias("node_count")
    )


def density(contracts: DataFrame) -> DataFrame:
    return node_counts(contracts).select("contract_id", "n_nodes", vectors.density(F.col("n_nodes")).alias("density"))


def node_counts(contracts: DataFrame) -> DataFrame:
    """contract_id, n_nodes of the readable contracts."""
    return narrowed(contracts, F.coalesce(F.size("nodes.id"), F.lit(0)).alias("n_nodes"))


def node_count_stats(contracts: DataFrame) -> DataFrame:
    """Least, upper median and largest number of nodes. The median is read off the histogram of sizes, not off a list of all graphs."""
    sizes = node_counts(contracts).select(F.col("n_nodes").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("graphs"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    upto = sizes.withColumn("upto", F.sum("graphs").over(w)).withColumn("all", F.sum("graphs").over(Window.partitionBy()))
    return upto.agg(F.min("n").alias("min_nodes"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median_nodes"), F.max("n").alias("max_nodes"), F.sum("graphs").alias("n_graphs"))


def vocabulary(node_rows: DataFrame, column: str, unknown: str) -> DataFrame:
    """value, index: values in the order in which they are first seen; ``unknown`` is 0.

    One row per distinct value reaches the final numbering, which goes by ranges of the order.
    """
    seen = node_rows.where(F.col(column).isNotNull() & (F.col(column) != unknown)).groupBy(F.col(column).alias("value")).agg(F.min(F.struct("contract_id", "pos")).alias("first"))
    flat = seen.select("value", F.col("first.contract_id").alias("c"), F.col("first.pos").alias("p"))
    numbered = numbered_in_order(flat, [F.col("c"), F.col("p"), F.col("value")]).select("value", F.col("rn").cast("int").alias("index"))
    return numbered.unionByName(node_rows.sparkSession.createDataFrame([(unknown, 0)], "value string, index int"))


def node_features(node_rows: DataFrame) -> DataFrame:
    """The nine numeric features of every node and the index of its geometry type."""
    f = F.col("features")
    number = lambda c: F.coalesce(c, F.lit(0.0))
    return node_rows.select(
        "contract_id", "pos", number(f["length"]).alias("length"),
        *(vectors.at(f["center"], i).alias(f"center_{i}") for i in range(2)), *(vectors.at(f["bbox"], i).alias(f"bbox_{i}") for i in range(4)),
        (F.coalesce("instance_id", F.lit(-1)) != -1).cast("double").alias("is_instance"), F.coalesce("semantic_id", F.lit(-1)).cast("double").alias("semantic"),
        vectors.geometry_index(F.coalesce("geometry_type", F.lit("other"))).alias("geometry"),
    )


def sparse_features(node_rows: DataFrame) -> DataFrame:
    """contract_id, pos, indices, values: the feature row of every node, zeros left out.

    Nine numbers, the contract's own one-hot of the geometry (seven cells, zeros if absent), a
    one-hot of the layer and one of the geometry type by their vocabularies. Layer
    vocabularies run to thousands of entries, so rows stay sparse; they are
    joined by value and broadcast only where Catalyst finds them small.
    """
    layers = vocabulary(node_rows, "layer", "UNK").select(F.col("value").alias("layer"), F.col("index").alias("layer_index"))
    types = vocabulary(node_rows, "geometry_type", "other").select(F.col("value").alias("type"), F.col("index").alias("type_index"))
    width = layers.agg((F.max("layer_index") + 1).alias("width"))
    own = node_rows.select("contract_id", "pos", "layer", F.col("geometry_type").alias("type"), F.col("features.geometry_type_onehot").alias("hot"))
    numeric = node_features(node_rows).join(own, ["contract_id", "pos"])
    numbers = ["length", "center_0", "center_1", "bbox_0", "bbox_1", "bbox_2", "bbox_3", "is_instance", "semantic"]
    joined = numeric.join(layers, "layer", "left").join(types, "type", "left").crossJoin(F.broadcast(width))  # one row
    cell = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("double").alias("v"))
    cells = F.concat(
        F.array(*(cell(F.lit(i), F.col(c)) for i, c in enumerate(numbers))),
        F.array(*(cell(F.lit(9 + i), vectors.at(F.col("hot").cast("array<double>"), i)) for i in range(7))),
        F.array(cell(16 + F.coalesce("layer_index", F.lit(0)), F.lit(1.0)), cell(16 + F.col("width") + F.coalesce("type_index", F.lit(0)), F.lit(1.0))),
    )
    held = F.filter(cells, lambda c: c["v"] != 0)
    return joined.select("contract_id", "pos", F.transform(held, lambda c: c["i"]).alias("indices"), F.transform(held, lambda c: c["v"]).alias("values"))


def graph_rows(contracts: DataFrame) -> DataFrame:
    """id, x, src, dst, graph_label: a graph per contract, its nodes' nine numbers and both directions of its edges, built inside its row."""
    held = narrowed(contracts, _fields("nodes", ("id", "features", "instance_id", "semantic_id")), _fields("edges", ("source", "target")))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def nine(n: Column) -> Column:
        f = n["features"]
        return F.array(
            number(f["length"]), *(vectors.at(f["center"], i) for i in range(2)), *(vectors.at(f["bbox"], i) for i in range(4)),
            (F.coalesce(n["instance_id"], F.lit(-1)) != -1).cast("double"), F.coalesce(n["semantic_id"], F.lit(-1)).cast("double"),
        )

    ends = edge_ends(contracts, ()).groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("a.pos").alias("s"), F.col("b.pos").alias("d")))).alias("e"))
    labels = held.select("contract_id", F.explode_outer("nodes.semantic_id").alias("semantic_id"))
    x = held.select("contract_id", F.transform("nodes", nine).alias("x"))
    way = lambda a, b: F.coalesce(F.concat(F.transform("e", lambda k: k[a]), F.transform("e", lambda k: k[b])), F.array().cast("array<int>"))
    joined = x.join(ends, "contract_id", "left").join(graph_label(labels), "contract_id", "left")
    return joined.select(F.col("contract_id").alias("id"), "x", way("s", "d").alias("src"), way("d", "s").alias("dst"), F.coalesce("graph_label", F.lit(0)).alias("graph_label"))


def directed_edges(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Both directions of every edge between nodes that exist, by node position, with distance and relation id."""
    ids = node_rows.groupBy("contract_id", "id").agg(F.max("pos").alias("node"))
    a = edge_rows.join(ids.select("contract_id", F.col("id").alias("source"), F.col("node").alias("a")), ["contract_id", "source"])
    return both_ways(a.join(ids.select("contract_id", F.col("id").alias("target"), F.col("node").alias("b")), ["contract_id", "target"]))


def both_ways(both: DataFrame) -> DataFrame:
    """directed_edges of edges (contract_id, pos, distance, relation) between the node positions a and b."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return both.select("contract_id", "pos", F.coalesce("distance", F.lit(0.0)).alias("distance"), vectors.relation_id(F.col("relation")).alias("relation_id"), ends.alias("x")).select(
        "contract_id", "pos", "x.src", "x.dst", "distance", "relation_id"
    )


def structural(node_rows: DataFrame) -> DataFrame:
    """Nodes between which edges are drawn."""
    return node_rows.where(~F.coalesce("layer", F.lit("")).isin(WITHOUT_EDGES) & (F.coalesce("geometry_type", F.lit("")) != "text"))


def segment_summary(node_rows: DataFrame) -> DataFrame:
    """contract_id, pos, dominant type (first drawn on a tie), total length, bounds and centre of the segments."""
    each = node_rows.select("contract_id", "pos", F.posexplode("segments").alias("k", "s"))
    by_type = each.groupBy("contract_id", "pos", "s.type").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    dominant = by_type.groupBy("contract_id", "pos").agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("dominant_type"))
    x = lambda f, p, i: f(F.get(F.col(f"s.{p}"), F.lit(i)))
    size = each.groupBy("contract_id", "pos").agg(
        F.sum("s.length").alias("total_length"),
        *(F.least(x(F.min, "start", i), x(F.min, "end", i)).alias(f"min_{n}") for i, n in enumerate("xy")),
        *(F.greatest(x(F.max, "start", i), x(F.max, "end", i)).alias(f"max_{n}") for i, n in enumerate("xy")),
    )
    return size.join(dominant, ["contract_id", "pos"]).select(
        "contract_id", "pos", "dominant_type", F.bround("total_length", 6).alias("total_length"), "min_x", "min_y", "max_x", "max_y",
        F.bround((F.col("min_x") + F.col("max_x")) / 2, 6).alias("center_x"), F.bround((F.col("min_y") + F.col("max_y")) / 2, 6).alias("center_y"),
    )


def free_attributes(node_rows: DataFrame) -> DataFrame:
    """contract_id, pos, key, value of the attributes that are no geometry or annotation (texts keep all)."""
    drop = F.map_filter("raw_attributes", lambda k, _: ~k.isin("d", "semantic-id", "instance-id"))
    kept = F.when(F.col("geometry_type") == "text", F.col("raw_attributes")).otherwise(drop)
    return node_rows.select("contract_id", "pos", F.explode(kept).alias("key", "value"))
