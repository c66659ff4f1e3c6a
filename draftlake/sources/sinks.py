"""Writers. Tables go to Parquet; JSON documents are written one per row where other tools read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contract_documents(elements: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """plan_id and one JSON document per plan, its nodes, edges and symbols in order."""
    node = F.struct(
        "id", "layer", "semantic_id", "instance_id", "semantic_label", "geometry_type", "content", "segments", F.struct("start", "end").alias("endpoints"),
        F.struct("length", "center", "bbox", "geometry_type_onehot", "radius", "rx", "ry").alias("features"), "raw_attributes",
    )

    def ordered(pos: str, item: Column) -> Column:
        # by position alone, as items hold maps, which have no order
        by_position = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), item.alias("item"))), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
        return F.transform(by_position, lambda x: x["item"])

    nodes = elements.where("pos is not null").groupBy("plan_id").agg(F.first("filename").alias("filename"), F.first("viewbox").alias("viewbox"), ordered("pos", node.alias("item")).alias("nodes"))
    linked = edges.groupBy("plan_id").agg(ordered("pos", F.struct("source", "target", "relation", "distance")).alias("edges"))
    grouped = symbols.groupBy("plan_id").agg(ordered("symbol_id", F.struct("symbol_id", "semantic_id", "instance_id", "semantic_label", "node_ids", "node_count")).alias("symbols"))
    whole = nodes.join(linked, "plan_id", "left").join(grouped, "plan_id", "left")
    metadata = F.struct("filename", "viewbox", F.size("nodes").alias("total_nodes"), F.coalesce(F.size("edges"), F.lit(0)).alias("total_edges"), F.coalesce(F.size("symbols"), F.lit(0)).alias("total_symbols"))
    return whole.select("plan_id", F.to_json(F.struct(metadata.alias("metadata"), "nodes", "edges", "symbols")).alias("document"))


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON text per line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line: attributes, pairs, splits, search results and reports for other tools."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def report_document(parts: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text with the rows of each (small) table of a report under its name."""
    whole = None
    for name, df in parts.items():
        part = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        whole = part if whole is None else whole.crossJoin(part)  # one row each
    if whole is None:
        raise ValueError("a report has at least one table")
    return whole.select(F.to_json(F.struct(*parts)).alias("document"))


def write_index(embeddings: DataFrame, path: str) -> DataFrame:
    """Write an embedding index and return its one-row summary."""
    embeddings.write.mode("overwrite").parquet(path)
    back = embeddings.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("embedding")).alias("dim"), F.countDistinct("floor_plan_id").alias("n_plans"))
