"""Readers of contracts, attributes, pairs, splits, embeddings and images, with explicit schemas."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "array<double>"
CONTRACT = (
    "metadata struct<filename:string,viewbox:array<double>,epsilon:double,total_nodes:int,total_edges:int,total_symbols:int,layer_counts:map<string,int>>, "
    f"nodes array<struct<id:string,layer:string,semantic_id:int,instance_id:int,semantic_label:string,geometry_type:string,content:string,"
    f"segments:array<struct<type:string,start:{POINT},end:{POINT},length:double,extra:struct<rx:double,ry:double,x_rotation:double,large_arc:double,sweep:double>>>,"
    f"endpoints:struct<start:{POINT},end:{POINT}>,features:struct<length:double,center:{POINT},bbox:{POINT},geometry_type_onehot:array<int>,radius:double,rx:double,ry:double>,"
    "raw_attributes:map<string,string>>>, edges array<struct<source:string,target:string,relation:string,distance:double>>, "
    "symbols array<struct<symbol_id:string,semantic_id:int,instance_id:int,semantic_label:string,node_ids:array<string>,node_count:int>>, _corrupt_record string"
)
ATTRIBUTES = "floor_plan_id string, source_json string, inventory map<string,bigint>, adjacencies array<string>, density string"
PAIRS = "query string, graph_path string, floor_plan_id string, scale_bucket int, bedroom_count int, template_type string"


def read_contracts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Contracts of several folders in the order given, missing folders skipped.

    dir_ord and path order the rows; a file that is no JSON has ``_corrupt_record`` set.
    """
    parts = []
    for i, folder in enumerate(folders):
        if "://" in folder or os.path.isdir(folder):
            part = spark.read.schema(CONTRACT).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*_contract.json").json(folder)
            parts.append(part.select(F.lit(i).alias("dir_ord"), F.col("_metadata.file_path").alias("path"), "*"))
    if not parts:
        return spark.createDataFrame([], f"dir_ord int, path string, {CONTRACT}")
    return reduce(DataFrame.unionByName, parts)


def readable(contracts: DataFrame) -> DataFrame:
    return contracts.where(F.col("_corrupt_record").isNull())


def skipped(contracts: DataFrame) -> DataFrame:
    """The files that can't be read, by full path."""
    return contracts.where(F.col("_corrupt_record").isNotNull()).select("path")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects; what is no object becomes a row of nulls, which is dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).dropna("all")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_objects(spark, path, PAIRS)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    return read_objects(spark, path, ATTRIBUTES)


def read_embeddings(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """row, floor_plan_id, source_json, embedding; raises if lengths differ or rows repeat (one aggregate over the table)."""
    index = spark.read.parquet(path)
    got = index.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row").alias("rows"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if got.n != got.rows:
        raise ValueError(f"{got.n} vectors for {got.rows} rows")
    if got.n and (got.least != got.most or (dim is not None and got.least != dim)):
        raise ValueError(f"vectors of {got.least} to {got.most} entries" + (f", {dim} expected" if dim else ""))
    return index


def concatenated(parts: list[DataFrame], row: str = "row") -> DataFrame:
    """Indexes one after the other: the rows of each part are numbered on from the largest number of the parts before."""
    out, offset = None, 0
    for part in parts:
        moved = part.withColumn(row, F.col(row) + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += (part.agg(F.max(row).alias("m")).first().m if len(parts) > 1 else None) or 0
        offset += 1
    if out is None:
        raise ValueError("nothing to concatenate")
    return out


def guarded_attributes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Attributes from files of JSON lines, each record guarded by itself: the readable ones, and path and text of those that aren't."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")
    parsed = raw.withColumn("r", F.from_json("value", f"{ATTRIBUTES}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | F.col("r.floor_plan_id").isNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select("path", "value")


def query_vector(spark: SparkSession, values: object) -> DataFrame:
    """One row with the vector of a list, or of a list with one list in it."""
    v = list(values)  # type: ignore[call-overload]
    if len(v) == 1 and isinstance(v[0], (list, tuple)):
        v = list(v[0])
    if not v or any(isinstance(x, (list, tuple)) for x in v):
        raise ValueError("a query is one vector")
    return spark.createDataFrame([([float(x) for x in v],)], "embedding array<double>")


def random_vector(spark: SparkSession, dim: int, seed: int) -> DataFrame:
    import numpy as np

    return query_vector(spark, np.random.default_rng(seed).normal(size=dim).tolist())


def read_or_create(spark: SparkSession, path: str, build, n_rows: int | None = None) -> DataFrame:  # noqa: ANN001
    """The table at a path, made by ``build()`` and written there first if it isn't yet, or has other than ``n_rows`` rows."""
    try:
        held = spark.read.parquet(path)
        if n_rows is None or held.count() == n_rows:
            return held
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A written table of graph rows. Older ones lack fields, which are filled in: no path, and the label that the semantic ids give, or 0."""
    held = spark.read.parquet(path)
    if "graph_path" not in held.columns:
        held = held.withColumn("graph_path", F.lit(""))
    if "graph_label" not in held.columns:
        label = F.lit(0)
        if "semantic_ids" in held.columns:
            known = F.array_sort(F.filter("semantic_ids", lambda x: x >= 0))
            count = lambda x: F.size(F.filter(known, lambda y: y == x))
            most = F.array_min(F.transform(F.array_distinct(known), lambda x: F.struct((-count(x)).alias("n"), x.alias("id"))))
            label = F.coalesce(most["id"] + 1, F.lit(0))
        held = held.withColumn("graph_label", label.cast("int"))
    return held.withColumn("graph_path", F.coalesce("graph_path", F.lit(""))).withColumn("graph_label", F.coalesce("graph_label", F.lit(0)))


def query_rows(pairs: DataFrame) -> DataFrame:
    """floor_plan_id, query of the pairs that have both."""
    return pairs.select("floor_plan_id", "query").where("floor_plan_id is not null and query is not null")


def side_of_path(path: Column, train_root: str, test_root: str) -> Column:
    """train or test if the normalised path lies below one of the roots, else null; train wins where both hold it."""
    from posixpath import normpath

    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/(?:\./)+", "/"), r"/{2,}", "/")
    # a folder and the step back out of it cancel, from the innermost outwards
    for _ in range(8):
        clean = F.regexp_replace(clean, r"(^|/)(?!\.\.(?:/|$))[^/]+/\.\./", "$1")
    below = lambda root: clean.startswith(normpath(root).rstrip("/") + "/")
    return F.when(below(train_root), F.lit("train")).when(below(test_root), F.lit("test"))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """floor_plan_id and path of the ``*.png`` files of a folder; contents aren't read until asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("floor_plan_id"), "path", "length")


def pairs_with_images(pairs: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose plan has an image, and those without one."""
    keyed = pairs.withColumn("floor_plan_id", F.regexp_replace("floor_plan_id", r"\.svg$", ""))
    ids = images.select("floor_plan_id").distinct()
    return keyed.join(ids, "floor_plan_id", "left_semi"), keyed.join(ids, "floor_plan_id", "left_anti")
