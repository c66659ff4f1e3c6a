"""Deeply nested records as an adjacency table, and entity tables pivoted from it.

Every object, array element and scalar of a record becomes a row (node, parent,
label, ordinal, scalar) of its record. Elements of an array hang on the array's
owner under the array's label, with their position as ordinal; objects that occur
once (``features``) lend their scalars to their owner under a dotted label, so an
entity's scalars are one join away. Entity tables come back by bringing object
nodes and their scalar children together and pivoting.

Scale. A record's rows are built inside its row and the records are partitioned by
id once, when repeated records are dropped; object nodes meet their children, and
references meet the nodes they name, within that partitioning, so the adjacency
table itself is never shuffled. Only the wanted paths are read and shredded.

Edge cases: null objects and arrays have no rows; null array elements are kept as
nodes without children, null scalars in arrays as null; ids may be typed loosely
(``n00007``, ``N7``, ``7``, ``7.0``); unreadable documents and rows without an id have no rows; of a
repeated record the latest readable one counts; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROW = "node: bigint, parent: bigint, label: string, ordinal: int, is_object: boolean, scalar: string"
ADJACENCY = f"array<struct<{ROW}>>"

#: Paths of the tables of a contract; dotted below an entity.
CONTRACT_PATHS = (
    "metadata", "nodes.id", "nodes.layer", "nodes.semantic_id", "nodes.instance_id", "nodes.semantic_label", "nodes.geometry_type", "nodes.content",
    "nodes.segments", "nodes.endpoints", "nodes.features", "nodes.raw_attributes", "edges", "symbols",
)
LINK_PATHS = ("nodes.id", "edges.source", "edges.target", "symbols.node_ids")


def _wanted(path: str, paths: tuple[str, ...]) -> bool:
    return any(path == p or path.startswith(p + ".") or p.startswith(path + ".") for p in paths)


def _row(node: Column, parent: Column, label: str | Column, ordinal: Column, is_object: bool, scalar: Column | None) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    value = F.lit(None).cast("string") if scalar is None else scalar.cast("string")
    return F.struct(node.alias("node"), parent.alias("parent"), name.alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(is_object).alias("is_object"), value.alias("scalar"))


def _branch(c: Column, kind: T.DataType, path: str, label: str, ordinal: Column, parent: Column, paths: tuple[str, ...], in_array: bool) -> Column | None:
    """Array of adjacency rows below one value."""
    none = F.array().cast(ADJACENCY)
    if isinstance(kind, T.StructType):
        node = F.xxhash64(parent, F.lit(label), ordinal)
        below = node if in_array else parent
        prefix = "" if in_array else f"{label}."
        parts = [
            _branch(c[f.name], f.dataType, f"{path}.{f.name}", prefix + f.name, F.lit(0), below, paths, False) for f in kind.fields if _wanted(f"{path}.{f.name}", paths)
        ]
        rows = F.concat(F.array(_row(node, parent, label, ordinal, True, None)), *(p for p in parts if p is not None))
        return rows if in_array else F.when(c.isNotNull(), rows).otherwise(none)
    if isinstance(kind, T.ArrayType):
        rows = F.flatten(F.transform(c, lambda x, i: _branch(x, kind.elementType, path, label, i, parent, paths, True)))
        return F.coalesce(rows, none)
    if isinstance(kind, T.MapType):
        entry = lambda e: _row(F.xxhash64(parent, F.lit(label), e["key"]), parent, F.concat(F.lit(f"{label}."), e["key"].cast("string")), F.lit(0), False, e["value"])
        return F.coalesce(F.transform(F.map_entries(c), entry), none)
    row = F.array(_row(F.xxhash64(parent, F.lit(label), ordinal), parent, label, ordinal, False, c))
    return row if in_array else F.when(c.isNotNull(), row).otherwise(none)


def adjacency_of_columns(records: DataFrame, record_id: str, columns: list[str], paths: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """record_id, ``keep`` and the array of adjacency rows of typed nested columns; the root is node 0."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    root = F.lit(0).cast("long")
    parts = [_branch(F.col(c), kinds[c], c, c, F.lit(0), root, paths, False) for c in columns if _wanted(c, paths)]
    return records.select(F.col(record_id).alias("record_id"), *keep, F.concat(*parts).alias("adjacency"))


def shred_value(value: object, paths: tuple[str, ...], arrays: frozenset[str]) -> list[dict]:
    """Adjacency rows of one parsed JSON object. ``arrays`` names the paths that hold entities, whether written as an array, one object or a mapping of objects."""
    out: list[dict] = []
    seen: set[int] = set()

    def emit(parent: int, label: str, ordinal: int, is_object: bool, scalar: object) -> int:
        node = xxhash.xxh3_64_intdigest(f"{parent}/{label}/{ordinal}") - (1 << 63)
        if node in seen:  # arrays within an array repeat places; the first one counts
            return node
        seen.add(node)
        if isinstance(scalar, bool):
            scalar = str(scalar).lower()
        out.append({"node": node, "parent": parent, "label": label, "ordinal": ordinal, "is_object": is_object, "scalar": None if scalar is None else str(scalar)})
        return node

    def walk(v: object, path: str, label: str, ordinal: int, parent: int, in_array: bool) -> None:
        if path in arrays and not in_array:
            if isinstance(v, dict):
                v = list(v.values()) if v and all(isinstance(x, dict) for x in v.values()) else [v]
            elif v is not None and not isinstance(v, list):
                v = [v]
        if isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, path, label, i, parent, True)
        elif isinstance(v, dict) or (v is None and in_array and path in arrays and path.count(".") == 0):
            node = emit(parent, label, ordinal, True, None)
            for k, x in (v or {}).items():
                if _wanted(f"{path}.{k}", paths):
                    walk(x, f"{path}.{k}", k if in_array else f"{label}.{k}", 0, node if in_array else parent, False)
        elif v is not None or in_array:
            emit(parent, label, ordinal, False, v)

    for k, x in (value.items() if isinstance(value, dict) else ()):
        if _wanted(k, paths):
            walk(x, k, k, 0, 0, False)
    return out


_ENTITIES = frozenset(("nodes", "edges", "symbols", "symbols.node_ids", "nodes.segments"))
_WRAPPERS = ("contract", "graph", "data", "plan", "payload")


def unwrap(document: object) -> dict | None:
    """The contract inside its wrappers, entities of inner objects brought to the top; None if there is none."""
    if not isinstance(document, dict):
        return None
    out = {k: v for k, v in document.items() if k not in _WRAPPERS or not isinstance(v, dict)}
    for k in _WRAPPERS:
        inner = unwrap(document[k]) if isinstance(document.get(k), dict) else None
        if inner:
            out |= {name: v for name, v in inner.items() if v is not None or name not in out}
    return out


def adjacency_of_json(raw: DataFrame, record_id: str, body: str, order: str, paths: tuple[str, ...]) -> DataFrame:
    """record_id, order, readable, adjacency of JSON texts in any of the known layouts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["body"]:
                try:
                    contract = unwrap(json.loads(text)) if text else None
                except (ValueError, RecursionError):
                    contract = None
                rows.append(None if contract is None else shred_value(contract, paths, _ENTITIES))
            yield pd.DataFrame({"record_id": pdf["record_id"], "at": pdf["at"], "readable": [r is not None for r in rows], "adjacency": [r or [] for r in rows]})

    kept = raw.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("record_id"), F.unix_micros(order).alias("at"), F.col(body).alias("body"))
    return kept.mapInPandas(run, f"record_id long, at long, readable boolean, adjacency {ADJACENCY}")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first by ``order``; leaves the data partitioned by key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def _narrow(c: Column, kind: T.DataType, path: str, paths: tuple[str, ...]) -> Column:
    """Keep only the wanted fields, so that the scan reads no others."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        fields = [f for f in kind.elementType.fields if _wanted(f"{path}.{f.name}", paths)]
        if len(fields) == len(kind.elementType.fields):
            return c
        return F.arrays_zip(*(c[f.name].alias(f.name) for f in fields))
    return c


def contract_adjacency(contracts: DataFrame, raw: DataFrame | None, paths: tuple[str, ...]) -> list[DataFrame]:
    """record_id, readable, adjacency per source; each partitioned by record_id with every record once."""
    columns = [c for c in ("metadata", "nodes", "edges", "symbols") if _wanted(c, paths)]
    kinds = {f.name: f.dataType for f in contracts.schema.fields}
    slim = contracts.where("contract_id is not null").select(
        "contract_id", F.col("_corrupt_record").isNull().alias("readable"), F.unix_micros("ingested_at").alias("at"), *(_narrow(F.col(c), kinds[c], c, paths).alias(c) for c in columns)
    )
    once = latest(slim, "contract_id", F.desc("readable"), F.desc("at"))
    out = [adjacency_of_columns(once, "contract_id", columns, paths, ("readable",))]
    if raw is not None:
        parsed = latest(adjacency_of_json(raw, "contract_id", "body", "received_at", paths), "record_id", F.desc("readable"), F.desc("at"))
        out.append(parsed.select("record_id", "readable", "adjacency"))
    return out


def adjacency_rows(packed: DataFrame) -> DataFrame:
    """The adjacency table: record_id, node, parent, label, ordinal, is_object, scalar."""
    # explode would make Catalyst build every array twice, to filter out the empty ones beforehand
    return packed.select("record_id", F.explode_outer("adjacency").alias("r")).where("r is not null").select("record_id", "r.*")


def entity_table(rows: DataFrame, entity: str, fields: dict[str, tuple[str, int, str]]) -> DataFrame:
    """record_id, key, parent, ordinal and the fields of one entity's objects.

    fields: name -> (label, ordinal, type). Object nodes and their scalar children
    meet on the object's node and are pivoted by one map per object; records stay where they are.
    """
    labels = {label for label, _, _ in fields.values()}
    mine = rows.where((F.col("is_object") & (F.col("label") == entity)) | (~F.col("is_object") & F.col("label").isin(*labels)))
    key = F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent"))
    # of an array the position is part of the name; null scalars need no entry
    many = {label for label, i, _ in fields.values() if i}
    name = F.when(F.col("label").isin(*many), F.concat("label", F.lit("/"), F.col("ordinal").cast("string"))).otherwise(F.col("label")) if many else F.col("label")
    first = (F.col("ordinal") == 0) | (F.col("label").isin(*many) if many else F.lit(False))
    of_object = lambda c: F.max(F.when(F.col("is_object"), F.col(c))).alias(c)
    wide = mine.groupBy("record_id", key.alias("key")).agg(
        F.max("is_object").alias("held"), of_object("ordinal"), of_object("parent"),
        F.collect_list(F.when(~F.col("is_object") & first & F.col("scalar").isNotNull(), F.struct(name, "scalar"))).alias("scalars"),
    ).where("held")
    cells = wide.select("record_id", "key", "parent", "ordinal", F.map_from_entries("scalars").alias("cells"))
    at = lambda label, i: F.try_element_at("cells", F.lit(f"{label}/{i}" if label in many else label))
    return cells.select("record_id", "key", "parent", "ordinal", *(at(label, i).try_cast(kind).alias(n) for n, (label, i, kind) in fields.items()))


def named_scalars(rows: DataFrame, prefix: str) -> DataFrame:
    """record_id, parent, name, value of the entries of a map, or of an object of free keys, under the label ``prefix``."""
    held = rows.where(~F.col("is_object") & F.col("label").startswith(f"{prefix}."))
    return held.select("record_id", "parent", F.substring("label", len(prefix) + 2, 1_000_000).alias("name"), F.col("scalar").alias("value"))


def node_number(c: Column) -> Column:
    """References are equal if their numbers are: ``n00007``, ``N7`` and ``7``. Others stand for themselves."""
    low = F.lower(F.trim(c))
    number = F.regexp_extract(low, r"^n?0*([0-9]+)(?:\.0+)?$", 1)
    return F.when(number != "", number).otherwise(low)


def dangling_references(adjacency: DataFrame) -> DataFrame:
    """contract_id, link, ordinal, node_ref of the references to a node that their contract does not hold."""
    rows = adjacency_rows(adjacency)
    key = F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent"))
    scalar = lambda label: F.max(F.when(~F.col("is_object") & (F.col("label") == label), F.col("scalar")))
    # object nodes with their scalar children; an entity's label tells which of the pivoted columns are its own
    entities = rows.groupBy("record_id", key.alias("key")).agg(
        F.max(F.when(F.col("is_object"), F.col("label"))).alias("entity"),
        F.max(F.when(F.col("is_object"), F.col("ordinal"))).alias("ordinal"),
        scalar("id").alias("id"), scalar("source").alias("source"), scalar("target").alias("target"),
        F.collect_list(F.when(~F.col("is_object") & (F.col("label") == "node_ids"), F.coalesce("scalar", F.lit("")))).alias("node_ids"),
    )
    ref = lambda link, c: F.struct(F.lit(link).alias("link"), F.trim(F.coalesce(c, F.lit(""))).alias("node_ref"))
    named = (
        F.when(F.col("entity") == "nodes", F.array(ref("node", F.col("id"))))
        .when(F.col("entity") == "edges", F.array(ref("source", F.col("source")), ref("target", F.col("target"))))
        .when(F.col("entity") == "symbols", F.transform("node_ids", lambda x: ref("symbol", x)))
    )
    refs = entities.select("record_id", "ordinal", F.explode(named).alias("r")).select("record_id", "ordinal", "r.link", "r.node_ref")
    same = Window.partitionBy("record_id", node_number(F.col("node_ref")))
    held = F.max(((F.col("link") == "node") & (F.col("node_ref") != "")).cast("int")).over(same)
    lost = refs.withColumn("held", held).where((F.col("link") != "node") & (F.col("held") == 0))
    return lost.select(F.col("record_id").alias("contract_id"), "link", "ordinal", "node_ref")


def symbol_members(adjacency: DataFrame) -> DataFrame:
    """contract_id, symbol (its ordinal), position, node_ref and node of every entry of node_ids.

    node is the ordinal of the node it names, the last one where ids repeat, and null if
    the contract holds none.
    """
    rows = adjacency_rows(adjacency)
    key = F.when(F.col("is_object"), F.col("node")).otherwise(F.col("parent"))
    scalar = lambda label: ~F.col("is_object") & (F.col("label") == label)
    entities = rows.groupBy("record_id", key.alias("key")).agg(
        F.max(F.when(F.col("is_object"), F.col("label"))).alias("entity"),
        F.max(F.when(F.col("is_object"), F.col("ordinal"))).alias("ordinal"),
        F.max(F.when(scalar("id"), F.col("scalar"))).alias("id"),
        F.collect_list(F.when(scalar("node_ids"), F.struct(F.col("ordinal").alias("position"), F.coalesce("scalar", F.lit("")).alias("ref")))).alias("node_ids"),
    )
    ref = lambda link, position, c: F.struct(F.lit(link).alias("link"), position.alias("position"), F.trim(F.coalesce(c, F.lit(""))).alias("node_ref"))
    named = F.when(F.col("entity") == "nodes", F.array(ref("node", F.lit(None).cast("int"), F.col("id")))).when(
        F.col("entity") == "symbols", F.transform("node_ids", lambda x: ref("symbol", x["position"], x["ref"]))
    )
    refs = entities.select("record_id", "ordinal", F.explode(named).alias("r")).select("record_id", "ordinal", "r.link", "r.position", "r.node_ref")
    same = Window.partitionBy("record_id", node_number(F.col("node_ref")))
    node = F.max(F.when((F.col("link") == "node") & (F.col("node_ref") != ""), F.col("ordinal"))).over(same)
    return refs.withColumn("node", node).where("link = 'symbol'").select(F.col("record_id").alias("contract_id"), F.col("ordinal").alias("symbol"), "position", "node_ref", "node")
