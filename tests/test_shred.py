import json
from datetime import datetime

from pyspark.sql import functions as F

from draftlake.operators import shred
from draftlake.sources.readers import CONTRACT


def contract(spark, rows):
    schema = f"contract_id long, {CONTRACT}, ingested_at timestamp, extra string"
    return spark.createDataFrame([(i, None, n, e, s, bad, datetime(2025, 1, day), "x") for i, n, e, s, bad, day in rows], schema)


def node(i):
    return {"id": i, "layer": None, "semantic_id": 1, "instance_id": -1, "semantic_label": None, "geometry_type": "line", "content": None, "segments": None, "endpoints": None, "features": None, "raw_attributes": None}


def edge(a, b):
    return {"source": a, "target": b, "relation": None, "distance": None}


def symbol(*ids):
    return {"symbol_id": "s", "semantic_id": 1, "instance_id": 1, "semantic_label": None, "node_ids": list(ids), "node_count": len(ids)}


def found(parts):
    return sorted((r.contract_id, r.link, r.ordinal, r.node_ref) for p in parts for r in shred.dangling_references(p).collect())


def raw(spark, bodies):
    return spark.createDataFrame([(i, "f", b, datetime(2025, 1, 1 + k)) for k, (i, b) in enumerate(bodies)], "contract_id long, source_json string, body string, received_at timestamp")


def test_dangling_references(spark):
    df = contract(
        spark,
        [
            (1, [node("n00001"), node("n00002")], [edge("N1", " 2 "), edge("n3", None), edge("n0000002", "x")], [symbol("1", "n00009", None)], None, 1),
            (1, [node("n00001"), node("n00002")], [edge("N1", " 2 "), edge("n3", None), edge("n0000002", "x")], [symbol("1", "n00009", None)], None, 2),
            (2, None, None, None, "bad", 1),
            (3, [], [edge("", "n1")], [], None, 1),
            (None, [], [edge("", "n1")], [], None, 1),
        ],
    )
    assert found(shred.contract_adjacency(df, None, shred.LINK_PATHS)) == [
        (1, "source", 1, "n3"), (1, "symbol", 0, ""), (1, "symbol", 0, "n00009"), (1, "target", 1, ""), (1, "target", 2, "x"), (3, "source", 0, ""), (3, "target", 0, "n1"),
    ]


def test_json_layouts(spark):
    nodes = [{"id": "n00001"}, {"id": 2}]
    bodies = [
        (10, json.dumps({"nodes": nodes, "edges": [{"source": 1, "target": 2.0}, {"source": 7}]})),
        (11, json.dumps({"version": 2, "contract": {"nodes": nodes, "edges": {"source": "n9", "target": "n1"}}})),
        (12, json.dumps({"graph": {"nodes": nodes, "edges": None}, "symbols": [{"node_ids": [1, None]}, {"node_ids": None}]})),
        (13, "<svg/>"), (14, None), (15, "[1, 2]"), (16, '{"nodes": ['), (17, "{}"),
        (10, "broken later"), (None, "{}"),
    ]
    parts = shred.contract_adjacency(contract(spark, []), raw(spark, bodies), shred.LINK_PATHS)
    assert found(parts) == [(10, "source", 1, "7"), (10, "target", 1, ""), (11, "source", 0, "n9"), (12, "symbol", 0, "")]


def test_entity_tables_keep_parents_and_order(spark):
    n = node("n00001") | {"features": {"length": 2.5, "center": [0.1, 0.2], "bbox": None, "geometry_type_onehot": [1, 0], "radius": None, "rx": None, "ry": None}}
    n["segments"] = [{"type": "line", "start": [0.0, 1.0], "end": [2.0, 3.0], "length": 4.0, "extra": None}, {"type": "arc", "start": None, "end": None, "length": None, "extra": None}]
    df = contract(spark, [(1, [node("n00002"), n], [], [], None, 1)])
    (a,) = shred.contract_adjacency(df, None, shred.CONTRACT_PATHS)
    rows = shred.adjacency_rows(a)
    nodes = shred.entity_table(rows, "nodes", {"id": ("id", 0, "string"), "length": ("features.length", 0, "double"), "y": ("features.center", 1, "double")})
    got = {r.ordinal: r for r in nodes.collect()}
    assert (got[0].id, got[0].length, got[1].id, got[1].length, got[1].y) == ("n00002", None, "n00001", 2.5, 0.2)
    segments = shred.entity_table(rows, "segments", {"type": ("type", 0, "string"), "x": ("end", 0, "double")}).collect()
    assert sorted((r.ordinal, r.type, r.x) for r in segments) == [(0, "line", 2.0), (1, "arc", None)]
    assert {r.parent for r in segments} == {got[1].key}


def test_empty(spark):
    assert found(shred.contract_adjacency(contract(spark, []), raw(spark, [(1, "x")]).where("false"), shred.LINK_PATHS)) == []


def test_node_number(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("n00007",), (" N7",), ("7",), ("7.0",), ("n-7",), ("0",), ("",)], "x string").select(shred.node_number(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == ["7", "7", "7", "7", "n-7", "0", ""]


def test_flat_tables_hold_every_link_and_contract(spark, tmp_path):
    import __spark_entry__ as entry

    ended = node("n00002") | {"endpoints": {"start": [1.0, 2.0], "end": [3.0, 4.0]}}
    typed = contract(
        spark,
        [(1, [node("n00001"), ended, node("2")], [], [symbol("N1", None, "n9"), symbol(), symbol("2", "2.0")], None, 1), (2, None, None, None, None, 1), (3, [], [], [], None, 1), (4, None, None, None, "bad", 1), (4, None, None, None, "bad", 2)],
    )
    typed.write.parquet(str(tmp_path / "contracts.parquet"))
    bodies = [(10, json.dumps({"graph": {"nodes": [{"id": 7, "endpoints": {"start": [5, 6], "end": None}}]}, "symbols": [{"node_ids": 7}]})), (11, "{}"), (12, "<svg/>")]
    raw(spark, bodies).write.parquet(str(tmp_path / "raw_contracts.parquet"))
    table = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.contract_id, r.symbol, r.position, r.node_ref, -1 if r.node is None else r.node) for r in table("p4_symbol_nodes")) == [
        (1, 0, 0, "N1", 0), (1, 0, 1, "", -1), (1, 0, 2, "n9", -1), (1, 2, 0, "2", 2), (1, 2, 1, "2.0", 2), (10, 0, 0, "7", 0),
    ]
    ends = {(r.contract_id, r.ordinal): (r.start_x, r.start_y, r.end_x, r.end_y) for r in table("p4_nodes")}
    assert ends == {(1, 0): (None,) * 4, (1, 1): (1.0, 2.0, 3.0, 4.0), (1, 2): (None,) * 4, (10, 0): (5.0, 6.0, None, None)}
    held = {r.contract_id: (r.readable, r.held_nodes, r.held_symbols) for r in table("p4_contracts")}
    assert held == {1: (True, 3, 3), 2: (True, 0, 0), 3: (True, 0, 0), 4: (False, 0, 0), 10: (True, 1, 1), 11: (True, 0, 0)}


def test_attributes_extras_and_repeated_places(spark):
    body = """{"nodes": [{"id": "n1", "raw_attributes": {"stroke": "red", "a.b": null}, "features": {"center": [[1, 2], [3, 4]]},
        "segments": [{"type": "arc", "extra": {"rx": 2.5, "sweep": 1}}]}], "metadata": {"viewbox": [0, 0, 10, "x"], "layer_counts": {"WALL": 1}}}"""
    raw = spark.createDataFrame([(7, body)], "contract_id long, body string").withColumn("received_at", F.current_timestamp())
    paths = (*shred.CONTRACT_PATHS, "metadata")
    adjacency = shred.latest(shred.adjacency_of_json(raw, "contract_id", "body", "received_at", paths), "record_id", F.desc("at"))
    rows = shred.adjacency_rows(adjacency).cache()
    nodes = shred.entity_table(rows, "nodes", {"id": ("id", 0, "string"), "x": ("features.center", 0, "double"), "y": ("features.center", 1, "double")}).collect()
    assert [(r.id, r.x, r.y) for r in nodes] == [("n1", 1.0, 2.0)]
    named = shred.named_scalars(rows, "raw_attributes").collect()
    assert {(r.name, r.value) for r in named if r.value} == {("stroke", "red")} and {r.parent for r in named} == {nodes[0].key}
    assert [(r.name, r.value, r.parent) for r in shred.named_scalars(rows, "metadata.layer_counts").collect()] == [("WALL", "1", 0)]
    (segment,) = shred.entity_table(rows, "segments", {"type": ("type", 0, "string"), "rx": ("extra.rx", 0, "double")}).collect()
    assert (segment.type, segment.rx, segment.parent) == ("arc", 2.5, nodes[0].key)
