"""Graph encoder, graph rows, feature rows, caches and small helpers against plain Python."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake import index
from draftlake.functions import vectors
from draftlake.operators import contracts as ct
from draftlake.operators import graph_encoder as ge
from draftlake.operators import metrics
from draftlake.operators.encoder import encode_by_halves
from draftlake.sources import readers, sinks
from draftlake.sources.readers import CONTRACT


def naive(x, src, dst, layers, readout):
    """Message passing node by node."""
    n = len(x)
    for layer in layers:
        out = []
        for i in range(n):
            near = [j for j, k in zip(src, dst, strict=True) if k == i]
            if layer.other is not None:
                mean = np.mean([x[j] for j in near], axis=0) if near else np.zeros(len(x[i]))
                row = x[i] @ layer.own + mean @ layer.other + layer.bias
            else:
                degree = lambda k: 1 + sum(b == k for b in dst)
                row = sum((x[j] / math.sqrt(degree(i) * degree(j)) for j in [*near, i]), np.zeros(len(x[i]))) @ layer.own + layer.bias
            row = (row - row.mean()) / math.sqrt(row.var() + 1e-5) * layer.gain + layer.shift
            out.append(np.maximum(row, 0))
        x = np.array(out)
    out = np.maximum(np.concatenate([x.mean(0), x.max(0)]) @ readout.hidden + readout.hidden_bias, 0) @ readout.out + readout.out_bias
    return out / np.linalg.norm(out)


@pytest.mark.parametrize("gcn", [False, True])
def test_encoder_equals_node_by_node(spark, gcn):
    rng = np.random.default_rng(1)
    layers, readout = ge.seeded_weights(4, 8, 5, 3, gcn)
    graphs = []
    for g in range(6):
        n = int(rng.integers(1, 9))
        e = rng.integers(0, n, (2, int(rng.integers(0, 12))))
        graphs.append((g, rng.standard_normal((n, 4)).tolist(), [*e[0].tolist(), *e[1].tolist()], [*e[1].tolist(), *e[0].tolist()]))
    rows = [*graphs, (90, None, None, None), (91, [], [5], [0]), (92, graphs[0][1], [0, 77], [0, 1])]
    df = spark.createDataFrame(rows, "id long, x array<array<double>>, src array<int>, dst array<int>")
    got = {r.id: r.embedding for r in ge.encode_graphs(df, layers, readout).collect()}
    for g, x, src, dst in graphs:
        assert np.allclose(got[g], naive(np.array(x), src, dst, layers, readout), atol=1e-9)
        assert abs(np.linalg.norm(got[g]) - 1) < 1e-9
    assert got[90] == got[91] and len(got[92]) == 5
    with pytest.raises(ValueError, match="two layers"):
        ge.seeded_weights(4, n_layers=1)


def node(i, layer, kind, hot, semantic=-1, instance=-1):
    features = {"length": 2.0, "center": [0.5], "bbox": None, "geometry_type_onehot": hot, "radius": None, "rx": None, "ry": None}
    return {"id": i, "layer": layer, "semantic_id": semantic, "instance_id": instance, "semantic_label": None, "geometry_type": kind, "content": None, "segments": None, "endpoints": None, "features": features, "raw_attributes": None}


def contracts(spark):
    edge = lambda a, b: {"source": a, "target": b, "relation": "adjacent", "distance": 0.1}
    rows = [
        (1, None, [node("a", "WALL", "line", [1, 0, 0, 0, 0, 0, 0], 3), node("b", "DOOR", "spline", None, 3, 7), node("c", None, None, [0, 0, 1], 5)], [edge("a", "b"), edge("b", "zzz"), edge("c", "b")], None, None),
        (2, None, None, None, None, None), (3, None, [node("q", "WALL", "line", [1, 0, 0, 0, 0, 0, 0])], [], None, None), (4, None, [node("q", "X", "line", None)], [], None, "broken"),
    ]
    return spark.createDataFrame(rows, f"contract_id long, {CONTRACT}").withColumn("ingested_at", F.current_timestamp())


def test_graph_rows(spark):
    got = {r.id: r for r in ct.graph_rows(contracts(spark)).collect()}
    assert got.keys() == {1, 2, 3}
    assert got[1].x[0] == [2.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0] and got[1].x[1][7:] == [1.0, 3.0]
    assert sorted(zip(got[1].src, got[1].dst, strict=True)) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert (got[1].graph_label, got[2].graph_label, got[3].graph_label) == (4, 0, 0)
    assert got[2].x is None and got[2].src == [] and got[3].dst == []


def test_sparse_features_hold_the_contracts_own_onehot(spark):
    rows = ct.nodes(contracts(spark), "layer", "geometry_type", "features", "instance_id", "semantic_id")
    got = {(r.contract_id, r.pos): dict(zip(r.indices, r["values"], strict=True)) for r in ct.sparse_features(rows).collect()}
    # layers in the order first seen: UNK 0, WALL 1, DOOR 2; types: other 0, line 1, spline 2
    assert got[1, 0] == {0: 2.0, 1: 0.5, 8: 3.0, 9: 1.0, 17: 1.0, 20: 1.0}
    assert got[1, 1] == {0: 2.0, 1: 0.5, 7: 1.0, 8: 3.0, 18: 1.0, 21: 1.0}
    assert got[1, 2] == {0: 2.0, 1: 0.5, 8: 5.0, 11: 1.0, 16: 1.0, 19: 1.0}


def test_older_caches_are_filled_in(spark, tmp_path):
    spark.createDataFrame([(1, [3, 5, 5, -1]), (2, [4, 2]), (3, [-1]), (4, None)], "id long, semantic_ids array<int>").write.parquet(str(tmp_path / "old"))
    got = {r.id: (r.graph_path, r.graph_label) for r in readers.read_cache(spark, str(tmp_path / "old")).collect()}
    assert got == {1: ("", 6), 2: ("", 3), 3: ("", 0), 4: ("", 0)}
    spark.createDataFrame([(1, "p", 9), (2, None, None)], "id long, graph_path string, graph_label int").write.parquet(str(tmp_path / "new"))
    assert {(r.id, r.graph_path, r.graph_label) for r in readers.read_cache(spark, str(tmp_path / "new")).collect()} == {(1, "p", 9), (2, "", 0)}


def test_sides_of_normalised_paths(spark):
    rows = [("/d/train/x.json", "train"), ("/d//train/./x.json", "train"), ("/d/test/../train/x.json", "train"), ("/d/train2/x.json", None), ("/d/test/a/b.json", "test"), ("train/x.json", None), ("\\d\\test\\q.json", "test"), (None, None)]
    df = spark.createDataFrame(rows, "path string, want string")
    for r in df.select("path", "want", readers.side_of_path(F.col("path"), "/d/train", "/d/test/").alias("side")).collect():
        assert r.side == r.want, r.path


def test_reports_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(r.a for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]
    document = json.loads(sinks.report_document({"rows": df, "metrics": df.agg(F.count("b").alias("n"))}).first().document)
    assert document["metrics"] == [{"n": 1}] and len(document["rows"]) == 2
    with pytest.raises(ValueError):
        sinks.report_document({})
    assert readers.query_rows(spark.createDataFrame([("p", "q"), (None, "q"), ("p", None)], "floor_plan_id string, query string")).count() == 1


def test_metrics_in_both_directions(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4)], "query_id long, rank long")
    got = {r.direction: r for r in metrics.both_directions(ranks, ranks.limit(1)).collect()}
    assert got["forward"].r_at_1 == 50.0 and got["forward"].mrr == 62.5
    assert set(got) == {"forward", "backward"}


def test_too_large_batches_are_halved():
    sizes = []

    def encode(items):
        if len(items) > 3:
            raise MemoryError
        sizes.append(len(items))
        return [i * 10 for i in items]

    assert encode_by_halves(encode, list(range(10))) == [i * 10 for i in range(10)] and max(sizes) <= 3
    assert encode_by_halves(encode, []) == []

    def never(items):
        raise MemoryError

    with pytest.raises(MemoryError):
        encode_by_halves(never, [1])


def test_index_command(spark, tmp_path, capsys):
    rows = [(0, "a", [1.0, 0.0]), (1, "b.svg", [0.0, 1.0]), (2, "c", [0.6, 0.8])]
    spark.createDataFrame(rows, "row long, floor_plan_id string, embedding array<double>").write.parquet(str(tmp_path / "i"))
    (tmp_path / "v.json").write_text("[[0.0, 2.0]]")
    index.main(["--index", str(tmp_path / "i"), "--vector", str(tmp_path / "v.json"), "--top-k", "2"])
    assert [json.loads(x)["row"] for x in capsys.readouterr().out.split("\n") if x.startswith("{")] == [1, 2]
    index.main(["--index", str(tmp_path / "i"), "--plan", "b", "--out", str(tmp_path / "o")])
    assert {r.row for r in spark.read.json(str(tmp_path / "o")).where("rank = 1").collect()} == {1}
    index.main(["--index", str(tmp_path / "i"), "--random", "3", "--top-k", "9"])
    with pytest.raises(SystemExit):
        index.main(["--index", "x", "--random", "3", "--plan", "b"])
    with pytest.raises(Exception, match="no vector of the plan"):
        index.main(["--index", str(tmp_path / "i"), "--plan", "zzz"])


def test_reading_helpers(spark, tmp_path):
    two = readers.concatenated([spark.createDataFrame([(0, "a"), (1, "b")], "row long, k string"), spark.createDataFrame([(0, "c")], "row long, k string")])
    assert sorted((r.row, r.k) for r in two.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    build = lambda: spark.range(3)
    assert readers.read_or_create(spark, str(tmp_path / "t"), build, 3).count() == 3
    assert readers.read_or_create(spark, str(tmp_path / "t"), lambda: spark.range(5), 3).count() == 3
    assert readers.read_or_create(spark, str(tmp_path / "t"), lambda: spark.range(5), 5).count() == 5
    (tmp_path / "a.json").write_text('{"floor_plan_id": "p", "inventory": {"bed": 2}}\nnot json\n\n{"floor_plan_id": "q", "inventory": 7}\n')
    good, bad = readers.guarded_attributes(spark, str(tmp_path / "a.json"))
    assert [r.floor_plan_id for r in good.collect()] == ["p"] and sorted(r.value for r in bad.collect()) == ["not json", '{"floor_plan_id": "q", "inventory": 7}']


def test_small_rules(spark):
    df = spark.createDataFrame([("7", 2.0), ("x", 0.0), (None, None)], "s string, r double").coalesce(1)
    got = df.select(vectors.safe(F.col("s"), "int", -1).alias("i"), vectors.circumference(F.col("r")).alias("c"), vectors.temperature(F.col("r")).alias("t")).collect()
    assert [r.i for r in got] == [7, -1, -1] and got[0].c == pytest.approx(4 * math.pi) and got[2].c is None
    assert got[0].t == pytest.approx(math.exp(-2)) and got[1].t == 1.0
    assert spark.range(1).select(vectors.temperature(F.lit(50.0)).alias("t")).first().t == 0.01
