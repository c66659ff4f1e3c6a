import pytest
from pyspark.sql import functions as F

from draftlake.operators import encoder, metrics
from draftlake.plans import pipeline

DRAWING = '<svg viewBox="0 0 100 100"><g id="WALL"><path d="M0 0 L10 0" semantic-id="14" instance-id="1"/><path d="M10 0 L20 0" semantic-id="15" instance-id="1"/><path d="M50 50 L60 60" semantic-id="14" instance-id="1"/></g><g id="WINDOW"><path d="M20 0.4 L30 0" semantic-id="16"/></g></svg>'


def test_drawings_to_pairs(spark, tmp_path):
    (tmp_path / "p.svg").write_text(DRAWING)
    elements, edges, symbols = pipeline.ingest_drawings(spark, str(tmp_path))
    assert [(r.source, r.target, r.relation, r.distance) for r in edges.orderBy("pos").collect()] == [("n00001", "n00002", "same_layer_adjacent", 0.0), ("n00002", "n00004", "wall_window", 0.004)]
    assert {(r.symbol_id, r.semantic_label, r.node_count) for r in symbols.collect()} == {("sym_14_1", "bed", 2), ("sym_15_1", "sofa", 1)}
    nodes = elements.withColumnRenamed("plan_id", "contract_id")
    attributes = pipeline.plan_attributes(nodes, edges.withColumnRenamed("plan_id", "contract_id"))
    a = attributes.first()
    assert a.inventory == {"bed": 2, "chair": 1, "sofa": 1} and a.adjacencies == ["bed is adjacent to the sofa", "chair is adjacent to the sofa"] and a.density == "compact"
    q = pipeline.query_pairs(attributes, F.col("contract_id")).first()
    assert "2 bedrooms, 1 chair, and 1 sofa" in q.query and q.query.endswith("Spatially, the bed is adjacent to the sofa, and the chair is adjacent to the sofa.") and q.scale_bucket == 1


def test_retrieval_finds_a_text_by_itself(spark):
    rows = [(i, f"{i} beds and {i + 1} sofas near room{i}", f"p{i}" + ".svg" * (i % 2), i % 4) for i in range(40)]
    pairs = spark.createDataFrame(rows, "pair_id long, query string, floor_plan_id string, scale_bucket int")
    texts = pairs.select(F.col("pair_id").alias("id"), F.col("query").alias("text"))
    index = encoder.hashed_words(texts).join(pairs.select(F.col("pair_id").alias("id"), "floor_plan_id"), "id").withColumnRenamed("id", "row")
    got = pipeline.evaluate(pairs.union(spark.createDataFrame([(99, "gone", "zzz", 0)], pairs.schema)), index, n_test=41)
    assert got["recall"].first().recall_at_1 == 1.0 and got["mrr"].first().mrr == 1.0
    c = got["coverage"].first()
    assert (c.n_test, c.n_answerable) == (41, 40)
    assert {r.bucket for r in got["by_bucket"].collect()} == {0, 1, 2, 3}
    hits = pipeline.retrieve(texts, index, 3)
    shown = pipeline.qualitative(hits, pairs.select(F.col("pair_id").alias("query_id"), "query", F.col("scale_bucket").alias("bucket")), pairs.select(F.col("pair_id").alias("query_id"), F.regexp_replace("floor_plan_id", r"\.svg$", "").alias("item")))
    assert shown.count() == 15 and shown.where("right").count() == 5


def test_pooling_and_layers(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0], False), (1, 1, [3.0, 0.0], False), (1, 2, [9.0, 9.0], True)], "contract_id long, node int, vector array<double>, pad boolean")
    assert encoder.mean_pool(v, ["contract_id"]).first().mean == [2.0, 1.0]
    held = v.where("not pad").drop("pad")
    assert encoder.graph_pool(held, ["contract_id"]).first().vector == [2.0, 1.0, 3.0, 2.0]
    edges = spark.createDataFrame([(1, 0, 1)], "contract_id long, src int, dst int")
    got = {r.node: r.neighbours for r in encoder.neighbour_mean(held, edges).collect()}
    assert got == {0: [0.0, 0.0], 1: [1.0, 2.0]}
    eye = [[1.0, 0.0], [0.0, 1.0]]
    layer = {r.node: r.vector for r in encoder.sage_layer(held, edges, eye, eye, [0.0, -3.0]).collect()}
    assert layer == {0: [1.0, 0.0], 1: [4.0, 0.0]}


def test_contrastive_loss(spark):
    import math

    s = spark.createDataFrame([(i, j, 1.0 if i == j else 0.0) for i in range(2) for j in range(2)], "i int, j int, score double")
    want = -math.log(math.exp(2) / (math.exp(2) + 1))
    assert metrics.contrastive_loss(s, 2.0).first().loss == pytest.approx(want, abs=1e-6)
    assert metrics.weighted_means(spark.createDataFrame([(1, 1.0), (3, 2.0)], "size int, value double")).first()["mean"] == 1.75


def test_training_batches(spark):
    pairs = spark.createDataFrame([(i, f"q{i}", f"/a/p{i % 4}.json", i % 2) for i in range(20)] + [(90, None, "/a/p0.json", 0), (91, "q", "/zzz.json", 0), (92, "q", "/other/p1.json", 1)], "pair_id long, query string, graph_path string, scale_bucket int")
    graphs = spark.createDataFrame([(f"/a/p{k}.json", [k]) for k in range(4)], "graph_path string, x array<int>")
    via = {r.pair_id: (r.graph_path, r.via) for r in pipeline.located(pairs, graphs).collect()}
    assert via[92] == ("/a/p1.json", "name") and via[0] == ("/a/p0.json", "path") and 91 not in via
    got = pipeline.training_batches(pairs, graphs, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.category)
    assert all(sorted(c) == [0, 0, 1, 1] for c in by.values()) and len(by) == 5 and {r.position for r in got} == {1, 2, 3, 4, 5}
    assert all(r.x == [r.pair_id % 4] for r in got if r.pair_id < 20)
