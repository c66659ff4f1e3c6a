import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from draftlake.operators import contracts as ct
from draftlake.operators import proximity, sampling

SCHEMA = "contract_id long, pos int, id string, layer string, semantic_id int, instance_id int, semantic_label string, geometry_type string"


def nodes(spark, rows):
    return spark.createDataFrame([(1, i, f"n{i}", *r) for i, r in enumerate(rows)], SCHEMA)


def test_inventory_and_low_signal(spark):
    df = nodes(spark, [("W", 1, -1, "sofa", "line"), ("W", 1, -1, " sofa ", "line"), ("W", 1, -1, "A-WALL", "line"), ("W", 1, -1, None, "line"), ("W", 2, -1, "bed", "line")])
    inv = ct.label_inventory(df)
    assert {(r.label, r.n) for r in inv.collect()} == {("sofa", 2), ("bed", 1)}
    assert ct.low_signal(inv).count() == 1
    assert ct.low_signal(inv.where("label = 'bed'")).count() == 0
    assert ct.inventory_maps(inv).first().inventory == {"bed": 1, "sofa": 2}


def test_graph_label_takes_the_smallest_on_a_tie(spark):
    assert ct.graph_label(nodes(spark, [("W", 5, -1, "a", "line"), ("W", 3, -1, "a", "line"), ("W", -1, -1, "a", "line")])).first().graph_label == 4
    assert ct.graph_label(nodes(spark, [("W", -1, -1, "a", "line")])).first().graph_label == 0


def test_symbols(spark):
    df = nodes(spark, [("W", 5, 1, "a", "line"), ("W", 5, -1, "a", "line"), ("W", 5, 1, "a", "line"), ("W", -1, 2, "a", "line")])
    assert [(r.symbol_id, r.node_ids, r.node_count) for r in ct.symbols(df).collect()] == [("sym_5_1", ["n0", "n2"], 2)]


def test_adjacency_is_unordered_and_distinct(spark):
    df = nodes(spark, [("W", 1, -1, "sofa", "line"), ("W", 1, -1, "bed", "line"), ("W", 1, -1, "wall", "line"), ("W", 1, -1, "sofa", "line")])
    edges = spark.createDataFrame([(1, 0, "n0", "n1"), (1, 1, "n1", "n3"), (1, 2, "n0", "n2"), (1, 3, "n0", "n3"), (1, 4, "n0", "gone")], "contract_id long, pos int, source string, target string")
    assert [r.sentence for r in ct.adjacency_pairs(df, edges).collect()] == ["bed is adjacent to the sofa"]


def test_vocabulary_in_the_order_first_seen(spark):
    df = nodes(spark, [("B", 1, -1, "a", "line"), ("A", 1, -1, "a", "line"), ("B", 1, -1, "a", "line"), (None, 1, -1, "a", "line")])
    assert {(r.value, r["index"]) for r in ct.vocabulary(df, "layer", "UNK").collect()} == {("UNK", 0), ("B", 1), ("A", 2)}


def _naive(points, eps):
    out = {}
    for (i, a), (j, b) in itertools.combinations(points, 2):
        d = min(math.dist(p, q) for p in a for q in b)
        if d <= eps:
            out[i, j] = d
    return out


def test_proximity_equals_the_double_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for plan in range(12):
        eps = rng.choice([0.0, 0.02, 0.1, 0.3])
        grid = rng.choice([0.02, 0.05])
        points = [(i, [(round(rng.random() / grid) * grid, round(rng.random() / grid) * grid) for _ in range(2)]) for i in range(40)]
        rows += [(plan, i, "L", list(a), list(b), eps) for i, (a, b) in points]
        want |= {(plan, *k): v for k, v in _naive(points, eps).items()}
    df = spark.createDataFrame(rows, "plan int, i int, layer string, start array<double>, end array<double>, eps double")
    near = proximity.near_pairs(df).cache()
    assert {(r.la, r.lb) for r in near.collect()} == {("L", "L")}
    got = {(r.plan, r.i, r.j): r.distance for r in near.collect()}
    assert got.keys() == want.keys()
    kept = {(r.plan, r.i, r.j) for r in proximity.capped_pairs(near, 3).collect()}
    degree, expected = Counter(), set()
    for p, i, j in sorted(want):
        if degree[p, i] < 3 and degree[p, j] < 3:
            expected.add((p, i, j))
            degree[p, i] += 1
            degree[p, j] += 1
    assert kept == expected


def test_near_pairs_broadcast_no_points(spark, tmp_path):
    # one short row of a file holds any number of points
    points = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.struct(i.alias("i"), F.array(i * 0.1, F.lit(0.0)).alias("start"), F.array(i * 0.1, F.lit(9.0)).alias("end")))
    spark.range(1).select(F.col("id").alias("plan"), points.alias("n")).write.parquet(str(tmp_path / "n"))
    rows = spark.read.parquet(str(tmp_path / "n")).select("plan", F.explode("n").alias("n")).select("plan", "n.*", F.lit("L").alias("layer"), F.lit(0.11).alias("eps"))
    near = proximity.near_pairs(rows)
    assert near.count() == 499 and proximity.capped_pairs(near, 3).count() == 499
    for df in (near, proximity.capped_pairs(near, 3)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def _next_fit(sizes, most_nodes, most_graphs):
    out, batch, graphs, total = {}, 0, 0, 0
    for n, i in sorted((n, i) for i, n in sizes):
        n = max(1, n)
        if n >= most_nodes:
            if graphs:
                batch, graphs, total = batch + 1, 0, 0
            out[i] = batch
            batch += 1
        else:
            if graphs and (graphs >= most_graphs or total + n > most_nodes):
                batch, graphs, total = batch + 1, 0, 0
            out[i] = batch
            graphs, total = graphs + 1, total + n
    return out


def test_next_fit_equals_the_fold(spark):
    rng = random.Random(1)
    for nodes_, graphs in ((10, 3), (50, 8), (7, 100)):
        sizes = [(i, rng.choice([0, 1, 2, 3, 3, 3, 5, 8, 20])) for i in range(150)]
        got = {r.id: r.batch for r in sampling.next_fit_batches(spark.createDataFrame(sizes, "id long, n long"), nodes_, graphs).collect()}
        assert got == _next_fit(sizes, nodes_, graphs)


def test_splits_are_disjoint_and_complete(spark):
    rows = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 3).alias("s"))
    split = sampling.ratio_split(rows, "x", [("train", 0.8), ("val", 0.1)], "test")
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    test = sampling.stratified_split(rows, "x", F.col("s"), 30)
    assert {(r.stratum, r["count"]) for r in test.where("split = 'test'").groupBy("stratum").count().collect()} == {(0, 10), (1, 10), (2, 10)}
    hold = sampling.holdout_split(rows.limit(1), "x", 0.9)
    assert hold.count() == 1


def test_balanced_batches(spark):
    rows = spark.createDataFrame([(i, 0 if i < 50 else 1) for i in range(60)], "x long, c int")
    got = sampling.balanced_batches(rows, "x", F.col("c"), 4).groupBy("batch", "category").count().collect()
    assert len(got) == 10 and all(r["count"] == 2 for r in got)


def test_node_count_stats_takes_the_upper_median(spark):
    rows = [(i, [(str(k),) for k in range(n)]) for i, n in enumerate([1, 2, 3, 10])]
    df = spark.createDataFrame(rows, "contract_id long, nodes array<struct<id:string>>").withColumns({"_corrupt_record": F.lit(None).cast("string"), "ingested_at": F.current_timestamp()})
    r = ct.node_count_stats(df).first()
    assert (r.min_nodes, r.median_nodes, r.max_nodes, r.n_graphs) == (1, 3, 10, 4)
