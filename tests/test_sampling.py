"""Splits, subsets and batches: seeds matter, sizes and edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from draftlake.common import numbered_in_order
from draftlake.functions import text, vectors
from draftlake.operators import contracts as ct
from draftlake.operators import metrics, sampling


@pytest.fixture(scope="module")
def ids(spark):
    return spark.createDataFrame([(i, i % 3) for i in range(997)], "id long, stratum int").cache()


def test_another_seed_is_another_draw(ids):
    def chosen(df, side):
        return {r.id for r in df.where(F.col("split") == side).collect()}

    by_seed = {
        "strata": [chosen(sampling.stratified_split(ids, "id", F.col("stratum"), 200, s), "test") for s in (1, 2, 1)],
        "ratio": [chosen(sampling.ratio_split(ids, "id", [("train", 0.8)], "test", s), "test") for s in (1, 2, 1)],
        "holdout": [chosen(sampling.holdout_split(ids, "id", 0.8, s), "val") for s in (1, 2, 1)],
        "random": [chosen(sampling.random_holdout(ids, "id", 0.2, s), "val") for s in (1, 2, 1)],
        "subset": [{r.id for r in sampling.subset(ids, "id", 200, s).collect()} for s in (1, 2, 1)],
    }
    for name, (a, b, again) in by_seed.items():
        assert a == again and len(a) == len(b) and len(a) >= 199, name
        # two independent draws of a fifth share about a fifth of their rows
        assert 0.05 * len(a) < len(a & b) < 0.45 * len(a), name
    # draws of one seed in different operators aren't the head of one order either side of a seed change
    assert by_seed["strata"][0] != by_seed["subset"][1]


def test_order_is_spread(ids):
    keys = [r.k for r in ids.select(vectors.random_order(F.col("id"), 5).alias("k")).collect()]
    assert all(0 <= k < 2**32 for k in keys) and len(set(keys)) > 990
    assert abs(sum(keys) / len(keys) / 2**32 - 0.5) < 0.05
    up = sum(a < b for a, b in zip(keys, keys[1:], strict=False))
    assert 400 < up < 600


def test_random_holdout_sizes(spark):
    for n, want in ((1, 1), (5, 1), (19, 1), (25, 2), (100, 10)):
        df = spark.range(n)
        assert sampling.random_holdout(df, "id", 0.1).where("split = 'val'").count() == want
    assert sampling.random_holdout(spark.range(0), "id", 0.1).count() == 0


def test_small_batches_and_first_records(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 2)], "id long, batch long")
    assert sorted(r.id for r in sampling.full_batches(df).collect()) == [1, 2, 4, 5, 6]
    assert [r.id for r in sampling.first_records(df, ["batch", "id"], 3).collect()] == [1, 2, 3]
    moved = sampling.shuffled_batches(df, 3).collect()
    assert sorted({r.position for r in moved}) == [1, 2, 3] and len({(r.batch, r.position) for r in moved}) == 3


def test_saved_sides_drop_unknown_ids(spark):
    saved = spark.createDataFrame([(1, "train"), (1, "train"), (2, "test"), (99, "test"), (None, "test")], "id long, split string")
    got = {(r.id, r.split) for r in sampling.saved_sides(saved, spark.range(3)).collect()}
    assert got == {(1, "train"), (2, "test")}


def test_numbers_follow_the_whole_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([5, 5, 5, 5, rng.randrange(50)])) for i in range(600)]
    got = {r.id: r.rn for r in numbered_in_order(spark.createDataFrame(rows, "id long, n long"), [F.col("n"), F.col("id")]).collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted((n, i) for i, n in rows))}
    assert numbered_in_order(spark.createDataFrame([], "id long, n long"), [F.col("n"), F.col("id")]).count() == 0


def test_harmonic_number_is_continued(spark):
    for n in (1, 7, 10_000, 10_001, 50_000):
        got = metrics.random_ranks(spark.createDataFrame([(n,)], "n long")).first()
        assert got.mrr == pytest.approx(100 * math.fsum(1 / i for i in range(1, n + 1)) / n, abs=2e-6)
    assert metrics.random_ranks(spark.createDataFrame([(10**9,)], "n long")).first().r_at_1 == 0.0


def test_count_phrases_and_templates(spark):
    rows = [("furniture", 1), ("furniture", 2), ("installed_furniture", 3), ("text_label", 1), ("text_label", 4), ("bed", 2), ("axis", 2)]
    got = [r.p for r in spark.createDataFrame(rows, "label string, n long").coalesce(1).select(text.count_phrase(F.col("label"), F.col("n")).alias("p")).collect()]
    assert got == ["1 furniture item", "2 furniture items", "3 installed furniture items", "1 label annotation", "4 label annotations", "2 bedrooms", "2 axes"]
    t = [r.t for r in spark.range(400).select(text.template_of(F.concat(F.lit("plan_"), "id"), 42).alias("t")).collect()]
    assert {0, 1, 2, 3} == set(t) and all(60 < t.count(k) < 140 for k in range(4))
    meta = spark.createDataFrame([((3,),), (None,), ((None,),)], "layout_summary struct<bedrooms:int>").select(F.struct("layout_summary").alias("m"))
    assert [r.b for r in meta.select(vectors.bedrooms(F.col("m")).alias("b")).collect()] == [3, -1, -1]


NODES = "array<struct<id:string,layer:string,semantic_label:string,endpoints:struct<start:array<double>,end:array<double>>>>"
EDGES = "array<struct<source:string,target:string,relation:string,distance:double>>"


def test_edge_ends_meet_their_nodes(spark):
    node = lambda i, layer: (i, layer, layer.lower(), None)
    rows = [
        (1, [node("a", "WALL"), node("b", "DOOR"), node("a", "WINDOW"), (None, "X", "x", None)], [("a", "b", "r", 1.0), ("a", "zzz", "r", 1.0), (None, "b", None, None), ("b", "b", "r", None)], None),
        (2, None, None, None), (3, [], [("a", "b", "r", 1.0)], None), (4, [node("a", "WALL")], None, "broken"), (5, [node("q", "WALL")], [("a", "q", "r", 1.0)], None),
    ]
    df = spark.createDataFrame(rows, f"contract_id long, nodes {NODES}, edges {EDGES}, _corrupt_record string").withColumn("ingested_at", F.current_timestamp())
    got = {(r.contract_id, r.pos, r.a.pos, r.a.layer, r.b.layer, r.edge.distance) for r in ct.edge_ends(df, ("layer",), ("distance",)).collect()}
    # the last of two nodes with one id counts, edges that lead nowhere have no row
    assert got == {(1, 0, 2, "WINDOW", "DOOR", 1.0), (1, 3, 1, "DOOR", "DOOR", None)}
