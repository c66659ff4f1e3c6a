import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from draftlake.functions import text, vectors


def one(spark, value, expr, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first().y


@pytest.mark.parametrize(
    ("query", "want"),
    [(" 2 BHK. with sqft ", "2 bedroom hall kitchen. with square feet"), ("2bhk", "2bhk"), ("w/o x", "witho x"), ("w/ x", "w/ x"), ("sq ft", "square feet"), ("2br", "2 bedroom"), ("1 rk workspace", "1 room kitchen workspace")],
)
def test_normalise_query_keeps_the_fixed_rules(spark, query, want):
    q = query.lower().strip()
    for a, b in text.ABBREVIATIONS:
        q = re.sub(a, b, q)
    assert one(spark, query, text.normalise_query("x")) == q == want


def test_queries_and_layers_of_all_scripts(spark, tmp_path):
    from datetime import datetime

    import __spark_entry__ as entry
    from draftlake.sources.readers import CONTRACT

    queries = ["\u00a0Caf\u00e9 2 BHK.\u3000", "\u201c3 RK\u201d \u2013 600 sq\u00a0ft", "\uff12 bhk", "\u00e9bhk bhk\u00e9", "\u200b2BR", "STRASSE \u00dc \u0416", "plain 2br", " ", "", None]
    spark.createDataFrame(list(enumerate(queries)), "pair_id long, query string").write.parquet(str(tmp_path / "pairs.parquet"))

    def want(q):
        q = q.lower().strip()
        for a, b in text.ABBREVIATIONS:
            q = re.sub(a, b, q)
        return q

    got = {r.pair_id: r.query for r in entry.queries()["query_normalize"](spark, str(tmp_path)).collect()}
    assert got == {i: want(q) for i, q in enumerate(queries) if q is not None}

    layers = ["m\u00f6bel neu", "\u0441\u0442\u0435\u043d\u0430", "\u00e9tage\u00a01", "pub dim", "\u5bb6\u5177", "\u5899\u4f53 a", None]
    nodes = [dict.fromkeys(("id", "semantic_id", "instance_id", "semantic_label", "geometry_type", "content", "segments", "endpoints", "features", "raw_attributes")) | {"layer": x} for x in layers]
    rows = spark.createDataFrame([(1, None, nodes, None, None, None, datetime(2025, 1, 1))], f"contract_id long, {CONTRACT}, ingested_at timestamp")
    rows.write.parquet(str(tmp_path / "contracts.parquet"))
    got = {r.raw: r.layer for r in entry.queries()["layer_name"](spark, str(tmp_path)).collect()}
    assert got == {x: {"\u5bb6\u5177": "FURNITURE", "\u5899\u4f53 a": "\u5899\u4f53 a"}.get(x, x.upper().replace(" ", "_")) for x in layers if x is not None}


def test_normalise_query_repaired(spark):
    f = lambda q: one(spark, q, text.normalise_query("x", strict=False))
    assert f("w/o lift") == "without lift"
    assert f("w/ lift") == "with lift"
    assert f("2bhk") == "2 bedroom hall kitchen"


@pytest.mark.parametrize("label", ["", "0", "-1", " -1 ", "x" * 41, "half_height_cabinet", "opening_symbol", "A-WALL", "p1", "dim_line", "a[b]", "18014 x 3"])
def test_labels_that_say_nothing(spark, label):
    assert one(spark, label, text.clean_label("x")) is None


@pytest.mark.parametrize("label", ["TV_cabinet", "sofa", " wall ", "x" * 40])
def test_labels_that_stay(spark, label):
    assert one(spark, label, text.clean_label("x")) == label.strip()


def test_layer_names(spark):
    f = lambda q, **kw: one(spark, q, text.layer_name("x", **kw))
    assert f("家具") == "FURNITURE"
    assert f("pub dim") == "PUB_DIM"
    assert f("墙体") == "墙体"
    assert f("墙体", translations={"墙体": "WALL"}) == "WALL"


@pytest.mark.parametrize(("noun", "n", "want"), [("box", 2, "boxes"), ("axis", 2, "axes"), ("axis", 1, "axis"), ("lobby", 3, "lobbies"), ("bay", 3, "bays"), ("bench", 2, "benches"), ("sofa", 0, "sofas"), ("y", 2, "ys")])
def test_pluralise(spark, noun, n, want):
    assert one(spark, noun, text.pluralise(F.col("x"), F.lit(n))) == want


@pytest.mark.parametrize(("parts", "want"), [([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")])
def test_join_english(spark, parts, want):
    assert one(spark, parts, text.join_english(F.col("x")), "x array<string>") == want


def test_inventory_text(spark):
    inv = {"bed": 160, "sofa": 1, "wall": 9, "room_text": 8, "axis": 3, "furniture": 2, "chair": 0, "table": 2, "desk": 1}
    assert one(spark, inv, text.inventory_text("x"), "x map<string,bigint>") == "160 bedrooms, 2 furniture items, 2 tables, and 1 desk"
    assert one(spark, {}, text.inventory_text("x"), "x map<string,bigint>") == "key interior elements"


@pytest.mark.parametrize(("s", "want"), [(0, "00:00"), (59, "00:59"), (3599, "59:59"), (3600, "01:00:00"), (45296, "12:34:56")])
def test_duration(spark, s, want):
    assert one(spark, s, text.duration(F.col("x")), "x int") == want


@pytest.mark.parametrize(("beds", "want"), [(None, 0), (0, 0), (1, 1), (50, 1), (51, 2), (150, 2), (151, 3)])
def test_scale_bucket(spark, beds, want):
    assert one(spark, beds, vectors.scale_bucket(F.col("x")), "x int") == want


@pytest.mark.parametrize(("n", "want"), [(299, "compact"), (300, "moderate"), (699, "moderate"), (700, "large")])
def test_density(spark, n, want):
    assert one(spark, n, vectors.density(F.col("x")), "x int") == want


def test_unit_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.unit(F.col("x")), "x array<double>") == [0.6, 0.8]
    with pytest.raises(Exception, match="zero vector"):
        one(spark, [0.0, 0.0], vectors.unit(F.col("x")), "x array<double>")


def test_relation(spark):
    f = lambda a, b: one(spark, a, vectors.relation(F.col("x"), F.lit(b)))
    assert [f("WALL", "WINDOW_1"), f("WINDOW", "A-WALL"), f("WALL", "WALL"), f("DOOR", "WALL")] == ["wall_window", "wall_window", "same_layer_adjacent", "adjacent"]


def test_ellipse(spark):
    import math

    assert one(spark, 2.0, vectors.ellipse_perimeter(F.col("x"), F.col("x")), "x double") == pytest.approx(4 * math.pi)
    assert one(spark, 0.0, vectors.ellipse_perimeter(F.col("x"), F.col("x")), "x double") == 0


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60))
def test_strip_suffix_is_stable(spark, s):
    once = one(spark, s, text.strip_svg("x"))
    assert once == s.removesuffix(".svg") or "\n" in s
