import json

import pytest

from draftlake.operators import search
from draftlake.sources import readers, sinks, svg

DRAWING = """<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" viewBox="{box}">
<g inkscape:label="WALL" id="x"><path d="M0 0 L10 0" semantic-id="1" instance-id="2" stroke="red"/><path d=""/><g id="pub dim"><path d="M0 0 L1 1"/></g></g>
<g><path d="M0 0 L9 9"/></g>
<g id="WINDOW"><circle cx="5" cy="5" r="2" semantic-id="35"/><ellipse cx="1" cy="1" rx="0" ry="0"/><circle cx="a" cy="1" r="1"/><text x="q" y="3"> Bed <tspan>room</tspan></text><text/></g></svg>"""


def test_svg_rows(spark, tmp_path):
    (tmp_path / "a.svg").write_text(DRAWING.format(box="0,0,100,100"))
    (tmp_path / "b.svg").write_text("<svg><g>")
    (tmp_path / "c.txt").write_text("no drawing")
    df = svg.read_svg(spark, str(tmp_path)).cache()
    c = svg.run_counters(df).first()
    assert (c.n_files, c.n_success, c.n_failed) == (2, 1, 1)
    rows = df.where("status = 'success'").orderBy("pos").collect()
    assert [(r.id, r.layer, r.geometry_type, r.semantic_label) for r in rows] == [
        ("n00001", "WALL", "line", "wall"), ("n00002", "PUB_DIM", "line", "dimension"), ("n00003", "WINDOW", "circle", "window"),
        ("n00004", "WINDOW", "ellipse", "window"), ("n00005", "WINDOW", "text", "window"),
    ]
    assert rows[0].raw_attributes == {"stroke": "red"} and rows[0].end == [0.1, 0.0] and rows[0].bbox == [0, 0, 0.1, 0]
    assert rows[4].content == "Bed room" and rows[4].center == [0.0, 0.03]
    assert rows[2].radius == 2 and rows[2].geometry_type_onehot == [0, 0, 0, 1, 0, 0, 0]


def test_svg_compat_leaves_path_ends_in_drawing_units():
    _, rows = svg.parse_svg(DRAWING.format(box="0 0 100 100").encode(), compat=True)
    assert rows[0]["end"] == [10.0, 0.0]


def test_svg_defaults():
    box, rows = svg.parse_svg(b"<svg viewBox='0 0 0 10'><g id='A'><path d='M0 0 L2 2'/></g></svg>")
    assert box == [0, 0, 0, 10] and rows[0]["end"] == [2.0, 0.2]
    assert svg.parse_svg(b"<svg><g id='A'/></svg>")[0] == [0, 0, 100, 100]


def test_contract_reader_skips_what_is_no_json(spark, tmp_path):
    for name, folder in (("one", "p"), ("two", "q")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}_contract.json").write_text(json.dumps({"nodes": [{"id": "n1", "features": {"length": 2}}], "edges": []}))
    (tmp_path / "q" / "bad_contract.json").write_text('{"nodes": [')
    (tmp_path / "q" / "other.json").write_text("{}")
    df = readers.read_contracts(spark, [str(tmp_path / "q"), str(tmp_path / "missing"), str(tmp_path / "p")]).cache()
    assert df.count() == 3
    assert [r.path.rpartition("/")[2] for r in readers.skipped(df).collect()] == ["bad_contract.json"]
    good = readers.readable(df).orderBy("dir_ord", "path").collect()
    assert [(r.dir_ord, r.nodes[0].features.length) for r in good] == [(0, 2.0), (2, 2.0)]
    assert readers.read_contracts(spark, [str(tmp_path / "nowhere")]).count() == 0


def test_objects_and_split_files(spark, tmp_path):
    p = tmp_path / "pairs.json"
    p.write_text(json.dumps([{"query": "a", "floor_plan_id": "x", "scale_bucket": 1}, {"query": "b", "bedroom_count": 2}]))
    rows = readers.read_pairs(spark, str(p)).orderBy("query").collect()
    assert [(r.query, r.scale_bucket, r.bedroom_count) for r in rows] == [("a", 1, None), ("b", None, 2)]
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.read_or_create(spark, str(tmp_path / "split"), build).count() == 3
    assert made == [1]


def test_embedding_index(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b.svg", [0.0, 1.0]), (2, "b", [0.6, 0.8])], "row long, floor_plan_id string, embedding array<float>")
    s = sinks.write_index(df, str(tmp_path / "i")).first()
    assert (s.n_rows, s.dim, s.n_plans) == (3, 2, 3)
    assert readers.read_embeddings(spark, str(tmp_path / "i"), 2).count() == 3
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, str(tmp_path / "i"), 3)
    df.union(df).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, str(tmp_path / "twice"))
    hits = search.search_one(df, [0.0, 2.0], 9).collect()
    assert [(h.rank, h.row) for h in hits] == [(1, 1), (2, 2), (3, 0)]
    assert hits[0].score == pytest.approx(1.0)
    for bad in ([0.0, 0.0], [[1.0], [2.0]]):
        with pytest.raises(ValueError):
            search.search_one(df, bad)
    with pytest.raises(Exception, match="3 entries"):
        search.search_one(df, [1.0, 0.0, 0.0]).collect()
    plans = spark.createDataFrame([("b",), ("a.svg",), ("zzz",)], "floor_plan_id string")
    found = search.by_plan(df.withColumnRenamed("row", "row_no"), plans, strict=False).collect()
    assert {(r.requested, r.row_no) for r in found} == {("b", 2), ("a.svg", 0)}
    with pytest.raises(Exception, match="no vector of the plan zzz"):
        search.by_plan(df.withColumnRenamed("row", "row_no"), plans).collect()
    assert search.by_plan(df.withColumnRenamed("row", "row_no"), plans.where("floor_plan_id <> 'zzz'")).count() == 2


def test_query_vectors(spark):
    assert readers.query_vector(spark, [[1, 2]]).first().embedding == [1.0, 2.0]
    assert readers.query_vector(spark, [1, 2]).first().embedding == [1.0, 2.0]
    with pytest.raises(ValueError):
        readers.query_vector(spark, [[1], [2]])
    assert len(readers.random_vector(spark, 4, 1).first().embedding) == 4


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    pairs = spark.createDataFrame([("q", "a.svg"), ("r", "b")], "query string, floor_plan_id string")
    held, missing = readers.pairs_with_images(pairs, readers.image_files(spark, str(tmp_path)))
    assert [r.query for r in held.collect()] == ["q"] and [r.query for r in missing.collect()] == ["r"]


def test_contract_documents_round_trip(spark, tmp_path):
    (tmp_path / "a.svg").write_text(DRAWING.format(box="0 0 100 100"))
    elements = svg.read_svg(spark, str(tmp_path))
    edges = spark.createDataFrame([("a", 0, "n00001", "n00003", "adjacent", 0.1)], "plan_id string, pos int, source string, target string, relation string, distance double")
    symbols = spark.createDataFrame([("a", "sym_1_2", 1, 2, "wall", ["n00001"], 1)], "plan_id string, symbol_id string, semantic_id int, instance_id int, semantic_label string, node_ids array<string>, node_count int")
    docs = sinks.contract_documents(elements, edges, symbols)
    d = json.loads(docs.first().document)
    assert d["metadata"]["total_nodes"] == 5 and d["edges"][0]["source"] == "n00001" and [n["id"] for n in d["nodes"]] == [f"n{i:05d}" for i in range(1, 6)]
    sinks.write_documents(docs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
