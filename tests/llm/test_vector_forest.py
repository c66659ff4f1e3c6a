import numpy as np

from draftlake.llm import vector_forest as vf

SCHEMA = "row_no long, embedding array<float>, h long, label string"


def clusters(n_clusters, size, spread, seed=0, dim=256):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_clusters):
        c = rng.standard_normal(dim)
        out += [c + spread * rng.standard_normal(dim) for _ in range(size)]
    m = np.array(out)
    return np.rint(m / np.linalg.norm(m, axis=1, keepdims=True) * 512) / 512


def brute(m, rows, cosine, k):
    s = (m @ m.T) / np.sqrt(np.outer((m * m).sum(1), (m * m).sum(1)))
    out = set()
    for i in range(len(m)):
        near = [j for j in range(len(m)) if j != i and s[i, j] >= cosine]
        for j in sorted(near, key=lambda j: (-s[i, j], rows[j]))[:k]:
            out.add((min(rows[i], rows[j]), max(rows[i], rows[j])))
    return out


def frame(spark, m, first=0):
    return [(first + i, [float(x) for x in v], 1, "x") for i, v in enumerate(m)]


def test_recall_against_brute_force(spark):
    m = clusters(40, 14, 0.45)
    got = {(r.row_a, r.row_b) for r in vf.found_pairs(spark.createDataFrame(frame(spark, m), SCHEMA)).collect()}
    want = brute(m, list(range(len(m))), 0.75, 10)
    assert len(want) > 1000 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


def test_unusable_vectors_copies_and_ties(spark):
    v = clusters(1, 1, 0)[0].tolist()
    w = (np.array(v) * 3.0).tolist()
    rows = [(1, v), (2, v), (3, w), (4, None), (5, [0.0] * 256), (6, v[:255]), (7, v[:255] + [float("nan")]), (8, v[:255] + [None]), (9, v[:255] + [float("inf")]), (None, v)] + [(100 + i, v) for i in range(30)]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)
    top = vf.similar_rows(df).collect()
    by = {}
    for r in top:
        by.setdefault(r.a, []).append((r.rank, r.b, round(r.score, 6)))
    assert set(by) == {1, 2, 3, *range(100, 130)}
    assert sorted(by[120]) == [(i + 1, b, 1.0) for i, b in enumerate([1, 2, 3, 100, 101, 102, 103, 104, 105, 106])]
    assert [b for _, b, _ in sorted(by[1])][:2] == [2, 3]


def test_empty_and_single(spark):
    assert vf.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vf.found_pairs(spark.createDataFrame(frame(spark, clusters(1, 1, 0)), SCHEMA)).count() == 0


def test_block_search_is_exact(spark):
    m = clusters(10, 6, 0.5, seed=3)
    df = spark.createDataFrame(frame(spark, m), SCHEMA)
    got = {(r.a, r["rank"]): r.b for r in vf.block_topk(df, modulus=20, k=5, query_block=2).collect()}
    s = (m @ m.T) / np.sqrt(np.outer((m * m).sum(1), (m * m).sum(1)))
    np.fill_diagonal(s, -2)
    want = {(i, k + 1): j for i in range(0, 60, 20) for k, j in enumerate(sorted(range(60), key=lambda j: (-s[i, j], j))[:5])}
    assert got == want
    report = vf.recall_report(df).first()
    assert report.recall >= 0.9 and report.n_top == 30 and 0 < report.recall_of_top <= 1


def test_packing_is_exact():
    m = np.array([[0.25, -0.125] * 128, [1.0, 2.0] * 128, [0.1, 1e9] * 128], dtype=np.float32)
    blobs = vf._pack(m)
    assert [len(b) for b in blobs] == [512, 512, 1024] or [len(b) for b in blobs][2] == 1024
    back = vf._unpack(blobs, 256)
    for a, b in zip(m.astype(np.float64), back, strict=True):
        assert np.allclose(a / np.linalg.norm(a), b / np.linalg.norm(b), atol=1e-12)


def test_crowded_prefixes_are_extended(spark):
    m = clusters(3, 200, 0.6, seed=5)
    packed = vf.packed_rows(spark.createDataFrame(frame(spark, m), SCHEMA))
    crowded = vf.crowded_prefixes(packed, 600, trees=2, leaf_rows=20)
    deep = vf.leaves(packed, crowded, trees=2)
    flat = vf.leaves(packed, {}, trees=2)
    assert crowded and deep.select("leaf").distinct().count() > flat.select("leaf").distinct().count() and deep.count() == 1200


def test_recall_stays_where_every_leaf_is_crowded(spark):
    # even spread, and a dense region of distinct vectors that holds half of the rows
    even = clusters(60, 8, 0.5, seed=6)
    rng = np.random.default_rng(7)
    center = rng.standard_normal(256)
    dense = np.concatenate([0.9 * center + c for c in clusters(60, 8, 0.5, seed=8) * 16])
    m = np.concatenate([even, np.rint(dense.reshape(-1, 256) / np.linalg.norm(dense.reshape(-1, 256), axis=1, keepdims=True) * 512) / 512])
    df = spark.createDataFrame(frame(spark, m), SCHEMA)
    want = brute(m, list(range(len(m))), 0.75, 10)
    for leaf_rows in (20, 1):
        got = {(r.row_a, r.row_b) for r in vf.found_pairs(df, leaf_rows=leaf_rows).collect()}
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(want)


def candidates(packed, n, **options):
    return {(r.a, r.b) for r in vf.forest_candidates(packed, n, 0.75, 4, **options).collect()}


def test_rows_with_few_candidates_ascend(spark):
    m = clusters(30, 10, 0.5, seed=9)
    packed = vf.packed_rows(spark.createDataFrame(frame(spark, m), SCHEMA)).cache()
    wide = candidates(packed, 300, trees=2, leaf_rows=10**6)
    deep = candidates(packed, 300, trees=2, leaf_rows=1, enough=0)
    some = candidates(packed, 300, trees=2, leaf_rows=1, enough=60)
    back = candidates(packed, 300, trees=2, leaf_rows=1, enough=10**6)
    assert len(deep) <= len(some) <= len(back)
    # all rows are back at the crowded prefixes they came from, so no pair of them is lost
    assert deep < back and deep <= some <= back
    want = brute(m, list(range(len(m))), 0.75, 10)
    assert len(back & want) >= len(deep & want) and len(back & want) >= len(wide & want)


def test_hot_groups_are_cut_into_blocks(spark, monkeypatch):
    m = clusters(2, 120, 0.45, seed=10)
    df = spark.createDataFrame(frame(spark, m), SCHEMA)
    want = {(r.row_a, r.row_b) for r in vf.found_pairs(df).collect()}
    monkeypatch.setattr(vf, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vf, "COPIES", 3)
    assert {(r.row_a, r.row_b) for r in vf.found_pairs(df).collect()} == want
    split = {(r.row_a, r.row_b) for r in vf.found_pairs(df, leaf_rows=1).collect()}
    assert len(split & want) >= 0.97 * len(want)
    twice = spark.createDataFrame(frame(spark, np.concatenate([m[:30]] * 8)), SCHEMA)
    got = {(r.row_a, r.row_b) for r in vf.found_pairs(twice).collect()}
    expected = brute(np.concatenate([m[:30]] * 8), list(range(240)), 0.75, 10)
    assert len(got & expected) >= 0.97 * len(expected)


def test_trees_in_groups_and_cleaned_shuffles(spark, monkeypatch):
    m = clusters(30, 10, 0.5, seed=9)
    packed = vf.packed_rows(spark.createDataFrame(frame(spark, m), SCHEMA)).cache()
    options = {"trees": 3, "leaf_rows": 10}
    whole = candidates(packed, 300, **options)
    monkeypatch.setattr(vf, "ENTRIES_AT_ONCE", 1)
    crowded = vf.crowded_prefixes(packed, 300, 3, leaf_rows=10, widths=vf.WIDTHS)
    assert vf.tree_groups(packed, 300, crowded, 3, 256) == [range(0, 1), range(1, 2), range(2, 3)]
    assert candidates(packed, 300, **options) == whole
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    out = vf.written(spark.range(1000).repartition(3, "id").groupBy("id").count())
    assert not {f for f in files() - before if f.endswith(".data")}
    assert out.count() == 1000
