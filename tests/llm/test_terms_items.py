import random
from collections import Counter, defaultdict
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from draftlake.llm import cooccurrence as co
from draftlake.llm import term_counts as tc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcé", max_size=6), st.integers(1, 5)), max_size=300), st.integers(1, 8))
def test_trie_counts_like_a_dictionary(adds, limit):
    trie, want = tc.BurstTrie(limit), defaultdict(lambda: [0, 0])
    for term, n in adds:
        trie.add(term, n, 1)
        want[term][0] += n
        want[term][1] += 1
    assert {t: [o, r] for t, o, r in trie.items()} == dict(want)
    assert all(len(c) <= limit for _, c in trie.subtrees())


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<string>, field_name string, term string")


def test_marked_terms(spark):
    rows = [(1, ["Wall", " wall ", "x" * 5000, None, "", "  "], "q", "q"), (1, ["wall", "wall"], "q", "q"), (2, ["wall", "door"], "q", "q"), (3, None, "q", "q"), (4, [], "q", "q"), (5, ["door"], "q", "q"), (6, ["door", "wall"], "q", "q")]
    got = {r.term[:5]: (r.occurrences, r.records, r.mark) for r in tc.marked_terms(records(spark, rows), "id", {"v": F.col("v")}).collect()}
    assert got == {"wall": (4, 3, "common"), "door": (3, 3, "common"), "xxxxx": (1, 1, "rare")}
    assert tc.marked_terms(records(spark, []), "id", {"v": F.col("v")}).count() == 0


def test_crowded_prefixes_are_routed_apart(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(i, [f"aaaa{rng.randrange(300)}", f"b{rng.randrange(9)}", "aaaa", "a"], "q", "q") for i in range(500)]
    terms = tc.record_terms(records(spark, rows), "id", {"v": F.col("v")})
    want = {t: (n, n) for t, n in Counter(t for _, v, *_ in rows for t in v).items()}
    for flush in (300_000, 20):
        monkeypatch.setattr(tc, "FLUSH_TERMS", flush)
        subtrees = terms.mapInArrow(tc._partial_tries, tc._SUBTREE).cache()
        crowded = tc.crowded_prefixes(subtrees, 50)
        assert ("v", "aaaa") in crowded and ("v", "b") not in crowded
        assert all(("v", x) in crowded for x in ("a", "aa"))
        merged = tc.merge_subtrees(subtrees, route_entries=50).collect()
        assert len(merged) == len(want) and {r.term: (r.occurrences, r.records) for r in merged} == want


def test_terms_that_meet_over_many_batches(spark):
    """A route whose subtrees fill several Arrow batches is still merged into one trie."""
    rows = [(i, [f"x{j % 997}$0$wall" for j in range(i, i + 40)], "q", "q") for i in range(800)] + [(None, ["wall", "x1$0$wall"], "q", "q")]
    df = records(spark, rows).repartition(8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = tc.term_counts(df, "id", {"v": F.col("v"), "w": F.col("v")}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = Counter(t for i, v, *_ in rows if i is not None for t in v)
    assert len(got) == 2 * len(want) and {(r.field_name, r.term): r.occurrences for r in got} == {(f, t): n for f in "vw" for t, n in want.items()}


def attributes(spark, rows):
    schema = "floor_plan_id string, inventory map<string,bigint>, adjacencies array<string>, items string, ingested_at timestamp"
    return spark.createDataFrame([(*r, "clash", datetime(2025, 1, 1)) for r in rows], schema)


def test_baskets(spark):
    rows = [("p.svg", {"Wall ": 1, "room text": 2, "gone": 0, "neg": -1, "none": None}, None), ("p", None, ["Bath-Tub is adjacent to the single  door.", "nonsense", None]), (None, {"x": 1}, None), ("q", {}, [])]
    got = {r.basket: r["items"] for r in co.plan_baskets(attributes(spark, rows)).collect()}
    assert got == {"p": ["bath_tub", "room_text", "single_door", "wall"], "q": []}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    baskets = {f"p{i}": sorted(rng.sample("abcdefgh", rng.randrange(0, 5))) for i in range(300)}
    baskets |= {f"hot{i}": ["a", "b"] for i in range(150)}
    df = attributes(spark, [(k, dict.fromkeys(v, 1), None) for k, v in baskets.items()])
    single = Counter(x for v in baskets.values() for x in v)
    pairs = Counter((a, b) for v in baskets.values() for a in v for b in v if a < b)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in co.item_pairs(co.plan_baskets(df)).collect()}
    assert got == {k: (n, single[k[0]], single[k[1]], len(baskets)) for k, n in pairs.items() if n >= 5 and n * 1000 >= len(baskets)}
    empty = co.item_pairs(co.plan_baskets(attributes(spark, [])))
    assert empty.count() == 0


def test_rare_pairs_are_reported(spark, tmp_path):
    import __spark_entry__ as entry

    # three rare pairs among 2,400 plans: two in one plan, one in three
    baskets = {f"p{i}": ["a", "b"] for i in range(2400)} | {"r0": ["lift", "pit"], "r1": ["a", "vault"]} | {f"s{i}": ["chapel", "organ"] for i in range(3)}
    attributes(spark, [(k, dict.fromkeys(v, 1), None) for k, v in baskets.items()]).write.parquet(str(tmp_path / "plan_attributes.parquet"))
    single = Counter(x for v in baskets.values() for x in v)
    pairs = Counter((a, b) for v in baskets.values() for a in v for b in v if a < b)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in entry.queries()["p5_item_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): (n, single[a], single[b], 2405, round(n * 2405 / (single[a] * single[b]), 6)) for (a, b), n in pairs.items()}
    assert co.all_item_pairs(co.plan_baskets(attributes(spark, []))).count() == 0
