import random

import pytest

from draftlake.llm import canonical_map as cm
from draftlake.llm import quota_sample as qs

TARGETS = "request_id int, scale_bucket int, sample_permille int, target_permille int, min_rows int"
PAIRS = "pair_id long, scale_bucket int, source string, request_id int, key string"


def pairs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], PAIRS)


def test_quotas_meet_needs_and_expose_shortfalls():
    cells = {(0, "a"): 100, (0, "b"): 50, (1, "a"): 3}
    quotas, short = qs.cell_quotas(cells, {0: 60, 1: 5, 2: 4})
    assert sum(q for (c, _), q in quotas.items() if c == 0) == 60 and quotas[1, "a"] == 3
    assert short == {0: 0, 1: 2, 2: 4}
    assert all(q <= cells[k] for k, q in quotas.items())
    assert abs(quotas[0, "a"] - 40) <= 2  # strata in proportion where the margins permit


def test_random_networks_are_feasible_and_as_full_as_possible():
    rng = random.Random(4)
    for _ in range(40):
        cells = {(c, s): rng.randrange(1, 40) for c in range(4) for s in "xyz" if rng.random() < 0.8}
        needs = {c: rng.randrange(0, 80) for c in range(4)}
        quotas, short = qs.cell_quotas(cells, needs)
        for c, need in needs.items():
            available = sum(n for (k, _), n in cells.items() if k == c)
            assert sum(q for (k, _), q in quotas.items() if k == c) == min(need, available)
            assert short.get(c, 0) == max(0, need - available)


def test_draw(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 0, 0, 1, 1, 2, 7, None]), rng.choice(["a", "b", None])) for i in range(3000)] + [(5, 0, "a"), (None, 0, "a")]
    targets = spark.createDataFrame([(1, 0, 100, 500, 0), (1, 1, 100, 500, 0), (1, 3, 100, 0, 4), (2, 2, 1000, 1000, 0)], TARGETS)
    df = pairs(spark, rows)
    report = {(r.request_id, r.scale_bucket): r for r in qs.shortfalls(df, targets).collect()}
    drawn = qs.draw_sample(df, targets)
    got = {(r.request_id, r.scale_bucket): r["count"] for r in drawn.groupBy("request_id", "scale_bucket").count().collect()}
    assert got == {k: r.quota for k, r in report.items() if r.quota}
    assert drawn.select("request_id", "pair_id").distinct().count() == drawn.count()
    assert report[1, 3].shortfall == 4 and report[2, 2].shortfall > 0 and report[1, 0].shortfall == 0
    assert sorted(r.pair_id for r in drawn.collect()) == sorted(r.pair_id for r in qs.draw_sample(df.repartition(7), targets).collect())
    empty = {(r.request_id, r.scale_bucket): r.shortfall for r in qs.shortfalls(pairs(spark, []), targets).collect()}
    assert empty == {(1, 0): 0, (1, 1): 0, (1, 3): 4, (2, 2): 0}
    assert qs.draw_sample(pairs(spark, []), targets).count() == 0
    shares = {(r.request_id, r.scale_bucket): r.n_drawn for r in qs.drawn_shares(df, targets).collect()}
    assert shares == {k: r.quota for k, r in report.items()}
    other = {r.pair_id for r in qs.draw_sample(df, targets, seed=7).collect()}
    assert other != {r.pair_id for r in drawn.collect()}


def test_targets_beyond_the_limit_raise(spark, monkeypatch):
    targets = spark.createDataFrame([(i, 0, 10, 500, 0) for i in range(5)] + [(None, 0, 1, 1, 1)], TARGETS)
    monkeypatch.setattr(qs, "MAX_TARGETS", 5)
    assert len(qs.request_needs(targets, 100)) == 5
    monkeypatch.setattr(qs, "MAX_TARGETS", 4)
    with pytest.raises(ValueError, match="more than 4"):
        qs.request_needs(targets, 100)
    assert qs.request_needs(spark.createDataFrame([(1, 0, 10, 10, 3), (1, 0, 10, 10, 9)], TARGETS), 10) == {1: {0: 9}}


ENTRIES = [(1, "WALL", ["Mauer", "墙体"]), (2, "WINDOW", ["Fenster", "fenêtre"]), (5, "ROOM_TEXT", ["Raumtext"]), (7, "COLUMN", None), (8, "STAIRCASE", []), (16, "KITCHEN_EQUIPMENT", []), (34, "CURTAIN_WALL", ["mur-rideau"]), (45, "EXISTING_TREE", []), (21, "FIRE_HYDRANT", [])]


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("wall", 1), (" Wall ", 1), ("WALLS", 1), ("ｗａｌｌ", 1), ("a-wall", 1), ("L5-WALL", 1), ("wall new", 1), ("Wall.bak", 1), ("wall (3)", 1), ("XB28$0$WALL", 1), ("墙体", 1), ("MAUER", 1),
        ("w1nd0w", 2), ("wnidow", 2), ("wndw.", 2), ("fenetre", 2), ("room text", 5), ("roomtext", 5), ("text, room", 5), ("colm", 7), ("strcs.", 8), ("kitchn_equpment", 16),
        ("curtain wall", 34), ("currtain_wal", 34), ("existing_tree", 45), ("fire yhdrent", 21), ("client markup", -1), ("layer 39", -1), ("$959b10", -1), ("copy of copy", -1), ("88", -1), ("???", -1), ("tmp", -1), ("x" * 3000, -1),
    ],
)
def test_meaning(typed, want):
    ref = cm.Reference(ENTRIES)
    tokens = cm.value_tokens(typed)
    repairs = {t: {w: s for w in ref.words() if (s := ref.stands_for(t, w))} for t in tokens}
    assert ref.meaning(tokens, repairs)[0] == want
    # what stands for a word shares a join key with it
    longest = max(map(len, ref.words()))
    for t, words in repairs.items():
        assert all(cm.typed_keys(t, longest) & cm.word_keys(w) for w in words)


def test_keys_miss_no_similar_word():
    rng = random.Random(5)
    words = ["window", "curtain", "wall", "door", "staircase", "kitchen", "equipment", "fenetre", "lift", "oil", "bolt", "column"]
    for _ in range(6000):
        w = rng.choice(words)
        t = list(w)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t)) if t else 0
            what = rng.randrange(5)
            if what == 0 and len(t) > 1:
                del t[k]
            elif what == 1:
                t.insert(k, rng.choice("abcsoil01"))
            elif what == 2 and t:
                t[k] = rng.choice("abcsoil01")
            elif what == 3 and len(t) > 1:
                t[k - 1], t[k] = t[k], t[k - 1]
            elif t:
                t = t[: max(1, len(t) - 1)]
        token = "".join(t)
        for x in words:
            if cm.token_similarity(token, x) >= 0.6:
                assert cm.typed_keys(token, 9) & cm.word_keys(x), (token, x)


def test_map_values(spark):
    canonical = spark.createDataFrame([(i, n, a, "x") for i, n, a in ENTRIES] + [(99, None, None, "x")], "layer_id int, canonical_layer string, aliases array<string>, value string")
    contracts = spark.createDataFrame(
        [(1, [("wall",), ("wall",), (None,), (" ",), ("WALL",), ("junk",)], "v"), (1, [("wall",)], "v"), (2, None, "v"), (3, [("wall",)], "v")], "contract_id long, nodes array<struct<layer:string>>, value string"
    )
    got = {(r.contract_id, r.layer, r.layer_id) for r in cm.found_layers(contracts, canonical).collect()}
    assert got == {(1, "wall", 1), (1, "junk", -1), (3, "wall", 1)}
    assert cm.found_layers(contracts.where("false"), canonical).count() == 0
    assert {r.layer_id for r in cm.found_layers(contracts, canonical.where("false")).collect()} == {-1}


@pytest.mark.parametrize(("a", "b", "d"), [("wall", "wall", 0), ("wnidow", "window", 1), ("widow", "window", 1), ("abc", "xyz", 3), ("kitten", "sitting", 3)])
def test_edit_distance(a, b, d):
    assert cm.edit_distance(a, b, 2) == min(d, 3)
