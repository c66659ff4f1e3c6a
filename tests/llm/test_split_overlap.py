import random

import pytest

from draftlake.llm import split_overlap as so

BASE = [
    "Looking for a dense radial arrangement that holds 63 benches, 110 boilers, 103 stairs, and 120 treadmills. In plan, the bench borders the pantry.",
    "Home of 2085 square feet on the river side, narrow overall; music room 288 square feet, entrance hall 58 square feet, workshop 129 square feet.",
    "find narrow plan 64 charging posts 7 treadmills 6 boilers 66 sliding doors laundry study street",
    "Client wants a stepped floor with 3 pallet racks and 94 railings, ideally 45 parking bays next to the boiler room, 9 kiosks at the east side.",
]


def corpus(n=400, seed=0):
    """Filler queries that make the usual words frequent."""
    rng = random.Random(seed)
    items = "benches boilers stairs treadmills kiosks railings sofas planters lockers".split()
    rooms = "pantry|music room|workshop|boiler room|laundry|study|entrance hall".split("|")
    out = []
    for _ in range(n):
        a, b, c = rng.sample(items, 3)
        kind = rng.randrange(3)
        if kind == 0:
            out.append(f"Looking for a dense radial arrangement that holds {rng.randrange(900)} {a}, {rng.randrange(900)} {b}, {rng.randrange(900)} stairs, and {rng.randrange(900)} {c}. In plan, the bench borders the {rng.choice(rooms)}.")
        elif kind == 1:
            out.append(f"Home of {rng.randrange(4000)} square feet on the river side, narrow overall; {rng.choice(rooms)} {rng.randrange(900)} square feet, entrance hall {rng.randrange(900)} square feet.")
        else:
            out.append(f"Client wants a stepped floor with {rng.randrange(900)} {a} and {rng.randrange(900)} {b}, ideally {rng.randrange(900)} parking bays next to the {rng.choice(rooms)}, facing the east side.")
    return out


VARIANTS = [
    (0, BASE[0]), (0, BASE[0].upper()), (0, "  " + BASE[0].replace(" ", "  ") + "​ [checked]"), (0, BASE[0].replace("arrangement", "arrangemnet").replace("boilers", "boielrs")),
    (0, BASE[0].replace("110", "l10").replace("63 benches", "63benches").replace("103 stairs", "103x stairs")), (0, "In plan, the bench borders the pantry. " + BASE[0].split(" In plan")[0]),
    (0, BASE[0].replace("and 120", "& 120").replace("borders", "adjoins")), (1, BASE[1].replace("2085", "2,085").replace("square feet", "sq. ft.")), (1, "(copied) " + BASE[1][:110] + "..."),
    (3, BASE[3].replace("3 pallet", "three pallet").replace("94", "ninety-four")), (3, "re-sent >> " + BASE[3]),
]
DIFFERENT = [
    (0, BASE[0].replace("110", "111")), (0, BASE[0].replace("boilers", "kiosks")), (0, BASE[0].replace("pantry", "workshop")), (1, BASE[1].replace("288", "58").replace("hall 58", "hall 288")),
    (0, BASE[0].replace("63 benches, 110 boilers", "110 benches, 63 boilers")), (3, BASE[3].replace("boiler room", "music room")),
]


def run(spark, train, test, filler=True):
    fill = corpus() if filler else []
    rows = [(i, t) for i, t in enumerate(train)] + [(1000 + i, t) for i, t in enumerate(test)] + [(5000 + i, t) for i, t in enumerate(fill)]
    sides = [(i, True, False) for i in range(len(train))] + [(1000 + i, False, True) for i in range(len(test))] + [(5000 + i, i % 2 == 0, i % 2 == 1) for i in range(len(fill))]
    records = spark.createDataFrame(rows, "id long, text string")
    found = so.overlap_pairs(records, spark.createDataFrame(sides, "id long, is_train boolean, is_test boolean"))
    return {(r.pair_a, r.pair_b): r.overlap for r in found.collect() if r.pair_a < 5000 and r.pair_b < 5000}


def test_rewritten_queries_are_found_and_others_not(spark):
    test = [t for _, t in VARIANTS] + [t for _, t in DIFFERENT]
    got = run(spark, BASE, test).keys()
    want = {(b, 1000 + i) for i, (b, _) in enumerate(VARIANTS)}
    assert got == want


def test_nulls_blanks_repeats_and_empty_tables(spark):
    got = run(spark, [None, "", "  ", "​", "...", "a b", BASE[2], BASE[2]], [None, "", "  ", "...", "a b", BASE[2], "x" * 50_000], filler=False)
    assert got.keys() == {(5, 1004), (6, 1005), (7, 1005)}
    assert run(spark, [], [], filler=False) == {}


def test_a_text_in_a_third_of_all_rows(spark):
    got = run(spark, [BASE[0]] * 60, [BASE[0]] * 40, filler=False)
    assert len(got) == 2400


def test_classes_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(so, "SALT_ROWS", 7)
    got = run(spark, [BASE[0]] * 60, [BASE[0]] * 40, filler=False)
    assert len(got) == 2400


def test_hot_keys_are_refined_without_loss(spark, monkeypatch):
    # queries without numbers share their set phrases; only those that are the same may stay
    rooms = ["pantry", "music room", "workshop", "laundry", "study", "archive", "gallery", "lobby", "canteen", "terrace"]
    train = [f"looking for a dense radial arrangement where the {a} borders the {b} and the light is good" for a in rooms for b in rooms if a < b]
    test = [x.upper() for x in train[::3]] + [x.replace("good", "bad") for x in train[:5]]
    want = run(spark, train, test, filler=False).keys()
    monkeypatch.setattr(so, "HOT_KEY", 2)
    assert run(spark, train, test, filler=False).keys() == want and {(3 * k, 1000 + k) for k in range(15)} <= want


def test_facts_count_however_rare(spark):
    """An item that only two of many records name is a fact like any other."""
    one, other = (BASE[0].replace("benches", x).replace("bench", x) for x in ("zithers", "marimba"))
    got = run(spark, [one], [other, one.upper()])
    assert got.keys() == {(0, 1001)}


def test_both_sides_and_report(spark):
    pairs = spark.createDataFrame([(0, BASE[0], "a", 1), (1, BASE[0].lower(), "b", 1), (2, BASE[1], "a", 1)], "pair_id long, query string, source string, id int")
    split = spark.createDataFrame([([0, 0, 2, 99, None], [1, 2, 2])], "train array<int>, test array<int>")
    records = pairs.selectExpr("pair_id as id", "query as text")
    found = so.overlap_pairs(records, so.split_sides(split)).collect()
    assert {(r.pair_a, r.pair_b) for r in found} == {(0, 1), (2, 2)}
    both = spark.createDataFrame([([0, 1], [1, 0])], "train array<int>, test array<int>")
    assert sorted((r.pair_a, r.pair_b) for r in so.overlap_pairs(records, so.split_sides(both)).collect()) == [(0, 0), (0, 1), (1, 1)]
    report = {(r.side, r.source): (r.n_records, r.n_overlapping) for r in so.overlap_report(pairs, split).collect()}
    assert report == {("train", "a"): (2, 2), ("test", "a"): (1, 1), ("test", "b"): (1, 1)}


def test_report_counts_records_and_their_own_fractions(spark):
    cut = BASE[3][: len(BASE[3]) * 2 // 3]
    rows = [(0, BASE[3], "a", 1), (1, BASE[3], "a", 1), (2, cut, "b", 1), (3, BASE[1], "b", 1)]
    pairs = spark.createDataFrame(rows, "pair_id long, query string, source string, id int")
    split = spark.createDataFrame([([0, 1, 3], [2])], "train array<int>, test array<int>")
    got = {(r.side, r.source): r for r in so.overlap_report(pairs, split).collect()}
    assert got["train", "a"].n_overlapping == 2 and got["test", "b"].n_overlapping == 1 and got["train", "b"].n_overlapping == 0 and got["train", "b"].mean_overlap is None
    # the cut text lies in the whole one, not the other way round
    assert got["test", "b"].mean_overlap > got["train", "a"].mean_overlap > 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("48x kiosks, l8 beds", ["48", "kiosks", "18", "beds"]), ("b0ilers", ["boilers"]), ("twenty-five desks", ["25", "desks"]), ("one hundred and four", ["104"]), ("1,541 m", ["1541", "m"]), ("３ beds", ["3", "beds"]), (None, [])],
)
def test_canonical_tokens(text, want):
    assert so.canonical_tokens(text) == want


def test_chunks_cover_the_text_and_follow_the_content():
    a = so.canonical_tokens(BASE[3])
    whole = so.content_chunks(a, so.CHUNKINGS[0])
    assert sum(n for _, n in whole) + len(whole) - 1 == len(" ".join(a))
    assert len({*whole} & {*so.content_chunks(["new", "words"] + a, so.CHUNKINGS[0])}) >= len(whole) // 2


def test_hot_keys_keep_records_that_share_little_of_themselves(spark, monkeypatch):
    monkeypatch.setattr(so, "HOT_KEY", 2)
    others = "amber basil cedar delta ember fjord grove heron inlet jetty knoll larch maple north ochre petal quartz reeds slate thorn umber velvet willow yarrow zinnia".split()
    longer = lambda i: "6 coral lamp " + " ".join(others[(5 * i + k) % 25] for k in range(6))
    texts = ["6 coral lamp"] + [longer(i) for i in range(5)]
    train, test = [0, 1, 2], [3, 4, 5]
    rows = [(i, x, i in train, i in test) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, is_train boolean, is_test boolean")
    tokens = [so.canonical_tokens(x) for x in texts]

    def enough(a, b):
        for m in so.CHUNKINGS:
            x, y = (dict(so.content_chunks(t, m)) for t in (a, b))
            shared = sum(n for d, n in x.items() if d in y)
            if shared >= so.MIN_OVERLAP * min(sum(x.values()), sum(y.values())):
                return True
        return False

    first = so.content_chunks(tokens[0], so.CHUNKINGS[0])[0]
    chunks = [so.content_chunks(t, so.CHUNKINGS[0]) for t in tokens[3:]]
    assert all(first in c and first[1] < so.MIN_OVERLAP * sum(n for _, n in c) for c in chunks)
    want = {(i, j) for i in train for j in test if enough(tokens[i], tokens[j]) and so.same_statement(tokens[i], tokens[j])}
    assert want == {(0, 3), (0, 4), (0, 5)}
    got = so.overlap_pairs(df.select("id", "text"), df.select("id", "is_train", "is_test"))
    assert {(r.pair_a, r.pair_b) for r in got.collect()} == want


def test_numbers_cut_before_a_mark_share_a_key():
    a, b = (so.canonical_tokens(f"wide house garage room pool 3 kitchen hall balcony {end}") for end in ("1 thanks", "12 room"))
    assert so.same_statement(a, b) and set(so.stated_numbers(a)) & set(so.begun_numbers(b))
