import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from draftlake.llm import bin_packing as bp
from draftlake.llm import source_mix as sm
from draftlake.llm import text_quality as tq
from draftlake.llm import tokens

DOCS = "doc_id long, text string, lang string, source string, size long, kind string"
needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_PATH), reason="no tokenizer file")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "clash") for i, t, lang, s in rows], DOCS)


@needs_tokenizer
def test_token_sizes(spark):
    df = docs(spark, [(1, "hello world", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "<|endoftext|>", "en", "a"), (5, "é" * 100_000, "fr", "b"), (None, "x", None, "a"), ((1 << 60) + 1, "x", "en", "a")])
    got = {r.doc_id: r.n_tokens for r in tokens.token_sizes(df).collect()}
    assert got[None] == got[(1 << 60) + 1] == 1
    assert 2 <= got[1] <= 4 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 10_000


def test_local_search_never_loses_or_overfills():
    rng = random.Random(7)
    for _ in range(30):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(0, 80))]
        bins, before, _ = bp.pack(sizes, 60)
        assert len(bins) <= before
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 60 for b in bins)
        if sizes:
            assert len(bins) <= sum(sizes) / 60 * 1.25 + 1


def test_local_search_empties_bins():
    # 7+7, 6+6, 6+6 in bins of 18 fit into two bins, which no move alone reaches
    sizes = [7, 7, 6, 6, 5, 5]
    bins, steps = bp.local_search([[0, 1], [2, 3], [4, 5]], sizes, 18)
    assert len(bins) == 2 and steps


def test_every_bin_can_be_a_partner():
    # 300 fuller bins that can't take the item, and one emptier bin that can: no exchange is left out
    sizes = [900, *[950] * 300, 100, 880]
    bins, _ = bp.local_search([[0], *([k] for k in range(1, 301)), [301], [302]], sizes, 1000)
    assert len(bins) == 302 and sorted(i for b in bins for i in b) == list(range(303))


def test_search_ends_where_no_exchange_gains():
    rng = random.Random(11)
    for _ in range(20):
        sizes = [rng.choice([3, 5, 7, 11, 13, 17, 19]) for _ in range(rng.randrange(1, 60))]
        bins, _ = bp.local_search([[i] for i in range(len(sizes))], sizes, 40)
        fill = [sum(sizes[i] for i in b) for b in bins]
        for x, bx in enumerate(bins):
            for a in bx if fill[x] < bp.UNDERFULL * 40 else ():
                for y, by in enumerate(bins):
                    if y == x or fill[y] < fill[x]:
                        continue
                    outs = [0, *(sizes[i] for i in by), *(sizes[i] + sizes[j] for k, i in enumerate(by) for j in by[k + 1 :])]
                    assert not any(o < sizes[a] and fill[y] + sizes[a] - o <= 40 for o in outs)


def test_packed_items(spark):
    rng = random.Random(1)
    rows = [(i, "s", rng.choice([0, 1, 30, 400, 900, 1500])) for i in range(500)] + [(900, "s", 2048), (901, "s", 2049), (902, "s", 7000), (7, "s", 10), (903, None, None), (None, "s", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    packed = bp.packed_items(sizes, group_items=100).collect()
    fill = Counter()
    for r in packed:
        fill[r.container] += r.size
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(n for i, _, n in rows if n and i is not None)
    assert {r.doc_id for r in packed if r.n_pieces > 1} == {901, 902}
    rest = [r.size for r in packed if r.size < 2048]
    assert len(fill) <= len(packed) - len(rest) + len(bp.pack(rest)[0]) + 6
    report = bp.packing_report(bp.packed_items(sizes)).first()
    assert report.n_split == 2 and report.fullest <= 2048 and report.n_containers >= report.least_containers
    assert {r.doc_id for r in bp.split_documents(bp.packed_items(sizes)).collect()} == {901, 902}
    search = bp.search_report(bp.packed_items(sizes, group_items=100)).collect()
    assert sum(r.n_tokens for r in search) == sum(r.size for r in packed if r.size < 2048) and all(r.bins_kept <= r.bins_before for r in search)
    assert bp.packed_items(sizes.where("false")).count() == 0


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", None]), rng.randrange(0, 200)) for i in range(2000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    total = sum(n for *_, n in rows)
    of = Counter()
    for _, s, n in rows:
        of[s] += n
    asked = [(1, "hot", 500, 400, 1), (1, "b", 500, 300, 3), (1, "zzz", 500, 300, 2), (2, "b", 1000, 900, 2), (2, "c", 10, 100, 1)]
    targets = spark.createDataFrame(asked, "mix_id int, source string, budget_permille int, target_permille int, max_repeats int")
    report = {(r.mix_id, r.source): r for r in sm.mix_report(sizes, targets).collect()}
    members = Counter()
    for r in sm.mix_members(sizes, targets).collect():
        members[r.mix_id, r.source] += r.n_tokens * r.repeats
    for m, s, b, t, cap in asked:
        budget, r = total * b * t / 1e6, report[m, s]
        assert r.short == (of[s] * cap < budget)
        assert r.actual == members[m, s] <= min(budget, of[s] * cap)
        assert r.actual >= min(budget, of[s] * cap) - 200
    assert {(r.mix_id, r.source) for r in sm.short_sources(sizes, targets).collect()} == {k for k, r in report.items() if r.short}
    assert {r.short for r in sm.mix_report(sizes.where("false"), targets).collect()} == {False}
    assert sm.mix_members(sizes.where("false"), targets).count() == 0


def test_prefix_positions_are_running_sums(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 7) for i in range(500)], "doc_id long, source string, n_tokens long")
    got = sm.prefix_positions(sizes, range_docs=40).collect()
    for s in "ab":
        mine = sorted((r.upto, r.n_tokens) for r in got if r.source == s)
        run = 0
        for upto, n in mine:
            run += n
            assert upto == run


PROSE = "The surveyor counted 12 doors and 3 windows on the second visit, and the numbers match the schedule. In the basement a wide passage links the study with the lift pit."
TEXTS = {
    "prose": [PROSE, PROSE.lower().replace(".", "").replace(",", ""), PROSE.upper(), "- " + PROSE.replace(". ", ".\n- "), "> “" + PROSE + "”", "\n".join(PROSE[i : i + 50] for i in range(0, len(PROSE), 50)),
              "Die ruhige Küche liegt nach Osten und ist über die Galerie zu erreichen.", "La cuisine est calme et donne côté jardin, juste après la terrasse.", "La cocina es tranquila y mira hacia el jardín.", "# Overview\n\n" + PROSE],
    "list": ["* sofa\n* bed\n* deep bidet\n* railing", "sofa; bed; deep bidet; railing; chair; desk", "[x] sofa\n[ ] bed\n[X] desk\n[ ] crib", "1.1 bidet ........ 4\n1.2 fridge ....... 79\n2.1 oven ....... 3", "Sofa.\nDeep bed.\nRailing.\nDesk x4.",
             "Please keep the beam out of the guest room until the contractor has signed the sheet:\n1. tile\n2. cold room\n3. podium\n4. timber\n5. bookcase", "sofa / bed / desk / crib / hob / oven"],
    "table": ["| item | qty |\n|---|---|\n| sofa | 3 |\n| bed | n/a |", "item\tqty\narea\t3\nsofa\t4\nbed\t\n", " 105.791   31.351\n 134.959   27.396\n 115.708   90.377", "id;x0;y0\nsofa;1;2\nbed;;4\ndesk;n/a;3\ncrib;5;6",
              "ITEM        QTY        AREA\nsofa        n/a        32\nbed         5          timber\ndesk                   4\n", "n00001  WALL            3   61.83\nn00002  PARKING        49   29.49\nn00003  SPRINKLER     4   3.0"],
    "junk": ["tbd", "0", "xx xx xx xx xx xx xx xx xx xx", "17 96 da 84 8f 3e 0c 46\n35 85 b3 b9 30 1a bb c7", "M 38 89 l-43.12 A 13 88 0 0 1 L 40,10", "n�m�pl�n�x�m�", "<td></td><tr><br/>&nbsp;&#160;<g/>", "KcbKPugZghiY03CB1ZS129vfOK7wHX5liWQQpVrB4jVJKHi8lf11jRuujS7", "_" * 80, "ks;dl fk;a jd kl;sj dkl skd;jf lk"],
}


NUMBERED = [(i, kind, text) for i, (kind, text) in enumerate((k, t) for k, ts in TEXTS.items() for t in ts)]


@pytest.fixture(scope="module")
def kinds(spark):
    """The texts among many of prose, as the kind depends on what is usual."""
    rows = [(i, t, "en", "s") for i, _, t in NUMBERED] + [(1000 + i, PROSE, "en", "s") for i in range(200)]
    return {r.doc_id: r.kind for r in tq.flagged_texts(tq.text_statistics(docs(spark, rows))).collect()}


@pytest.mark.parametrize(("i", "kind", "text"), NUMBERED)
def test_kinds(kinds, i, kind, text):
    assert kinds[i] == kind, text


def test_kind_depends_on_the_sketches(spark):
    half = PROSE + "\n" + "\n".join(["deep sofa", "bed", "railing", "desk x4"])
    stats = tq.text_statistics(docs(spark, [(1, half, "en", "s")])).cache()
    among = lambda texts: tq.language_sketches(tq.text_statistics(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])))
    usual = tq.scored_texts(stats, among([PROSE] * 50)).first()
    assert usual.kind == "prose" and usual.z_prose_share < -1
    lists = "\n".join(["- sofa", "- bed", "- desk", "- hob"])
    only = tq.text_statistics(docs(spark, [(1, lists, "en", "s")]))
    assert tq.scored_texts(only, among([PROSE] * 50)).first().kind == "list"
    # where most texts are lists, a list is nothing unusual
    assert tq.scored_texts(only, among([lists] * 50)).first().kind == "prose"


def test_sketches_of_parts_merge(spark):
    rows = [(i, PROSE if i % 3 else PROSE[: 20 + i], "en", "s") for i in range(300)]
    stats = tq.text_statistics(docs(spark, rows)).cache()
    parts = tq.language_sketches(stats.where("doc_id < 100")).unionByName(tq.language_sketches(stats.where("doc_id >= 100")))
    merged = parts.groupBy("lang").agg(F.kll_merge_agg_double("k_n_words").alias("k")) if hasattr(F, "kll_merge_agg_double") else None
    if merged is not None:
        at = merged.select(F.kll_sketch_get_quantile_double("k", F.lit(0.5)).alias("q")).first().q
        whole = tq.language_sketches(stats).select(F.kll_sketch_get_quantile_double("k_n_words", F.lit(0.5)).alias("q")).first().q
        assert abs(at - whole) <= 2


def test_flagged_texts(spark):
    rows = [(i, t, "en", "s") for i, _, t in NUMBERED]
    rows += [(900, None, "en", "s"), (901, " \n ", "EN", "s"), (902, PROSE, None, "s"), (None, "tbd", "en", "s"), (903, PROSE, "EN", None), (904, PROSE + " " + PROSE * 2000, "xx", "s")] + [(1000 + i, PROSE, "en", "s") for i in range(60)]
    got = {r.doc_id: r.kind for r in tq.not_prose(docs(spark, rows)).collect()}
    assert got == {i: k for i, k, _ in NUMBERED if k != "prose"} | {None: "junk"}
    stats = {r.doc_id: r for r in tq.flagged_texts(tq.text_statistics(docs(spark, rows))).collect()}
    assert stats[902].lang == stats[904].lang == "other" and stats[903].lang == "en" and 900 not in stats and 901 not in stats
    assert stats[1000].n_words == 29 and stats[1000].punctuated_lines == 1.0 and 0.3 < stats[1000].common_words < 0.7
    assert stats[1000].mean_word_length == pytest.approx(sum(map(len, re.findall(r"[^\W\d_]+", PROSE))) / 29)
    assert tq.not_prose(docs(spark, [])).count() == 0


def kinds_of(texts):
    got = tq.describe(pa.array(texts, pa.string()), ["en"] * len(texts))
    return [max(("prose", "list", "table", "junk"), key=lambda k: got[f"{k}_share"][i]) for i in range(len(texts))]


def test_repeated_text_is_junk_at_any_length():
    for unit in ("foo bar baz qux", "Home Menu Login Search Imprint", "The plan is not here."):
        n = len(unit.split())
        for tokens_wanted in (100, 396, 400, 404, 800, 20_000):
            for between in (" ", "\n"):
                assert kinds_of([between.join([unit] * (tokens_wanted // n))]) == ["junk"], (unit, tokens_wanted, between)
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra") for b in ("den", "fol", "gas", "hut", "jen", "tor")]
    long = " ".join(" ".join(["the", rng.choice(words), "and", "a", rng.choice(words), rng.choice(words), "of", "this", rng.choice(words), "is", "by", rng.choice(words) + str(".")]) for _ in range(4000))
    assert kinds_of([long]) == ["prose"]


def test_slices_give_the_same_statistics(monkeypatch):
    texts = [t for _, _, t in NUMBERED] + [PROSE * 50]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)})
    whole = pa.Table.from_batches(tq._describe(iter([batch])))
    monkeypatch.setattr(tq, "SLICE_BYTES", 100)
    parts = pa.Table.from_batches(tq._describe(iter([batch])))
    assert whole.equals(parts.combine_chunks()) or whole.to_pylist() == parts.to_pylist()


def test_long_markup_is_seen():
    assert kinds_of(["<div class='" + "x" * 5000 + "'></div> <span title='" + "y" * 900 + "'>"]) == ["junk"]
