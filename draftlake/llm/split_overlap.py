"""Problem 1: records of one split that are also, exactly or almost, in another.

Method: content-defined chunks. Every record is normalised to canonical tokens
(width, case, invisible characters, thousands separators, number words, digits
misread as letters, units glued to numbers, spelling slips repaired towards the
corpus's own frequent words), a rolling hash over the token stream cuts it into
chunks, chunk digests are joined across the splits and the lengths of shared
chunks are summed into the overlap fraction of either record. Pairs in which one record
shares enough then pass an exact check of the stated numbers and words.

Scale. Records with equal canonical text form one class and only one
representative takes part in the join, so a text that makes up a third of all
rows costs one row. As the check requires the stated numbers to agree, they are part of
the join key, and classes whose numbers don't occur on the other side leave before any
chunk moves. A key that is still frequent is refined with the record's other chunks
(or, where the chunk makes up min_overlap of one record by itself, meets all records of
the other side, however little of them it is): two records of which one shares min_overlap
share a second chunk or have such a one, so nothing is lost. Classes are expanded to records in parts of SALT_ROWS, and the report
counts members per class instead of expanding them.

Edge cases: null and blank texts never match; a text without any word or digit
is treated as blank; a record on both sides matches itself; positions without a
record are ignored; repeated positions count once; extra columns are ignored;
empty inputs give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.common import checkpoint, shuffle_partitions

#: Words that carry no stated fact, and the wordings that writers of such queries swap for each other:
#: fixed values of this project's language, for other texts to be given anew.
WORDING = frozenset(
    "a an the and of in on to at with w for that this is are has have by me i it as there where which "
    "plan plans floor sheet sheets drawing drawings sq square ft feet sqft foot".split()
)
SYNONYMS = {
    "flat": "apartment", "story": "storey", "adjoins": "borders", "containing": "holding", "contains": "holds",
    "searching": "looking", "kindly": "please", "face": "side", "close": "near",
}
UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")
_TOKEN = re.compile(r"[^\W_]+")
_MISREAD = re.compile(r"[0-9loi]*[0-9][0-9loi]*")
_GLUED = re.compile(r"([0-9loi]*[0-9])([a-z]+)")
_AS_DIGITS = str.maketrans("loi", "101")
_AS_LETTERS = str.maketrans("01", "ol")

#: Share of all records from which a word counts as frequent, so that slips are repaired towards it; bounds the vocabulary
#: by (words per record) / share entries whatever the corpus size, so that it may be broadcast. The check of facts doesn't use it.
FREQUENT_SHARE = 0.002
MIN_OVERLAP = 0.35
CHUNK_MOD, CHUNK_MIN, CHUNK_MAX = 2, 2, 8
#: Rolling-hash multipliers; each gives one chunking, and a pair needs the overlap in one of them.
CHUNKINGS = (1_000_003, 69_069)
#: Records from which a key is refined.
HOT_KEY = 200
#: Members of a class that are expanded under one key.
SALT_ROWS = 20_000
#: Classes up to which their ids may be broadcast (16 MB); more of them are joined by a shuffle.
SMALL_CLASSES = 1_000_000


def canonical_tokens(text: str | None) -> list[str]:
    """Tokens of a text, alike for the ways in which one query is written again."""
    if not text:
        return []
    s = (text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))).lower()
    s = _THOUSANDS.sub("", s)
    raw: list[str] = []
    for t in _TOKEN.findall(s):
        if t.isalpha() or t.isdigit():
            raw.append(t)
        elif _MISREAD.fullmatch(t):
            raw.append(t.translate(_AS_DIGITS))
        elif m := _GLUED.fullmatch(t):
            raw.append(m[1].translate(_AS_DIGITS))
            if m[2] != "x":
                raw.append(m[2])
        else:
            raw.append(t.translate(_AS_LETTERS))
    out: list[str] = []
    i = 0
    while i < len(raw):
        t = raw[i]
        if t in UNITS or t in TENS:
            value, i = _spelled(raw, i)
            out.append(str(value))
            continue
        out.append(str(int(t)) if t.isdecimal() and len(t) < 19 else SYNONYMS.get(t, t))
        i += 1
    return out


def _spelled(raw: list[str], i: int) -> tuple[int, int]:
    value = 0
    if raw[i] in UNITS and i + 1 < len(raw) and raw[i + 1] == "hundred":
        value, i = 100 * UNITS[raw[i]], i + 2
        if i + 1 < len(raw) and raw[i] == "and" and (raw[i + 1] in UNITS or raw[i + 1] in TENS):
            i += 1
    if i < len(raw) and raw[i] in TENS:
        value, i = value + TENS[raw[i]], i + 1
        if i < len(raw) and 0 < UNITS.get(raw[i], 0) < 10:
            value, i = value + UNITS[raw[i]], i + 1
    elif i < len(raw) and raw[i] in UNITS:
        value, i = value + UNITS[raw[i]], i + 1
    return value, i


def _deletes(w: str) -> set[str]:
    return {w[:k] + w[k + 1 :] for k in range(len(w))}


class Speller:
    """Repairs a rare token to the frequent word at one edit (a swap of neighbours counts as one)."""

    def __init__(self, vocabulary: dict[str, int]):
        # other wordings are as frequent as the word that stands for them
        vocabulary = {s: vocabulary[w] for s, w in SYNONYMS.items() if w in vocabulary} | vocabulary
        self.vocabulary = vocabulary
        self.shorter: dict[str, list[str]] = {}
        for w in vocabulary:
            if len(w) > 4:
                for d in _deletes(w):
                    self.shorter.setdefault(d, []).append(w)
        self.seen: dict[str, str] = {}

    def __call__(self, t: str) -> str:
        if t in self.vocabulary or t.isdigit() or len(t) < 4:
            return t
        if (got := self.seen.get(t)) is None:
            mine = _deletes(t)
            found = {w for w in mine if len(w) > 4 and w in self.vocabulary} | set(self.shorter.get(t, ()))
            for d in mine:
                found.update(w for w in self.shorter.get(d, ()) if _one_edit(t, w))
            got = min(found, key=lambda w: (-self.vocabulary[w], w)) if found else t
            got = SYNONYMS.get(got, got)
            if len(self.seen) < 200_000:
                self.seen[t] = got
        return got


def _one_edit(a: str, b: str) -> bool:
    if len(a) != len(b):
        return False
    off = [k for k in range(len(a)) if a[k] != b[k]]
    return len(off) == 1 or (len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])


_CRC: dict[str, int] = {}


def _crc(t: str) -> int:
    h = _CRC.get(t)
    if h is None:
        h = zlib.crc32(t.encode())
        if len(_CRC) < 200_000:
            _CRC[t] = h
    return h


def content_chunks(tokens: list[str], multiplier: int) -> list[tuple[int, int]]:
    """(digest, length) of the chunks that a rolling hash over two tokens cuts."""
    out: list[tuple[int, int]] = []
    start, before, last = 0, 0, len(tokens)
    for end, t in enumerate(tokens, 1):
        h = _crc(t)
        n = end - start
        if n >= CHUNK_MAX or (n >= CHUNK_MIN and (((before * multiplier + h) & 0xFFFFFFFF) >> 7) % CHUNK_MOD == 0) or end == last:
            piece = " ".join(tokens[start:end])
            out.append((xxhash.xxh3_64_intdigest(piece, seed=multiplier) - (1 << 63), len(piece)))
            start = end
        before = h
    return out


def _slip(x: str, y: str) -> bool:
    """Could one word be the other one with a slip: one letter more, less or else, or two exchanged?"""
    if min(len(x), len(y)) < 4 or abs(len(x) - len(y)) > 1:
        return False
    return _one_edit(x, y) if len(x) == len(y) else (min(x, y, key=len) in _deletes(max(x, y, key=len)))


def _without_marks(a: list[str], b: list[str]) -> list[str]:
    """``a`` less a last word that was cut off, and less up to two words put before or after a text that ``b`` has too."""
    held = set(b)
    if a and a[-1] not in held and any(w.startswith(a[-1]) for w in held):
        a = a[:-1]
    for _ in range(2):
        if len(a) > 1 and b and a[-1] not in held and not a[-1].isdigit() and b[-1] in a:
            a = a[:-1]
        if len(a) > 1 and b and a[0] not in held and not a[0].isdigit() and b[0] in a:
            a = a[1:]
    return a


def same_statement(a: list[str], b: list[str]) -> bool:
    """True if two repaired token lists state the same facts in other words.

    Numbers must be equal as multisets. Every word that isn't wording is a fact, however
    rare: one in place of another (an item or room exchanged), or the numbers of two items
    exchanged, makes the lists different, unless the two words are a slip apart; words
    missing on one side alone do not, nor do marks before or after the text. A text cut off
    at its end may lack the facts of the part that was cut. Nothing depends on the other records.
    """
    if len(a) > len(b):
        a, b = b, a
    a, b = _without_marks(a, b), _without_marks(b, a)
    numbers_a, numbers_b = Counter(t for t in a if t.isdigit()), Counter(t for t in b if t.isdigit())
    if numbers_a != numbers_b:
        return _cut_off(a, b)
    words = lambda x: Counter(t for t in x if not t.isdigit() and t not in WORDING)
    words_a, words_b = words(a), words(b)
    only_a, only_b = words_a - words_b, words_b - words_a
    for x in list(only_a):
        for y in list(only_b):
            if only_b[y] and only_a[x] and _slip(x, y):
                n = min(only_a[x], only_b[y])
                only_a[x] -= n
                only_b[y] -= n
    only_a, only_b = +only_a, +only_b
    if (only_a and only_b) or only_a.total() + only_b.total() > max(6, len(b) // 3):
        return _cut_off(a, b)
    content = [[t for t in x if t.isdigit() or t not in WORDING] for x in (a, b)]
    follow = [Counter((x[k], x[k + 1]) for k in range(len(x) - 1) if x[k].isdigit() and not x[k + 1].isdigit()) for x in content]
    more, less = follow[0] - follow[1], follow[1] - follow[0]
    if any(n != m and w == v for n, w in more for m, v in less) and not (only_a or only_b):
        return False
    lead = [{x[k]: x[k - 1] for k in range(1, len(x)) if x[k].isdigit() and not x[k - 1].isdigit()} for x in content]
    both = [n for n in lead[0] if n in lead[1] and lead[0][n] != lead[1][n]]
    return not any(lead[0][n] == lead[1][m] and lead[0][m] == lead[1][n] for n in both for m in both if n < m)


def _cut_off(a: list[str], b: list[str]) -> bool:
    """Is the shorter text the longer one cut off at its end (marks before or after aside)?"""
    keep = lambda x: [t for t in x if t.isdigit() or t not in WORDING]
    last = a[-1] if a else ""
    x, y = keep(a), keep(b)
    stated = lambda z: sum(t.isdigit() for t in z)
    if len(x) < 4 or len(x) < 0.5 * len(y) or stated(x) < stated(y) // 2:
        return False
    k, missed, marks = 0, 0, 2
    for t in x:
        at = next((j for j in range(k, min(k + 3, len(y))) if y[j] == t or _slip(t, y[j])), None)
        if at is None:
            if t == last and k < len(y) and y[k].startswith(t):
                continue  # cut inside a word or number
            if k == 0 and marks and not t.isdigit():
                marks -= 1  # a mark put before the text
                continue
            return False
        missed += at - k
        k = at + 1
    lost = Counter(t for t in y[:k] if t.isdigit()) - Counter(t for t in x if t.isdigit())
    return missed <= 2 and not lost


def _numbers_key(numbers: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(sorted(numbers))) - (1 << 63)


def stated_numbers(tokens: list[str]) -> list[int]:
    """Key of all numbers of a text, and of all but the last where the text may be cut within it (up to two marks may follow)."""
    numbers = [t for t in tokens if t.isdigit()]
    keys = [_numbers_key(numbers)]
    if any(t.isdigit() for t in tokens[-3:]):
        keys.append(_numbers_key(numbers[:-1]))
    return keys


def begun_numbers(tokens: list[str]) -> list[int]:
    """Keys of the numbers with which a text begins, from half of them (less one that was cut) to all.

    Equal texts and cut ones (same_statement accepts no others) agree in one of these keys
    and one of the other's stated_numbers, so joining on them loses nothing.
    """
    numbers = [t for t in tokens if t.isdigit()]
    return list({_numbers_key(numbers[:k]) for k in range(max(0, len(numbers) // 2 - 1), len(numbers) + 1)})


_TOKENS = "id long, is_train boolean, is_test boolean, tokens array<string>"
_CHUNK = "array<struct<chunking:int,digest:long,length:int>>"


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = pa.array([canonical_tokens(t) for t in b.column(3).to_pylist()], pa.list_(pa.string()))
        yield pa.record_batch({"id": b.column(0), "is_train": b.column(1), "is_test": b.column(2), "tokens": tokens})


def _chunk_lists(content: list[list[str]]) -> pa.ListArray:
    """The distinct chunks of all chunkings of each record, as one flat column of structs."""
    upto, chunking, digest, length = [0], [], [], []
    for x in content:
        for k, m in enumerate(CHUNKINGS):
            for d, n in set(content_chunks(x, m)):
                chunking.append(k)
                digest.append(d)
                length.append(n)
        upto.append(len(digest))
    flat = pa.StructArray.from_arrays([pa.array(chunking, pa.int32()), pa.array(digest, pa.int64()), pa.array(length, pa.int32())], ["chunking", "digest", "length"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat)


def frequent_words(tokens: DataFrame, n_records: int, share: float = FREQUENT_SHARE) -> dict[str, int]:
    """Words in at least ``share`` of the records; at most (mean words per record) / share of them."""
    least = max(3, int(share * n_records))
    rows = (
        tokens.select(F.explode(F.array_distinct("tokens")).alias("t"))
        .where(~F.col("t").rlike("^[0-9]+$"))
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
        .collect()
    )
    return {r.t: r.n for r in rows}


def _classes(cuts: DataFrame) -> DataFrame:
    """One row per class of equal records: its representative, the sides it lies on with their numbers of records, and its numbers."""
    return cuts.groupBy("class_id").agg(
        F.min("id").alias("id"), F.count_if("is_train").alias("n_train"), F.count_if("is_test").alias("n_test"), F.min_by("stated", "id").alias("stated"), F.min_by("begun", "id").alias("begun")
    )


def _may_meet(classes: DataFrame) -> DataFrame:
    """class_id of the classes that state numbers with which another class on the other side begins, or the other way round."""
    each = classes.select(
        "class_id", (F.col("n_train") > 0).alias("tr"), (F.col("n_test") > 0).alias("te"),
        F.explode(F.array_distinct(F.concat("stated", "begun"))).alias("number"), "stated", "begun",
    ).select("class_id", "tr", "te", "number", F.array_contains("stated", F.col("number")).alias("st"), F.array_contains("begun", F.col("number")).alias("bg"))
    any_ = lambda x, y: F.max(F.col(x) & F.col(y))
    useful = each.groupBy("number").agg(
        F.count(F.lit(1)).alias("n"), any_("tr", "st").alias("tr_st"), any_("te", "bg").alias("te_bg"), any_("te", "st").alias("te_st"), any_("tr", "bg").alias("tr_bg")
    ).where("n > 1 and (tr_st and te_bg or te_st and tr_bg)")
    return each.select("class_id", "number").join(useful.select("number"), "number", "left_semi").select("class_id").distinct()


def overlap_links(records: DataFrame, sides: DataFrame, min_overlap: float = MIN_OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links between classes of equal records, the classes, and their members.

    records(id, text); sides(id, is_train, is_test), one row per id.
    Returns links(train_class, test_class, train_overlap, test_overlap), the class itself
    included where it lies on both sides, classes(class_id, n_train, n_test) and
    members(id, class_id, is_train, is_test).
    """
    spark = records.sparkSession
    text = records.select("id", "text").where(F.col("text").isNotNull() & (F.trim("text") != ""))
    n = shuffle_partitions(spark)  # stated, so that the Python stages keep all cores where the tables are small
    sided = text.repartition(n, "id").join(sides.select("id", "is_train", "is_test").repartition(n, "id"), "id").select("id", "is_train", "is_test", "text")
    tokens = checkpoint(sided.mapInArrow(_tokenise, _TOKENS).where(F.size("tokens") > 0))
    spread = spark.sparkContext.broadcast(frequent_words(tokens, tokens.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Speller(spread.value)
        longs = pa.list_(pa.int64())
        for b in batches:
            fixed = [[repair(t) for t in x] for x in b.column(3).to_pylist()]
            content = [[t for t in x if t not in WORDING] or x for x in fixed]
            yield pa.record_batch(
                {
                    "id": b.column(0), "is_train": b.column(1), "is_test": b.column(2), "tokens": pa.array(fixed, pa.list_(pa.string())),
                    "class_id": pa.array([xxhash.xxh3_64_intdigest(" ".join(x)) - (1 << 63) for x in content], pa.int64()),
                    "stated": pa.array([stated_numbers(x) for x in fixed], longs), "begun": pa.array([begun_numbers(x) for x in fixed], longs), "chunks": _chunk_lists(content),
                }
            )

    cuts = checkpoint(tokens.mapInArrow(cut, f"id long, is_train boolean, is_test boolean, tokens array<string>, class_id long, stated array<long>, begun array<long>, chunks {_CHUNK}"))
    members = cuts.select("id", "class_id", "is_train", "is_test")
    classes = checkpoint(_classes(cuts))
    own = classes.where("n_train > 0 and n_test > 0").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("test_class"), F.lit(1.0).alias("train_overlap"), F.lit(1.0).alias("test_overlap"))

    meeting = checkpoint(classes.join(_may_meet(classes), "class_id", "left_semi").select("id", "n_train", "n_test"))
    ids = F.broadcast(meeting) if meeting.count() <= SMALL_CLASSES else meeting
    held = checkpoint(cuts.select("id", "class_id", "tokens", "stated", "begun", "chunks").join(ids, "id"))

    whole = lambda side: f"aggregate(filter({side}chunks, c -> c.chunking = k), 0, (s, c) -> s + c.length)"
    pieces = held.select("class_id", "n_train", "n_test", "stated", "begun", "chunks", F.explode("chunks").alias("c"))
    pieces = pieces.withColumn("others", F.expr("transform(filter(chunks, x -> x.chunking = c.chunking and x.digest <> c.digest), x -> x.digest)"))
    pieces = pieces.withColumn("total", F.expr("aggregate(filter(chunks, x -> x.chunking = c.chunking), 0, (s, x) -> s + x.length)"))
    nothing = F.lit(0).cast("long")
    pieces = pieces.select("class_id", "n_train", "n_test", "stated", "begun", "c.digest", "others", (F.col("c.length") / F.col("total") >= min_overlap).alias("alone"))

    def keyed(side: str, numbers: Column) -> DataFrame:
        """class, key, refined: a side's records by digest and numbers; a record whose chunk is enough by itself meets all of the other side."""
        mine, theirs = (F.lit(k).cast("long") for k in ((1, 2) if side == "train" else (2, 1)))
        met = F.when(F.col("alone"), F.array(mine, theirs)).otherwise(F.array(theirs))
        each = pieces.where(F.col(f"n_{side}") > 0).select(F.col("class_id").alias(f"{side}_class"), "digest", F.concat("others", met).alias("refined"), F.explode(numbers).alias("numbers"))
        return each.select(f"{side}_class", F.xxhash64("digest", "numbers").alias("key"), "refined")

    def meet(a: str, b: str, begun: Column) -> DataFrame:
        """Pairs where the numbers that the ``a`` side states are those with which the ``b`` side begins."""
        left, right = keyed(a, F.col("stated")), keyed(b, begun)
        size = lambda df, name: df.groupBy("key").agg(F.count(F.lit(1)).alias(name))
        # keys of one side alone join nothing; where both are frequent the records' other chunks are part of the key
        both = size(left, "l").join(size(right, "r"), "key").select("key", ((F.col("l") > HOT_KEY) & (F.col("r") > HOT_KEY)).alias("hot"))
        refine = lambda df: df.join(both, "key").withColumn("also", F.explode(F.when(F.col("hot"), F.col("refined")).otherwise(F.array(nothing)))).drop("refined", "hot")
        return refine(left).join(refine(right), ["key", "also"]).where("train_class <> test_class").select("train_class", "test_class")

    # where all numbers agree the first join finds the pair, so the second needs the cut texts only
    candidates = checkpoint(meet("train", "test", F.col("begun")).union(meet("test", "train", F.array_except("begun", F.slice("stated", 1, 1)))).distinct())
    side = lambda name, k: held.select(F.col("class_id").alias(name), F.col("tokens").alias(f"tokens_{k}"), F.col("chunks").alias(f"{k}chunks"))
    ks = F.array(*map(F.lit, range(len(CHUNKINGS))))
    both = candidates.join(side("train_class", "a"), "train_class").join(side("test_class", "b"), "test_class").withColumn("ks", ks)
    shared = "aggregate(filter(array_intersect(achunks, bchunks), c -> c.chunking = k), 0, (s, c) -> s + c.length)"
    best = lambda x: F.expr(f"array_max(transform(ks, k -> {shared} / greatest(1, {whole(x)})))")
    near = both.select("train_class", "test_class", "tokens_a", "tokens_b", best("a").alias("train_overlap"), best("b").alias("test_overlap"))
    near = near.where(F.greatest("train_overlap", "test_overlap") >= min_overlap).repartition(n, "train_class", "test_class")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # in the order of classes, so that a pair is judged alike whichever of its records is the train one
            same = [
                same_statement(list(a), list(b)) if x < y else same_statement(list(b), list(a))
                for x, y, a, b in zip(pdf["train_class"], pdf["test_class"], pdf["tokens_a"], pdf["tokens_b"], strict=True)
            ]
            yield pdf.loc[same, ["train_class", "test_class", "train_overlap", "test_overlap"]]

    judged = near.mapInPandas(judge, "train_class long, test_class long, train_overlap double, test_overlap double")
    return judged.unionByName(own), classes.select("class_id", "n_train", "n_test"), members


def overlap_pairs(records: DataFrame, sides: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """pair_a, pair_b (smaller id first), overlap (of the record that shares more): every train and test record that are one record written again.

    Each link is expanded in parts of SALT_ROWS train members, so that a class of any size
    is many keys. Two records that lie on both sides meet twice, of which one is left out where they meet.
    """
    links, classes, members = overlap_links(records, sides, min_overlap)
    parts = F.ceil(F.col("n_train") / SALT_ROWS)
    sized = links.join(classes.select(F.col("class_id").alias("train_class"), parts.alias("parts")), "train_class")
    salted = sized.select("train_class", "test_class", F.greatest("train_overlap", "test_overlap").alias("overlap"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    train = members.where("is_train").join(classes.select("class_id", parts.alias("parts")), "class_id")
    train = train.select(F.col("class_id").alias("train_class"), F.col("id").alias("train_id"), F.col("is_test").alias("too"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    test = members.where("is_test").select(F.col("class_id").alias("test_class"), F.col("id").alias("test_id"), F.col("is_train").alias("also"))
    met = salted.join(test, "test_class").join(train, ["train_class", "part"]).where(~(F.col("too") & F.col("also") & (F.col("train_id") > F.col("test_id"))))
    return met.select(F.least("train_id", "test_id").alias("pair_a"), F.greatest("train_id", "test_id").alias("pair_b"), "overlap")


def split_sides(eval_split: DataFrame) -> DataFrame:
    """id, is_train, is_test of every position that the split lists, however often."""
    listed = lambda c: eval_split.select(
        F.explode(F.col(c).cast("array<bigint>")).alias("id"), F.lit(c == "train").alias("is_train"), F.lit(c == "test").alias("is_test")
    )
    return listed("train").unionByName(listed("test")).where("id is not null").groupBy("id").agg(F.max("is_train").alias("is_train"), F.max("is_test").alias("is_test"))


def overlap_report(pairs: DataFrame, eval_split: DataFrame) -> DataFrame:
    """Per side and source: records, records with an overlap on the other side, share, and the mean of their overlap fractions.

    All records of a class share its links, so classes are counted per side and source and no link is expanded.
    """
    sides = split_sides(eval_split)
    links, _, members = overlap_links(pairs.select(F.col("pair_id").alias("id"), F.col("query").alias("text")), sides)
    links = checkpoint(links)
    touched = reduce(
        DataFrame.unionByName,
        (links.groupBy(F.col(f"{s}_class").alias("class_id")).agg(F.max(f"{s}_overlap").alias("overlap")).withColumn("side", F.lit(s)) for s in ("train", "test")),
    )
    on = F.explode(F.expr("filter(array(if(is_train, 'train', null), if(is_test, 'test', null)), x -> x is not null)"))
    each = pairs.select(F.col("pair_id").alias("id"), "source").join(sides, "id").join(members.select("id", "class_id"), "id", "left").select("class_id", "source", on.alias("side"))
    counted = each.groupBy("class_id", "source", "side").agg(F.count(F.lit(1)).alias("n")).join(touched, ["class_id", "side"], "left")
    over = F.sum(F.when(F.col("overlap").isNotNull(), F.col("n")).otherwise(0))
    return counted.groupBy("side", "source").agg(
        F.sum("n").alias("n_records"), over.alias("n_overlapping"), F.round(over / F.sum("n"), 6).alias("share_overlapping"),
        F.round(F.try_divide(F.sum(F.col("overlap") * F.col("n")), over), 6).alias("mean_overlap"),
    )
