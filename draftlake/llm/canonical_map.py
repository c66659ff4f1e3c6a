"""Problem 7: free-entered values mapped to the closest entry of a reference list.

Method: token-level repair. The distinct values are cut into tokens, and the distinct
tokens are joined to the reference vocabulary (tokens of the entries and of
their accepted other names) on deletion neighbourhoods (edit distance), beginnings and
letters of abbreviations, digits misread for letters being one with them. What
meets is compared exactly, and a soft TF-IDF over the repaired tokens ranks the
entries that an inverted index finds for them.
Values whose best score is too low, or whose best entries tie, are reported as
unmatched (-1).

Scale. Work is per distinct token and per distinct value, not per row, and neither
looks at the whole list: a token meets the words that share a key, a value the entries
that hold a repaired token. The reference list is a fixed table; its size is
checked before its entries are sent to the workers. Values are brought back to the rows by a join on the value.

Edge cases: null and blank values are left out; values equal to an entry are
left out of the report of typed ones; a value without letters means none; very
long values are compared by their tokens like any other; empty inputs give
empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.common import checkpoint, shuffle_partitions

MAX_ENTRIES = 20_000
ACCEPT = 0.62
#: Decorations around a layer's name that say nothing about what it holds.
DECORATIONS = frozenset("bak new old exist existing layer layers rev line lines copy of tmp temp final draft level the and de del la le des du el los".split())
_SPLIT = re.compile(r"[^\w]+|_+")
#: Drawings bound into another one put their name, a number and such a mark before the layer's.
_BOUND = re.compile(r"\$\d+\$|\|")
_LEVEL = re.compile(r"[a-z]?\d+[a-z]?")


def fold(text: str) -> str:
    """Width, case and accents removed."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
    return "".join(c for c in s if not unicodedata.combining(c))


def value_tokens(text: str) -> list[str]:
    parts = [p for p in _BOUND.split(fold(text)) if any(c.isalpha() for c in p)]
    return [t for t in _SPLIT.split(parts[-1] if parts else "") if t]


def edit_distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein (neighbour swaps count one); ``most`` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = row, before, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def _abbreviates(t: str, w: str) -> bool:
    """The letters of t in order within w, the first one first; the consonants of w or its beginning and end."""
    if len(t) < 3 or len(t) >= len(w) or t[0] != w[0]:
        return False
    k = 0
    for c in w:
        if k < len(t) and t[k] == c:
            k += 1
    return k == len(t)


def token_similarity(t: str, w: str) -> float:
    """How far a typed token stands for a reference token, 0 to 1."""
    if t == w:
        return 1.0
    if any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
        mixed = "".join("o" if c == "0" else w[i] if c == "1" and i < len(w) and w[i] in "il" else c for i, c in enumerate(t))
        if mixed == w:
            return 0.98
        t = mixed
    if any(c.isdigit() for c in t):
        return 0.0
    n = max(len(t), len(w))
    if not t.isascii() or not w.isascii():
        return 1.0 - edit_distance(t, w, 1) / n if n >= 5 and edit_distance(t, w, 1) <= 1 else 0.0
    for u, cost in ((t, 0.0), (t[:-1] if t.endswith("s") and len(t) > 4 else t, 0.02)):
        if u == w:
            return 1.0 - cost
    most = 0 if n < 3 else 1 if n < 6 else 2
    d = edit_distance(t, w, most)
    best = 0.0
    if d <= most and (t[0] == w[0] or d <= 1 or n >= 7):
        best = 1.0 - (0.12 if n > 3 else 0.3) * d - (0.04 if t[0] != w[0] else 0.0)
    elif n == 5 and len(t) > 3 and edit_distance(t, w, 2) == 2:
        best = 0.6  # too little for a word alone (ACCEPT), enough beside words that match
    if len(t) >= 3 and w.startswith(t):
        best = max(best, 0.7 + 0.25 * len(t) / len(w))
    for u in (t, t[:-1] if t.endswith("s") else t):
        if _abbreviates(u, w):
            best = max(best, 0.6 + 0.3 * len(u) / len(w))
    return best


class Reference:
    """The entries' names as bags of tokens with inverse document frequencies."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        self.names: list[tuple[int, list[str]]] = []
        for key, name, others in entries:
            for text in [name, *(others or [])]:
                if text and (tokens := value_tokens(text)):
                    self.names.append((key, tokens))
        count: dict[str, set[int]] = {}
        for key, tokens in self.names:
            for t in tokens:
                count.setdefault(t, set()).add(key)
        n = len({k for k, _ in self.names}) or 1
        self.weight = {t: math.log(1 + n / len(k)) for t, k in count.items()}
        self.unknown = math.log(1 + n)
        self.solid = {"".join(tokens): (key, tokens) for key, tokens in self.names if len(tokens) > 1}

        self.names_of: dict[str, list[int]] = {}
        for i, (_, tokens) in enumerate(self.names):
            for w in {*tokens, "".join(tokens)}:
                self.names_of.setdefault(w, []).append(i)

    def words(self) -> list[str]:
        """What typed tokens may stand for: the names' tokens, and names of several tokens written together."""
        return sorted({*self.weight, *self.solid})

    def stands_for(self, token: str, word: str) -> float:
        """How far a typed token stands for one of words(), 0 if too little."""
        s = token_similarity(token, word)
        return s if s >= (0.6 if word in self.weight else 0.8) else 0.0

    def rank(self, tokens: list[str], repairs: dict[str, dict[str, float]]) -> list[tuple[float, int]]:
        """(score, key) of every entry that any token stands for, best first; soft TF-IDF."""
        typed = []
        for k, t in enumerate(tokens):
            r = repairs.get(t) or {}
            if not any(s >= 0.8 for s in r.values()) and (len(t) == 1 or t in DECORATIONS or t.isdigit() or _LEVEL.fullmatch(t) or (k and len(t) == 1)):
                r = {} if len(tokens) > 1 else r
                if not r:
                    continue
            typed.append((t, r))
        if not typed:
            return []
        best: dict[int, float] = {}
        for i in sorted({i for _, r in typed for w in r for i in self.names_of.get(w, ())}):
            key, name = self.names[i]
            whole = "".join(name)
            norm_name = sum(self.weight[w] ** 2 for w in name)
            got = 0.0
            used: set[int] = set()
            for w in name:
                at, s = max(((i, r.get(w, 0.0)) for i, (_, r) in enumerate(typed) if i not in used), key=lambda x: x[1], default=(-1, 0.0))
                if s > 0:
                    used.add(at)
                    got += s * self.weight[w] ** 2
            together = max((s for _, r in typed for w, s in r.items() if w == whole), default=0.0) if len(name) > 1 else 0.0
            if together and together * norm_name > got:
                got, used = together * norm_name, {i for i, (_, r) in enumerate(typed) if whole in r}
            if not got:
                continue
            rest = sum((0.0 if typed[i][0] in DECORATIONS else self.unknown**2) for i in range(len(typed)) if i not in used)
            score = got / math.sqrt(norm_name * (norm_name + rest)) if norm_name else 0.0
            best[key] = max(best.get(key, 0.0), score)
        return sorted(((s, k) for k, s in best.items()), key=lambda x: (-x[0], x[1]))

    def meaning(self, tokens: list[str], repairs: dict[str, dict[str, float]], accept: float = ACCEPT) -> tuple[int, float]:
        ranked = self.rank(tokens, repairs)
        if not ranked or ranked[0][0] < accept or (len(ranked) > 1 and ranked[0][0] - ranked[1][0] < 0.02):
            return -1, ranked[0][0] if ranked else 0.0
        return ranked[0][1], ranked[0][0]


_LOOKS = str.maketrans("oil", "011")


def looks(token: str) -> str:
    """One form for letters and the digits that are misread for them."""
    return token.translate(_LOOKS)


def edit_keys(token: str) -> set[str]:
    """The token and what is left of it without one or two letters: tokens at most two edits apart share such a key."""
    s = looks(token)
    one = {s[:k] + s[k + 1 :] for k in range(len(s))}
    return {s} | one | {x[:k] + x[k + 1 :] for x in one if len(s) > 3 for k in range(len(x))}


def typed_keys(token: str, longest: int) -> set[str]:
    """Join keys of a typed token: two tokens of which token_similarity is above zero share one with word_keys."""
    keys = {"e" + k for k in edit_keys(token)} if len(token) <= longest + 2 else set()
    for u in {token, token[:-1]} if token.endswith("s") else {token}:
        s = looks(u)
        if 3 <= len(u) <= longest:
            keys |= {"p" + s, f"a{s[0]}{s[1]}{s[-1]}"}
    return keys


def word_keys(word: str) -> set[str]:
    """Join keys of a reference word: its edits, beginnings, and first letters with any two later ones in order (abbreviations)."""
    s = looks(word)
    keys = {"e" + k for k in edit_keys(word)} | {"p" + s[:k] for k in range(3, len(s) + 1)}
    return keys | {f"a{s[0]}{s[i]}{s[j]}" for i in range(1, len(s)) for j in range(i + 1, len(s))}


def reference_rows(canonical: DataFrame, key: str, name: str, aliases: str) -> list[tuple[int, str, list[str]]]:
    rows = canonical.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(aliases).alias("a")).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return [(r.k, r.n, list(r.a or [])) for r in rows if r.n is not None]


def repaired_tokens(tokens: DataFrame, rows: list[tuple[int, str, list[str]]]) -> DataFrame:
    """token, words, scores: what each distinct token may stand for, by a join on the keys of both and the exact similarity of what meets."""
    spark = tokens.sparkSession
    reference = Reference(rows)
    words = reference.words()
    longest = max(map(len, words), default=0)

    def of_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"token": pdf["token"], "keys": [list(typed_keys(t, longest)) for t in pdf["token"]]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = Reference(spread.value)
        for pdf in batches:
            found = [{w: s for w in ws if (s := ref.stands_for(t, w))} for t, ws in zip(pdf["token"], pdf["words"], strict=True)]
            yield pd.DataFrame({"token": pdf["token"], "words": [list(f) for f in found], "scores": [list(f.values()) for f in found]})

    spread = spark.sparkContext.broadcast(rows)
    n = shuffle_partitions(spark)
    typed = tokens.repartition(n, F.xxhash64("token")).mapInPandas(of_tokens, "token string, keys array<string>").select("token", F.explode("keys").alias("key"))
    listed = spark.createDataFrame([(w, k) for w in words for k in word_keys(w)], "word string, key string")
    met = typed.join(listed, "key").groupBy("token").agg(F.sort_array(F.collect_set("word")).alias("words"))
    return met.mapInPandas(compare, "token string, words array<string>, scores array<double>")


def map_values(values: DataFrame, canonical: DataFrame, value: str = "value", key: str = "layer_id", name: str = "canonical_layer", aliases: str = "aliases") -> DataFrame:
    """value, layer_id (-1 if none), score for every distinct value that is not blank."""
    spark = values.sparkSession
    rows = reference_rows(canonical, key, name, aliases)
    spread = spark.sparkContext.broadcast(rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(tokens=[value_tokens(v) for v in pdf["value"]])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reference = Reference(spread.value)
        for pdf in batches:
            keys, scores = [], []
            for tokens, table in zip(pdf["tokens"], pdf["repairs"], strict=True):
                repairs = {r["token"]: dict(zip(r["words"], r["scores"], strict=True)) for r in (table if table is not None else [])}
                k, s = reference.meaning(list(tokens), repairs)
                keys.append(k)
                scores.append(round(s, 6))
            yield pd.DataFrame({"value": pdf["value"], key: keys, "score": scores})

    # stated, so that few distinct values still use all cores; by a hash, as a repetition of the same key would be optimised away
    n = shuffle_partitions(spark)
    distinct = values.select(F.col(value).alias("value")).where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct().repartition(n, F.xxhash64("value"))
    tokens = checkpoint(distinct.mapInPandas(cut, "value string, tokens array<string>"))
    repaired = repaired_tokens(tokens.select(F.explode("tokens").alias("token")).distinct(), rows)
    each = tokens.select("value", "tokens", F.explode_outer(F.array_distinct("tokens")).alias("token")).join(repaired, "token", "left")
    per_value = each.groupBy("value").agg(F.first("tokens").alias("tokens"), F.collect_list(F.when(F.size("words") > 0, F.struct("token", "words", "scores"))).alias("repairs"))
    return per_value.mapInPandas(choose, f"value string, {key} int, score double")


def typed_values(contracts: DataFrame) -> DataFrame:
    """contract_id, value: the distinct layers of each contract, as stored, that are not blank."""
    each = contracts.select("contract_id", F.explode(F.array_distinct("nodes.layer")).alias("value"))
    return each.where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()


def found_layers(contracts: DataFrame, canonical: DataFrame) -> DataFrame:
    """contract_id, layer, layer_id of the typed layers that are not letter for letter an entry."""
    names = canonical.select(F.col("canonical_layer").alias("value"))
    typed = typed_values(contracts).join(names, "value", "left_anti")
    mapped = map_values(typed.select("value"), canonical)
    return typed.join(mapped, "value").select("contract_id", F.col("value").alias("layer"), "layer_id")
