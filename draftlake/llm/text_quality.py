"""Problem 10: text statistics per document, their distribution tails per language, and the kind of text.

Every document's statistics cover its whole text and are computed by Arrow's kernels
over the lines and tokens of many documents at once, never row by row: words, mean word length, symbols, lines that end in punctuation, common words, and which
shares of the text stand in sentences, in short entries, in cells and in unreadable
matter. Mergeable KLL quantile sketches of each statistic are built per language
(map-side partial sketches, merged after one small shuffle), values become robust
z-scores and percentiles against them, and values in a tail are flagged.

A text is no prose if its share of sentences is in the lower tail of its language. Its
kind is then the structure whose share lies furthest out. So the same text may be
usual in one collection and unusual in another.

z is (value - median) / spread, the spread being the distance of the 40th from the 60th
percentile as if the values were normal, so that up to two fifths of a language's
documents may be of other kinds without moving it. Shares of most documents are all
but equal; their spread counts as SHARE_SPREAD at least.

Scale. The sketches are a few hundred values per language and statistic, the
only thing joined back, and the number of languages is bounded by grouping all
unknown codes as one. No document is shuffled where a table has more splits than
the cluster has cores; what leaves the scan's task is a row of numbers per document.

Edge cases: null and blank texts have null statistics and no kind; unknown, null
and upper-case languages are normalised; very long texts are read whole, and nothing
depends on their length; a language with few documents is measured against those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.common import checkpoint, spread

LANGUAGES = ("en", "de", "fr", "es")
#: Common words per language, fixed values.
COMMON = {
    "en": "the a an and or of in on to at with for that this is are was were be been has have had by from it its as not but so which who when where than then into out up no only one all more most some there they them their we our you your he she his her if would could should will can may must do does did about after before between under over what why how each every other because while during".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder von im in am an auf zu zum zur mit für ist sind war waren wird werden wurde hat haben nicht aber nur als auch noch nach vor bei aus über unter zwischen wenn dass weil obwohl sie es er wir ihr man sich davon dort hier wie was keine kein".split(),
    "fr": "le la les un une des et ou de du au aux en dans sur à pour par avec sans est sont était été a ont il elle ils elles on nous vous ce cette ces qui que dont mais ne pas plus sous entre après avant si car l d n s qu se son sa ses leur y lui".split(),
    "es": "el la los las un una unos unas y o de del al en con por para sin es son era fue ha han no pero más que se su sus lo le les como cuando donde entre sobre bajo antes después si porque ya este esta hay".split(),
}
_ALL_COMMON = sorted({w for ws in COMMON.values() for w in ws})

#: Marks that open an entry of a list.
BULLET = r"^(?:>\s*)?(?:\[[ xX]?\]|[-*+•‣◦–—·o>]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]|\d{1,3}(?:\.\d{1,3})+\.?|\d{1,3}\s+[-–])\s+"
#: Dots or a rule that lead to a page or a gap to be filled in.
LEADER = r"(?:\.{3,}|…|_{3,}|·{3,})\s*\d*$"
MARKS = "/ | ; , • · - – — & +".split()
NUMBER = r"^[-+]?\d[\d.,:/%°²³xX-]*$"
#: Pieces of vector paths and of encoded bytes.
PATH = r"^(?:[MmLlHhVvAaCcQqSsTtZz]?-?\d[\d.,-]*|[MmLlHhVvAaCcQqSsTtZz])$"
HEX = r"^(?:(?:0x)?[0-9a-fA-F]{2}|[0-9A-F]{4}(?:-[0-9A-F]{4})+|[0-9a-fA-F]{8,})$"
#: Markup, and what wrongly decoded letters look like.
ODD = r"<[^<>]*>|&#?\w{1,8};|�|[¤¥©±¼½¾™€¶¿Â]\S|Ã.|â.|Ð.|ï."
_EDGE = r"""[.,;:!?…\-–—/“”„"«»'‘’()\[\]]*"""
#: A token that could be a word of running text: letters, a vowel among them and no heap of consonants; or a plain number, mark or letter.
_WORD_SHAPE = r"^" + _EDGE + r"\pL[\pL'’./&()-]{1,25}" + _EDGE + "$"
_VOWEL = r"(?i)[aeiouyäöüáéíóúàèìòùâêîôûëïœæ]"
_CONSONANTS = r"(?i)[bcdfghjklmnpqrstvwxz]{6}"
_OTHER_SHAPE = r"(?i)^" + _EDGE + r"(?:[-+]?\d[\d.,:/%°²³x-]*|x\d{1,3}|n\d{3,6}|[aeiouylndscà])" + _EDGE + "$"
PUNCTUATION = ".,;:!?…-–—/“”„\"«»'‘’()[]*|"
#: Letters and figures or semicolons in one token, where a line's words are looked at one by one.
MIXED = r"\d\pL|\pL\d|;\pL|;;"
#: Texts that only hold a place; fixed values.
PLACEHOLDER = (
    r"(?is)^\W*(?:tbd|tba|tbc|todo|n/?a|none|null|nil|nan|xxx+|xx|test|placeholder|lorem ipsum.*|untitled|empty|-+|\?+|\.+|\d{1,6}|fixme|wip|draft|see above"
    r"|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\})\W*$"
)
SENTENCE_MARKS = list(".!?:;…\"”»’")
#: Characters for which an entry or a row counts at least, about a third of a sentence.
ENTRY_CHARS = 33
#: Tokens of a window in which distinct ones are counted; their share of a whole text falls with its length.
WINDOW = 50
#: Least spread of a share; with FAR it means that a text of which half is usual is not unusual.
SHARE_SPREAD = 0.14
FAR = 3.5
#: Text looked at together in a worker.
SLICE_BYTES = 8 << 20
#: Distance of the 40th from the 60th percentile of the standard normal distribution.
_INNER = 0.5067

KINDS = ("list", "table", "junk")
SHARES = ("prose_share", "list_share", "table_share", "junk_share")
PERCENTILES = ("symbol_ratio", "punctuated_lines", "common_words", "prose_share")
STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", *SHARES)


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def _among(values: pa.Array, words: list[str]) -> np.ndarray:
    return pc.is_in(values, value_set=pa.array(words, pa.string())).to_numpy(zero_copy_only=False)


def _lengths(values: pa.Array) -> np.ndarray:
    return pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(values: pa.Array, char: str) -> np.ndarray:
    return pc.count_substring(values, char).to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and of which list each is."""
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(at: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n)


def _wordlike(tokens: pa.Array) -> np.ndarray:
    word = _matches(tokens, _WORD_SHAPE) & _matches(tokens, _VOWEL) & ~_matches(tokens, _CONSONANTS)
    return word | _matches(tokens, _OTHER_SHAPE)


def _cells(raw: pa.Array, t: pa.Array, doubled: np.ndarray) -> np.ndarray:
    """Thousands: the mark that divides a line into cells; below: the number of cells."""
    gaps = np.ones(len(t), np.int64)
    at = np.nonzero(doubled)[0]
    if len(at):
        gaps[at] = pc.list_value_length(pc.split_pattern_regex(t.take(pa.array(at)), r"\s{2,}")).to_numpy(zero_copy_only=False)
    tabs, pipes, semis, commas = _counted(raw, "\t"), _counted(t, "|"), _counted(t, ";"), _counted(t, ",")
    edges = pc.starts_with(t, "|").to_numpy(zero_copy_only=False).astype(np.int64) + pc.ends_with(t, "|").to_numpy(zero_copy_only=False)
    most = lambda x: np.minimum(x, 998)
    return np.select(
        [tabs > 0, pipes >= 2, gaps >= 3, semis > 0, commas > 0, gaps == 2],
        [1001 + most(tabs), 2001 + most(pipes - edges), 3000 + most(gaps), 4001 + most(semis), 5001 + most(commas), np.full(len(t), 3002)], 1,
    )


def _variety(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document its tokens, and the mean number of distinct ones in windows of WINDOW tokens in a row."""
    n_tokens = _sums(doc, n).astype(np.int64)
    first = np.cumsum(n_tokens) - n_tokens
    windows = -(-n_tokens // WINDOW)
    window = (np.cumsum(windows) - windows)[doc] + (np.arange(len(doc)) - first[doc]) // WINDOW
    n_codes = int(codes.max(initial=0)) + 1
    held = window * n_codes + codes
    held.sort()
    distinct = held[np.diff(held, prepend=-1) != 0] // n_codes
    of = np.repeat(np.arange(n), windows)
    # a last window that is not full counts as half of one on average, so that the figure doesn't depend on the length
    full = np.maximum(1.0, (windows + n_tokens / WINDOW) / 2)
    return n_tokens, _sums(of[distinct], n) / full


def describe(texts: pa.Array, langs: list[str]) -> dict[str, np.ndarray]:
    """The statistics of texts that are not blank, by kernels over whole columns: lines, tokens and their counts."""
    n_docs = len(texts)
    solid = _lengths(pc.replace_substring_regex(texts, r"\s+", ""))
    symbols = _lengths(pc.replace_substring_regex(texts, r"[\pL\pN\s]+", ""))
    debris = _matches(pc.utf8_trim_whitespace(texts), PLACEHOLDER)
    raw, doc = _pieces(pc.split_pattern(pc.replace_substring_regex(texts, "\r\n|[\r\x0b\x0c\x85  ]", "\n"), "\n"))
    t = pc.utf8_trim_whitespace(raw)
    held = pc.binary_length(t).to_numpy(zero_copy_only=False) > 0
    raw, t, doc = raw.filter(pa.array(held)), t.filter(pa.array(held)), doc[held]
    n_lines = len(t)
    bare = pc.replace_substring_regex(t, BULLET, "")
    n = _lengths(t)
    bullet = _lengths(bare) < n
    body = pc.replace_substring_regex(bare, r"(?i)\bn/a\b", "0")
    doubled = pc.match_substring(t, "  ").to_numpy(zero_copy_only=False)
    cells = _cells(raw, t, doubled)
    n_cells, mark = np.where(cells > 1, cells % 1000, 1), cells // 1000
    spaced = doubled & _matches(t, r"\S\s{3,}\S")

    split = pc.replace_substring_regex(body, "['’]", " ")
    tokens, line = _pieces(pc.utf8_split_whitespace(split))
    keep = ~_among(tokens, [*MARKS, ""])
    tokens, line = tokens.filter(pa.array(keep)), line[keep]
    low = pc.utf8_lower(pc.utf8_trim(tokens, PUNCTUATION))
    word = pc.greater_equal(low, "a").to_numpy(zero_copy_only=False)
    common = _among(low, _ALL_COMMON)
    n_tokens, n_words, n_common = _sums(line, n_lines).astype(np.int64), _sums(line, n_lines, word), _sums(line, n_lines, common)

    odd = np.zeros(n_lines, np.int64)
    at = np.nonzero(_matches(t, "[<&�¤¥©±¼½¾™€¶¿ÂÃâÐï]"))[0]
    if len(at):
        odd[at] = n[at] - _lengths(pc.replace_substring_regex(t.take(pa.array(at)), ODD, ""))
    mixed = _matches(t, MIXED)
    reads = (n_words >= 4) & (n_common >= 0.2 * n_words) & ((n_common >= 2) | (n_words >= 6)) & (n_words >= 0.7 * n_tokens) & (odd < 0.1 * n)

    # single tokens are looked at only where a line doesn't read like a sentence
    close = (~reads | mixed)[line]
    some, some_line = tokens.filter(pa.array(close)), line[close]
    per = lambda mask: _sums(some_line, n_lines, mask)
    wordlike = per(_wordlike(some))
    sentence = reads & (~mixed | (wordlike >= 0.75 * n_tokens))
    digits, hexes, paths, numbers = (per(_matches(some, x)) for x in (r"\d", HEX, PATH, NUMBER))

    letters = _matches(body, r"\pL")
    before, after = np.zeros(n_lines, bool), np.zeros(n_lines, bool)
    before[1:] = (cells[1:] == cells[:-1]) & (doc[1:] == doc[:-1])
    after[:-1] = before[1:]
    weak = mark > 3  # semicolons and commas stand in sentences and lists too
    columns = (n_cells >= 2) & (before | after) & (~weak | (n_cells >= 3) | (before & after))
    per_doc = _sums(doc, n_docs)
    encoded = (n_tokens >= 4) & letters & (((digits > 0.3 * n_tokens) & (hexes > 0.5 * n_tokens)) | (paths == n_tokens))
    figures = (n_tokens >= 2) & (per_doc[doc] > 1) & (numbers == n_tokens)
    rule = (mark == 2) & ~_matches(t, r"[\pL\pN]")
    in_gaps = spaced & (_sums(doc, n_docs, spaced)[doc] >= 2) & (n_words <= 4 * np.maximum(2, n_cells)) & ~bullet
    listed = (n_words > 0) & (n_words <= 8) & _matches(body, LEADER)
    in_cells = columns & (~weak | ((n < 30 * n_cells) & ~(bullet & (n_cells == 2))))
    kind = np.select(
        [sentence & ~(columns & ((mark == 1) | (mark == 2))) & ~in_gaps, odd > 0.15 * n, encoded, listed, figures | rule | in_gaps, in_cells, wordlike < 0.6 * np.maximum(1, n_tokens)],
        [0, 3, 3, 1, 2, 2, 3], 1,
    )
    entries = np.ones(n_lines, np.int64)
    at = np.nonzero(kind == 1)[0]
    if len(at):
        parts, of = _pieces(pc.split_pattern_regex(body.take(pa.array(at)), r"\s*[;/|•·]\s*|,\s+"))
        entries[at] = np.maximum(1, _sums(of, len(at), pc.binary_length(pc.utf8_trim_whitespace(parts)).to_numpy(zero_copy_only=False) > 0))
    weight = np.where((kind == 1) | (kind == 2), np.maximum(n, ENTRY_CHARS * entries), n)
    p, l, tab, j = (_sums(doc[kind == k], n_docs, weight[kind == k]) for k in range(4))

    # a few words without a verb read like a heading; there is nothing to list
    heading = _sums(doc[kind == 1], n_docs, entries[kind == 1]) < 3
    p, l = np.where(heading, p + l, p), np.where(heading, 0.0, l)
    token_doc = doc[line]
    codes = low.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    in_doc, variety = _variety(codes, token_doc, n_docs)
    width = np.minimum(in_doc, WINDOW)
    debris |= (in_doc >= 5) & (variety <= 0.25 * width) & ((variety <= 3) | (variety < 0.15 * width))
    every = np.maximum(1.0, p + l + tab + j)
    share = lambda x, of_debris: np.where(debris, of_debris, x / every)

    known = np.zeros(len(tokens), bool)
    lang_of = np.array([LANGUAGES.index(x) if x in LANGUAGES else -1 for x in langs], np.int64)[token_doc]
    for k, name in [(-1, None), *enumerate(LANGUAGES)]:
        at = np.nonzero(lang_of == k)[0]
        if len(at):
            known[at] = _among(low.take(pa.array(at)), COMMON[name]) if name else common[at]
    words = _sums(token_doc, n_docs, word)
    some_words = np.maximum(words, 1)
    ended = _among(pc.utf8_slice_codeunits(t, -1), SENTENCE_MARKS)
    return {
        "n_words": words, "mean_word_length": _sums(token_doc, n_docs, _lengths(low) * word) / some_words, "symbol_ratio": symbols / np.maximum(solid, 1),
        "punctuated_lines": _sums(doc, n_docs, ended) / np.maximum(per_doc, 1), "common_words": _sums(token_doc, n_docs, known) / some_words,
        "prose_share": share(p, 0.0), "list_share": share(l, 0.0), "table_share": share(tab, 0.0), "junk_share": share(j, 1.0),
    }


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        # texts of about SLICE_BYTES at a time, so that a batch of long ones takes no more memory
        upto = np.cumsum(pc.binary_length(whole.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            b = whole.slice(at, to - at)
            at = to
            got = describe(b.column(2), b.column(1).to_pylist())
            yield pa.record_batch({"doc_id": b.column(0), "lang": b.column(1), **{s: pa.array(got[s], pa.float64()) for s in STATISTICS}})


def normal_language(c: Column | str) -> Column:
    """Lower-case code of a known language, ``other`` for anything else."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*LANGUAGES), low).otherwise(F.lit("other"))


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang and the statistics of every text that is not null or blank."""
    held = documents.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\s\p{Z}]"))
    columns = held.select(F.col("doc_id").cast("long").alias("doc_id"), normal_language("lang").alias("lang"), "text")
    return spread(columns).mapInArrow(_describe, "doc_id long, lang string, " + ", ".join(f"{s} double" for s in STATISTICS))


def language_sketches(stats: DataFrame) -> DataFrame:
    """One row per language with a KLL sketch of every statistic; sketches of parts can be merged."""
    return stats.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), *(F.kll_sketch_agg_double(s).alias(f"k_{s}") for s in STATISTICS))


def _below(statistic: str):  # noqa: ANN202
    return lambda q: q < F.col(statistic)


def scored_texts(stats: DataFrame, sketches: DataFrame, far: float = FAR) -> DataFrame:
    """Statistics with robust z-scores and percentiles (in steps of five) against the sketches, the statistics in a tail, and the kind."""
    at = lambda s, q: F.kll_sketch_get_quantile_double(f"k_{s}", F.lit(q))
    marks = sketches.select(
        "lang", *(x for s in STATISTICS for x in (at(s, 0.5).alias(f"m_{s}"), ((at(s, 0.6) - at(s, 0.4)) / _INNER).alias(f"w_{s}"))),
        *(F.array(*(at(s, q / 20) for q in range(1, 20))).alias(f"q_{s}") for s in PERCENTILES),
    )
    joined = stats.join(F.broadcast(marks), "lang")  # at most one row per known language and one for the others
    width = lambda s: F.greatest(F.col(f"w_{s}"), F.lit(SHARE_SPREAD)) if s in SHARES else F.when(F.col(f"w_{s}") > 0, F.col(f"w_{s}"))
    scores = joined.select("*", *(((F.col(s) - F.col(f"m_{s}")) / width(s)).alias(f"z_{s}") for s in STATISTICS))
    tails = F.filter(F.array(*(F.when(F.abs(F.col(f"z_{s}")) > far, F.lit(s)) for s in STATISTICS)), lambda x: x.isNotNull())
    furthest = F.array_max(F.array(*(F.struct(F.col(f"z_{k}_share").alias("z"), F.lit(k).alias("kind")) for k in KINDS)))["kind"]
    return scores.select(
        "doc_id", "lang", *STATISTICS, *(F.round(f"z_{s}", 4).alias(f"z_{s}") for s in STATISTICS),
        *((5 * F.size(F.filter(f"q_{s}", _below(s)))).alias(f"p_{s}") for s in PERCENTILES),
        tails.alias("tails"), F.when(F.col("z_prose_share") < -far, furthest).otherwise(F.lit("prose")).alias("kind"),
    )


def flagged_texts(stats: DataFrame, far: float = FAR) -> DataFrame:
    """scored_texts against the sketches of the same collection."""
    stats = checkpoint(stats)  # numbers only; the texts are read once, for the sketches and for the scores
    return scored_texts(stats, language_sketches(stats), far)


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_id, kind of the texts that are no prose."""
    return flagged_texts(text_statistics(documents)).where("kind <> 'prose'").select("doc_id", "kind")
