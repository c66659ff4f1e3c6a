"""String rules of the retrieval pipeline as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import vectors

# Results must equal those of existing exports.
INVALID_LABELS = ["", "0", "-1"]
MAX_LABEL_CHARS = 40
CAD_CODE = r"(?i)[$]|[#]|\d{4,}\s*x\s|^lf|^p\d|^a[-_]|^knot[-_]|^0[-_]|^s[-_]|^m[-_]|^dim[-_]|symb|\[|\]|^vpipe|^equip[-_]|(?:[^\s]+[-_]){2,}[^\s]+"
ABBREVIATIONS = [
    (r"\bbhk\.?\b", "bedroom hall kitchen"),
    (r"\brk\b", "room kitchen"),
    (r"\bsq\s*ft\b", "square feet"),
    (r"\bsqft\b", "square feet"),
    (r"\bw/\b", "with"),
    (r"\bw/o\b", "without"),
    (r"\b2br\b", "2 bedroom"),
    (r"\b3br\b", "3 bedroom"),
]
#: For strict=False: what the shorthand means, where the fixed rules miss or garble it.
REPAIRED_ABBREVIATIONS = [
    (r"\bw/o(?=\s|$)", "without"),
    (r"\bw/(?=\s|$)", "with"),
    (r"\b(\d+)\s*bhk\b\.?", "$1 bedroom hall kitchen"),
    (r"\b(\d+)\s*rk\b", "$1 room kitchen"),
    (r"\bsq\.?\s*ft\b\.?", "square feet"),
    (r"\b(\d+)\s*br\b", "$1 bedroom"),
]
#: What every rule's match contains.
SHORTHAND = r"bhk|(?<![a-z])rk|\dbr|\d\s*[br]|sq|w/"
LAYER_NAMES = {"地饰": "FLOOR_DECORATION", "家具": "FURNITURE", "装施家具": "INSTALLED_FURNITURE"}
NOT_IN_TEXT = [
    "wall", "window", "opening_symbol", "dimension", "single_door", "axis", "floor_decoration", "hatch", "installed_furniture", "column", "blind_window", "dote", "curtwall",
]
NOTHING_TO_LIST = "key interior elements"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Blanks and word boundaries of all scripts, which Java's \s and \b leave out.
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_LETTER = r"[\p{L}\p{N}_]"
BOUNDARY = f"(?:(?<={_LETTER})(?!{_LETTER})|(?<!{_LETTER})(?={_LETTER}))"


def any_script(pattern: str) -> str:
    """The pattern with \\s and \\b meant for all scripts."""
    return pattern.replace(r"\b", BOUNDARY).replace(r"\s", BLANK)


def normalise_query(c: Column | str, strict: bool = True) -> Column:
    """Lower case, outer blanks removed, shorthand expanded. ``strict`` keeps the fixed rules with their gaps."""
    rules = ABBREVIATIONS if strict else REPAIRED_ABBREVIATIONS
    bare = F.regexp_replace(F.lower(col(c)), f"^{BLANK}+|{BLANK}+$", "")
    expanded = reduce(lambda x, rule: F.regexp_replace(x, F.lit(any_script(rule[0])), F.lit(rule[1])), rules, bare)
    # one search without boundaries tells the texts that hold no shorthand at all
    return F.when(bare.rlike(SHORTHAND), expanded).otherwise(bare)


def is_garbage_label(c: Column | str) -> Column:
    return (F.length(col(c)) > MAX_LABEL_CHARS) | col(c).rlike(CAD_CODE)


def clean_label(c: Column | str) -> Column:
    """The trimmed label, null if it is a sentinel or a CAD code."""
    t = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return F.when(~t.isin(INVALID_LABELS) & ~is_garbage_label(t), t)


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike("[\\u4e00-\\u9fff]")


def layer_name(c: Column | str, translations: dict[str, str] | None = None) -> Column:
    """Known translation, else upper case with underscores; names in CJK script without a translation stay as they are."""
    known = LAYER_NAMES | (translations or {})
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(table, col(c)), F.when(has_cjk(c), col(c)).otherwise(F.upper(F.replace(col(c), F.lit(" "), F.lit("_")))))


def strip_svg(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\.svg$", "")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def plan_stem(path: Column | str) -> Column:
    """File name without folder, extension and the ``_contract`` ending."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), r"_contract$", "")


def humanise(c: Column | str) -> Column:
    spaced = F.replace(col(c), F.lit("_"), F.lit(" "))
    return F.when(spaced == "bed", F.lit("bedroom")).otherwise(spaced)


def pluralise(noun: Column, count: Column) -> Column:
    low = F.lower(noun)
    return (
        F.when(count == 1, noun)
        .when(noun == "axis", F.lit("axes"))
        .when(low.rlike("[^aeiou]y$"), F.concat(F.substring(noun, F.lit(1), F.length(noun) - 1), F.lit("ies")))
        .when(low.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es")))
        .otherwise(F.concat(noun, F.lit("s")))
    )


def count_phrase(label: Column, count: Column) -> Column:
    """``3 sofas``, ``1 bedroom``, ``2 furniture items``."""
    noun, number = humanise(label), count.cast("string")
    some = lambda one: F.when(count == 1, F.lit(one)).otherwise(F.lit(one + "s"))
    furniture = noun.isin("furniture", "installed furniture")
    return (
        F.when(furniture, F.concat(number, F.lit(" "), noun, some(" item")))
        .when(noun.startswith("text "), F.concat(number, F.lit(" "), F.substring(noun, F.lit(6), F.length(noun)), some(" annotation")))
        .otherwise(F.concat(number, F.lit(" "), pluralise(noun, count)))
    )


def join_english(parts: Column) -> Column:
    """One, two, or several parts with commas and a final ``and``."""
    n = F.size(parts)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.get(parts, F.lit(0)))
        .when(n == 2, F.concat_ws(" and ", parts))
        .otherwise(F.concat(F.array_join(F.slice(parts, 1, n - 1), ", "), F.lit(", and "), F.get(parts, n - 1)))
    )


def top_inventory(inventory: Column | str, n: int = 4) -> Column:
    """Sorted array of (-count, label), the n most frequent labels that belong in a text."""
    entries = F.map_entries(col(inventory))
    kept = F.filter(entries, lambda e: ~F.lower(e["key"]).contains("text") & ~e["key"].isin(NOT_IN_TEXT) & (e["value"] > 0))
    return F.slice(F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("minus_count"), e["key"].alias("label")))), 1, n)


def inventory_phrases(inventory: Column | str) -> Column:
    return F.transform(top_inventory(inventory), lambda e: count_phrase(e["label"], -e["minus_count"]))


def listed(phrases: Column) -> Column:
    """The phrases as one; give a column, not an expression, as it is used several times."""
    return F.when(F.size(phrases) > 0, join_english(phrases)).otherwise(F.lit(NOTHING_TO_LIST))


def inventory_text(inventory: Column | str) -> Column:
    return listed(inventory_phrases(inventory))


def adjacency_clause(adjacencies: Column | str) -> Column:
    """Sentence on the first two adjacencies, empty if there is none."""
    return clause_of(F.transform(F.slice(col(adjacencies), 1, 2), humanise))


def clause_of(first: Column) -> Column:
    n = F.size(first)
    return (
        F.when(n == 1, F.concat(F.lit(" Spatially, the "), F.get(first, F.lit(0)), F.lit(".")))
        .when(n == 2, F.concat(F.lit(" Spatially, the "), F.get(first, F.lit(0)), F.lit(", and the "), F.get(first, F.lit(1)), F.lit(".")))
        .otherwise(F.lit(""))
    )


def query_text(template: Column, density: Column, inventory: Column, clause: Column) -> Column:
    """One of the four fixed sentences; template in 0..3."""
    said = [
        ("This is a ", " layout featuring "),
        ("A ", " floor plan with "),
        ("In this ", " plan, you can find "),
        ("The drawing shows a ", " arrangement containing "),
    ]
    part = lambda i: F.get(F.array(*(F.lit(s[i]) for s in said)), template.cast("int"))
    return F.concat(part(0), density, part(1), inventory, F.lit("."), clause)


def template_of(plan: Column, seed: int = 42) -> Column:
    """Which of the four sentences a plan gets, 0 to 3, by a hash of its id and the seed."""
    return vectors.random_order(plan, seed) % 4


def with_queries(attributes: DataFrame, plan: Column, seed: int = 42) -> DataFrame:
    """``attributes`` with the column query. The phrases and items are columns of their own, so that no step is evaluated for each of its uses."""
    keep = attributes.columns
    phrased = attributes.select("*", template_of(plan, seed).alias("_template"), inventory_phrases("inventory").alias("_phrases"), F.transform(F.slice("adjacencies", 1, 2), humanise).alias("_first"))
    items = phrased.select(*keep, "_template", "_first", listed(F.col("_phrases")).alias("_items"))
    return items.select(*keep, query_text(F.col("_template"), F.col("density"), F.col("_items"), F.coalesce(clause_of(F.col("_first")), F.lit(""))).alias("query"))


def adjacency_sentence(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(" is adjacent to the "), F.greatest(a, b))


def duration(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def clipped(c: Column | str, n: int = 80) -> Column:
    return F.concat(F.substring(col(c), 1, n), F.lit("..."))
