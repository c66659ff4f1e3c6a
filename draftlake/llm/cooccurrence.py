"""Problem 5: items that appear together, with pointwise mutual information and lift.

Items are deduplicated per basket, the ordered pairs of a basket are emitted
from one sorted array, their counts are combined map-side before the shuffle,
and the marginals give PMI and lift.

Every pair is reported by all_item_pairs. item_pairs, from which the pairs that are cases
are taken, leaves out what is in too few baskets.

Scale. An item in fewer baskets than the wanted minimum can be in no wanted pair,
so item_pairs drops it before pairs are formed (exact, as n_ab <= n_a). A pair leaves
a task once, so hot pairs don't skew the shuffle. The marginals are joined, not
broadcast by force: Catalyst broadcasts them where their measured size allows.

Edge cases: null lists and maps hold nothing; null, zero and negative counts are
no items; a basket of one item counts in N and in its marginal; an item is no
pair with itself; baskets spread over several rows are united; null ids are no
basket; empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.common import checkpoint

ADJACENT = r"(?i)^(.*?)\s+is\s+adjacent\s+to\s+the\s+(.*)$"


def clean_label(c: Column) -> Column:
    """Lower case, no outer spaces or full stops, runs of spaces, hyphens and underscores one underscore."""
    bare = F.regexp_replace(F.lower(c), r"^[\s.]+|[\s.]+$", "")
    return F.regexp_replace(bare, r"[\s_-]+", "_")


def plan_baskets(attributes: DataFrame) -> DataFrame:
    """basket, items (sorted, distinct): inventory keys with a count above zero and both labels of each adjacency sentence."""
    plan = F.regexp_replace("floor_plan_id", r"\.svg$", "")
    counted = F.map_keys(F.map_filter("inventory", lambda _, n: n > 0))
    sides = F.flatten(F.transform("adjacencies", lambda a: F.array(F.regexp_extract(a, ADJACENT, 1), F.regexp_extract(a, ADJACENT, 2))))
    none = F.array().cast("array<string>")
    items = F.concat(F.coalesce(counted, none), F.coalesce(sides, none))
    rows = attributes.where("floor_plan_id is not null").select(plan.alias("basket"), F.array_distinct(F.transform(items, clean_label)).alias("items"))
    rows = rows.select("basket", F.explode_outer("items").alias("item")).select("basket", F.when(F.col("item") != "", F.col("item")).alias("item"))
    return rows.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"))


def item_pairs(baskets: DataFrame, least: int = 5, one_in: int = 1000) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b, n, lift, pmi of the pairs in at least ``least`` baskets and in one of ``one_in``."""
    baskets = checkpoint(baskets)  # read for the marginals and for the pairs
    total = baskets.agg(F.count(F.lit(1)).alias("n"))
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    enough = lambda c: (F.col(c) >= least) & (F.col(c) * one_in >= F.col("n"))
    kept = single.crossJoin(F.broadcast(total)).where(enough("n_item"))  # one row
    # frequent items only: at most (mean basket size) x one_in of them, a bound independent of the data's size
    vocabulary = kept.agg(F.collect_set("item").alias("frequent"))
    held = baskets.crossJoin(F.broadcast(vocabulary)).select(F.array_sort(F.array_intersect("items", "frequent")).alias("items"))
    return _scored(_together(held), kept).where(enough("n_ab"))


def all_item_pairs(baskets: DataFrame) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b, n, lift, pmi of every pair that is in a basket, however rare."""
    baskets = checkpoint(baskets)
    total = baskets.agg(F.count(F.lit(1)).alias("n"))
    single = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    return _scored(_together(baskets), single.crossJoin(F.broadcast(total)))  # one row


def _together(held: DataFrame) -> DataFrame:
    first = held.where(F.size("items") > 1).select("items", F.posexplode("items").alias("at", "item_a"))
    pairs = first.select("item_a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))


def _scored(together: DataFrame, marginals: DataFrame) -> DataFrame:
    scored = together.join(marginals.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n"), "item_a").join(
        marginals.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b"
    )
    lift = F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b"))
    return scored.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round(lift, 6).alias("lift"), F.round(F.log2(lift), 6).alias("pmi"))


def associated(pairs: DataFrame, factor: int = 3) -> DataFrame:
    """Pairs together at least ``factor`` times as often as chance."""
    return pairs.where(F.col("n_ab") * F.col("n") >= factor * F.col("n_a") * F.col("n_b"))
