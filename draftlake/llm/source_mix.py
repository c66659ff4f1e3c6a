"""Problem 9: sources mixed to target weights by exact token budgets.

Every document gets a hash-random key. Within each source the documents are
range-partitioned by key, token counts are summed per range, the ranges' sums
are accumulated, and a document's position is its range's offset plus the
running sum inside the range: an exact distributed prefix sum. The size of a
source is its last position. A mix takes whole passes over a source while the
budget lasts, up to its cap of repeats, and cuts one more pass where the exact
budget ends (the document that would cross it is left out). A source is short if
all its passes were needed and what they delivered is still less than the budget.

Scale. As keys are uniform, ranges of equal width hold equally many documents,
whatever the source, so a source with a third of all rows is many ranges, each a
bounded window. Range sums are a table of sources x ranges, which is aggregated
and joined, not collected. The report reads single documents only of the ranges
in which a cut lies, at most one per target. Targets are joined; Catalyst
broadcasts them where their size allows.

Edge cases: sizes count over all documents, null and unknown sources included in
the corpus total; null texts have size 0 and join no mix; documents captured
twice count twice; a target source without documents is reported short; targets
without a source or number stand with a budget of zero; empty input reports zero shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlake.common import checkpoint, stable_hash

RANGE_DOCS = 5_000


def keyed_ranges(sizes: DataFrame, seed: int = 42, range_docs: int = RANGE_DOCS) -> tuple[DataFrame, DataFrame]:
    """The documents with key and range, and per source and range: tokens, docs, and both before the range (offset, docs_before)."""
    keyed = sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).withColumn("key", stable_hash("doc_id", seed=seed))
    n_ranges = max(1, keyed.count() // range_docs)
    keyed = keyed.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 63)) * n_ranges))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return keyed, summed.select("source", "range", "tokens", "docs", upto("tokens").alias("offset"), upto("docs").alias("docs_before"))


def _positions(keyed: DataFrame, ranges: DataFrame) -> DataFrame:
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(ranges.select("source", "range", "offset"), ["source", "range"])
    return placed.withColumn("upto", F.col("offset") + F.sum("n_tokens").over(inside))


def prefix_positions(sizes: DataFrame, seed: int = 42, range_docs: int = RANGE_DOCS) -> DataFrame:
    """source, doc_id, n_tokens, upto: tokens of the source up to and with the document, in the order of its random key."""
    return _positions(*keyed_ranges(sizes, seed, range_docs)).select("source", "doc_id", "n_tokens", "upto")


def budgets(sizes: DataFrame, ranges: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target row: size (last position of the source), millionths and budget of tokens, passes (whole), rest (tokens of the cut pass).

    budget = corpus * budget_permille * target_permille / 1e6 tokens, in exact decimals.
    A source without documents uses up its passes, as they deliver nothing.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    listed = targets.select("mix_id", "source", zero("budget_permille"), zero("target_permille"), zero("max_repeats"))
    corpus = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus"))
    totals = ranges.groupBy("source").agg(F.max(F.col("offset") + F.col("tokens")).alias("size"))
    asked = listed.join(totals, "source", "left").crossJoin(F.broadcast(corpus)).withColumn("size", F.coalesce("size", F.lit(0)))  # one row
    millionths = F.col("corpus").cast("decimal(20,0)") * F.col("budget_permille") * F.col("target_permille")
    cap = F.col("max_repeats").cast("long")
    passes = F.when(F.col("size") > 0, F.least(cap, F.expr("budget div size"))).otherwise(cap)
    return (
        asked.withColumn("millionths", millionths)
        .withColumn("budget", F.floor(F.col("millionths") / F.lit(1_000_000)).cast("long"))
        .withColumn("passes", passes)
        .withColumn("rest", F.when(F.col("passes") < cap, F.col("budget") - F.col("passes") * F.col("size")).otherwise(F.lit(0).cast("long")))
    )


def mix_members(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source, doc_id, n_tokens, repeats: how often each document is in each mix."""
    sizes = checkpoint(sizes)
    keyed, ranges = keyed_ranges(sizes)
    asked = budgets(sizes, ranges, targets).select("mix_id", "source", "passes", "rest")
    placed = _positions(keyed, ranges).join(asked, "source")
    repeats = F.col("passes") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)
    return placed.select("mix_id", "source", "doc_id", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def mix_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target row: budget and actual tokens, target and actual share of the mix, passes, documents of the cut pass, short."""
    sizes = checkpoint(sizes)
    keyed, ranges = keyed_ranges(sizes)
    ranges = checkpoint(ranges)
    asked = checkpoint(budgets(sizes, ranges, targets).withColumn("nth", F.monotonically_increasing_id()))
    # the range in which the budget of the cut pass ends, and the documents of such ranges up to that place
    cut = asked.select("nth", "source", "rest").join(ranges, "source").where((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("tokens")))
    placed = _positions(keyed.join(cut.select("source", "range").distinct(), ["source", "range"], "left_semi"), ranges)
    inside = cut.select("nth", "source", "range", "rest").join(placed, ["source", "range"]).where(F.col("upto") <= F.col("rest"))
    ends = inside.groupBy("nth").agg(F.max("upto").alias("reached"), F.count(F.lit(1)).alias("more"))
    cuts = cut.join(ends, "nth", "left").select("nth", F.coalesce("reached", "offset").alias("cut_tokens"), (F.col("docs_before") + F.coalesce("more", F.lit(0))).alias("cut_docs"))
    full = asked.join(cuts, "nth", "left").withColumn("actual", F.col("passes") * F.col("size") + F.coalesce("cut_tokens", F.lit(0)))
    short = (F.col("passes") >= F.col("max_repeats")) & (F.col("actual").cast("decimal(20,0)") * 1_000_000 < F.col("millionths"))
    mix = Window.partitionBy("mix_id")
    return full.select(
        "mix_id", "source", "budget", "actual", (F.col("target_permille") / 1000).alias("target_share"),
        F.round(F.try_divide(F.col("actual").cast("double"), F.sum("actual").over(mix)), 6).alias("actual_share"),
        "passes", F.coalesce("cut_docs", F.lit(0)).alias("cut_docs"), "max_repeats", short.alias("short"),
    )


def short_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_id, source of the targets that even the capped repeats can't fill: what the passes deliver is less than the budget."""
    return mix_report(sizes, targets).where("short").select("mix_id", "source")
