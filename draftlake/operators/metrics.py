"""Retrieval metrics over hit lists and rank tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10)
EXACT_HARMONIC = 10_000


def first_hits(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id and the rank of its first relevant hit (null if none); every query of ``relevant`` has a row.

    hits(query_id, item, rank); relevant(query_id, item).
    """
    found = hits.join(relevant, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return relevant.select("query_id").distinct().join(found, "query_id", "left")


def recall(first: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    hit = lambda k: F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)))
    return first.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(hit(k), 6).alias(f"recall_at_{k}") for k in ks))


def mrr(first: DataFrame, within: int = 10) -> DataFrame:
    """Mean reciprocal rank; a miss or a rank beyond ``within`` counts zero."""
    return first.agg(F.round(F.avg(F.coalesce(F.when(F.col("first_rank") <= within, 1 / F.col("first_rank")), F.lit(0.0))), 6).alias("mrr"))


def recall_by(first: DataFrame, groups: DataFrame, k: int = 5) -> DataFrame:
    """Recall@k per group; groups(query_id, bucket)."""
    hit = F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))
    return first.join(groups, "query_id").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(hit), 6).alias("recall"))


def random_recall(n_index: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, recall of random answers: min(k / N, 1); n_index has one row (n)."""
    return n_index.select("n", F.explode(F.array(*map(F.lit, ks))).alias("k")).select("k", F.least(F.col("k") / F.col("n"), F.lit(1.0)).alias("recall"))


def full_rank_metrics(ranks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Percentages R@k and MRR and the lower median of rank (from 1) of the one right item of every query."""
    return ranks.agg(
        *(F.round(100 * F.avg((F.col("rank") <= k).cast("int")), 2).alias(f"r_at_{k}") for k in ks),
        F.round(100 * F.avg(1 / F.col("rank")), 2).alias("mrr"),
        F.round(F.expr("percentile_disc(0.5) within group (order by rank)"), 1).alias("median_rank"),
    )


def both_directions(forward: DataFrame, backward: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """direction and full_rank_metrics of the ranks of texts among plans and of plans among texts."""
    named = lambda ranks, name: full_rank_metrics(ranks, ks).select(F.lit(name).alias("direction"), "*")
    return named(forward, "forward").unionByName(named(backward, "backward"))


def random_ranks(n_index: DataFrame) -> DataFrame:
    """Analytic baseline in percent: 1/N, and the harmonic number over N.

    The harmonic number is summed up to EXACT_HARMONIC; beyond it the expansion
    ln n + gamma + 1/2n - 1/12n^2 is exact to the last digit of a double.
    """
    n = F.col("n")
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(EXACT_HARMONIC).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / i)
    expanded = F.log(n.cast("double")) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n.cast("double") * n)
    harmonic = F.when(n > EXACT_HARMONIC, expanded).otherwise(summed)
    return n_index.select("n", F.round(100 / F.col("n"), 6).alias("r_at_1"), F.round(100 * harmonic / F.col("n"), 6).alias("mrr"))


def metric_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta of two tidy tables (metric, value)."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric").select("metric", "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def tidy(wide: DataFrame) -> DataFrame:
    """metric, value of a one-row table of numbers."""
    return wide.unpivot([], wide.columns, "metric", "value") if len({t for _, t in wide.dtypes}) == 1 else wide.select(*(F.col(c).cast("double") for c in wide.columns)).unpivot([], wide.columns, "metric", "value")


def label_precision(hits: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """label, precision@k of the neighbours' labels; hits(query_id, row, rank), labels(row, label); unknown labels are -1."""
    of = lambda name, value: labels.select(F.col("row").alias(name), F.col("label").alias(value))
    joined = hits.where(F.col("rank") <= k).join(of("query_id", "own"), "query_id", "left").join(of("row", "other"), "row", "left")
    match = F.coalesce("own", F.lit(-1)) == F.coalesce("other", F.lit(-1))
    return joined.groupBy(F.coalesce("own", F.lit(-1)).alias("label")).agg(
        F.countDistinct("query_id").alias("n_queries"), F.round(F.sum(match.cast("int")) / (F.countDistinct("query_id") * k), 6).alias("precision")
    )


def group_similarity(vectors: DataFrame, dim: int) -> DataFrame:
    """Mean cosine within each label (without self pairs) and to all other labels, of unit vectors.

    A sum of dot products is the dot product of sums, so only per-label sums are needed
    and no pair is formed: within = (|S|^2 - n) / (n (n - 1)).
    """
    doubles = vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    sums = doubles.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    counts = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = sums.groupBy("i").agg(F.sum("s").alias("t"))
    dots = sums.join(total, "i").groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("own"), F.sum("q").alias("self"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("cross"))
    every = counts.agg(F.sum("n").alias("all"))
    joined = dots.join(counts, "label").crossJoin(F.broadcast(every))  # one row
    n, others = F.col("n"), F.col("all") - F.col("n")
    within, across = F.try_divide(F.col("own") - F.col("self"), n * (n - 1)), F.try_divide(F.col("cross"), n * others)
    return joined.select("label", "n", F.round(within, 6).alias("within"), F.round(across, 6).alias("across"))


def score_spread(scores: DataFrame) -> DataFrame:
    """query_id, spread (highest less lowest stored score) and gap (first less second) of stored answers."""
    s = F.filter("top_k_scores", lambda x: x.isNotNull())
    ordered = F.sort_array(s, asc=False)
    gap = F.when(F.size(s) > 1, F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))
    return scores.where("top_k_scores is not null").select("query_id", F.round(F.array_max(s) - F.array_min(s), 6).alias("spread"), F.round(gap, 6).alias("gap"))


def weighted_means(batches: DataFrame) -> DataFrame:
    """Mean of per-batch values weighted by batch size; batches(size, value)."""
    return batches.agg(F.round(F.try_divide(F.sum(F.col("size") * F.col("value")), F.sum("size")), 6).alias("mean"))


def contrastive_loss(scores: DataFrame, scale: float) -> DataFrame:
    """Symmetric cross-entropy of a square table of similarities (i, j, score) with the diagonal as the right answers."""
    logit = F.col("score") * min(scale, 100.0)

    def one_way(axis: str) -> DataFrame:
        highest = scores.groupBy(axis).agg(F.max(logit).alias("m"))
        joined = scores.join(highest, axis)
        per = joined.groupBy(axis).agg(F.log(F.sum(F.exp(logit - F.col("m")))).alias("l"), F.first("m").alias("m"), F.max(F.when(F.col("i") == F.col("j"), logit)).alias("right"))
        return per.agg(F.avg(F.col("l") + F.col("m") - F.col("right")).alias("loss"))

    return one_way("i").crossJoin(one_way("j").withColumnRenamed("loss", "other")).select(F.round((F.col("loss") + F.col("other")) / 2, 6).alias("loss"))
