"""Splits and batches. All choices follow a hash of the id and a seed, so they don't depend on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlake.common import numbered_in_order
from draftlake.functions.vectors import random_order


def numbered(df: DataFrame, order: list[Column], name: str = "rn", bins: int = 1024, key: Column | None = None) -> DataFrame:
    """Row number over the whole table in the order of a random key, without one task sorting it all.

    ``key`` (the first of ``order``, in [0, 2**32)) is cut into ranges; rows are numbered
    within their range and offset by the counts of the ranges before.
    """
    if key is None:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    ranged = df.withColumn("_bin", F.floor(key / F.lit((1 << 32) // bins)))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).select("_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # at most ``bins`` rows
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(*order))
    return ranged.withColumn("_rn", inside).join(F.broadcast(offsets), "_bin").withColumn(name, F.col("_before") + F.col("_rn")).drop("_bin", "_rn", "_before")


def stratified_split(rows: DataFrame, id_col: str, stratum: Column, n_test: int = 200, seed: int = 99) -> DataFrame:
    """id, stratum, split: per stratum min(n_test // strata, size) test rows, filled up at random to n_test."""
    key = random_order(F.col(id_col), seed)
    base = rows.select(F.col(id_col).alias("id"), stratum.alias("stratum"), key.alias("key"))
    share = base.agg(F.greatest(F.lit(1), F.floor(F.lit(n_test) / F.countDistinct(F.coalesce(F.col("stratum").cast("string"), F.lit("")))).cast("int")).alias("share"))
    w = Window.partitionBy("stratum").orderBy("key", "id")
    # only the first n_test of a stratum can be chosen, so a large stratum is cut per task before it is ranked
    first = base.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n_test).crossJoin(F.broadcast(share)).where(F.col("nth") <= F.col("share")).select("id")  # one row
    rest = base.join(first, "id", "left_anti").orderBy("key", "id").limit(n_test).select("id", "key")
    chosen = first.select("id", F.lit(0).alias("late"), F.lit(0).cast("long").alias("key")).unionByName(rest.select("id", F.lit(1).alias("late"), "key"))
    test = chosen.orderBy("late", "key", "id").limit(n_test).select("id", F.lit(True).alias("test"))
    return base.join(test, "id", "left").select("id", "stratum", F.when(F.col("test"), F.lit("test")).otherwise(F.lit("train")).alias("split"))


def ratio_split(rows: DataFrame, id_col: str, parts: list[tuple[str, float]], rest: str, seed: int = 42) -> DataFrame:
    """id, split: shuffled ids cut at floor(N * ratio) for each part in turn, what is left is ``rest``."""
    key = random_order(F.col(id_col), seed)
    base = numbered(rows.select(F.col(id_col).alias("id"), key.alias("key")), [F.col("key"), F.col("id")], key=F.col("key"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    joined = base.crossJoin(F.broadcast(total))  # one row
    upto, name = F.lit(0), None
    for part, ratio in parts:
        upto = upto + F.floor(F.col("total") * F.lit(ratio))
        here = F.col("rn") <= upto
        name = F.when(here, F.lit(part)) if name is None else name.when(here, F.lit(part))
    return joined.select("id", name.otherwise(F.lit(rest)).alias("split"))


def holdout_split(rows: DataFrame, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """id, split: train of int(N * ratio) rows, at least one and at most N - 1; the rest is val."""
    key = random_order(F.col(id_col), seed)
    base = numbered(rows.select(F.col(id_col).alias("id"), key.alias("key")), [F.col("key"), F.col("id")], key=F.col("key"))
    size = rows.agg(F.count(F.lit(1)).alias("n")).select(F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(ratio)))).alias("cut"))
    return base.crossJoin(F.broadcast(size)).select("id", F.when(F.col("rn") <= F.col("cut"), F.lit("train")).otherwise(F.lit("val")).alias("split"))  # one row


def random_holdout(rows: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """id, split: val of max(1, int(N * share)) rows at random, the rest is train."""
    key = random_order(F.col(id_col), seed)
    base = numbered(rows.select(F.col(id_col).alias("id"), key.alias("key")), [F.col("key"), F.col("id")], key=F.col("key"))
    size = rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("n_val"))
    return base.crossJoin(F.broadcast(size)).select("id", F.when(F.col("rn") <= F.col("n_val"), F.lit("val")).otherwise(F.lit("train")).alias("split"))  # one row


def first_records(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a given order (a limit is the feature here)."""
    return rows.orderBy(*order).limit(n)


def full_batches(batches: DataFrame, least: int = 2) -> DataFrame:
    """Rows of the batches that hold at least ``least`` of them; a loss over pairs needs two."""
    kept = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("batch")
    return batches.join(kept, "batch", "left_semi")


def saved_sides(saved: DataFrame, current: DataFrame, id_col: str = "id") -> DataFrame:
    """id, split of the saved (id, split) rows whose id is among the current records; unknown ids are dropped, repeated ones count once."""
    return saved.select("id", "split").distinct().join(current.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")


def subset(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random without replacement (a sample is the feature here)."""
    key = random_order(F.col(id_col), seed)
    return rows.orderBy(key, F.col(id_col)).limit(n)


def balanced_batches(rows: DataFrame, id_col: str, category: Column, batch_size: int, seed: int = 42) -> DataFrame:
    """id, category, batch: every batch has batch_size // categories rows of each category; as many batches as the smallest category fills."""
    base = rows.select(F.col(id_col).alias("id"), category.alias("category"), random_order(F.col(id_col), seed).alias("key")).where("category is not null")
    counts = base.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.agg(F.greatest(F.lit(1), F.floor(F.lit(batch_size) / F.count(F.lit(1)))).alias("per"), F.min("n").alias("least")).select("per", F.floor(F.col("least") / F.col("per")).alias("batches"))
    # ranges of the random key are numbered apart and offset, so that a category is never sorted in one task
    ranged = base.withColumn("bin", F.floor(F.col("key") / F.lit((1 << 32) // 256)))
    before = Window.partitionBy("category").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("category", "bin").agg(F.count(F.lit(1)).alias("n")).select("category", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("category", "bin").orderBy("key", "id"))
    placed = ranged.withColumn("rn", inside).join(offsets, ["category", "bin"]).crossJoin(F.broadcast(plan))  # one row
    batch = F.floor((F.col("before") + F.col("rn") - 1) / F.col("per"))
    return placed.select("id", "category", batch.alias("batch"), "batches").where(F.col("batch") < F.col("batches")).drop("batches")


def chunk_batches(sizes: DataFrame, batch_size: int) -> DataFrame:
    """id, n, batch: rows in the order of size, cut into chunks of batch_size.

    The order is numbered by ranges, so equal sizes, however many, are several tasks.
    """
    return numbered_in_order(sizes.select("id", "n"), [F.col("n"), F.col("id")]).select("id", "n", F.floor((F.col("rn") - 1) / batch_size).alias("batch"))


def next_fit_batches(sizes: DataFrame, most_nodes: int, most_graphs: int) -> DataFrame:
    """id, n, batch: graphs in the order of size, a batch closed when the next one would exceed either limit; a graph of most_nodes or more is alone.

    Only the histogram of sizes decides where batches end (equal graphs are alike), so the
    fold runs over distinct sizes, each with its batches' boundaries, and the rows join those.
    """
    counts = sizes.groupBy(F.greatest("n", F.lit(1)).alias("size")).agg(F.count(F.lit(1)).alias("c"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame({"size": [], "c": []})
        out = []
        batch, graphs, nodes = 0, 0, 0
        for size, c in held.sort_values("size").itertuples(index=False):
            size, left, done = int(size), int(c), 0
            if size >= most_nodes:
                if graphs:
                    batch, graphs, nodes = batch + 1, 0, 0
                out.append((size, done, left, batch, 1))  # one batch each
                batch += left
                continue
            while left:
                room = min(most_graphs - graphs, (most_nodes - nodes) // size)
                if room <= 0:
                    batch, graphs, nodes = batch + 1, 0, 0
                    continue
                per = min(most_graphs, most_nodes // size)
                if graphs == 0 and left > per:  # whole batches of equal graphs at once
                    full = left // per
                    out.append((size, done, full * per, batch, per))
                    batch, done, left = batch + full, done + full * per, left - full * per
                    continue
                take = min(room, left)
                out.append((size, done, take, batch, take))
                graphs, nodes, done, left = graphs + take, nodes + take * size, done + take, left - take
        yield pd.DataFrame(out, columns=["size", "begin", "count", "batch", "per"])

    runs = counts.coalesce(1).mapInPandas(fold, "size long, begin long, count long, batch long, per long")
    # the place among equal sizes follows from the place in the whole order and the histogram of sizes
    before = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    placed = numbered_in_order(sizes.select("id", "n", F.greatest("n", F.lit(1)).alias("size")), [F.col("size"), F.col("n"), F.col("id")])
    placed = placed.join(offsets, "size").withColumn("nth", F.col("rn") - 1 - F.col("before")).join(runs, "size").where((F.col("nth") >= F.col("begin")) & (F.col("nth") < F.col("begin") + F.col("count")))
    return placed.select("id", "n", (F.col("batch") + F.floor((F.col("nth") - F.col("begin")) / F.col("per"))).alias("batch"))


def shuffled_batches(batches: DataFrame, seed: int = 42) -> DataFrame:
    """Batches in random order: a new position for every batch number."""
    order = batches.select("batch").distinct().select("batch", F.row_number().over(Window.orderBy(random_order(F.col("batch"), seed), "batch")).alias("position"))
    return batches.join(order, "batch")


