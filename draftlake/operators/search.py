"""Exact cosine search over an embedding index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlake.common import checkpoint
from draftlake.functions import text, vectors

QUERY_BLOCK = 8_192
#: Scores computed at once (16 MB of doubles), and candidates kept before they are cut to k per query.
CELLS = 2_000_000


class BestOf:
    """The k best rows of every query over any number of score blocks; ties go to the smaller row."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.least = np.full(n_queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """Scores of queries x rows; -inf is no candidate."""
        q, r = np.nonzero((scores >= self.least[:, None]) & (scores > -np.inf))
        if len(q):
            self.held.append((q, rows[r], scores[q, r]))
            self.waiting += len(q)
            if self.waiting > CELLS:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score), at most k of each query, best first."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, r, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1])
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = nth == self.k - 1
        self.least[q[last]] = s[last]
        keep = nth < self.k
        q, r, s = q[keep], r[keep], s[keep]
        self.held, self.waiting = [(q, r, s)], 0
        return q, r, s


def row_slices(n_queries: int, n_rows: int) -> Iterator[slice]:
    """Slices of rows whose scores against all queries fit CELLS."""
    step = max(1, CELLS // max(1, n_queries))
    return (slice(i, i + step) for i in range(0, n_rows, step))


def search_one(index: DataFrame, query: list[float], top_k: int = 10, normalise: bool = True, row: str = "row") -> DataFrame:
    """rank and the index columns of the top_k most similar rows to one vector; k is cut to the size of the index.

    The vector is a literal, the order a top-k per task and one merge. A query of
    another length than the index raises; so does a zero query that is to be normalised.
    """
    q = np.asarray(query, dtype=np.float64)
    if q.ndim != 1:
        raise ValueError("a query is one vector")
    if normalise:
        n = float(np.linalg.norm(q))
        if n == 0:
            raise ValueError("a zero vector has no direction")
        q = q / n
    v = F.array(*map(F.lit, q.tolist()))
    fits = F.when(F.size("embedding") != len(q), F.raise_error(F.lit(f"the query has {len(q)} entries, the index has others")).cast("double")).otherwise(vectors.dot(F.col("embedding"), v))
    hits = index.select("*", fits.alias("score")).orderBy(F.desc("score"), F.asc(row)).limit(top_k)
    return hits.select(F.row_number().over(Window.orderBy(F.desc("score"), F.asc(row))).alias("rank"), *[c for c in index.columns if c != "embedding"], "score")


def top_k(queries: DataFrame, index: DataFrame, k: int = 10, digits: int = 6, drop_self: bool = True) -> DataFrame:
    """query_id, row, score, rank of the k most similar index rows of every query.

    queries(query_id, embedding), index(row, embedding), unit vectors. Scores are
    rounded before ranking and ties go to the smaller row. Queries are taken in blocks
    of at most QUERY_BLOCK (the only broadcast); a block is a matrix product per batch
    of the index that keeps k rows per query, so a task emits k rows per query and no
    pair table ever exists.
    """
    spark = queries.sparkSession
    held = queries.select("query_id", vectors.as_double(F.col("embedding")).alias("q"))
    n_blocks = max(1, -(-held.count() // QUERY_BLOCK))
    parts = None
    for block in range(n_blocks):
        mine = held if n_blocks == 1 else held.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)
        rows = mine.collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        spread = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.q for r in rows])))

        def run(batches: Iterator[pd.DataFrame], spread=spread) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, q = spread.value
            best = BestOf(len(ids), k)
            for pdf in batches:
                for part in row_slices(len(ids), len(pdf)):
                    row = pdf["row"].to_numpy()[part]
                    score = np.round(q @ np.stack(pdf["embedding"].to_numpy()[part]).T, digits)
                    if drop_self:
                        score[ids[:, None] == row[None, :]] = -np.inf
                    best.add(score, row)
            at, row, score = best.cut()
            yield pd.DataFrame({"query_id": ids[at], "row": row, "score": score})

        part = index.select(F.col("row").cast("long").alias("row"), vectors.as_double(F.col("embedding")).alias("embedding")).mapInPandas(run, "query_id long, row long, score double")
        if n_blocks > 1:  # answers are written block by block, so that one block at a time is held
            part = checkpoint(part)
            spread.destroy()
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "query_id long, row long, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "row")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_of(queries: DataFrame, index: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, rank (from 1) of each query's right row among all: one more than the rows that are better.

    queries(query_id, embedding, right_row). A task counts per query, so no ranking of
    all pairs is built.
    """
    spark = queries.sparkSession
    right = index.select(F.col("row").alias("right_row"), vectors.as_double(F.col("embedding")).alias("r"))
    held = queries.select("query_id", "right_row", vectors.as_double(F.col("embedding")).alias("q")).join(right, "right_row")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = None
    for block in range(n_blocks):
        rows = held.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        q = np.array([r.q for r in rows])
        own = np.round((q * np.array([r.r for r in rows])).sum(axis=1), digits)
        spread = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), np.array([r.right_row for r in rows]), q, own))

        def run(batches: Iterator[pd.DataFrame], spread=spread) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, right_rows, q, own = spread.value
            better = np.zeros(len(ids), dtype=np.int64)
            for pdf in batches:
                for part in row_slices(len(ids), len(pdf)):
                    row = pdf["row"].to_numpy()[part]
                    score = np.round(q @ np.stack(pdf["embedding"].to_numpy()[part]).T, digits)
                    better += ((score > own[:, None]) | ((score == own[:, None]) & (row[None, :] < right_rows[:, None]))).sum(axis=1)
            yield pd.DataFrame({"query_id": ids, "better": better})

        one = index.select(F.col("row").cast("long").alias("row"), vectors.as_double(F.col("embedding")).alias("embedding")).mapInPandas(run, "query_id long, better long")
        if n_blocks > 1:
            one = checkpoint(one.groupBy("query_id").agg(F.sum("better").alias("better")))
            spread.destroy()
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank long")
    return parts.groupBy("query_id").agg((F.sum("better") + 1).alias("rank"))


def by_plan(index: DataFrame, plans: DataFrame, strict: bool = True) -> DataFrame:
    """requested id, row and vector of plans named with or without ``.svg``; of a plan with several rows the last counts.

    An id that the index doesn't hold raises when the result is read; without ``strict`` it is left out.
    """
    last = index.groupBy(text.strip_svg("floor_plan_id").alias("key")).agg(F.max("row_no").alias("row_no"), F.max_by("embedding", "row_no").alias("embedding"))
    joined = plans.select(F.col("floor_plan_id").alias("requested"), text.strip_svg("floor_plan_id").alias("key")).join(last, "key", "left" if strict else "inner")
    missing = F.raise_error(F.concat(F.lit("no vector of the plan "), F.coalesce("requested", F.lit("(null)")))).cast("long")
    return joined.select("requested", F.coalesce("row_no", missing).alias("row_no") if strict else "row_no", "embedding")


def integrity(index: DataFrame, dim: int) -> DataFrame:
    """One row: vectors, distinct rows, vectors of another length, without finite entries, of another norm than one."""
    e = F.col("embedding")
    finite = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))
    return index.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_no").alias("n_distinct"), F.count_if(e.isNull()).alias("n_null"),
        F.count_if(e.isNotNull() & (F.size(e) != dim)).alias("n_other_length"), F.count_if(e.isNotNull() & ~finite).alias("n_not_finite"),
        F.count_if(finite & (F.abs(vectors.norm(e) - 1) > 0.01)).alias("n_not_unit"),
    )
