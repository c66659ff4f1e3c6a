"""Search an embedding index from the command line: python -m draftlake.index --index PATH (--vector FILE | --plan ID | --random SEED)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.operators import search
from draftlake.sources import readers


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="draftlake.index", description=__doc__)
    p.add_argument("--index", required=True, help="parquet table with row, floor_plan_id, embedding")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--vector", help="JSON file with one vector")
    one.add_argument("--plan", help="a plan id, with or without .svg, whose vector is the query")
    one.add_argument("--random", type=int, metavar="SEED", help="a random vector")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--raw", action="store_true", help="take the vector as it is instead of at length one")
    p.add_argument("--out", help="folder for the hits as JSON lines; printed if absent")
    return p.parse_args(argv)


def hits(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The rows that answer the arguments' query."""
    index = readers.read_embeddings(spark, a.index)
    if a.plan is not None:
        plans = spark.createDataFrame([(a.plan,)], "floor_plan_id string")
        query = list(search.by_plan(index.withColumnRenamed("row", "row_no"), plans).first().embedding)
    elif a.vector is not None:
        with open(a.vector, encoding="utf-8") as f:
            query = list(readers.query_vector(spark, json.load(f)).first().embedding)
    else:
        dim = index.select(F.size("embedding").alias("n")).first().n
        query = list(readers.random_vector(spark, dim, a.random).first().embedding)
    return search.search_one(index, query, a.top_k, normalise=not a.raw)


def main(argv: list[str] | None = None) -> None:
    a = arguments(sys.argv[1:] if argv is None else argv)
    found = hits(SparkSession.builder.getOrCreate(), a)
    if a.out:
        found.write.mode("overwrite").json(a.out)
    else:
        for line in found.toJSON().collect():  # top-k rows
            print(line)


if __name__ == "__main__":
    main()
