"""Token counts of texts under a public subword tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.common import spread

#: Rank file of a byte-level BPE vocabulary; set DRAFTLAKE_TOKENIZER or pass ``path`` for another one.
DEFAULT_PATH = os.environ.get("DRAFTLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The published pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(path: str):  # noqa: ANN202
    """The tokenizer, loaded once in each worker process."""
    import tiktoken

    held = sys.modules.setdefault("_draftlake_tokenizers", types.ModuleType("_draftlake_tokenizers"))
    if not hasattr(held, "by_path"):
        held.by_path = {}
    if path not in held.by_path:
        shipped = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
        with open(shipped if os.path.exists(shipped) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        held.by_path[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held.by_path[path]


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file along with the job, so that executors need not have it at that path."""
    sc = spark.sparkContext
    if os.path.exists(path) and not any(f.endswith("/" + os.path.basename(path)) for f in sc.listFiles):
        sc.addFile(path)


def count_tokens(texts: list[str | None], path: str = DEFAULT_PATH) -> list[int]:
    """Tokens of each text, 0 for null."""
    encode = _encoder(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def token_sizes(documents: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """doc_id, source, n_tokens of every row; whole texts are encoded where they are read (see common.spread for small tables)."""

    ship(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "source": b.column(1), "n_tokens": pa.array(count_tokens(b.column(2).to_pylist(), path), pa.int64())})

    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string").alias("source")
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), source, "text")).mapInArrow(run, "doc_id long, source string, n_tokens long")
