"""Problem 2: the k most similar vectors of every vector, by a hash-prefix forest.

Every tree turns a vector into a long hash string: the vector is rotated at
random and its digits are the signed axes on which it lies furthest out, the
furthest first, so that similar vectors share digits. The rows of a tree are arrays
sorted by the prefix to which they descend: the first digit, and where a prefix is
crowded a longer one, until it isn't. As two similar vectors seldom agree on the order of
the later digits, a row in a crowded prefix descends to all sets of two or three
digits among its WIDTHS furthest, whatever their order; going down costs more entries per
row instead of partners. A row that has fewer than ENOUGH candidates over the prefixes
of all trees ascends in all trees at once to the crowded prefixes it came from (any of them
holds enough) and is compared with all their rows. Within a prefix rows are compared by
256-bit sign sketches in blocks (matrix products), and the pairs that may reach the
wanted cosine become candidates.

Candidates are verified exactly: each row is labelled with the smallest row
among its candidates, the full vectors travel once or a few times to the labels
of their pairs, and all rows that meet there are compared, which also finds
pairs no tree had seen.

Scale. Only sketches (32 bytes) are shuffled per tree; where rows go down, few trees at a time,
and the shuffle files of a step are removed when its result is written. The vectors travel as
8- or 16-bit grid values where they lie on such a grid (32-bit floats otherwise).
No group of rows is compared in one task beyond a block: a prefix that is still crowded
at full length, a prefix to which rows ascend, and a label where many rows meet are cut
into blocks, and each two of them are a key of their own. Of the rows that meet only each
one's k best leave a block. Rows with exactly equal vectors are one representative in
the forest, so a vector that a third of all rows share does not make a leaf of that size;
they get back their own copies as partners afterwards, at most k each, salted by their number.

Edge cases: rows without a number, null, wrong-length, non-finite and all-zero vectors take no part;
ties go to the smaller row number; fewer than two usable rows give no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlake.common import checkpoint, shuffle_partitions
from draftlake.operators.search import BestOf, row_slices

DIM = 256
SKETCH_BITS = 256
TREES = 7
#: A leaf with more rows is split by sets of one digit more, up to DEPTH digits.
LEAF_ROWS = 6000
DEPTH = 3
#: Digits from which the sets of one, two and three are drawn (1, 6 and 20 sets).
WIDTHS = (1, 4, 6)
#: Standard deviations of the sketch's estimate by which a candidate may seem less similar than wanted.
SLACK = 1.8
GRID = 512.0
#: Rows that are compared with each other in one go; larger groups are cut into blocks.
BLOCK_ROWS = 8192
#: Candidates over all trees below which a row ascends.
ENOUGH = 200
#: Copies of one vector that get their partners under one key.
COPIES = 20_000
#: Rows on which the prefixes to extend are found, and up to which a list of row numbers may be broadcast.
FIT_ROWS = 50_000
SMALL_ROWS = 1_000_000


#: Entries per row that are shuffled at once; trees whose entries are more go one group after the other.
ENTRIES_AT_ONCE = 12
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Checkpoint after which the shuffle files that led to it are removed."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return checkpoint(df.select("*"))  # planned anew, under this setting
    finally:
        conf.set(_CLEANUP, before)


def usable(vectors: DataFrame, row: str = "row_no", embedding: str = "embedding", dim: int = DIM) -> DataFrame:
    """row_no, embedding of the rows with ``dim`` finite entries, not all zero."""
    e = F.col(embedding)
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col(row).isNotNull() & e.isNotNull() & (F.size(e) == dim) & F.coalesce(good, F.lit(False))).select(F.col(row).cast("long").alias("row_no"), e.alias("embedding"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _rotation(seed: int, dim: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, dim)).astype(np.float32)


def _pack(m: np.ndarray) -> list[bytes]:
    """Rows as 8- or 16-bit grid values if all of a row lie on the grid, else as 32-bit floats."""
    scaled = m * GRID
    whole = np.rint(scaled)
    on_grid = np.abs(scaled - whole).max(axis=1) == 0
    most = np.abs(whole).max(axis=1)
    bits = np.where(~on_grid | (most > 32767), 32, np.where(most > 127, 16, 8))
    forms = {8: np.clip(whole, -127, 127).astype(np.int8), 16: np.clip(whole, -32767, 32767).astype(np.int16), 32: m}
    return [forms[b][i].tobytes() for i, b in enumerate(bits.tolist())]


def _unpack(blobs: list[bytes], dim: int) -> np.ndarray:
    kinds = {dim: np.int8, 2 * dim: np.int16, 4 * dim: np.float32}
    out = np.empty((len(blobs), dim), dtype=np.float64)
    for i, b in enumerate(blobs):
        out[i] = np.frombuffer(b, dtype=kinds[len(b)])
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def packed_rows(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """row_no and the packed vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch({"row_no": b.column(0), "v": pa.array(_pack(_matrix(b.column(1), dim)), pa.binary())})

    return usable(vectors, dim=dim).mapInArrow(pack, "row_no long, v binary")


def _digits(m: np.ndarray, rotation: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` digits of every row's hash string: its furthest signed axes after the rotation."""
    p = m @ rotation
    far = np.argpartition(np.abs(p), -depth, axis=1)[:, -depth:]
    size = np.take_along_axis(np.abs(p), far, axis=1)
    far = np.take_along_axis(far, np.argsort(-size, axis=1, kind="stable"), axis=1)
    return 2 * far + (np.take_along_axis(p, far, axis=1) > 0)


def _sets(digits: np.ndarray, size: int, width: int) -> np.ndarray:
    """Codes of all sets of ``size`` among the first ``width`` digits of every row, a column each."""
    ordered = [np.sort(digits[:, list(c)], axis=1).astype(np.int64) for c in combinations(range(width), size)]
    base = np.int64(1024)  # more than any digit
    return np.stack([sum((d[:, i] * base**i for i in range(size)), np.int64(size) << 40) for d in ordered], axis=1)


def _leaf_codes(digits: np.ndarray, full: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row index and code of every leaf a row is in; a row in a crowded one goes on to all sets of the next size."""
    at, rows, codes = np.arange(len(digits)), [], []
    for size, width in enumerate(widths, 1):
        sets = _sets(digits[at], size, width)
        crowded = np.isin(sets, full) if size < len(widths) else np.zeros(sets.shape, dtype=bool)
        row, which = np.nonzero(~crowded)
        rows.append(at[row])
        codes.append(sets[row, which])
        at = at[crowded.any(axis=1)]
    return np.concatenate(rows), np.concatenate(codes)


def _narrow(depth: int) -> tuple[int, ...]:
    """One set of each size."""
    return tuple(range(1, depth + 1))


def _code(leaf: int) -> tuple[int, int]:
    return leaf >> 50, leaf & ((1 << 50) - 1)


def crowded_prefixes(
    packed: DataFrame, n_rows: int, trees: int = TREES, depth: int = DEPTH, leaf_rows: int = LEAF_ROWS, dim: int = DIM, widths: tuple[int, ...] | None = None, fit_rows: int = FIT_ROWS
) -> dict[tuple[int, int], int]:
    """(tree, code) -> estimated rows of the prefixes that hold more than ``leaf_rows`` rows, fitted on about ``fit_rows`` of them.

    At most trees x sets per row x rows / leaf_rows prefixes are crowded; they are counted in
    Spark, length by length, and only those reach the driver. The sample decides how far rows
    go down, not which rows are indexed.
    """
    every = max(1, n_rows // fit_rows)
    widths = widths or _narrow(depth)
    sample = packed.where(F.pmod(F.xxhash64("row_no"), F.lit(every)) == 0).select("row_no", "v")
    crowded: dict[tuple[int, int], int] = {}
    for size in range(1, len(widths) + 1):
        counts = leaves(sample, crowded, trees, dim=dim, widths=widths[:size]).groupBy("leaf").count()
        mine = {_code(r.leaf): r["count"] * every for r in counts.where(F.col("count") * every > leaf_rows).collect()}
        if not mine.keys() - crowded.keys():
            break
        crowded |= mine
    return crowded


def leaves(packed: DataFrame, crowded: dict[tuple[int, int], int], trees: int = TREES, depth: int = DEPTH, dim: int = DIM, widths: tuple[int, ...] | None = None, sketched: bool = True, chosen: range | None = None) -> DataFrame:
    """leaf, row_no, sketch: per tree (of the ``chosen`` ones) the prefixes to which each row descends, one unless its first digit is crowded and ``widths`` allow more."""
    widths = widths or _narrow(depth)
    chosen = chosen or range(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _rotation(99_991, dim)
        rotations = [_rotation(17 + t, dim) for t in chosen]
        full = [np.array(sorted(p for k, p in crowded if k == t), dtype=np.int64) for t in chosen]
        for b in batches:
            if not b.num_rows:
                continue
            m = _unit(_unpack(b.column(1).to_pylist(), dim)).astype(np.float32)
            sketch = pa.array([x.tobytes() for x in np.packbits(m @ planes[:, :SKETCH_BITS] > 0, axis=1)], pa.binary()) if sketched else pa.nulls(len(m), pa.binary())
            for t, r, crowd in zip(chosen, rotations, full, strict=True):
                at, codes = _leaf_codes(_digits(m, r, max(widths)), crowd, widths)
                yield pa.record_batch({"leaf": pa.array(codes + (np.int64(t) << 50)), "row_no": b.column(0).take(pa.array(at)), "sketch": sketch.take(pa.array(at))})

    return packed.select("row_no", "v").mapInArrow(run, "leaf long, row_no long, sketch binary")


def ancestors(packed: DataFrame, crowded: dict[tuple[int, int], int], trees: int = TREES, dim: int = DIM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """leaf, row_no, sketch: the longest crowded prefixes that rows have passed on their way down."""
    depths = sorted({c >> 40 for _, c in crowded}, reverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _rotation(99_991, dim)
        rotations = [_rotation(17 + t, dim) for t in range(trees)]
        for b in batches:
            if not b.num_rows:
                continue
            m = _unit(_unpack(b.column(1).to_pylist(), dim)).astype(np.float32)
            sketch = pa.array([x.tobytes() for x in np.packbits(m @ planes[:, :SKETCH_BITS] > 0, axis=1)], pa.binary())
            for t, r in enumerate(rotations):
                digits = _digits(m, r, max(widths))
                waiting = np.ones(len(m), dtype=bool)
                for size in depths:
                    if size >= len(widths):
                        continue  # rows stay in such a prefix, and are compared there
                    sets = _sets(digits, size, widths[size - 1])
                    here = np.isin(sets, np.array([c for k, c in crowded if k == t], dtype=np.int64)) & waiting[:, None]
                    at, which = np.nonzero(here)
                    waiting &= ~here.any(axis=1)
                    if len(at):
                        yield pa.record_batch({"leaf": pa.array(sets[at, which] + (np.int64(t) << 50)), "row_no": b.column(0).take(pa.array(at)), "sketch": sketch.take(pa.array(at))})

    return packed.select("row_no", "v").mapInArrow(run, "leaf long, row_no long, sketch binary")


def blocked(rows: DataFrame, key: str, n_blocks: Column) -> DataFrame:
    """``rows`` with place, side: every two blocks of a group meet at a place of their own, the lower one as side 0; a block alone is side 0."""
    mine = F.pmod(F.xxhash64(F.lit(7), "row_no"), F.col("_n"))
    spread = rows.withColumn("_n", n_blocks).withColumn("_b", mine).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    low, high = F.least("_b", "_k"), F.greatest("_b", "_k")
    place = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.xxhash64(key, low, high))
    return spread.withColumn("place", place).withColumn("side", F.when(F.col("_b") > F.col("_k"), 1).otherwise(0)).drop("_n", "_b", "_k")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(side, row_no, value) of each place of a partition that is sorted by place; a place may span batches."""
    place, sides, rows, values = None, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        s, r, v = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
        cuts = np.concatenate([[0], np.nonzero(np.diff(ids))[0] + 1, [len(ids)]])
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            if ids[at] != place:
                if len(values) > 1:
                    yield np.concatenate(sides), np.concatenate(rows), values
                place, sides, rows, values = ids[at], [], [], []
            sides.append(s[at:to])
            rows.append(r[at:to])
            values += v[at:to]
    if len(values) > 1:
        yield np.concatenate(sides), np.concatenate(rows), values


def _tiles(sides: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Positions to compare with each other; True where both are one piece, whose pairs come twice."""
    left, right = np.nonzero(sides == 0)[0], np.nonzero(sides == 1)[0]
    if len(right):
        for i in range(0, len(left), block):
            for j in range(0, len(right), block):
                yield left[i : i + block], right[j : j + block], False
        return
    for i in range(0, len(left), block):
        for j in range(i, len(left), block):
            yield left[i : i + block], left[j : j + block], i == j


def candidate_pairs(in_places: DataFrame, cosine: float, n_partitions: int, block: int = 4096) -> DataFrame:
    """a < b of rows at one place (place, side, row_no, sketch) whose sketches may stand for a cosine of at least ``cosine``."""
    far = math.acos(cosine) / math.pi
    limit = far + SLACK * math.sqrt(far * (1 - far) / SKETCH_BITS)
    #: matching minus differing bits of a pair at the limit
    least = SKETCH_BITS * (1 - 2 * limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides, rows, sketches in _groups(batches):
            x = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32) * 2 - 1
            for p, q, own in _tiles(sides, block):
                a, b = np.nonzero(x[p] @ x[q].T >= least)
                left, right = rows[p[a]], rows[q[b]]
                keep = left < right if own else left != right
                if keep.any():
                    left, right = left[keep], right[keep]
                    yield pa.record_batch({"a": pa.array(np.minimum(left, right)), "b": pa.array(np.maximum(left, right))})

    ordered = in_places.select("place", "side", "row_no", "sketch").repartition(n_partitions, "place").sortWithinPartitions("place")
    return ordered.mapInArrow(run, "a long, b long")


def tree_groups(packed: DataFrame, n_rows: int, crowded: dict[tuple[int, int], int], trees: int, dim: int) -> list[range]:
    """All trees, in groups whose entries are at most ENTRIES_AT_ONCE per row, as estimated on a sample, or one tree each."""
    every = max(1, n_rows // FIT_ROWS)
    sample = packed.where(F.pmod(F.xxhash64("row_no"), F.lit(every)) == 0)
    n = leaves(sample, crowded, trees, dim=dim, widths=WIDTHS, sketched=False).count() / max(1, sample.count())
    size = max(1, trees // max(1, math.ceil(n / ENTRIES_AT_ONCE)))
    return [range(t, min(trees, t + size)) for t in range(0, trees, size)]


def forest_candidates(packed: DataFrame, n_rows: int, cosine: float, n_partitions: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, dim: int = DIM, enough: int = ENOUGH) -> DataFrame:
    """a < b of all rows that meet in a prefix, after descent and ascent, and whose sketches allow the cosine."""
    spark = packed.sparkSession
    crowded = crowded_prefixes(packed, n_rows, trees, leaf_rows=leaf_rows, dim=dim, widths=WIDTHS)
    one = F.lit(1).cast("long")
    if not crowded:  # no row has gone down, so none can ascend
        return candidate_pairs(blocked(leaves(packed, crowded, trees, dim=dim, widths=WIDTHS), "leaf", one), cosine, n_partitions).distinct()
    # at most trees x sets per row x rows / leaf_rows prefixes
    sizes = spark.createDataFrame([((t << 50) + c, max(1, -(-n // BLOCK_ROWS))) for (t, c), n in crowded.items()], "leaf long, n_blocks long")
    down = None
    for group in tree_groups(packed, n_rows, crowded, trees, dim):
        entries = leaves(packed, crowded, trees, dim=dim, widths=WIDTHS, chosen=group).join(F.broadcast(sizes), "leaf", "left")
        met = candidate_pairs(blocked(entries.withColumn("n_blocks", F.coalesce("n_blocks", one)), "leaf", F.col("n_blocks")), cosine, n_partitions)
        met = met if len(group) == trees else written(met.distinct())
        down = met if down is None else down.union(met)
    # candidates of each row over all trees; those with too few go back up
    bare = leaves(packed, crowded, trees, dim=dim, widths=WIDTHS, sketched=False).select("leaf", "row_no")
    met = bare.groupBy("leaf").agg((F.count(F.lit(1)) - 1).alias("others"))
    found = bare.join(met, "leaf").groupBy("row_no").agg(F.sum("others").alias("found"))
    few = written(found.where(F.col("found") < enough).select("row_no"))
    above = ancestors(packed, crowded, trees, dim, WIDTHS).join(F.broadcast(sizes), "leaf")
    asking = above.join(few, "row_no", "left_semi")
    asked = written(asking.select("leaf").distinct())
    members = ancestors(packed, crowded, trees, dim, WIDTHS).join(F.broadcast(sizes), "leaf").join(F.broadcast(asked), "leaf", "left_semi")  # at most the crowded prefixes
    block = F.pmod(F.xxhash64(F.lit(11), "row_no"), F.col("n_blocks"))
    up = (
        asking.select("leaf", "row_no", "sketch", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
        .unionByName(members.select("leaf", "row_no", "sketch", F.lit(1).alias("side"), block.alias("block")))
        .select(F.xxhash64("leaf", "block").alias("place"), "side", "row_no", "sketch")
    )
    return down.union(candidate_pairs(up, cosine, n_partitions)).distinct()


def verified_pairs(pairs: DataFrame, packed: DataFrame, cosine: float, n_partitions: int, k: int, dim: int = DIM, block: int = 2048) -> DataFrame:
    """a, b, score: of each row the k best partners with a cosine of at least ``cosine`` at each label where it meets them."""
    spark = packed.sparkSession
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("row_no"), "label")
    spot = (
        pairs.join(label.select(F.col("row_no").alias("a"), F.col("label").alias("la")), "a")
        .join(label.select(F.col("row_no").alias("b"), F.col("label").alias("lb")), "b")
        .select(F.explode(F.array("a", "b")).alias("row_no"), F.least("la", "lb").alias("spot"))
        .distinct()
    )
    spot = written(spot)
    hot = spot.groupBy("spot").count().where(F.col("count") > BLOCK_ROWS).select("spot", F.ceil(F.col("count") / BLOCK_ROWS).alias("n_blocks")).collect()  # at most rows met / BLOCK_ROWS
    if hot:
        sizes = spark.createDataFrame([(r.spot, r.n_blocks) for r in hot], "spot long, n_blocks long")
        cut = blocked(spot.join(F.broadcast(sizes), "spot", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1).cast("long"))), "spot", F.col("n_blocks"))
    else:
        cut = spot.select(F.col("spot").alias("place"), F.lit(0).alias("side"), "row_no")
    moved = cut.join(packed, "row_no").select("place", "side", "row_no", "v").repartition(n_partitions, "place").sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides, rows, blobs in _groups(batches):
            m = _unpack(blobs, dim)
            squares = (m * m).sum(axis=1)
            for p, q, own in _tiles(sides, block):
                # one rounding less than dividing by two norms, so that equal cosines compare equal
                score = (m[p] @ m[q].T) / np.sqrt(np.outer(squares[p], squares[q]))
                score[rows[p][:, None] == rows[q][None, :]] = -np.inf
                score[score < cosine] = -np.inf
                for s, x, y in ((score, p, q),) if own else ((score, p, q), (score.T, q, p)):
                    at, to = np.nonzero(s > -np.inf)
                    b, c = rows[y[to]], s[at, to]
                    if len(at) > k * len(x):
                        best = BestOf(len(x), k)
                        best.add(s, rows[y])
                        at, b, c = best.cut()
                    if len(at):
                        yield pa.record_batch({"a": pa.array(rows[x[at]]), "b": pa.array(b), "score": pa.array(c)})

    return moved.mapInArrow(run, "a long, b long, score double").dropDuplicates(["a", "b"])


def _top(col_a: Column, scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_rows(vectors: DataFrame, cosine: float = 0.75, k: int = 10, trees: int = TREES, dim: int = DIM, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """a, b, score, rank: of each row its k most similar others with at least ``cosine``."""
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    packed = written(packed_rows(vectors, dim))
    n_rows = packed.count()
    key = (F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("m"))
    classes = packed.select("row_no", *key).groupBy("h", "m").agg(F.min("row_no").alias("rep"), F.count(F.lit(1)).alias("copies"))
    same = classes.where("copies > 1")
    copies = written(packed.select("row_no", *key).join(same, ["h", "m"]).select("row_no", "rep"))
    doubles = copies.where("row_no <> rep").select("row_no")
    if doubles.count() <= SMALL_ROWS:  # 8 MB at most
        single = packed.join(F.broadcast(doubles), "row_no", "left_anti")
    else:  # by a shuffle, once for all passes over the vectors that follow
        single = written(packed.join(doubles, "row_no", "left_anti"))
    pairs = written(forest_candidates(single, n_rows, cosine, 2 * n, trees, leaf_rows, dim))
    scored = written(verified_pairs(pairs, single, cosine, 2 * n, k, dim))
    return _with_copies(scored, copies, same.select("rep", "copies"), k)


def _with_copies(scored: DataFrame, copies: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Give representatives' results to their copies; of a class only the k + 1 smallest rows can be partners of one row.

    A class gets its partners under several keys, one per COPIES rows.
    """
    least = Window.partitionBy("rep").orderBy("row_no")
    first = copies.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= k + 1).select("rep", "row_no")
    partner = scored.join(first.select(F.col("rep").alias("b"), F.col("row_no").alias("other")), "b", "left").select("a", F.coalesce("other", "b").alias("b"), "score")
    partner = _top(F.col("a"), partner, k).drop("rank")
    n_salts = F.ceil(F.col("copies") / COPIES)
    salted = copies.join(sizes, "rep").select("rep", "row_no", F.pmod(F.xxhash64("row_no"), n_salts).alias("salt"))
    salts = sizes.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), n_salts - 1)).alias("salt"))
    theirs = partner.join(salts.withColumnRenamed("rep", "a"), "a").join(salted.select(F.col("rep").alias("a"), F.col("row_no").alias("mine"), "salt"), ["a", "salt"])
    alone = partner.join(sizes.select(F.col("rep").alias("a")), "a", "left_anti")
    own = first.join(salts, "rep").select("rep", F.col("row_no").alias("b"), "salt").join(salted, ["rep", "salt"]).where("row_no <> b").select(F.col("row_no").alias("a"), "b", F.lit(1.0).alias("score"))
    return _top(F.col("a"), alone.select("a", "b", "score").unionByName(theirs.select(F.col("mine").alias("a"), "b", "score")).unionByName(own), k)


def found_pairs(vectors: DataFrame, cosine: float = 0.75, k: int = 10, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """row_a < row_b, one of which is among the other's k most similar."""
    top = similar_rows(vectors, cosine, k, leaf_rows=leaf_rows)
    return top.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b")).distinct()


QUERY_BLOCK = 16_384


def block_topk(vectors: DataFrame, modulus: int = 20, k: int = 10, dim: int = DIM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """a, b, score, rank: exact top k of the rows whose number is divisible by ``modulus``, against all rows.

    Queries are taken in blocks of ``query_block`` (16 MB of floats each, the only
    thing that is broadcast); each block is one pass over the vectors that keeps
    k partners per query and partition. A block's answers are written before the next one is
    taken, and its broadcast is freed.
    """
    spark = vectors.sparkSession
    packed = checkpoint(packed_rows(vectors, dim))
    asked = packed.where(F.col("row_no") % modulus == 0)
    n_blocks = max(1, -(-asked.count() // query_block))
    parts = None
    for block in range(n_blocks):
        chosen = asked.where(F.pmod(F.xxhash64("row_no"), F.lit(n_blocks)) == block).collect()  # at most about query_block rows
        spread = spark.sparkContext.broadcast((np.array([r.row_no for r in chosen], dtype=np.int64), [bytes(r.v) for r in chosen]))

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, asked_for = spread.value
            if not len(ids):
                return
            q = _unpack(asked_for, dim)
            q_squares = (q * q).sum(axis=1)
            best = BestOf(len(ids), k)
            for batch in batches:
                rows, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for part in row_slices(len(ids), len(rows)):
                    m = _unpack(blobs[part], dim)
                    score = (q @ m.T) / np.sqrt(np.outer(q_squares, (m * m).sum(axis=1)))
                    score[ids[:, None] == rows[part][None, :]] = -np.inf
                    best.add(score, rows[part])
            at, b, score = best.cut()
            yield pa.record_batch({"a": pa.array(ids[at]), "b": pa.array(b), "score": pa.array(score)})

        part = checkpoint(_top(F.col("a"), packed.mapInArrow(run, "a long, b long, score double"), k))
        spread.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts


def recall_report(vectors: DataFrame, cosine: float = 0.75, k: int = 10, modulus: int = 20) -> DataFrame:
    """Recall of the forest against the exact block search for the query rows: over partners of at least ``cosine``, and over their whole top k."""
    exact = checkpoint(block_topk(vectors, modulus, k).select("a", "b", "score"))
    forest = similar_rows(vectors, cosine, k).where(F.col("a") % modulus == 0).select("a", "b", F.lit(1).alias("hit"))
    near = F.col("score") >= cosine
    return exact.join(forest, ["a", "b"], "left").agg(
        F.count_if(near).alias("n_exact"), F.count_if(near & F.col("hit").isNotNull()).alias("n_found"), F.round(F.try_divide(F.count_if(near & F.col("hit").isNotNull()), F.count_if(near)), 6).alias("recall"),
        F.count(F.lit(1)).alias("n_top"), F.round(F.try_divide(F.count("hit"), F.count(F.lit(1))), 6).alias("recall_of_top"),
    )
