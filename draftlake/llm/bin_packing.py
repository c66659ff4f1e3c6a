"""Problem 8: items packed into containers of fixed capacity, by swap-based local search.

Items are spread over groups at random, packed by best fit in falling size, and
then improved: documents are moved, exchanged one for one or two for one between
underfull bins wherever that increases the sum of squared fills, until bins run
empty. Bins are indexed by their free space and the sizes in them, so every bin
with free space is a possible partner and none is left out. The bins that stay underfull in any group are gathered and searched again
in fewer groups, so that only a few bins in the whole corpus remain unfilled.

An item larger than the capacity is split: full pieces are containers of their
own, the rest is an item like any other. No other item is split.

Scale. A group holds about ``group_items`` items whatever the corpus size; the
hash spreads equal sizes and sources evenly, so there is no hot group. The search for
a partner costs at most the number of distinct free spaces, whatever the number of bins.
Nothing is collected.

Edge cases: null and blank texts and sizes of zero need no container; rows without an id can't be placed; ties in
size are packed in the order of ids; a repeated id is packed as often as it
occurs; empty input gives no container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.common import checkpoint, shuffle_partitions, stable_hash

CAPACITY = 2048
GROUP_ITEMS = 20_000
#: Bins of the first round below this fill are gathered for the second.
UNDERFULL = 0.985


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item positions; sizes must be sorted in falling order."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    frees: list[int] = []  # sorted free spaces that occur
    for i, s in enumerate(sizes):
        at = bisect.bisect_left(frees, s)
        if at < len(frees):
            free = frees[at]
            b = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], frees[at]
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - s
        if left:
            if left not in by_free:
                by_free[left] = []
                bisect.insort(frees, left)
            by_free[left].append(b)
    return bins


class Shelves:
    """Bins by free space, with the sizes of their items and of two of their items together.

    A bin holds at most about sqrt(2 x capacity) distinct sizes and ``capacity`` distinct sums
    of two, and there are at most ``capacity`` free spaces, so looking for the best partner
    of an item costs the same however many bins there are.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.rooms: list[int] = []
        self.held: dict[int, set[int]] = {}
        #: room -> for one and for two items the sorted (size, bin) of its bins, built when asked for
        self.sums: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        for b in range(len(bins)):
            self._put(b)

    def _put(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if self.bins[b] and room:
            if room not in self.held:
                self.held[room] = set()
                bisect.insort(self.rooms, room)
            self.held[room].add(b)
            self.sums.pop(room, None)

    def _take(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if b in self.held.get(room, ()):
            self.held[room].remove(b)
            self.sums.pop(room, None)
            if not self.held[room]:
                del self.held[room]
                self.rooms.remove(room)

    def _of(self, room: int, without: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The sizes in the bins of a room but one; of several bins with a size any one stands for all."""
        if without in self.held[room]:
            return self._sums(self.held[room] - {without})
        if room not in self.sums:
            self.sums[room] = self._sums(self.held[room])
        return self.sums[room]

    def _sums(self, bins: set[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        ones: dict[int, int] = {}
        twos: dict[int, int] = {}
        for b in bins:
            count: dict[int, int] = {}
            for i in self.bins[b]:
                count[self.sizes[i]] = count.get(self.sizes[i], 0) + 1
            for s in count:
                ones.setdefault(s, b)
            distinct = sorted(count)
            for k, s in enumerate(distinct):
                if count[s] > 1:
                    twos.setdefault(2 * s, b)
                for u in distinct[k + 1 :]:
                    twos.setdefault(s + u, b)
        return sorted(ones.items()), sorted(twos.items())

    def _pick(self, b: int, total: int, n: int) -> tuple[int, ...]:
        """n items of a bin whose sizes are ``total`` together."""
        if n == 1:
            return (next(i for i in self.bins[b] if self.sizes[i] == total),)
        at: dict[int, int] = {}
        for i in self.bins[b]:
            if total - self.sizes[i] in at:
                return at[total - self.sizes[i]], i
            at[self.sizes[i]] = i
        raise AssertionError("no such two items")

    def best(self, a: int, x: int) -> tuple[int, tuple[int, ...]] | None:
        """The fuller bin and the none, one or two of its smaller items for which a should leave x, if that increases the squared fill."""
        size, mine, best = self.sizes[a], self.fill[x], None
        for room in self.rooms:
            fuller = self.capacity - room
            if fuller < mine:
                break
            most = min(size, room)
            if best is not None and 2 * most * (fuller - mine + most) <= best[0]:
                continue
            if fuller == mine and len(self.held[room]) == 1:
                continue  # x itself
            options = [(0, None)] if size <= room else []
            for held in self._of(room, x) if size > 1 else ():
                at = bisect.bisect_left(held, (size - room, -1))  # the smallest that makes enough room
                if at < len(held) and held[at][0] < size:
                    options.append(held[at])
            for back, y in options:
                gain = 2 * (size - back) * (fuller - mine + size - back)
                if gain > 0 and (best is None or gain > best[0]):
                    if y is None:
                        y = next((b for b in self.held[room] if b != x), None)
                        if y is None:
                            continue
                    best = (gain, y, back, room)
        if best is None:
            return None
        _, y, back, _ = best
        if not back:
            return y, ()
        return y, self._pick(y, back, 1) if any(self.sizes[i] == back for i in self.bins[y]) else self._pick(y, back, 2)

    def exchange(self, a: int, x: int, y: int, out: tuple[int, ...]) -> None:
        self._take(x)
        self._take(y)
        self.bins[x].remove(a)
        self.bins[y].append(a)
        for i in out:
            self.bins[y].remove(i)
            self.bins[x].append(i)
        change = self.sizes[a] - sum(self.sizes[i] for i in out)
        self.fill[x] -= change
        self.fill[y] += change
        self._put(x)
        self._put(y)


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """The bins after moves and exchanges out of underfull bins that increase the sum of squared fills, until none does, and their number.

    Every bin with free space may be the partner. As each step increases the sum, the search ends.
    """
    shelves = Shelves(bins, sizes, capacity)
    steps, improved = 0, True
    while improved:
        improved = False
        loose = sorted((b for b in range(len(bins)) if bins[b] and shelves.fill[b] < UNDERFULL * capacity), key=lambda b: (shelves.fill[b], b))
        for x in loose:
            for a in sorted(bins[x], key=lambda i: -sizes[i]):
                if a in bins[x] and (found := shelves.best(a, x)):
                    shelves.exchange(a, x, *found)
                    steps += 1
                    improved = True
    return [b for b in bins if b], steps


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[list[int]], int, int]:
    """Bins of positions into ``sizes``, the number of bins before the search, and of its moves and exchanges."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    ranked = [sizes[i] for i in order]
    first = best_fit(ranked, capacity)
    before = len(first)
    bins, steps = local_search(first, ranked, capacity)
    return [[order[i] for i in b] for b in bins], before, steps


_PACKED = "place long, bin int, doc_id long, piece int, n_pieces int, size long, filled long, bins_before int, steps int"


def _pack_groups(items: DataFrame, n_groups: int, capacity: int, n_partitions: int, seed: int) -> DataFrame:
    columns = [c.split()[0] for c in _PACKED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                pdf = pd.concat(held, ignore_index=True).sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
                sizes = pdf["size"].tolist()
                bins, before, steps = pack(sizes, capacity)
                where, filled = [0] * len(sizes), [0] * len(sizes)
                for b, inside in enumerate(bins):
                    total = sum(sizes[i] for i in inside)
                    for i in inside:
                        where[i], filled[i] = b, total
                yield pdf.assign(bin=where, filled=filled, bins_before=before, steps=steps)[columns]

        for pdf in batches:
            for place, g in pdf.groupby("place", sort=False):
                if place != at:
                    yield from flush()
                    at, held = place, []
                held.append(g)
        yield from flush()

    grouped = items.select("doc_id", "piece", "n_pieces", "size", F.pmod(stable_hash("doc_id", "piece", seed=seed), F.lit(n_groups)).alias("place"))
    return grouped.repartition(n_partitions, "place").sortWithinPartitions("place").mapInPandas(run, _PACKED)


def packed_items(sizes: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """container, doc_id, piece, n_pieces, size, filled from sizes(doc_id, n_tokens), with the figures of the search in the item's
    group: pack_group (its name, null for full pieces), bins_before and steps."""
    n = shuffle_partitions(sizes.sparkSession)
    pieces = F.ceil(F.col("n_tokens") / F.lit(float(capacity))).cast("int")
    cut = checkpoint(
        sizes.where("n_tokens > 0 and doc_id is not null")
        .select("doc_id", "n_tokens", pieces.alias("n_pieces"))
        .select("doc_id", "n_tokens", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .select("doc_id", "piece", "n_pieces", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("long").alias("size"))
    )
    none = F.lit(None)
    whole = cut.where(F.col("size") == capacity).select(
        F.concat(F.lit("w-"), F.col("doc_id"), F.lit("-"), F.col("piece")).alias("container"), "doc_id", "piece", "n_pieces", "size", F.col("size").alias("filled"),
        none.cast("string").alias("pack_group"), none.cast("int").alias("bins_before"), none.cast("int").alias("steps"),
    )
    rest = cut.where(F.col("size") < capacity)
    n_items = rest.count()
    n_groups = max(1, -(-n_items // group_items))
    first = checkpoint(_pack_groups(rest, n_groups, capacity, n, 1))

    def named(df: DataFrame, r: int) -> DataFrame:
        group = F.concat(F.lit(f"{r}-"), F.col("place").cast("string"))
        return df.select(F.concat(group, F.lit("-"), "bin").alias("container"), "doc_id", "piece", "n_pieces", "size", "filled", group.alias("pack_group"), "bins_before", "steps")

    if n_groups == 1:
        return whole.unionByName(named(first, 1))
    loose = first.where(F.col("filled") < UNDERFULL * capacity)
    again = max(1, -(-loose.count() // group_items))
    second = _pack_groups(loose.select("doc_id", "piece", "n_pieces", "size"), again, capacity, min(n, again), 2)
    return whole.unionByName(named(first.where(F.col("filled") >= UNDERFULL * capacity), 1)).unionByName(named(second, 2))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, the least possible number, items, split documents, tokens, mean fill, underfull containers."""
    per = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"), F.count_if((F.col("n_pieces") > 1) & (F.col("piece") == 0)).alias("split"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("used") / F.lit(capacity)).alias("least_containers"),
        F.sum("items").alias("n_items"),
        F.sum("split").alias("n_split"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity)), 6).alias("mean_fill"),
        F.count_if(F.col("used") < F.lit(UNDERFULL * capacity)).alias("n_underfull"),
    )


def search_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per group of items packed together: bins and mean fill by best fit alone, moves and exchanges made, bins they emptied.

    Of the first round's groups the tokens of the bins that were packed again are missing; they stand with the second round's.
    """
    per = packed.where("pack_group is not null").groupBy("pack_group", "bins_before", "steps")
    held = per.agg(F.countDistinct("container").alias("bins_kept"), F.sum("size").alias("n_tokens"))
    return held.select("pack_group", "bins_before", "steps", "bins_kept", "n_tokens", F.round(F.col("n_tokens") / (F.col("bins_kept") * F.lit(capacity)), 6).alias("mean_fill"))


def split_documents(packed: DataFrame) -> DataFrame:
    """doc_id of the documents that needed splitting."""
    return packed.where("n_pieces > 1").select("doc_id").distinct()
