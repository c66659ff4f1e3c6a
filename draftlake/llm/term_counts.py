"""Problem 3: occurrences and records of every distinct term, by burst-trie counting.

Every worker counts the terms of its records in a compact burst trie: inner
nodes branch on a character, leaves are small containers of suffixes with an
occurrence and a record counter, and a container that grows beyond its limit
bursts into a node. A trie is handed on as its subtrees, each a path and a container,
when it is full or its records end. Each subtree is routed by an adaptive prefix: short
where few terms start alike, longer below crowded prefixes. Matching subtrees of
all workers meet and are merged into one trie.

Scale. A term leaves a worker's trie once, whatever its frequency, so a term in a third
of all records costs a row per trie. The router lengthens prefixes under which more than
a limit of entries lie until none is crowded, so no merge holds more than about that
many terms; only the crowded prefixes (at most entries / limit of each length) reach
the workers, as a broadcast set. A worker's trie is flushed at FLUSH_TERMS entries. Each
record counts once: its terms are counted inside its row, the rows of one record meet by
id in that form (distinct terms with counts) and copies of one record are dropped there.

Edge cases: terms are trimmed and lower-cased; null and empty ones are left out;
copies of a record count once (the copy with most terms); rows without an id are no record;
records without terms still count in the total; empty input gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.common import checkpoint, shuffle_partitions

CONTAINER = 64
ROUTE_ENTRIES = 50_000
#: Lengths of routing prefixes; each length is tried only below crowded prefixes of the one before.
ROUTE_LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
FLUSH_TERMS = 300_000


class BurstTrie:
    """Terms with two counters. Containers map suffixes to [occurrences, records]."""

    __slots__ = ("limit", "n_terms", "root")

    def __init__(self, limit: int = CONTAINER):
        self.limit = limit
        self.n_terms = 0
        # a node is [mapping, own]: mapping holds suffix -> counters while it is a
        # container, and character -> node once it has burst; own is None for containers
        self.root: list = [{}, None]

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while node[1] is not None:  # burst
            if depth == len(term):
                self.n_terms += not node[1][1]
                node[1][0] += occurrences
                node[1][1] += records
                return
            c = term[depth]
            child = node[0].get(c)
            if child is None:
                child = node[0][c] = [{}, None]
            node, depth = child, depth + 1
        suffix = term[depth:]
        counters = node[0].get(suffix)
        if counters is not None:
            counters[0] += occurrences
            counters[1] += records
            return
        node[0][suffix] = [occurrences, records]
        self.n_terms += 1
        if len(node[0]) > self.limit:
            self._burst(node)

    def _burst(self, node: list) -> None:
        held = node[0]
        node[0], node[1] = {}, [0, 0]
        for suffix, (o, r) in held.items():
            if not suffix:
                node[1][0] += o
                node[1][1] += r
                continue
            child = node[0].get(suffix[0])
            if child is None:
                child = node[0][suffix[0]] = [{}, None]
            child[0][suffix[1:]] = [o, r]
        for child in node[0].values():
            if len(child[0]) > self.limit:
                self._burst(child)

    def subtrees(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """(path, container) of every leaf, in the order of paths; a burst node's own term is a container of ''."""
        stack = [("", self.root)]
        while stack:
            path, node = stack.pop()
            if node[1] is None:
                if node[0]:
                    yield path, node[0]
                continue
            if node[1][1]:
                yield path, {"": node[1]}
            stack.extend((path + c, child) for c, child in sorted(node[0].items(), reverse=True))

    def items(self) -> Iterator[tuple[str, int, int]]:
        for path, held in self.subtrees():
            for suffix, (o, r) in held.items():
                yield path + suffix, o, r


_COUNTED = "record_id string, size long, terms array<struct<field_name:string,term:string,n:long>>"
_SUBTREE = "field_name string, path string, suffixes array<string>, occurrences array<long>, records array<long>"
_TERM = "field_name string, term string, occurrences long, records long"


def _rows(rows: list[tuple[str, str, dict[str, list[int]]]], first: tuple[str, ...] = ("field_name", "path")) -> pa.RecordBatch:
    named = {name: pa.array([r[i] for r in rows], pa.string()) for i, name in enumerate(first)}
    held = [r[len(first)] for r in rows]
    lists = lambda pick: [[pick(c) for c in h.values()] for h in held]
    return pa.record_batch(
        named | {
            "suffixes": pa.array([list(h) for h in held], pa.list_(pa.string())),
            "occurrences": pa.array(lists(lambda c: c[0]), pa.list_(pa.int64())), "records": pa.array(lists(lambda c: c[1]), pa.list_(pa.int64())),
        }
    )


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of tries over the terms of records."""
    tries: dict[str, BurstTrie] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for field, trie in tries.items():
            part = []
            for path, held in trie.subtrees():
                part.append((field, path, held))
                if len(part) == 1_000:
                    yield _rows(part)
                    part = []
            if part:
                yield _rows(part)
        tries.clear()

    for batch in batches:
        # one pass per batch before the trie: equal terms of a batch are one insertion
        seen: dict[tuple[str, str], list[int]] = {}
        for f, term, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = seen.get((f, term))
            if got is None:
                seen[f, term] = [n, 1]
            else:
                got[0] += n
                got[1] += 1
        for (f, term), (o, r) in seen.items():
            if f not in tries:
                tries[f] = BurstTrie()
            tries[f].add(term, o, r)
        if sum(t.n_terms for t in tries.values()) >= FLUSH_TERMS:
            yield from flush()
    yield from flush()


def crowded_prefixes(subtrees: DataFrame, route_entries: int = ROUTE_ENTRIES) -> set[tuple[str, str]]:
    """(field, prefix) under which more than ``route_entries`` entries lie, at most entries / route_entries of each length."""
    spark = subtrees.sparkSession
    entries = subtrees.select("field_name", F.explode(F.transform("suffixes", lambda s: F.concat("path", s))).alias("term"))
    crowded: set[tuple[str, str]] = set()
    above: list[tuple[str, str]] = []
    for k, length in enumerate(ROUTE_LENGTHS):
        mine = entries.select("field_name", F.substring("term", 1, length).alias("p"), F.length("term").alias("l")).where(F.col("l") >= length).drop("l")
        if k:
            known = spark.createDataFrame(above, "field_name string, above string")
            mine = mine.withColumn("above", F.substring("p", 1, ROUTE_LENGTHS[k - 1])).join(F.broadcast(known), ["field_name", "above"], "left_semi")  # at most entries / route_entries
        above = [(r.field_name, r.p) for r in mine.groupBy("field_name", "p").count().where(F.col("count") > route_entries).collect()]
        if not above:
            break
        crowded |= set(above)
    return crowded


def _route(field: str, term: str, crowded: set[tuple[str, str]]) -> str:
    """The shortest prefix of the term that is not crowded."""
    for length in ROUTE_LENGTHS:
        if len(term) <= length or (field, term[:length]) not in crowded:
            return term[:length]
    return term


def merge_subtrees(subtrees: DataFrame, route_entries: int = ROUTE_ENTRIES) -> DataFrame:
    """Sum matching subtrees of all workers: field_name, term, occurrences, records."""
    n = shuffle_partitions(subtrees.sparkSession)
    spread = subtrees.sparkSession.sparkContext.broadcast(crowded_prefixes(subtrees, route_entries))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole subtrees where all their terms go one way, else cut into the parts that do."""
        crowded = spread.value
        for batch in batches:
            out = []
            for field, path, suffixes, occurrences, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts: dict[str, dict[str, list[int]]] = {}
                one = _route(field, path, crowded)
                if len(one) < len(path) or (len(path) in ROUTE_LENGTHS and (field, path) not in crowded):
                    parts[one] = {s: [o, r] for s, o, r in zip(suffixes, occurrences, records, strict=True)}
                else:
                    for s, o, r in zip(suffixes, occurrences, records, strict=True):
                        parts.setdefault(_route(field, path + s, crowded), {})[s] = [o, r]
                out += [(field, to, path, held) for to, held in parts.items()]
            if out:
                yield _rows(out, ("field_name", "route", "path"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, str] | None = None
        trie = BurstTrie()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(trie.items())
            for i in range(0, len(rows), 20_000):
                term, o, r = zip(*rows[i : i + 20_000], strict=True)
                yield pa.record_batch({"field_name": pa.array([at[0]] * len(term), pa.string()), "term": pa.array(term, pa.string()), "occurrences": pa.array(o, pa.int64()), "records": pa.array(r, pa.int64())})

        for batch in batches:
            for field, to, path, suffixes, occurrences, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (field, to) != at:
                    if at is not None:
                        yield from flush()
                    at, trie = (field, to), BurstTrie()
                for s, o, r in zip(suffixes, occurrences, records, strict=True):
                    trie.add(path + s, o, r)
        if at is not None:
            yield from flush()

    routed = subtrees.mapInArrow(route, "field_name string, route string, path string, suffixes array<string>, occurrences array<long>, records array<long>")
    return routed.repartition(n, "field_name", "route").sortWithinPartitions("field_name", "route").mapInArrow(merge, _TERM)


def record_terms(records: DataFrame, record_id: str, fields: dict[str, Column]) -> DataFrame:
    """field_name, term, n: the distinct terms of each record, copies of a record dropped.

    ``fields`` maps a field name to an ARRAY<STRING> column of values. The terms are counted
    inside the row, so only distinct terms with their counts are shuffled.
    """
    names = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, held = [], []
            for values in zip(*(batch.column(1 + i).to_pylist() for i in range(len(names))), strict=True):
                counts = [(name, Counter(s for v in column or () if v is not None and (s := v.strip(" ")))) for name, column in zip(names, values, strict=True)]
                sizes.append(sum(c.total() for _, c in counts))
                held.append([{"field_name": name, "term": term, "n": n} for name, c in counts for term, n in c.items()])
            kind = pa.list_(pa.struct([("field_name", pa.string()), ("term", pa.string()), ("n", pa.int64())]))
            yield pa.record_batch({"record_id": batch.column(0), "size": pa.array(sizes, pa.int64()), "terms": pa.array(held, kind)})

    # lower case is left to the JVM, whose rules are the documented ones
    lowered = [F.transform(values, lambda v: F.lower(v)).alias(f"f{i}") for i, values in enumerate(fields.values())]
    flat = records.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), *lowered).mapInArrow(count, _COUNTED)
    one = flat.groupBy("record_id").agg(F.max_by("terms", "size").alias("terms"))
    return one.select(F.explode("terms").alias("t")).select("t.field_name", "t.term", "t.n")


def term_counts(records: DataFrame, record_id: str, fields: dict[str, Column], route_entries: int = ROUTE_ENTRIES) -> DataFrame:
    """field_name, term, occurrences, records of every distinct term."""
    return merge_subtrees(checkpoint(record_terms(records, record_id, fields).mapInArrow(_partial_tries, _SUBTREE)), route_entries)


def marked_terms(records: DataFrame, record_id: str, fields: dict[str, Column], rare: int = 2, common: float = 0.4) -> DataFrame:
    """term_counts with mark: rare (at most ``rare`` records), common (more than ``common`` of all records) or null."""
    total = records.agg(F.countDistinct(record_id).alias("total"))
    counts = term_counts(records, record_id, fields).crossJoin(F.broadcast(total))  # one row
    mark = F.when(F.col("records") <= rare, F.lit("rare")).when(F.col("records") > common * F.col("total"), F.lit("common"))
    return counts.select("field_name", "term", "occurrences", "records", F.round(F.col("records") / F.col("total"), 6).alias("share"), mark.alias("mark"))


def node_fields() -> dict[str, Column]:
    """Fields of arrays of structs, not lambdas, so that the scan reads no other fields."""
    return {"semantic_label": F.col("nodes.semantic_label"), "layer": F.col("nodes.layer")}
