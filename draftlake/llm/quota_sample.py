"""Problem 6: a sample that meets target category proportions, by min-cost flow on cell counts.

The eligible rows are counted per cell (category x stratum). For each request a
flow network carries rows from the strata's availability through the cells to
the categories' needs: cell arcs hold the available rows and cost little while a
stratum stays within its proportional share and more beyond it, so that strata
are mixed as evenly as the margins permit; slack arcs of prohibitive cost take
what no cell can deliver and expose each category's shortfall. The integer cell
quotas are then drawn at random.

Scale. The network is as large as the number of cells (categories x strata), not
of rows; the driver sees counts only and checks their number. The draw needs no
sort of a cell: rows get a random 63-bit key, the keys' leading bits are counted per cell, bins below the
cut are taken whole and only the one bin in which the cut lies is ranked, so a
cell with a third of all rows is spread over all tasks.

Edge cases: repeated ids count once; categories out of range or null are not
eligible; null strata form one stratum; a request without need draws nothing; a
need beyond the supply takes all there is and is reported; empty input reports
every positive need as shortfall.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftlake.common import checkpoint, stable_hash

SLACK_COST = 1_000_000
#: Cells and target rows that the driver takes; more of them raise.
MAX_CELLS = 200_000
MAX_TARGETS = 200_000
#: Leading bits of the random key that are counted per cell.
BIN_BITS = 10


class MinCostFlow:
    """Successive shortest paths with potentials, on integer capacities and non-negative costs."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = defaultdict(list)
        self.to: list[object] = []
        self.capacity: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.capacity.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.capacity[arc + 1]

    def run(self, source: object, sink: object) -> int:
        potential: dict[object, int] = defaultdict(int)
        total = 0
        while True:
            best: dict[object, int] = {source: 0}
            via: dict[object, int] = {}
            heap: list[tuple[int, int, object]] = [(0, 0, source)]
            done, tick = set(), 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    if self.capacity[e] > 0:
                        y = self.to[e]
                        nd = d + self.cost[e] + potential[x] - potential[y]
                        if y not in best or nd < best[y]:
                            best[y], via[y] = nd, e
                            tick += 1
                            heapq.heappush(heap, (nd, tick, y))
            if sink not in best:
                return total
            for x, d in best.items():
                potential[x] += d
            push, x = None, sink
            while x != source:
                e = via[x]
                push = self.capacity[e] if push is None else min(push, self.capacity[e])
                x = self.to[e ^ 1]
            x = sink
            while x != source:
                e = via[x]
                self.capacity[e] -= push
                self.capacity[e ^ 1] += push
                x = self.to[e ^ 1]
            total += push


def cell_quotas(cells: dict[tuple[int, str], int], needs: dict[int, int]) -> tuple[dict[tuple[int, str], int], dict[int, int]]:
    """Integer quota per (category, stratum) cell, and shortfall per category."""
    net = MinCostFlow()
    wanted, eligible = sum(needs.values()), sum(cells.values())
    strata: dict[str, int] = defaultdict(int)
    for (_, s), n in cells.items():
        strata[s] += n
    arcs, slack = {}, {}
    for s, n in strata.items():
        # within its proportional share a stratum is free, beyond it each row costs
        fair = min(n, math.ceil(wanted * n / eligible)) if eligible else 0
        net.arc("source", ("s", s), fair, 0)
        if n > fair:
            net.arc("source", ("s", s), n - fair, 10)
    supply: dict[int, int] = defaultdict(int)
    for (c, _), n in cells.items():
        supply[c] += n
    for (c, s), n in sorted(cells.items()):
        if needs.get(c, 0) > 0:
            fair = min(n, needs[c] * n // supply[c])
            # the cell's own share is free, the rest of its availability costs a little
            arcs[c, s] = [net.arc(("s", s), ("c", c), fair, 0), net.arc(("s", s), ("c", c), n - fair, 1)]
    for c, need in needs.items():
        if need > 0:
            slack[c] = net.arc("source", ("c", c), need, SLACK_COST)
            net.arc(("c", c), "sink", need, 0)
    net.run("source", "sink")
    return {k: q for k, both in arcs.items() if (q := sum(net.flow(a) for a in both))}, {c: net.flow(a) for c, a in slack.items()}


def eligible_rows(pairs: DataFrame, strata: str = "source") -> DataFrame:
    """pair_id, scale_bucket, stratum: rows with a bucket in 0..3, each pair_id once."""
    rows = pairs.where(F.col("scale_bucket").between(0, 3) & F.col("pair_id").isNotNull())
    return rows.groupBy("pair_id").agg(F.min(F.struct("scale_bucket", F.coalesce(strata, F.lit("(none)")).alias("stratum"))).alias("r")).select("pair_id", "r.*")


def request_needs(targets: DataFrame, eligible: int) -> dict[int, dict[int, int]]:
    """Need per request and bucket: greatest(min_rows, ceil(E * sample * target / 1e6)); targets is a fixed table.

    A target listed twice counts with its larger need, one without request or bucket not at all.
    """
    needs: dict[int, dict[int, int]] = {}
    listed = targets.where("request_id is not null and scale_bucket is not null").select("request_id", "scale_bucket", "sample_permille", "target_permille", "min_rows")
    rows = listed.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets; ask for them in several tables")
    for r in rows:
        share = -(-eligible * (r.sample_permille or 0) * (r.target_permille or 0) // 1_000_000)
        of = needs.setdefault(r.request_id, {})
        of[r.scale_bucket] = max(of.get(r.scale_bucket, 0), r.min_rows or 0, share)
    return needs


def plan_quotas(rows: DataFrame, targets: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Of eligible rows: quotas (request, bucket, stratum, quota) and report (request, bucket, need, available, quota, shortfall)."""
    counted = rows.groupBy("scale_bucket", "stratum").count().limit(MAX_CELLS + 1).collect()
    if len(counted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; choose a coarser stratum")
    cells = {(r.scale_bucket, r.stratum): r["count"] for r in counted}
    available: dict[int, int] = defaultdict(int)
    for (c, _), n in cells.items():
        available[c] += n
    quotas, report = [], []
    for request, needs in sorted(request_needs(targets, sum(cells.values())).items()):
        drawn, short = cell_quotas(cells, needs)
        quotas += [(request, c, s, q) for (c, s), q in sorted(drawn.items())]
        taken: dict[int, int] = defaultdict(int)
        for (c, _), q in drawn.items():
            taken[c] += q
        report += [(request, c, need, available[c], taken[c], short.get(c, 0)) for c, need in sorted(needs.items())]
    return quotas, report


def shortfalls(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """request_id, scale_bucket, need, available, quota, shortfall of every target row."""
    _, report = plan_quotas(eligible_rows(pairs), targets)
    return pairs.sparkSession.createDataFrame(report, "request_id int, scale_bucket int, need long, available long, quota long, shortfall long")


def draw_sample(pairs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """request_id, pair_id, scale_bucket, stratum: the rows drawn for every request.

    The requests' keys are hashes, so they are derived twice (for the counts of bins and for
    the choice) instead of being kept; only rows of the bins in which a cut lies are ranked.
    """
    spark = pairs.sparkSession
    rows = checkpoint(eligible_rows(pairs))
    quotas, _ = plan_quotas(rows, targets)
    wanted = spark.createDataFrame(quotas, "request_id int, scale_bucket int, stratum string, quota long")
    cell = ["request_id", "scale_bucket", "stratum"]
    key = stable_hash("pair_id", "request_id", seed=seed)
    # at most one row per cell and request, whose numbers plan_quotas has checked
    keyed = rows.join(F.broadcast(wanted), ["scale_bucket", "stratum"]).withColumn("key", key).withColumn("bin", F.shiftright("key", 63 - BIN_BITS))
    below = Window.partitionBy(*cell).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = keyed.groupBy(*cell, "quota", "bin").count().withColumn("before", F.coalesce(F.sum("count").over(below), F.lit(0)))
    cut = bins.where(F.col("before") < F.col("quota")).groupBy(*cell, "quota").agg(F.max("bin").alias("last"), F.max_by("before", "bin").alias("taken"))
    chosen = keyed.drop("quota").join(F.broadcast(cut), cell).where(F.col("bin") <= F.col("last"))  # one row per cell and request
    whole = chosen.where(F.col("bin") < F.col("last"))
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("key", "pair_id"))
    partly = chosen.where(F.col("bin") == F.col("last")).withColumn("rank", rank).where(F.col("rank") <= F.col("quota") - F.col("taken")).drop("rank")
    return whole.unionByName(partly).select("request_id", "pair_id", "scale_bucket", "stratum")


def drawn_shares(pairs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """request_id, scale_bucket, n_drawn of the sample, also of the buckets of which nothing was drawn."""
    counted = draw_sample(pairs, targets, seed).groupBy("request_id", "scale_bucket").agg(F.count(F.lit(1)).alias("n_drawn"))
    asked = targets.where("request_id is not null and scale_bucket is not null").select("request_id", "scale_bucket").distinct()
    return asked.join(counted, ["request_id", "scale_bucket"], "left").select("request_id", "scale_bucket", F.coalesce("n_drawn", F.lit(0)).alias("n_drawn"))
