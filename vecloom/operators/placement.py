"""Cluster statistics, placement of clusters on units, routing of probes."""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Nearest neighbours of a cluster that may join it on its unit.
NEAR = 64
#: Consecutive query ids whose probes of a cluster are numbered together.
TURNS = 1 << 16


def cluster_sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("cid").agg(F.count("*").alias("n_points"))


def probe_frequency(probes: DataFrame) -> DataFrame:
    return probes.groupBy("cid").agg(F.count("*").alias("freq"))


def cluster_work(sizes: DataFrame, frequency: DataFrame) -> DataFrame:
    """(cid, n_points, freq, work): work is freq * n_points in 64 bits; clusters without probes or points count 0."""
    return sizes.join(frequency, "cid", "full").select(
        "cid", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("freq", F.lit(0)).alias("freq"), (F.coalesce("n_points", F.lit(0)) * F.coalesce("freq", F.lit(0))).alias("work")
    )


def average_work(work: DataFrame, units: int) -> DataFrame:
    """One row: total work and its share of each unit, rounded up."""
    return work.agg(F.sum("work").alias("total_work")).select("total_work", F.expr(f"(total_work + {units - 1}) div {units}").alias("avg_work"))


def cluster_rank(work: DataFrame) -> DataFrame:
    """Clusters by falling work, rank from 1. One row per cluster: their number is a parameter of the index."""
    return work.withColumn("rank", F.row_number().over(W.orderBy(F.desc("work"), "cid")).cast("bigint"))


def place(stats: list[tuple[int, int, int]], neighbors: dict[int, list[int]], units: int, capacity: int) -> list[tuple[int, int, int]]:
    """(cid, replica, unit) for clusters (cid, n_points, work): every cluster is placed.

    The hottest cluster left goes first. One with more work than a unit's fair share is copied to as many units as its
    work has shares, which split its probes; others go to the first unit, from the last one used on, that stays under
    the share, which is loosened by a fiftieth whenever no unit does. A unit that takes a cluster is topped up with
    that cluster's nearest neighbours while they fit, since queries probe them together. Clusters without work, and
    those for which no unit had room under its share, end on the least loaded unit that has room. Where none has, a
    ValueError says so.
    """
    points, work = {c: n for c, n, _ in stats}, {c: w for c, _, w in stats}
    share = max(1, -(-sum(work.values()) // units))
    load, stored, out = [0] * units, [0] * units, []
    on: list[set[int]] = [set() for _ in range(units)]
    todo = deque(sorted(work, key=lambda c: (-work[c], c)))
    left = set(todo)

    def put(c: int, unit: int, replica: int, part: int) -> None:
        out.append((c, replica, unit))
        load[unit] += part
        stored[unit] += points[c]
        on[unit].add(c)
        left.discard(c)

    later, at = [], 0
    while todo:
        c = todo.popleft()
        if c not in left:
            continue
        if not work[c]:
            later.append(c)
            continue
        copies = min(units, -(-work[c] // share))
        if copies > 1:
            part = -(-work[c] // copies)
            order = sorted(range(units), key=lambda u: (load[u] + part > share, load[u], (u - at) % units))
            chosen = [u for u in order if stored[u] + points[c] <= capacity][:copies]
            if not chosen:
                later.append(c)
                continue
            for r, u in enumerate(chosen):
                put(c, u, r, -(-work[c] // len(chosen)))
            continue
        slack, unit = 1.0, None
        while unit is None:
            able = [u for u in ((at + i) % units for i in range(units)) if load[u] + work[c] <= slack * share]
            unit = next((u for u in able if stored[u] + points[c] <= capacity), None)
            if unit is None and len(able) == units:
                break
            slack += 0.02 if len(able) else max(0.02, (min(load) + work[c]) / share - slack)
        if unit is None:
            later.append(c)
            continue
        put(c, unit, 0, work[c])
        for n in neighbors.get(c, ()):
            if n in left and work[n] and work[n] <= share and load[unit] + work[n] <= share and stored[unit] + points[n] <= capacity:
                put(n, unit, 0, work[n])
        at = (unit + 1) % units
    heap = [(load[u], stored[u], u) for u in range(units)]
    for c in sorted((c for c in later if c in left), key=lambda c: (-points[c], c)):
        aside = []
        heapq.heapify(heap)
        while heap:
            unit = heapq.heappop(heap)[2]
            aside.append(unit)
            if stored[unit] + points[c] <= capacity:
                break
        else:
            raise ValueError(f"cluster {c} of {points[c]} points fits on none of {units} units")
        put(c, unit, 0, work[c])
        heap += [(load[u], stored[u], u) for u in aside]
    assert not left
    return sorted(out)


def placement(work: DataFrame, neighbors: DataFrame, units: int, capacity: int) -> DataFrame:
    """place() for cluster_work and centroid_neighbors(n=NEAR): a row and NEAR neighbours of each cluster, so the driver does it."""
    import numpy as np

    t = neighbors.where(F.col("rank") <= NEAR).select("cid", "rank", "neighbor").toArrow()
    cid, rank, other = (t.column(i).to_numpy() for i in range(3))
    order = np.lexsort((rank, cid))
    cids, first = np.unique(cid[order], return_index=True)
    near = dict(zip(cids.tolist(), (x.tolist() for x in np.split(other[order], first[1:]))))
    rows = place([(r["cid"], r["n_points"], r["work"]) for r in work.collect()], near, units, capacity)
    return work.sparkSession.createDataFrame(rows, "cid bigint, replica bigint, unit bigint")


def unplaced(clusters: DataFrame, placed: DataFrame) -> DataFrame:
    return clusters.select("cid").join(placed, "cid", "left_anti")


def route(probes: DataFrame, placed: DataFrame) -> DataFrame:
    """Each probe (qid, cid) goes to one replica of its cluster, in turn by qid: (qid, cid, replica, unit).

    The turn has two levels: probes are numbered within TURNS consecutive query ids, and the counts of the ranges
    before (a row for each cluster and range) are added, so no task gets all probes of a hot cluster.
    """
    copies = placed.groupBy("cid").agg(F.count("*").alias("copies"))
    probes = probes.select("qid", "cid", F.floor(F.col("qid") / TURNS).alias("range"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("cid").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = probes.groupBy("cid", "range").agg(F.count("*").alias("n")).join(copies, "cid").select("cid", "range", "copies", before.alias("before"))
    turn = F.col("before") + F.row_number().over(W.partitionBy("cid", "range").orderBy("qid")) - 1
    dealt = probes.join(ranges, ["cid", "range"]).withColumn("replica", F.pmod(turn, F.col("copies")))
    return dealt.join(placed, ["cid", "replica"]).select("qid", "cid", "replica", "unit")


def unit_offsets(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where each cluster begins in its unit's store: (unit, cid, n_points, first)."""
    w = W.partitionBy("unit").orderBy("cid").rowsBetween(W.unboundedPreceding, -1)
    return placed.join(sizes, "cid").select("unit", "cid", "n_points", F.coalesce(F.sum("n_points").over(w), F.lit(0)).alias("first"))


def unit_load(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, n_probes, n_queries, n_rows): probes, different queries and rows to scan of each unit."""
    return routed.join(sizes, "cid").groupBy("unit").agg(F.count("*").alias("n_probes"), F.countDistinct("qid").alias("n_queries"), F.sum("n_points").alias("n_rows"))


def sorted_load(load: DataFrame) -> DataFrame:
    """(place, unit, n_rows): units by falling rows, place from 1. One row a unit: their number is a parameter."""
    return load.select(F.row_number().over(W.orderBy(F.desc("n_rows"), "unit")).cast("bigint").alias("place"), "unit", "n_rows")


def slices(assigned: DataFrame, most: int, units: int) -> DataFrame:
    """(cid, slice, unit, n_points): each cluster of (id, cid) in slices of `most` consecutive points, by id, and a unit for each.

    Slices are dealt to units in turn, the largest first (ties: by cid and slice). A hot cluster is spread over units
    without a copy: each unit scans its slices for every probe of the cluster. A slice's place follows from counts, a
    row for each cluster and hash bucket of ids, so no task holds a cluster.
    """
    counts = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    each = counts.select("cid", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {most}"))).alias("slice"))
    sized = each.select("cid", "slice", F.least(F.lit(most).cast("bigint"), F.col("n") - F.col("slice") * most).alias("n_points"))
    turn = F.row_number().over(W.orderBy(F.desc("n_points"), "cid", "slice")) - 1  # a row a slice: points / most
    return sized.select("cid", "slice", F.pmod(turn, F.lit(units)).cast("bigint").alias("unit"), "n_points")


def slice_load(sliced: DataFrame, frequency: DataFrame) -> DataFrame:
    """(unit, n_probes, n_rows): every probe of a cluster meets all its slices, wherever they are."""
    return sliced.join(frequency, "cid").groupBy("unit").agg(F.sum("freq").alias("n_probes"), F.sum(F.col("freq") * F.col("n_points")).alias("n_rows"))


def balance(load: DataFrame) -> DataFrame:
    """One row: greatest, least and mean load, and the units that have them (the lowest at ties)."""
    return load.agg(
        F.max("n_rows").alias("max_rows"), F.min("n_rows").alias("min_rows"), F.min(F.struct(-F.col("n_rows"), "unit"))["unit"].alias("max_unit"), F.min(F.struct("n_rows", "unit"))["unit"].alias("min_unit"),
        F.sum("n_rows").alias("sum_rows"), F.count("*").alias("n_units"), F.max("n_probes").alias("max_probes"), F.max("n_queries").alias("max_queries"),
    )
