"""Recall and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recall_at(results: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 10, 100)) -> DataFrame:
    """One row: share of queries in truth (qid, id: the true nearest) whose neighbour is among the first j results, for each j.

    Queries without results count as missed; ranks past the results' own end can't hold it.
    """
    found = truth.join(results.select("qid", "id", "rank"), ["qid", "id"], "left")
    return found.agg(F.count("*").alias("n_queries"), *(F.sum(F.coalesce((F.col("rank") <= j).cast("bigint"), F.lit(0))).alias(f"hits_{j}") for j in at)).select(
        "n_queries", *(F.round(F.col(f"hits_{j}") / F.col("n_queries"), 6).alias(f"recall_{j}") for j in at)
    )


def overlap(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: share of the true k nearest (qid, rank, id) that the first k results hold."""
    want = truth.where(F.col("rank") <= k)
    got = results.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit"))
    return want.join(got, ["qid", "id"], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def explore(index, queries: DataFrame, truth: DataFrame, nprobes=(1, 2, 4, 8, 16, 32, 64, 128, 256), ks=(1,), repeats: int = 1) -> DataFrame:
    """One row for each setting of the grid: (nprobe, k, recall, cost, seconds).

    recall: 1-recall@k against truth (qid, id). cost: list rows that the probes meet, which doesn't depend on the
    machine; seconds: mean of `repeats` runs. Settings are run in turn: a grid is a few dozen, each a full search.
    """
    import time

    from vecloom.operators.coarse import probe
    from vecloom.params import SearchParams

    sizes = index.lists.groupBy("cid").agg(F.count("*").alias("n")).collect()  # one row a cluster
    n = {r["cid"]: r["n"] for r in sizes}
    met = probe(queries, index.centroids, max(nprobes), "qid", keep=False).groupBy("cid", "rank").count().collect()
    rows = []
    for nprobe in nprobes:
        cost = sum(r["count"] * n.get(r["cid"], 0) for r in met if r["rank"] <= nprobe)
        for k in ks:
            start = time.time()
            for _ in range(repeats):
                recall = recall_at(index.search(queries, SearchParams(k, nprobe)), truth, (k,)).first()[1]
            rows.append((nprobe, k, recall, cost, (time.time() - start) / repeats))
    return queries.sparkSession.createDataFrame(rows, "nprobe bigint, k bigint, recall double, cost bigint, seconds double")


def sweep(index, queries: DataFrame, batches, nprobes, ks) -> DataFrame:
    """(batch, nprobe, k, probes, list_rows, kept): for each setting of the grid, what the first `batch` queries by qid meet.

    probes: clusters probed; list_rows: rows of these; kept: rows of each probe's best list at most. One pass over the
    probes for the whole grid; explore() measures recall and seconds besides.
    """
    from vecloom.operators.coarse import probe

    spark = queries.sparkSession
    sizes = index.lists.groupBy("cid").agg(F.count("*").alias("n_points"))
    first = queries.orderBy("qid").limit(max(batches))  # the largest batch, a parameter
    met = probe(first, index.centroids, max(nprobes), "qid", keep=False).join(sizes, "cid").withColumn("n", F.dense_rank().over(W.orderBy("qid")))
    grid = spark.createDataFrame([(b, p, k) for b in batches for p in nprobes for k in ks], "batch bigint, nprobe bigint, k bigint")
    return met.join(grid, (F.col("n") <= F.col("batch")) & (F.col("rank") <= F.col("nprobe"))).groupBy("batch", "nprobe", "k").agg(
        F.count("*").alias("probes"), F.sum("n_points").alias("list_rows"), F.sum(F.least("n_points", "k")).alias("kept")
    )


def unit_sweep(probes: DataFrame, sizes: DataFrame, units) -> DataFrame:
    """(units, max_rows, mean_rows): load of the fullest unit and the mean if clusters are dealt to units by cid, for each number of units."""
    rows = probes.groupBy("cid").agg(F.count("*").alias("freq")).join(sizes, "cid").select("cid", (F.col("freq") * F.col("n_points")).alias("n"))
    each = rows.select("n", "cid", F.explode(F.array(*(F.lit(u).cast("bigint") for u in units))).alias("units")).groupBy("units", (F.col("cid") % F.col("units")).alias("unit")).agg(F.sum("n").alias("n"))
    return each.groupBy("units").agg(F.max("n").alias("max_rows"), F.round(F.sum("n") / F.col("units"), 6).alias("mean_rows"))


def operating_points(measured: DataFrame, cost: str = "cost", gain: str = "recall") -> DataFrame:
    """Rows that no other row beats: cheaper ones all gain less. One row per setting of a parameter grid."""
    before = F.max(gain).over(W.orderBy(cost, F.desc(gain)).rowsBetween(W.unboundedPreceding, -1))
    return measured.withColumn("_best", before).where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def first_acceptable(measured: DataFrame, least: float, cost: str = "cost", gain: str = "recall") -> DataFrame:
    """The cheapest setting that gains more than `least`."""
    return operating_points(measured, cost, gain).where(F.col(gain) > least).orderBy(cost).limit(1)
