"""Coarse clusters: assignment, probing, residuals, centroid geometry, one step of Lloyd's algorithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.functions import vectors as V
from vecloom.session import checked

#: Elements of a block of distances in a worker (64 MB).
CELLS = 1 << 23


def load_centroids(centroids: DataFrame):
    """(cids, matrix) of centroids (cid, c), in order of cid. Their number is a parameter of the index, not of its data."""
    import numpy as np

    rows = sorted((r["cid"], list(r["c"])) for r in centroids.select("cid", "c").collect())
    c = np.array([r[1] for r in rows], np.float64)
    checked(c.nbytes, "centroids")
    return np.array([r[0] for r in rows], np.int64), c


def probe(vectors: DataFrame, centroids: DataFrame, n: int = 1, id_col: str = "id", keep: bool = True) -> DataFrame:
    """The n nearest centroids of each vector (id, v): (id, rank, cid, d[, v]), rank from 1, ties to the lowest cid.

    Centroids are broadcast; vectors pass through in Arrow batches once, without a shuffle and without a row for every
    pair. Fewer than n centroids give fewer rows; no centroids, none. d is a whole number where vectors and centroids are.
    """
    kind = V.kind_of((vectors, "v"), (centroids, "c"))
    cids, c = load_centroids(centroids)
    shared = vectors.sparkSession.sparkContext.broadcast((cids, c))
    kinds = dict(vectors.dtypes)
    names = [id_col, "rank", "cid", "d", *(["v"] if keep else [])]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cids, c = shared.value
        if not len(cids):
            return
        for whole in batches:
            step = max(1, CELLS // len(cids))
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                at, d = kernels.smallest(kernels.l2(kernels.matrix(b.column(1)), c), n)
                w = at.shape[1]
                rows = pa.array(np.repeat(np.arange(b.num_rows), w))
                out = [b.column(0).take(rows), pa.array(np.tile(np.arange(1, w + 1), b.num_rows)), pa.array(cids[at.ravel()]), pa.array(np.rint(d.ravel()).astype(np.int64) if kind == "bigint" else d.ravel().clip(0))]
                yield pa.RecordBatch.from_arrays(out + ([b.column(1).take(rows)] if keep else []), names)

    schema = f"{id_col} {kinds[id_col]}, rank bigint, cid bigint, d {kind}" + (f", v {kinds['v']}" if keep else "")
    return vectors.select(id_col, "v").mapInArrow(run, schema)


def assign(vectors: DataFrame, centroids: DataFrame, id_col: str = "id") -> DataFrame:
    """Each vector's nearest centroid: (id, cid, d, v)."""
    return probe(vectors, centroids, 1, id_col).drop("rank")


def residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """assigned (.., cid, v) with r = v - c. Centroids are few and broadcast, once their bytes are known; nothing is shuffled."""
    checked(8 * (centroids.agg(F.sum(F.size("c") + 1)).first()[0] or 0), "centroids")
    wide = (lambda x: F.col(x)) if V.kind_of((assigned, "v"), (centroids, "c")) == "bigint" else (lambda x: F.col(x).cast("array<double>"))
    return assigned.join(F.broadcast(centroids.select("cid", "c")), "cid").withColumn("r", V.subtract(wide("v"), wide("c"))).drop("c")


def centroid_distances(centroids: DataFrame) -> DataFrame:
    """(a, b, d) for all ordered pairs of centroids: nlist^2 rows by definition."""
    c = centroids.select(F.col("cid").alias("id"), F.col("c").alias("v"))
    n = c.count()
    return probe(c, centroids, n, keep=False).select(F.col("id").alias("a"), F.col("cid").alias("b"), "d")


def centroid_neighbors(centroids: DataFrame, n: int | None = None) -> DataFrame:
    """(cid, rank, neighbor, d): other centroids by distance, rank from 1; the n nearest only, in nlist * n rows, if n is given."""
    c = centroids.select(F.col("cid").alias("id"), F.col("c").alias("v"))
    d = (centroid_distances(centroids) if n is None else probe(c, centroids, n + 1, keep=False).select(F.col("id").alias("a"), F.col("cid").alias("b"), "d")).where("a <> b")
    w = W.partitionBy("a").orderBy("d", "b")
    out = d.select(F.col("a").alias("cid"), F.row_number().over(w).cast("bigint").alias("rank"), F.col("b").alias("neighbor"), "d")
    return out.where(F.col("rank") <= n) if n else out


def lloyd_step(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, n, c): each cluster's mean, of whole numbers by division toward zero; clusters without vectors are left out.

    Vectors become sums per cluster and dimension before anything is shuffled.
    """
    long = assign(vectors, centroids).select("cid", F.posexplode("v").alias("i", "x"))
    means = long.groupBy("cid", "i").agg(F.count("*").alias("n"), F.expr("sum(x) div count(*)" if V.kind_of((vectors, "v")) == "bigint" else "avg(x)").alias("x"))
    return means.groupBy("cid").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
