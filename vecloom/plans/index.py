"""Indexes: built by rule or by training, saved as Parquet, searched."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import coarse, pq, project, search
from vecloom.params import IndexSpec, SearchParams, parse_index, parse_search
from vecloom.session import stored

#: Vectors that training looks at: about so many for each word or centroid, drawn by a hash of the id.
TRAIN_PER_CENTROID = 256


@dataclass
class Index:
    """centroids (cid, c), codebook (m, k, w), lists (cid, id, code or v); parts that the spec doesn't need are None.

    With a second level: its codebook `fine` and the lists' column of that name. With projection: axes (axis, w).
    """

    spec: IndexSpec
    lists: DataFrame
    centroids: DataFrame | None = None
    codebook: DataFrame | None = None
    fine: DataFrame | None = None
    axes: DataFrame | None = None

    def search(self, queries: DataFrame, params: SearchParams | str = SearchParams()) -> DataFrame:
        """(qid, rank, id, dist) for queries (qid, v). Distances of projected vectors are those of the projections.

        With a second level, k * factor candidates by the first are ranked by both.
        """
        p = parse_search(params) if isinstance(params, str) else params
        if self.axes is not None:
            queries = project.project(queries, self.axes)
        if self.fine is not None:
            found = search.ivf_search(self.lists, queries, self.centroids, p.k * p.factor, p.nprobe if self.spec.nlist else 1, self.codebook, self.spec.metric, by_residual=bool(self.spec.nlist))
            return search.rescore(found, self.lists, queries, self.centroids, self.codebook, self.fine, p.k, self.spec.metric)
        if self.spec.kind == "flat":
            return search.flat_knn(self.lists, queries, p.k, self.spec.metric)
        if self.spec.kind == "pq":
            return search.ivf_search(self.lists, queries, self.centroids, p.k, 1, self.codebook, self.spec.metric, by_residual=False)
        return search.ivf_search(self.lists, queries, self.centroids, p.k, p.nprobe, self.codebook, self.spec.metric)

    def save(self, path: str) -> None:
        """Lists are written by cluster, so that a search reads the probed clusters only; hot clusters take several files."""
        spark = self.lists.sparkSession
        lists = self.lists if "cid" in self.lists.columns else self.lists.withColumn("cid", F.lit(0).cast("bigint"))
        if "part" not in lists.columns:
            lists = lists.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
        # cid decides a file's folder; the hash part lets a cluster spread over tasks, and Spark splits the large ones further.
        lists.hint("rebalance", "cid", "part").drop("part").write.partitionBy("cid").parquet(f"{path}/lists")
        for name in ("centroids", "codebook", "fine", "axes"):
            if (df := getattr(self, name)) is not None:
                df.coalesce(1).write.parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps(asdict(self.spec)),)], "spec string").coalesce(1).write.text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        spec = IndexSpec(**json.loads(spark.read.text(f"{path}/meta").first()[0]))
        lists = spark.read.parquet(f"{path}/lists").withColumn("cid", F.col("cid").cast("bigint"))
        part = lambda name: spark.read.parquet(f"{path}/{name}")
        return Index(spec, lists, part("centroids") if spec.nlist or spec.m else None, part("codebook") if spec.m else None, part("fine") if spec.fine else None, part("axes") if spec.axes else None)


def add(vectors: DataFrame, spec: IndexSpec, centroids: DataFrame | None, codebook: DataFrame | None, fine: DataFrame | None = None, axes: DataFrame | None = None) -> Index:
    """Vectors (id, v) into lists: projection, nearest centroid, residual, code, fine code of what it leaves over. One pass without a shuffle."""
    if axes is not None:
        vectors = project.project(vectors.select("id", "v"), axes)
    if spec.kind == "flat":
        return Index(spec, vectors.select("id", "v"), axes=axes)
    if spec.nlist:
        placed = coarse.assign(vectors, centroids)
    else:
        zero = F.transform("v", lambda x: x * 0)
        placed = vectors.select("id", F.lit(0).cast("bigint").alias("cid"), "v")
        centroids = vectors.limit(1).select(F.lit(0).cast("bigint").alias("cid"), zero.alias("c"))
    if not spec.m:
        return Index(spec, placed.select("cid", "id", "v"), centroids, axes=axes)
    r = coarse.residuals(placed, centroids) if spec.metric == "l2" or spec.nlist else placed.withColumn("r", F.col("v"))
    coded = pq.encode(r.select("cid", "id", "r"), codebook)
    if fine is None:
        return Index(spec, coded.select("cid", "id", "code"), centroids, codebook, axes=axes)
    both = pq.encode(pq.remainders(coded, codebook), fine, "rest", "fine")
    return Index(spec, both.select("cid", "id", "code", "fine"), centroids, codebook, fine, axes)


def rule_index(vectors: DataFrame, nlist: int = 16, m: int = 8, ksub: int = 16, fine: int = 0) -> Index:
    """A reproducible index: centroids are the vectors with ids below nlist, words the parts of the residuals of the next ksub.

    With `fine` parts of a second level, its words are those of what the codes leave over of the ksub vectors after these.
    """
    d = len(vectors.first()["v"])
    centroids = vectors.where(F.col("id") < nlist).select(F.col("id").alias("cid"), F.col("v").alias("c"))

    def words(first: int, parts: int, of, column: str) -> DataFrame:
        some = vectors.where((F.col("id") >= first) & (F.col("id") < first + ksub))
        rows = of(coarse.residuals(coarse.assign(some, centroids), centroids).select("id", "r"))
        each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("m"), (F.col("id") - first).cast("int").alias("k"), F.col(column).alias("x"))
        return each.select("m", "k", V.subvector(F.col("x"), F.col("m"), d // parts).alias("w"))

    codebook = words(nlist, m, lambda r: r, "r")
    second = words(nlist + ksub, fine, lambda r: pq.remainders(pq.encode(r, codebook), codebook), "rest") if fine else None
    return add(vectors, IndexSpec(nlist, m, (ksub - 1).bit_length(), fine=fine), centroids, codebook, second)


def kmeans(rows, k: int, seed: int = 7, rounds: int = 20):
    """Lloyd's algorithm from k-means++ starts on a bounded sample, in numpy; empty clusters take the farthest vectors."""
    import numpy as np

    from vecloom.functions import kernels

    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    c = rows[[rng.integers(len(rows))]]
    d = kernels.l2(rows, c)[:, 0].clip(0)
    while len(c) < k:
        total = d.sum()
        pick = rng.choice(len(rows), p=d / total) if total > 0 else len(c)
        c = np.concatenate([c, rows[[pick]]])
        d = np.minimum(d, kernels.l2(rows, rows[[pick]])[:, 0].clip(0))
    for _ in range(rounds):
        dist = kernels.l2(rows, c)
        at = dist.argmin(1)
        new = c.copy()
        for j in range(k):
            on = at == j
            new[j] = rows[on].mean(0) if on.any() else rows[dist.min(1).argmax()]
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return c


def train_sample(vectors: DataFrame, n: int) -> DataFrame:
    """About n vectors, all if there are fewer: those whose id's hash is in the lowest n / count-th, whatever the size of the base.

    A filter: nothing is sorted or gathered, so the sample is spread as the base is. Stored, since training reads it again and again.
    """
    count = vectors.count()
    if count > n:
        vectors = vectors.where(F.xxhash64("id", F.lit(5)) < F.lit(int(-(2**63) + 2**64 * n // count)).cast("bigint"))
    return search.spread(stored(vectors.select("id", "v"), "train"))


def train_words(rows: DataFrame, column: str, parts: int, ksub: int, seed: int) -> DataFrame:
    """(m, k, w): a codebook of the vectors of a sample, by k-means in numpy, one task for each part."""
    d = len(rows.first()[column])
    if d % parts:
        raise ValueError(f"{d} dimensions can't be cut in {parts} parts")
    each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("m"), F.col(column).alias("x")).select("m", V.subvector(F.col("x"), F.col("m"), d // parts).cast("array<double>").alias("x"))

    def words(table):
        import numpy as np
        import pyarrow as pa

        from vecloom.functions import kernels

        m, rows = table.column("m")[0].as_py(), kernels.matrix(table.column("x"))
        c = kmeans(rows[np.lexsort(rows.T[::-1])], ksub, seed + m)
        c = np.concatenate([c, np.repeat(c[-1:], ksub - len(c), 0)])
        return pa.table({"m": pa.array([m] * ksub, pa.int32()), "k": pa.array(range(ksub), pa.int32()), "w": pa.array(c.tolist(), pa.list_(pa.float64()))})

    return stored(each.groupBy("m").applyInArrow(words, "m int, k int, w array<double>"), "words")


def train(vectors: DataFrame, spec: IndexSpec | str, seed: int = 7) -> dict[str, DataFrame | None]:
    """centroids, codebook, fine and axes of an index, as the spec needs them: MLlib's k-means for the clusters, numpy's for the words."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spec = parse_index(spec) if isinstance(spec, str) else spec
    spark, out = vectors.sparkSession, dict.fromkeys(("centroids", "codebook", "fine", "axes"))
    sample = train_sample(vectors, TRAIN_PER_CENTROID * max(spec.nlist, spec.ksub if spec.m else 1, spec.axes))
    if spec.axes:
        out["axes"] = project.principal_axes(sample, spec.axes)
        sample = project.project(sample, out["axes"])
    if spec.nlist:
        model = KMeans(k=spec.nlist, seed=seed, maxIter=20, featuresCol="f").fit(sample.select(array_to_vector(F.col("v").cast("array<double>")).alias("f")))
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        out["centroids"] = spark.createDataFrame(rows, "cid bigint, c array<double>")
    if spec.m:
        base = coarse.residuals(coarse.assign(sample, out["centroids"]), out["centroids"]) if spec.nlist else sample.withColumn("r", F.col("v"))
        out["codebook"] = train_words(base, "r", spec.m, spec.ksub, seed)
        if spec.fine:
            rest = pq.remainders(pq.encode(base.select("id", "r"), out["codebook"]), out["codebook"])
            out["fine"] = train_words(rest, "rest", spec.fine, spec.ksub, seed)
    return out


def build(vectors: DataFrame, spec: IndexSpec | str, metric: str = "l2", seed: int = 7) -> Index:
    """Trains on a bounded sample and indexes every vector. Float vectors have float residuals and distances."""
    spec = parse_index(spec, metric) if isinstance(spec, str) else spec
    if spec.kind == "flat" and not spec.axes:
        return add(vectors, spec, None, None)
    return add(vectors, spec, **train(vectors, spec, seed))


def refined(index: Index, base: DataFrame, queries: DataFrame, params: SearchParams, factor: int = 10) -> DataFrame:
    """factor * k candidates by codes, then exact distances (metric ip: products) of these: (qid, rank, id, dist).

    The candidates are nq * factor * k rows; base vectors join them on id.
    """
    kind, ip = V.kind_of((base, "v"), (queries, "v")), index.spec.metric == "ip"
    found = index.search(queries, SearchParams(params.k * factor, params.nprobe)).select("qid", "id")
    q = queries.select("qid", F.col("v").alias("qv"))
    exact = base.select("id", "v").join(found, "id").join(q, "qid").select("qid", "id", (V.dot if ip else V.l2)(F.col("qv"), F.col("v"), kind).alias("dist"))
    return search.top_k(exact, params.k, ip)
