"""Nearest-neighbour search: data stays where it is, queries go to it, best lists are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.functions import vectors as V
from vecloom.operators.coarse import CELLS, load_centroids, probe
from vecloom.operators.pq import load_codebook, tables
from vecloom.session import BROADCAST_BYTES, checked, stored

#: Queries that go out in one broadcast. More are joined with the lists, or searched in further passes over a flat base.
QUERY_BLOCK = 32_768
#: Rows of a list, and probes of it, that meet in one task of a join.
LIST_ROWS = 1 << 15
PROBE_ROWS = 1 << 14
#: Rows that a task gathers by cluster before it scores them.
SCAN_ROWS = 1 << 18


def top_k(candidates: DataFrame, k: int, descending: bool = False, per: str = "qid") -> DataFrame:
    """(qid, rank, id, dist): the k best of each query by (dist, id), rank from 1. Spark limits each partition first (WindowGroupLimit).

    dist keeps its type: distances are ranked as they are, never rounded.
    """
    order = F.desc("dist") if descending else F.asc("dist")
    w = W.partitionBy(per).orderBy(order, F.asc("id"))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(per, F.col("rank").cast("bigint").alias("rank"), "id", "dist")


def query_blocks(queries: DataFrame, block: int | None = None):
    """The query set in blocks of (qids, matrix); a block stays under the broadcast bound whatever the dimension.

    Tasks pack their queries, so that few large records reach the driver, a partition at a time.
    """
    import numpy as np

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                v = np.ascontiguousarray(kernels.matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["qids", "v"])

    qids, v = np.zeros(0, np.int64), None
    for r in queries.select(F.col("qid").cast("bigint"), "v").mapInArrow(pack, "qids binary, v binary").toLocalIterator():
        more = np.frombuffer(r["qids"], np.int64)
        rows = np.frombuffer(r["v"], np.float64).reshape(len(more), -1)
        qids, v = np.concatenate([qids, more]), rows if v is None else np.concatenate([v, rows])
        most = max(1, min(block or QUERY_BLOCK, BROADCAST_BYTES // 2 // (8 * v.shape[1])))
        while len(qids) >= most:
            yield qids[:most], v[:most]
            qids, v = qids[most:], v[most:]
    if len(qids):
        yield qids, v


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster runs at once, if it has fewer: what a few files hold, next to many queries."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _union(parts: list[DataFrame], spark, kind: str = "bigint") -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"qid bigint, id bigint, dist {kind}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scores(best, q, book, metric: str, by_residual: bool, k: int, whole: bool):
    """A function (center, rows, x, ids) that adds the distances of queries `rows` and the vectors or codes x to best."""
    import numpy as np

    def score(center, rows, x, ids) -> None:
        own = q[rows]
        if book is not None:
            table = kernels.lut(own - center if metric == "l2" and by_residual else own, book, metric)
        step = max(k + 1, CELLS // len(rows))
        for a in range(0, len(x), step):
            part, exact, slack = x[a : a + step], None, 0.0
            if book is None:
                d = kernels.l2(own, part) if metric == "l2" else -(own @ part.T)
                if not whole:
                    exact, slack = (lambda row, at, part=part: kernels.scores(own[row], part[at], metric)), kernels.slack(own, part)
            else:
                d = np.zeros((len(rows), len(part)))
                for m in range(book.shape[0]):
                    d += table[:, m * book.shape[1] + part[:, m]]
                if metric == "ip":
                    d = -(d + (own @ center)[:, None] * by_residual)
            best.add(rows, np.rint(d, out=d) if whole else d, ids[a : a + step], exact, slack)

    return score


def _batch(qids, best, metric: str, whole: bool):
    """The best list of each query as an Arrow batch (qid, id, dist)."""
    import numpy as np
    import pyarrow as pa

    row, d, ids = best.table()
    d = d if metric == "l2" else -d
    return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids.astype(np.int64)), pa.array(d.astype(np.int64) if whole else d.astype(np.float64))], ["qid", "id", "dist"])


def flat_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact search of (id, v) for (qid, v): (qid, rank, id, dist). Each task keeps k per query; only these are shuffled.

    dist is a whole number where all vectors are, else a double. A query set of one block is a lazy plan. Of more
    blocks, each is a pass over the base, whose best lists are stored in the shared folder before the next block
    reaches the driver: one block at a time is broadcast, and then given up.
    """
    spark, kind = base.sparkSession, V.kind_of((base, "v"), (queries, "v"))
    whole, parts, blocks = kind == "bigint", [], query_blocks(queries)
    block, after = next(blocks, None), next(blocks, None)
    several = after is not None
    while block is not None:
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            import numpy as np

            qids, q = shared.value
            best, every = kernels.TopK(k, len(q)), np.arange(len(q))
            score = _scores(best, q, None, metric, False, k, whole)
            for b in batches:
                score(None, every, kernels.matrix(b.column(1)), b.column(0).to_numpy())
            yield _batch(qids, best, metric, whole)

        found = spread(base.select("id", "v")).mapInArrow(run, f"qid bigint, id bigint, dist {kind}")
        if several:
            found = stored(top_k(found, k, metric == "ip"), "best").drop("rank")
            shared.destroy()
        parts.append(found)
        block, after = after, next(blocks, None) if after is not None else None
    return top_k(_union(parts, spark, kind), k, metric == "ip")


def ivf_search(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, codebook: DataFrame | None = None, metric: str = "l2", by_residual: bool = True, code: str = "code") -> DataFrame:
    """Search of inverted lists: (cid, id, code) with a codebook, else (cid, id, v).

    The probes of one block of queries, grouped by cluster, are broadcast. A filter on the probed clusters reaches the
    scan: partitions of other clusters aren't read. Lists pass through in Arrow batches, which a task sorts by cluster,
    SCAN_ROWS at a time, so that tables are made once for all rows of a cluster; each task keeps k per query; only
    these are shuffled. Query sets of more than one block go through ivf_join. metric ip: dist is the product,
    greatest first. dist is a whole number where all vectors are, else a double.
    """
    import numpy as np

    spark, blocks = lists.sparkSession, query_blocks(queries)
    block = next(blocks, None)
    if block is not None and next(blocks, None) is not None:
        return ivf_join(lists, queries, centroids, k, nprobe, codebook, metric, by_residual, code)
    kind = _kind(lists, queries, centroids, codebook)
    if block is None:
        return top_k(_union([], spark, kind), k, metric == "ip")
    cids, c = load_centroids(centroids)
    book = load_codebook(codebook) if codebook is not None else None
    column, whole, (qids, q) = code if book is not None else "v", kind == "bigint", block
    near, _ = kernels.smallest(kernels.l2(q, c), nprobe)
    by: dict[int, list[int]] = {}
    for i, row in enumerate(near.tolist()):
        for j in row:
            by.setdefault(j, []).append(i)
    shared = spark.sparkContext.broadcast((qids, q, c, {int(cids[j]): (j, np.array(rows)) for j, rows in by.items()}, book))

    def run(batches):
        import numpy as np

        qids, q, c, by, book = shared.value
        best, kept, size = kernels.TopK(k, len(q)), [], 0
        score = _scores(best, q, book, metric, by_residual, k, whole)

        def scan():
            if not kept:
                return
            cid, ids, x = (np.concatenate(y) for y in zip(*kept))
            order = np.argsort(cid, kind="stable")
            cid, ids, x = cid[order], ids[order], x[order]
            edges = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1], [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if int(cid[lo]) not in by:
                    continue
                j, every = by[int(cid[lo])]
                some = max(1, CELLS // (book.shape[0] * book.shape[1])) if book is not None else len(every)
                for rows in (every[i : i + some] for i in range(0, len(every), some)):
                    score(c[j], rows, x[lo:hi], ids[lo:hi])

        for b in batches:
            kept.append((b.column(0).to_numpy(), b.column(1).to_numpy(), kernels.matrix(b.column(2), "int64" if book is not None else "float64")))
            size += b.num_rows
            if size >= SCAN_ROWS:
                scan()
                kept, size = [], 0
        scan()
        yield _batch(qids, best, metric, whole)

    probed = lists.where(F.col("cid").isin([int(cids[j]) for j in by])) if len(by) < len(cids) else lists
    found = spread(probed.select(F.col("cid").cast("bigint"), "id", column)).mapInArrow(run, f"qid bigint, id bigint, dist {kind}")
    return top_k(found, k, metric == "ip")


def _kind(lists: DataFrame, queries: DataFrame, centroids: DataFrame, codebook: DataFrame | None) -> str:
    return V.kind_of((queries, "v"), *([(centroids, "c"), (codebook, "w")] if codebook is not None else [(lists, "v")]))


def ivf_join(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, codebook: DataFrame | None = None, metric: str = "l2", by_residual: bool = True, code: str = "code") -> DataFrame:
    """ivf_search for query sets of any size: the same rows, with queries that never pass through the driver.

    Queries are probed where they are, and probes meet the rows of their cluster in one exchange by (cluster, part of the list, part
    of its probes). Clusters of more than LIST_ROWS rows or PROBE_ROWS probes have several parts, so a hot one spreads
    over tasks and none holds more than a part of each. Only sizes, one row a cluster, reach the driver. Flat lists are searched in
    spatial parts (near.join) for metric l2: distances from their boxes rule out most meetings, so that far fewer rows are exchanged.
    """
    if codebook is None and metric == "l2":
        from vecloom.operators import near

        return near.join(lists, queries, centroids, k, nprobe)
    spark, kind = lists.sparkSession, _kind(lists, queries, centroids, codebook)
    _, c = load_centroids(centroids)
    book = load_codebook(codebook) if codebook is not None else None
    shared = spark.sparkContext.broadcast(book)
    column, whole = code if book is not None else "v", kind == "bigint"
    probed = probe(queries.select(F.col("qid").cast("bigint").alias("qid"), "v"), centroids, nprobe, "qid").select("cid", "qid", "v")
    parts = lambda df, n, name: df.groupBy(F.col("cid").cast("bigint").alias("cid")).agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    grid = parts(lists, LIST_ROWS, "of_list").join(parts(probed, PROBE_ROWS, "of_probes"), "cid")
    grid = spark.createDataFrame(grid.toArrow()) if c.size else grid  # nlist rows at most
    checked(16 * len(c), "parts of clusters")

    def dealt(df, ident: str, own: str, other: str):
        mine = F.pmod(F.xxhash64(ident, F.lit(11)), F.col(own)).cast("int").alias(own)
        return df.join(F.broadcast(grid), "cid").select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    keys = ["cid", "of_list", "of_probes"]
    left = dealt(lists.select(F.col("cid").cast("bigint").alias("cid"), "id", F.col(column).alias("x")), "id", "of_list", "of_probes")
    right = dealt(probed, "qid", "of_probes", "of_list").join(F.broadcast(centroids.select(F.col("cid").cast("bigint").alias("cid"), "c")), "cid")

    def run(rows, queries):
        import numpy as np
        import pyarrow as pa

        if not rows.num_rows or not queries.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.int64() if whole else pa.float64())})
        book, q = shared.value, kernels.matrix(queries.column("v"))
        best, center = kernels.TopK(k, len(q)), kernels.matrix(queries.column("c").slice(0, 1))[0]
        score, ids = _scores(best, q, book, metric, by_residual, k, whole), rows.column("id").to_numpy()
        x, every = kernels.matrix(rows.column("x"), "int64" if book is not None else "float64"), np.arange(len(q))
        some = max(1, CELLS // (book.shape[0] * book.shape[1])) if book is not None else len(q)
        for i in range(0, len(q), some):
            score(center, every[i : i + some], x, ids)
        return pa.Table.from_batches([_batch(queries.column("qid").to_numpy(), best, metric, whole)])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"qid bigint, id bigint, dist {kind}")
    return top_k(found, k, metric == "ip")


def rescore(found: DataFrame, lists: DataFrame, queries: DataFrame, centroids: DataFrame, codebook: DataFrame, fine: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Candidates (qid, id) ranked by both levels of their codes: (qid, rank, id, dist).

    lists (cid, id, code, fine). A candidate's vector is its centroid, the words of its code and those of its fine code
    in sum; dist is its distance from the query (ip: product). Candidates meet their codes in a join on id, of which
    Spark broadcasts the candidates if they are few; centroids and codebooks are broadcast, their bytes checked.
    """
    spark, kind = lists.sparkSession, V.kind_of((queries, "v"), (centroids, "c"), (codebook, "w"), (fine, "w"))
    shared = spark.sparkContext.broadcast((*load_centroids(centroids), load_codebook(codebook), load_codebook(fine)))
    rows = lists.select(F.col("cid").cast("bigint").alias("cid"), "id", "code", "fine").join(found.select("qid", "id"), "id").join(queries.select("qid", "v"), "qid")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cids, c, book, more = shared.value
        for b in batches:
            if b.num_rows:
                x = c[np.searchsorted(cids, b.column(2).to_numpy())] + kernels.decode(kernels.matrix(b.column(3), "int64"), book) + kernels.decode(kernels.matrix(b.column(4), "int64"), more)
                d = kernels.scores(kernels.matrix(b.column(5)), x, metric)
                d = d if metric == "l2" else -d
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.rint(d).astype(np.int64) if kind == "bigint" else d)], ["qid", "id", "dist"])

    scored = rows.select(F.col("qid").cast("bigint").alias("qid"), "id", "cid", "code", "fine", "v").mapInArrow(run, f"qid bigint, id bigint, dist {kind}")
    return top_k(scored, k, metric == "ip")


def adc_scan(codes: DataFrame, probes: DataFrame, codebook: DataFrame, m: int, ksub: int, clip: int | None = None) -> DataFrame:
    """All candidates as DataFrame operations: probes (qid, cid, r) with tables, joined with codes (cid, id, code) on cid.

    (qid, id, dist). The same distances as ivf_search, which makes no row for a candidate; this is the form to filter or
    join further. Spark splits clusters that are hot in this join.
    """
    t = tables(probes.select("qid", "cid", "r"), codebook).select("qid", "cid", "lut")
    return codes.join(t, "cid").select("qid", "id", V.adc(F.col("lut"), F.col("code"), m, ksub, clip).alias("dist"))


def merge_top_k(parts: list[DataFrame], k: int) -> DataFrame:
    """Best lists of segments (qid, id, dist), united and cut to k."""
    return top_k(_union([p.select("qid", "id", "dist") for p in parts], parts[0].sparkSession), k)


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, rank, cid, d, r): probed clusters and query residuals."""
    from vecloom.operators.coarse import residuals

    return residuals(probe(queries, centroids, nprobe, "qid"), centroids).select("qid", "rank", "cid", "d", "r")
