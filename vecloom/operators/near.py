"""Exact search of flat inverted lists for query sets of any size, in spatial parts.

A cluster's list is cut along its widest axes, so that near vectors share a part; a part's box is what its rows span.
A query first meets the part it falls in, which bounds its k-th best distance, and then only those other parts of its
probed clusters whose boxes aren't farther away. What a box rules out can't be among the k best, so the rows are those
of a scan of all probed lists. No list row goes to more than one task of a round, unless its part has very many queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.functions import vectors as V
from vecloom.operators import search
from vecloom.operators.coarse import CELLS, load_centroids
from vecloom.session import checked, stored

#: Sampled rows for each part, and bytes of a sample, at most: where the cuts of the lists are.
SAMPLED, SAMPLE_BYTES = 512, 64 << 20
#: Rows of a block, the least that a task compares a query with or leaves out by its box.
BLOCK_ROWS = 256
#: Bytes of a row group of stored lists: a scan has a whole one in memory.
ROW_GROUP = 16 << 20
#: Boxes are ruled out with this much to spare, far more than sums of floats are off by.
SPARE = 1 - 1e-9

_PART = "part int, copy int, ids binary, x binary"


# --- Arrays in rows ------------------------------------------------------------------------------------------------


def pack(x) -> bytes:
    """An array in the least type that holds its values; of whole numbers all first bytes before all second ones."""
    import numpy as np

    if x.dtype.kind == "f":
        with np.errstate(over="ignore"):
            short = x.astype("<f4")
        return b"f4" + short.tobytes() if (short == x).all() else b"f8" + x.astype("<f8").tobytes()
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    size = next(n for n in (1, 2, 4, 8) if -(1 << (8 * n - 1)) <= lo and hi < 1 << (8 * n - 1))
    return f"i{size}".encode() + np.ascontiguousarray(x.ravel().astype(f"<i{size}")).view(np.uint8).reshape(-1, size).T.tobytes()


def unpack(b: bytes, dtype):
    import numpy as np

    size = int(b[1:2])
    raw = np.frombuffer(b, np.uint8, offset=2)
    if b[:1] == b"f":
        return raw.view(f"<f{size}").astype(dtype)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(f"<i{size}").ravel().astype(dtype)


def _packed_vectors(x, whole: bool) -> bytes:
    import numpy as np

    return pack(np.ascontiguousarray(x.T).astype(np.int64) if whole else np.ascontiguousarray(x.T))


def _vectors(b: bytes, n: int):
    import numpy as np

    return np.ascontiguousarray(unpack(b, np.float64).reshape(-1, n).T)


def _gathered(table, column: str = "ids"):
    """(ids, vectors) of the packed rows of a group."""
    import numpy as np

    ids = [unpack(b.as_py(), np.int64) for b in table.column(column)]
    x = [_vectors(b.as_py(), len(i)) for b, i in zip(table.column("x"), ids)]
    return (np.concatenate(ids), np.concatenate(x)) if ids else (np.zeros(0, np.int64), None)


# --- Cuts ----------------------------------------------------------------------------------------------------------


class Cuts:
    """A binary tree for each cluster; its leaves are numbered cluster by cluster. x[axis] <= cut goes to the left."""

    def __init__(self, cids, at, x, most: float):
        """at: the cluster's place in cids of each sampled vector x; most: sampled rows of a leaf."""
        import numpy as np

        self.cids, self.first, node, depth = cids, [], [], [0]

        def grow(rows, level: int) -> int:
            me = len(node)
            node.append([-1, 0.0, 0, 0, 0])
            depth[0] = max(depth[0], level)
            part = x[rows]
            wide = np.ptp(part, axis=0) if len(rows) > most else np.zeros(1)
            if not wide.max() > 0:
                node[me][4] = self.leaves
                self.leaves += 1
                return me
            value = part[:, axis := int(wide.argmax())]
            cut = np.partition(value, (len(value) - 1) // 2)[(len(value) - 1) // 2]
            cut = cut if cut < value.max() else value[value < cut].max()
            left = value <= cut
            node[me][:4] = axis, float(cut), grow(rows[left], level + 1), grow(rows[~left], level + 1)
            return me

        self.leaves, self.roots, order = 0, [], np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(len(cids) + 1))
        for j in range(len(cids)):
            self.first.append(self.leaves)
            self.roots.append(grow(order[edges[j] : edges[j + 1]], 0))
        self.first.append(self.leaves)
        self.first, self.roots, self.depth = np.array(self.first), np.array(self.roots), depth[0]
        self.axis, self.cut, self.left, self.right, self.leaf = (np.array(c) for c in zip(*node))

    def route(self, at, x):
        """The leaf of each vector of x in the cluster at its place."""
        import numpy as np

        node, every = self.roots[at], np.arange(len(x))
        for _ in range(self.depth):
            axis = self.axis[node]
            node = np.where(axis < 0, node, np.where(x[every, axis] <= self.cut[node], self.left[node], self.right[node]))
        return self.leaf[node]


class Parts:
    """Cuts with the boxes and sizes of all leaves. A leaf of far more rows than LIST_ROWS is several parts, by hash of the id."""

    def __init__(self, cuts: Cuts, leaf, n, lo, hi, most: int):
        import numpy as np

        self.cuts, self.n = cuts, np.zeros(cuts.leaves, np.int64)
        self.n[leaf] = n
        self.subs = -(-self.n // (2 * most))  # none without rows
        self.start = np.concatenate([[0], np.cumsum(self.subs)])
        of = np.repeat(np.arange(cuts.leaves), self.subs)
        place = np.zeros(cuts.leaves, np.int64)
        place[leaf] = np.arange(len(leaf))
        self.lo, self.hi = lo[place[of]], hi[place[of]]
        self.of_cluster = self.start[cuts.first]  # parts of cluster j: of_cluster[j] to of_cluster[j + 1]

    def of_rows(self, at, x, ids):
        import numpy as np

        leaf = self.cuts.route(at, x)
        return self.start[leaf] + (_mixed(ids) % np.maximum(self.subs[leaf], 1).astype(np.uint64)).astype(np.int64)

    def home(self, near, q, k: int):
        """The first part to search for each query: where it falls in the nearest cluster that has k rows there, else any row; -1 for none."""
        import numpy as np

        out, enough = np.full(len(q), -1), np.zeros(len(q), bool)
        for r in range(near.shape[1]):
            leaf = self.cuts.route(near[:, r], q)
            n = self.n[leaf] // np.maximum(self.subs[leaf], 1)
            better = ~enough & ((n >= k) | ((out < 0) & (n > 0)))
            out[better] = self.start[leaf[better]]
            enough |= n >= k
        for i in np.flatnonzero(out < 0):  # it falls where no row is, in all clusters
            some = [p for j in near[i] for p in range(self.of_cluster[j], self.of_cluster[j + 1])]
            if some:
                out[i] = some[int(box(q[i : i + 1], self.lo[some], self.hi[some])[0].argmin())]
        return out

    def others(self, near, q, bound, own):
        """(query, part): parts of probed clusters, but for the query's own, that aren't farther away than its bound."""
        import numpy as np

        found = []
        for j in np.unique(near):
            lo, hi = self.of_cluster[j], self.of_cluster[j + 1]
            if lo == hi:
                continue
            rows, step = np.flatnonzero((near == j).any(1)), max(1, CELLS // 4 // (hi - lo))
            for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                keep = ~(box(q[some], self.lo[lo:hi], self.hi[lo:hi]) * SPARE > bound[some][:, None])
                row, part = np.nonzero(keep)
                row, part = some[row], part + lo
                apart = part != own[row]
                found.append((row[apart], part[apart]))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def box(q, lo, hi):
    """Squared distances of all q from all boxes; 0 inside."""
    import numpy as np

    out = np.zeros((len(q), len(lo)))
    for i in range(q.shape[1]):
        x = q[:, i : i + 1]
        out += np.maximum(np.maximum(lo[:, i] - x, x - hi[:, i]), 0) ** 2
    return out


# --- Search of one part --------------------------------------------------------------------------------------------


def distinct(ids, x, k: int):
    """Rows without those that have k rows of the same vector and lower ids, which no list of k best has."""
    import numpy as np

    odd = np.random.default_rng(5).integers(1, 1 << 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(x).view(np.uint64)
    key = (((bits ^ (bits >> np.uint64(32))) * odd) ^ (bits * odd >> np.uint64(29))).sum(1, dtype=np.uint64)
    order = np.lexsort((ids, key))
    same = (key[order][1:] == key[order][:-1]) & (x[order][1:] == x[order][:-1]).all(1)
    kept = np.sort(order[kernels.first_of_each(np.concatenate([[0], np.cumsum(~same)]), k)])
    return ids[kept], x[kept]


def blocks(x, size: int):
    """(order, edges) of blocks of at most `size` rows, halved along their widest axes."""
    import numpy as np

    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part, half = x[rows], len(rows) // 2
        p = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)
        todo += [rows[p[half:]], rows[p[:half]]]
    return np.concatenate(out), np.cumsum([0, *map(len, out)])


def nearest(ids, x, q, k: int, whole: bool, bound=None):
    """The k best of the rows (ids, x) for each of q, without what is farther away than its bound."""
    import numpy as np

    best = kernels.TopK(k, len(q))
    if bound is not None:
        best.limit = bound.copy()
    if not len(ids) or not len(q):
        return best
    ids, x = distinct(ids, x, k)
    order, edges = blocks(x, max(BLOCK_ROWS, 4 * k))
    ids, x = ids[order], x[order]
    lo, hi = np.minimum.reduceat(x, edges[:-1]), np.maximum.reduceat(x, edges[:-1])
    score, step = search._scores(best, q, None, "l2", False, k, whole), max(1, CELLS // len(lo))
    for s in range(0, len(q), step):
        far = box(q[s : s + step], lo, hi) * SPARE
        first = far.argmin(1)
        first[far[np.arange(len(far)), first] > best.limit[s : s + step]] = -1
        for own in (True, False):
            for b in range(len(lo)):
                rows = np.flatnonzero(first == b if own else (first != b) & (first >= 0) & ~(far[:, b] > best.limit[s : s + step]))
                if len(rows):
                    score(None, rows + s, x[edges[b] : edges[b + 1]], ids[edges[b] : edges[b + 1]])
    return best


# --- Rounds --------------------------------------------------------------------------------------------------------


def _mixed(ids):
    """A hash of each id, of 31 bits."""
    import numpy as np

    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _runs(key):
    """Edges of the runs of equal keys."""
    import numpy as np

    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)


def _rows(rows, names: str, types):
    """Arrow batches of tuples, 1000 in each."""
    import pyarrow as pa

    for i in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), types)], names.split())


def _each(batch):
    """The rows of a batch one at a time."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def _held(lists: DataFrame, cids, whole: bool, k: int) -> tuple[DataFrame, int]:
    """The lists of clusters cids, packed and stored once: (cid, ids, x), and a sampled row of `every` in (n_some, some).

    Of equal vectors that a task gathers, those with the k lowest ids stay: no best list has another.
    """
    every, scan = max(1, search.LIST_ROWS // SAMPLED), search.SCAN_ROWS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def flushed(kept):
            cid, ids, x = (np.concatenate(c) for c in zip(*kept))
            order = np.argsort(cid, kind="stable")
            cid, ids, x = cid[order], ids[order], x[order]
            edges, rows = _runs(cid), []
            for a, b in zip(edges[:-1], edges[1:]):
                i, v = distinct(ids[a:b], x[a:b], k)
                on = _mixed(i) % np.uint64(every) == 0
                rows.append((int(cid[a]), pack(i), _packed_vectors(v, whole), int(on.sum()), _packed_vectors(v[on], whole)))
            return _rows(rows, "cid ids x n_some some", (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()))

        kept, size = [], 0
        for b in batches:
            cid = b.column(0).to_numpy()
            there = np.isin(cid, cids)
            if there.any():
                kept.append((cid[there], b.column(1).to_numpy()[there].astype(np.int64), kernels.matrix(b.column(2))[there]))
                size += int(there.sum())
            if size >= scan:
                yield from flushed(kept)
                kept, size = [], 0
        if size:
            yield from flushed(kept)

    return stored(lists.select(F.col("cid").cast("bigint"), "id", "v").mapInArrow(run, "cid bigint, ids binary, x binary, n_some bigint, some binary"), "lists", **{"parquet.block.size": ROW_GROUP}), every


def _cut(held: DataFrame, every: int, cids, d: int) -> Cuts:
    """Where the sample cuts the lists; a sample of more than SAMPLE_BYTES is thinned evenly."""
    import numpy as np

    n, most = held.agg(F.sum("n_some")).first()[0] or 0, max(1, SAMPLE_BYTES // (8 * d))
    share = max(1, -(-n // most))

    def thin(batches):
        import pyarrow as pa

        for b in batches:
            for cid, m, some in _each(b):
                x = _vectors(some, m)[(len(some) + cid) % share :: share]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([cid], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([pack(x.T)], pa.binary())], ["cid", "n_some", "some"])

    got = held.select("cid", "n_some", "some").where("n_some > 0").mapInArrow(thin, "cid bigint, n_some bigint, some binary").toArrow()
    size = got.column("n_some").to_numpy()
    x = np.concatenate([np.zeros((0, d)), *(_vectors(b.as_py(), m) for b, m in zip(got.column("some"), size))])
    return Cuts(cids, np.repeat(np.searchsorted(cids, got.column("cid").to_numpy()), size), x, max(1, search.LIST_ROWS / (every * share)))


def _measured(held: DataFrame, cuts: Cuts, d: int) -> Parts:
    """Rows and box of each leaf."""
    shared = held.sparkSession.sparkContext.broadcast(cuts)
    checked(16 * d * cuts.leaves, "boxes of the lists")

    def batch(leaf, n, lo, hi):
        import numpy as np
        import pyarrow as pa

        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, d, dtype=np.int32)), pa.array(m.ravel()))
        return [pa.array(leaf.astype(np.int32)), pa.array(n.astype(np.int64)), lists(lo), lists(hi)]

    def own(batches):
        import numpy as np
        import pyarrow as pa

        cuts = shared.value
        n, lo, hi = np.zeros(cuts.leaves, np.int64), np.full((cuts.leaves, d), np.inf), np.full((cuts.leaves, d), -np.inf)
        for b in batches:
            for cid, ids, x in _each(b):
                x = _vectors(x, len(unpack(ids, np.int64)))
                leaf = cuts.route(np.full(len(x), np.searchsorted(cuts.cids, cid)), x)
                order = np.argsort(leaf, kind="stable")
                leaf, x = leaf[order], x[order]
                edges = _runs(leaf)
                has = leaf[edges[:-1]]
                n[has] += np.diff(edges)
                lo[has], hi[has] = np.minimum(lo[has], np.minimum.reduceat(x, edges[:-1])), np.maximum(hi[has], np.maximum.reduceat(x, edges[:-1]))
        has = np.flatnonzero(n)
        for i in range(0, len(has), 4096):
            at = has[i : i + 4096]
            yield pa.RecordBatch.from_arrays(batch(at, n[at], lo[at], hi[at]), ["leaf", "n", "lo", "hi"])

    def united(table):
        import numpy as np
        import pyarrow as pa

        lo, hi = kernels.matrix(table.column("lo")).min(0)[None], kernels.matrix(table.column("hi")).max(0)[None]
        return pa.Table.from_arrays(batch(table.column("leaf").to_numpy()[:1], np.array([table.column("n").to_numpy().sum()]), lo, hi), ["leaf", "n", "lo", "hi"])

    schema = "leaf int, n bigint, lo array<double>, hi array<double>"
    got = held.select("cid", "ids", "x").mapInArrow(own, schema).groupBy("leaf").applyInArrow(united, schema).toArrow()
    wide = lambda c: kernels.matrix(got.column(c)).reshape(-1, d)
    return Parts(cuts, got.column("leaf").to_numpy(), got.column("n").to_numpy(), wide("lo"), wide("hi"), search.LIST_ROWS)


def _dealt(held: DataFrame, shared, copies, whole: bool) -> DataFrame:
    """The rows of the parts that have queries, packed by part: a row for each part of SCAN_ROWS list rows, and each copy."""
    most, scan = held.sparkSession.sparkContext.broadcast(copies), search.SCAN_ROWS

    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts, copies = shared.value[0], most.value

        def flushed(kept):
            part, ids, x = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((ids, part))
            part, ids, x = part[order], ids[order], x[order]
            edges = _runs(part)
            for a, b in zip(edges[:-1], edges[1:]):
                packed = pack(ids[a:b]), _packed_vectors(x[a:b], whole)
                for copy in range(copies[part[a]]):
                    yield int(part[a]), copy, *packed

        kept, size = [], 0
        for b in batches:
            for cid, ids, x in _each(b):
                ids = unpack(ids, np.int64)
                x = _vectors(x, len(ids))
                part = parts.of_rows(np.full(len(x), np.searchsorted(parts.cuts.cids, cid)), x, ids)
                on = copies[part] > 0
                kept.append((part[on], ids[on], x[on]))
                size += int(on.sum())
                if size >= scan:
                    yield from _rows(list(flushed(kept)), "part copy ids x", (pa.int32(), pa.int32(), pa.binary(), pa.binary()))
                    kept, size = [], 0
        if size:
            yield from _rows(list(flushed(kept)), "part copy ids x", (pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    return held.select("cid", "ids", "x").mapInArrow(run, _PART)


def _packed_queries(part, qids, q, bound, whole: bool, most: int):
    """Rows (part, n, ids, x, dist) of queries by part, `most` at most in one."""
    import numpy as np

    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = _runs(part)
    for a, b in zip(edges[:-1], edges[1:]):
        for s in range(a, b, most):
            rows = order[s : min(b, s + most)]
            yield int(part[a]), len(rows), pack(qids[rows]), _packed_vectors(q[rows], whole), pack(bound[rows])


def _met(held: DataFrame, queries: DataFrame, shared, run, schema: str, n_parts: int, whole: bool) -> DataFrame:
    """Packed queries (part, n, ids, x, ..) and the rows of their parts in one task each; very many queries of a part in several."""
    import numpy as np
    import pyarrow as pa

    spark = held.sparkSession
    sizes = queries.groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    copies = np.zeros(n_parts, np.int32)
    copies[sizes.column("part").to_numpy()] = -(-sizes.column("n").to_numpy() // search.PROBE_ROWS)
    has = np.flatnonzero(copies)
    grid = spark.createDataFrame(pa.table({"part": pa.array(has.astype(np.int32)), "copies": pa.array(copies[has])}))
    right = queries.join(F.broadcast(grid), "part").withColumn("copy", F.pmod(F.xxhash64("ids", F.lit(11)), "copies").cast("int")).drop("copies")
    left = _dealt(held, shared, copies, whole)
    return left.groupBy("part", "copy").cogroup(right.groupBy("part", "copy")).applyInArrow(run, schema)


def join(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """The k nearest (qid, rank, id, dist) in the lists (cid, id, v) of the nprobe nearest clusters of each query (qid, v).

    The lists are computed once and stored packed. What reads them finds the boxes and then makes two rounds, each of
    which exchanges them by part. The best lists of the first round are stored, with the parts that queries have yet to
    meet. The driver gets the sample and the boxes, whose bytes are bounded and checked.
    """
    import pyarrow as pa

    spark, kind = lists.sparkSession, V.kind_of((queries, "v"), (lists, "v"))
    whole, most = kind == "bigint", max(1, search.PROBE_ROWS // 4)
    cids, c = load_centroids(centroids)
    empty = spark.createDataFrame([], f"qid bigint, id bigint, dist {kind}")
    if not len(cids):
        return search.top_k(empty, k)
    held, every = _held(lists, cids, whole, k)
    parts = _measured(held, _cut(held, every, cids, c.shape[1]), c.shape[1])
    n_parts = int(parts.start[-1])
    if not n_parts:
        return search.top_k(empty, k)
    shared = spark.sparkContext.broadcast((parts, c))
    scan = search.SCAN_ROWS

    def near(q, c):
        return kernels.smallest(kernels.l2(q, c), nprobe)[0]

    def first(batches):
        import numpy as np
        import pyarrow as pa

        (parts, c), kept, size = shared.value, [], 0

        def flushed():
            qids, q = (np.concatenate(x) for x in zip(*kept))
            step = max(1, CELLS // len(c))
            home = np.concatenate([parts.home(near(q[s : s + step], c), q[s : s + step], k) for s in range(0, len(q), step)])
            on = home >= 0
            rows = [r[:4] for r in _packed_queries(home[on], qids[on], q[on], np.zeros(int(on.sum()), np.int64), whole, most)]
            yield from _rows(rows, "part n ids x", (pa.int32(), pa.int64(), pa.binary(), pa.binary()))

        for b in batches:
            if b.num_rows:
                kept.append((b.column(0).to_numpy(), kernels.matrix(b.column(1))))
                size += b.num_rows
            if size >= scan:
                yield from flushed()
                kept, size = [], 0
        if size:
            yield from flushed()

    def best_there(rows, queries):
        """Best lists (part -1, n, ids of queries, their rows, ids found, distances), and queries for other parts."""
        import numpy as np
        import pyarrow as pa

        parts, c = shared.value
        qids, q = _gathered(queries)
        if not len(qids):
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        ids, x = _gathered(rows)
        row, dist, found = nearest(ids, x, q, k, whole).table()
        bound = np.full(len(q), np.inf)
        last = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) + k - 1 if len(row) >= k else np.zeros(0, np.int64)
        bound[row[last]] = dist[last]
        out, step = [(-1, len(q), pack(qids), pack(found), pack(dist.astype(np.int64) if whole else dist), pack(row))], max(1, CELLS // len(c))
        own = np.full(len(q), queries.column("part")[0].as_py())
        for s in range(0, len(q), step):
            e = s + step
            at, part = parts.others(near(q[s:e], c), q[s:e], bound[s:e], own[s:e])
            out += [(*r, None) for r in _packed_queries(part, qids[s:e][at], q[s:e][at], bound[s:e][at], whole, most)]
        return pa.table({n: pa.array(col, t) for n, t, col in zip(names, types, zip(*out))})

    def unpacked(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for qids, ids, dist, row in _each(b):
                row = unpack(row, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unpack(qids, np.int64)[row]), pa.array(unpack(ids, np.int64)), pa.array(unpack(dist, np.int64 if whole else np.float64))], ["qid", "id", "dist"])

    def rest(rows, queries):
        import numpy as np
        import pyarrow as pa

        qids, q = _gathered(queries)
        ids, x = _gathered(rows)
        bound = np.concatenate([unpack(b.as_py(), np.float64) for b in queries.column("dist")]) if len(qids) else np.zeros(0)
        return pa.Table.from_batches([search._batch(qids, nearest(ids, x, q, k, whole, bound) if len(qids) else kernels.TopK(k, 0), "l2", whole)])

    names, types = ("part", "n", "ids", "x", "dist", "row"), (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    homes = stored(queries.select(F.col("qid").cast("bigint"), "v").mapInArrow(first, "part int, n bigint, ids binary, x binary"), "queries")
    once = stored(_met(held, homes, shared, best_there, "part int, n bigint, ids binary, x binary, dist binary, row binary", n_parts, whole), "best")
    found = once.where("part < 0").select("ids", "x", "dist", "row").mapInArrow(unpacked, f"qid bigint, id bigint, dist {kind}")
    more = _met(held, once.where("part >= 0").drop("row"), shared, rest, f"qid bigint, id bigint, dist {kind}", n_parts, whole)
    return search.top_k(found.unionByName(more), k)
