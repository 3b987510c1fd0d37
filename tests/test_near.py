"""Flat lists searched in spatial parts: the rows of a scan of all probed lists."""

import numpy as np
import pytest
from oracle import compare, connect

from vecloom.operators import near, search
from vecloom.params import IndexSpec, SearchParams
from vecloom.plans.index import add
from vecloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def frame(spark, ids, x, name="id"):
    whole = x.dtype.kind == "i"
    return spark.createDataFrame([(int(i), r) for i, r in zip(ids, x.tolist())], f"{name} bigint, v array<{'int' if whole else 'double'}>")


def index(spark, ids, x, nlist):
    starts = frame(spark, range(nlist), x[:nlist], "cid").withColumnRenamed("v", "c")
    return add(frame(spark, ids, x), IndexSpec(nlist), starts, None)


def scanned(ids, x, qids, q, nlist, k, nprobe):
    """The same by hand."""
    between = lambda a, b: ((a[:, None].astype(np.float64) - b[None]) ** 2).sum(2)
    cid, out = between(x, x[:nlist]).argmin(1), []
    for i, v in zip(qids, q):
        probed = np.argsort(between(v[None], x[:nlist])[0], kind="stable")[:nprobe]
        d = np.where(np.isin(cid, probed), ((x - v).astype(np.float64) ** 2).sum(1), np.inf)
        best = [j for j in np.lexsort((ids, d))[:k] if d[j] < np.inf]
        out += [(int(i), r + 1, int(ids[j]), d[j]) for r, j in enumerate(best)]
    return sorted(out)


def small(monkeypatch, **more):
    for name, n in ({"QUERY_BLOCK": 7, "LIST_ROWS": 64, "PROBE_ROWS": 16, "SCAN_ROWS": 500} | more).items():
        monkeypatch.setattr(search, name, n)
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)


def points(kind):
    rng = np.random.default_rng(4)
    x = rng.integers(-30, 30, (3000, 3)) * [1, 4, 9]
    if kind == "few":
        x = x // 40
    if kind == "copies":
        x[np.arange(3000) % 3 > 0] = x[17]
    return rng.permutation(90_000)[:3000] - 30_000, x if kind != "floats" else x + rng.normal(size=x.shape) / 7


@pytest.mark.parametrize("kind", ["apart", "few", "copies", "floats"])
@pytest.mark.parametrize("k, nprobe", [(10, 1), (10, 4), (3, 20), (200, 2)])
def test_parts_give_the_rows_of_a_scan(spark, monkeypatch, kind, k, nprobe):
    small(monkeypatch)
    ids, x = points(kind)
    qids, q = np.arange(150), x[np.arange(150) * 7 + 1] + (np.arange(150) % 3)[:, None]
    got = sorted(tuple(r) for r in index(spark, ids, x, 20).search(frame(spark, qids, q, "qid"), SearchParams(k, nprobe)).collect())
    want = scanned(ids, x, qids, q, 20, k, nprobe)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


@pytest.mark.parametrize("kind", ["apart", "copies"])
def test_few_candidates_are_exchanged(spark, monkeypatch, kind):
    """Not k of each probed part of a list: little more than the result."""
    small(monkeypatch)
    ids, x = points(kind)
    ix, seen = index(spark, ids, x, 20), []
    queries = frame(spark, range(100), x[np.arange(100) * 7 + 1], "qid")
    monkeypatch.setattr(search, "top_k", lambda found, k, descending=False, per="qid", f=search.top_k: (seen.append(found), f(found, k, descending, per))[1])
    assert ix.search(queries, SearchParams(10, 8)).count() == 1000
    assert 1000 <= seen[-1].count() < 2500


def test_equal_queries_and_equal_rows_spread(spark, monkeypatch):
    """One vector with most rows and most queries has several copies of its part, and none of its rows is lost."""
    small(monkeypatch, SCAN_ROWS=40)
    ids, x = points("copies")
    q = np.repeat(x[17:18], 90, 0)
    got = sorted(tuple(r) for r in index(spark, ids, x, 5).search(frame(spark, range(90), q, "qid"), SearchParams(10, 2)).collect())
    lowest = np.sort(ids[(x == x[17]).all(1)])[:10]
    assert got == [(i, r + 1, int(j), 0) for i in range(90) for r, j in enumerate(lowest)]


def test_lists_without_rows(spark, monkeypatch):
    small(monkeypatch)
    ids, x = points("apart")
    ix, queries = index(spark, ids, x, 5), frame(spark, range(30), x[:30], "qid")
    assert not search.ivf_join(ix.lists.where("id is null"), queries, ix.centroids, 10, 3).count()
    assert not search.ivf_join(ix.lists, queries.where("qid < 0"), ix.centroids, 10, 3).count()
    assert not search.ivf_join(ix.lists, queries, ix.centroids.where("cid < 0"), 10, 3).count()
    few = search.ivf_join(ix.lists.where(f"id = {ids[9]}"), queries, ix.centroids, 10, 5)
    assert few.count() == 30


def test_lineitem_of_many_blocks_is_the_same_as_sql(spark, monkeypatch):
    small(monkeypatch, QUERY_BLOCK=500, LIST_ROWS=2048, PROBE_ROWS=300, SCAN_ROWS=10_000)
    assert compare(spark, SF, QUERIES["lineitem_search"], ORACLE_SQL["lineitem_search"], connect(SF)) == 30_520


@pytest.mark.parametrize("x", [[0, 1, -1], [], [127, -128], [128, 5], [2**40, -3], [-(2**63), 2**63 - 1], [0.5, 2.0], [1e300, 0.1], [float("inf"), 3.0]])
def test_packed_arrays_are_the_same(x):
    x = np.array(x, np.float64 if any(isinstance(y, float) for y in x) else np.int64)
    got = near.unpack(near.pack(x), x.dtype)
    assert got.dtype == x.dtype and (got == x).all() and len(got) == len(x)
