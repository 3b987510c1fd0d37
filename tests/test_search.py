import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.functions import vectors as V
from vecloom.operators import coarse, cooc, evaluate, placement, pq, search
from vecloom.params import IndexSpec, SearchParams
from vecloom.plans.index import Index, add, build, refined, rule_index


def frame(spark, v, name="id"):
    return spark.createDataFrame([(i, [int(x) for x in r]) for i, r in enumerate(v)], f"{name} bigint, v array<int>")


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], r["dist"]) for r in df.collect())


def brute(v, q, k):
    out = []
    for i, x in enumerate(q):
        d = ((v - x) ** 2).sum(1)
        out += [(i, n + 1, int(j), int(d[j])) for n, j in enumerate(np.lexsort((np.arange(len(v)), d))[:k])]
    return out


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    centers = rng.integers(-500, 500, (20, 16))
    v = centers[rng.integers(0, 20, 3000)] + rng.integers(-30, 31, (3000, 16))
    return v, v[rng.choice(3000, 40, False)] + rng.integers(-5, 6, (40, 16))


def test_flat_is_exact_with_ties_and_hits(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 3, (300, 3))  # many equal vectors
    q = v[:7]
    got = rows(search.flat_knn(frame(spark, v), frame(spark, q, "qid"), 12))
    assert got == brute(v, q, 12) and got[0][3] == 0


def test_query_blocks_are_united(spark, monkeypatch):
    v = np.random.default_rng(3).integers(-9, 9, (200, 4))
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search.query_blocks, "__defaults__", (3,))
    assert rows(search.flat_knn(frame(spark, v), frame(spark, v[:10], "qid"), 5)) == brute(v, v[:10], 5)


def test_all_probes_of_flat_lists_are_exact(spark, blobs):
    v, q = blobs
    base, queries = frame(spark, v), frame(spark, q, "qid")
    centroids = frame(spark, v[:30]).select(F.col("id").alias("cid"), F.col("v").alias("c"))
    ix = add(base, IndexSpec(30), centroids, None)
    assert rows(ix.search(queries, "nprobe=30,k=10")) == brute(v, q, 10)
    hits = [sum(r[2] == t[2] for r, t in zip(rows(ix.search(queries, f"nprobe={n},k=1")), brute(v, q, 1))) for n in (1, 4, 30)]
    assert hits == sorted(hits) and hits[-1] == len(q)


def test_fewer_candidates_than_k_and_empty_sets(spark):
    v = np.array([[0, 0], [100, 100], [101, 100]])
    centroids = frame(spark, v[:2]).select(F.col("id").alias("cid"), F.col("v").alias("c"))
    ix = add(frame(spark, v), IndexSpec(2), centroids, None)
    assert rows(ix.search(frame(spark, v[:1], "qid"), SearchParams(10, 1))) == [(0, 1, 0, 0)]
    none = spark.createDataFrame([], "qid bigint, v array<int>")
    assert rows(ix.search(none, SearchParams())) == []
    empty = spark.createDataFrame([], "id bigint, v array<int>")
    assert rows(search.flat_knn(empty, frame(spark, v[:1], "qid"), 3)) == []


def test_kernel_and_plan_agree(spark, blobs):
    v, q = blobs
    base, queries = frame(spark, v), frame(spark, q, "qid")
    ix = rule_index(base, 16, 4, 16)
    fast = rows(ix.search(queries, SearchParams(10, 5)))
    plan = search.adc_scan(ix.lists, search.probes(queries, ix.centroids, 5), ix.codebook, 4, 16)
    assert fast == rows(search.top_k(plan, 10))


def test_saved_index_reads_probed_clusters_only(spark, tmp_path, blobs):
    v, q = blobs
    base, queries = frame(spark, v), frame(spark, q[:2], "qid")
    ix = rule_index(base, 16, 4, 16)
    ix.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    found = again.search(queries, SearchParams(10, 2))
    assert rows(found) == rows(ix.search(queries, SearchParams(10, 2)))
    assert "PartitionFilters: [isnotnull" in (plan := found._jdf.queryExecution().toString()) or "PartitionFilters: [cast(cid" in plan or "cid#" in plan.split("PartitionFilters")[1][:60]
    assert again.spec == ix.spec


def test_trained_recall(spark, blobs):
    v, q = blobs
    base, queries = frame(spark, v), frame(spark, q, "qid")
    truth = search.flat_knn(base, queries, 10)
    ix = build(base, "IVF16,PQ8x5")
    assert evaluate.overlap(ix.search(queries, SearchParams(10, 4)), truth, 10).first()[0] > 0.4
    assert evaluate.overlap(refined(ix, base, queries, SearchParams(10, 8), 10), truth, 10).first()[0] >= 0.9


def test_recombined_codes_are_lossless(spark, blobs):
    v, q = blobs
    ix = rule_index(frame(spark, v[:400]), 8, 4, 16)
    tables = pq.tables(search.probes(frame(spark, q[:5], "qid"), ix.centroids, 3), ix.codebook).select("qid", "cid", "lut")
    want = sorted(map(tuple, search.adc_scan(ix.lists, search.probes(frame(spark, q[:5], "qid"), ix.centroids, 3), ix.codebook, 4, 16).collect()))
    for lines in (cooc.modal_lines(ix.lists), cooc.mine_lines(ix.lists)):
        e = cooc.encode(ix.lists, lines, 4, 16)
        hit = cooc.hit_rate(e).first()
        assert hit["n_hit"] > 0 and hit["n_adds"] < 4 * hit["n_vectors"]
        assert sorted(map(tuple, cooc.scan(e, tables, cooc.line_sums(tables, lines, 16), 4, 16).collect())) == want


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.999, -1.999, 0.5, -300.0],)], "v array<double>")
    q = V.quantize(F.col("v"), 1.0)
    assert df.select(q.alias("x")).first()["x"] == [1, -1, 0, -300]
    assert df.select(V.wrap_int8(q).alias("x")).first()["x"] == [1, -1, 0, -44]
    assert df.select(V.clamp_int8(q).alias("x")).first()["x"] == [1, -1, 0, -128]
    assert df.select(V.l2(q, q).alias("a"), V.dot(q, q).alias("b")).first() == (0, 90002)
    item = V.pack_item(F.lit(3), F.lit(200))
    assert df.select(item.alias("p"), *(x.alias(n) for x, n in zip(V.unpack_item(item), "mk"))).first() == (968, 3, 200)


def test_smallest_takes_lowest_places_at_ties():
    d = np.array([[3, 1, 1, 0, 1], [2, 2, 2, 2, 2]])
    at, value = kernels.smallest(d, 3)
    assert at.tolist() == [[3, 1, 2], [0, 1, 2]] and value.tolist() == [[0, 1, 1], [2, 2, 2]]


def test_placement():
    stats = [(0, 100, 9000), (1, 50, 100), (2, 60, 90), (3, 10, 0), (4, 40, 95)]
    placed = placement.place(stats, {1: [4, 2, 0, 3]}, 4, 1000)
    assert {c for c, _, _ in placed} == {0, 1, 2, 3, 4}
    assert sum(c == 0 for c, _, _ in placed) == 4 and len({u for c, _, u in placed if c == 0}) == 4
    assert placement.place([], {}, 4, 10) == []
    with pytest.raises(ValueError):
        placement.place([(0, 11, 1)], {}, 2, 10)
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, units = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        stats = [(c, int(rng.integers(0, 50)), int(w)) for c, w in enumerate((rng.pareto(1, n) * 20).astype(int) * rng.integers(0, 2, n))]
        capacity = sum(s[1] for s in stats) + 1
        placed = placement.place(stats, {c: rng.permutation(n).tolist() for c in range(n)}, units, capacity)
        assert {c for c, _, _ in placed} == set(range(n))
        by = {}
        for c, r, u in placed:
            by.setdefault(c, []).append((r, u))
        assert all(sorted(r for r, _ in x) == list(range(len(x))) and len({u for _, u in x}) == len(x) for x in by.values())


def test_lloyd_step_leaves_out_empty_clusters(spark):
    v = np.array([[0, 0], [2, -3], [100, 100]])
    c = spark.createDataFrame([(0, [0, 0]), (1, [100, 100]), (2, [999, 999])], "cid bigint, c array<int>")
    assert sorted((r["cid"], r["n"], list(r["c"])) for r in coarse.lloyd_step(frame(spark, v), c).collect()) == [(0, 2, [1, -1]), (1, 1, [100, 100])]


def test_results_do_not_depend_on_routing(spark, blobs):
    v, q = blobs
    base, queries = frame(spark, v[:500]), frame(spark, q[:10], "qid")
    centroids = frame(spark, v[:8]).select(F.col("id").alias("cid"), F.col("v").alias("c"))
    probes = coarse.probe(queries, centroids, 3, "qid", keep=False).select("qid", "cid")
    placed = spark.createDataFrame([(c, r, (c + r) % 4) for c in range(8) for r in range(1 + c % 3)], "cid bigint, replica bigint, unit bigint")
    routed = placement.route(probes, placed)
    assert sorted(map(tuple, routed.select("qid", "cid").collect())) == sorted(map(tuple, probes.collect()))


def test_operating_points(spark):
    m = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.5), (3, 30, 0.9), (4, 40, 0.8), (5, 10, 0.4)], "n int, cost int, recall double")
    assert sorted(r["n"] for r in evaluate.operating_points(m).collect()) == [1, 3]
    assert evaluate.first_acceptable(m, 0.6).first()["n"] == 3


def test_explore(spark, blobs):
    v, q = blobs
    base, queries = frame(spark, v[:600]), frame(spark, q[:20], "qid")
    centroids = frame(spark, v[:8]).select(F.col("id").alias("cid"), F.col("v").alias("c"))
    truth = search.flat_knn(base, queries, 1).select("qid", "id")
    grid = evaluate.explore(add(base, IndexSpec(8), centroids, None), queries, truth, (1, 8), (1,))
    rows = {r["nprobe"]: r for r in grid.collect()}
    assert rows[8]["recall"] == 1.0 and rows[8]["cost"] == 600 * 20 > rows[1]["cost"]
    assert {r["nprobe"] for r in evaluate.operating_points(grid).collect()} <= {1, 8}


def test_stream(spark, tmp_path, blobs):
    from vecloom.streaming.serve import serve

    v, q = blobs
    ix = add(frame(spark, v), IndexSpec(), None, None)
    frame(spark, q[:6], "qid").repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("qid bigint, v array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    serve(stream, ix, SearchParams(5), lambda df, n: got.extend(rows(df)), str(tmp_path / "ckpt")).awaitTermination(60)
    assert sorted(got) == brute(v, q[:6], 5)


# --- Floats --------------------------------------------------------------------------------------------------------


def floats(spark, v, name="id"):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], f"{name} bigint, v array<double>")


def brute_floats(v, q, k, metric="l2"):
    out = []
    for i, x in enumerate(q):
        d = ((x - v) ** 2).sum(1) if metric == "l2" else -(x * v).sum(1)
        out += [(i, n + 1, int(j), float(d[j] if metric == "l2" else -d[j])) for n, j in enumerate(np.lexsort((np.arange(len(v)), d))[:k])]
    return out


@pytest.fixture(scope="module")
def units():
    """Unit vectors, whose distances all lie between 0 and 4; the last 50 are equal to the first."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v = np.concatenate([v, v[:50]])
    return v, v[::25]


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_flat_floats_are_exact(spark, units, metric):
    v, q = units
    got, want = rows(search.flat_knn(floats(spark, v), floats(spark, q, "qid"), 10, metric)), brute_floats(v, q, 10, metric)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_small_and_large_floats_keep_their_order(spark):
    """Distances far below one, and differences far below the vectors' length."""
    v = np.array([[1e-6 * i, 0.0] for i in range(40)]) + [0, 1000.0]
    got = rows(search.flat_knn(floats(spark, v), floats(spark, v[20:21], "qid"), 5))
    assert [r[2] for r in got] == [20, 19, 21, 18, 22] and got[0][3] == 0.0


def test_all_probes_of_float_lists_are_exact(spark, units):
    v, q = units
    base, queries = floats(spark, v), floats(spark, q, "qid")
    ix = add(base, IndexSpec(20), base.where("id < 20").select(F.col("id").alias("cid"), F.col("v").alias("c")), None)
    want = brute_floats(v, q, 10)
    for got in (rows(ix.search(queries, "nprobe=20,k=10")), rows(search.ivf_join(ix.lists, queries, ix.centroids, 10, 20))):
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_refined_floats(spark, units, metric):
    v, q = units
    base, queries = floats(spark, v), floats(spark, q, "qid")
    ix = build(base, "IVF8,PQ12x6", metric)
    got = refined(ix, base, queries, SearchParams(10, 8), 30)
    assert evaluate.overlap(got, search.flat_knn(base, queries, 10, metric), 10).first()[0] >= 0.9
    want = {(r[0], r[2]): r[3] for r in brute_floats(v, q, len(v), metric)}
    assert all(abs(r[3] - want[r[0], r[2]]) < 1e-9 for r in rows(got))


# --- Query sets of many blocks -------------------------------------------------------------------------------------


def test_queries_of_many_blocks_meet_the_lists_in_a_join(spark, monkeypatch, blobs):
    v, q = blobs
    base, queries = frame(spark, v), frame(spark, q, "qid")
    ix = rule_index(base, 16, 4, 16)
    flat = add(base, IndexSpec(16), ix.centroids, None)
    want = [rows(x.search(queries, SearchParams(10, 5))) for x in (ix, flat)]
    ip = rows(search.ivf_search(ix.lists, queries, ix.centroids, 10, 5, ix.codebook, "ip"))
    for name, n in (("QUERY_BLOCK", 7), ("LIST_ROWS", 64), ("PROBE_ROWS", 3)):
        monkeypatch.setattr(search, name, n)
    plan = flat.search(queries, SearchParams(10, 5))
    assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().toString()
    assert [rows(ix.search(queries, SearchParams(10, 5))), rows(plan)] == want
    assert rows(search.ivf_search(ix.lists, queries, ix.centroids, 10, 5, ix.codebook, "ip")) == ip


def test_sample_is_spread(spark, blobs):
    from vecloom.plans.index import train_sample

    base = frame(spark, blobs[0])
    some = train_sample(base, 1000)
    assert 850 < some.count() < 1150 and some.rdd.getNumPartitions() >= 4
    assert train_sample(base, 5000).count() == 3000


# --- Placement, slices, lines ----------------------------------------------------------------------------------------


def test_turns_of_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(placement, "TURNS", 4)
    probes = spark.createDataFrame([(q, q % 2) for q in range(40)], "qid bigint, cid bigint")
    placed = spark.createDataFrame([(0, 0, 5), (0, 1, 6), (0, 2, 7), (1, 0, 5)], "cid bigint, replica bigint, unit bigint")
    got = {(r["qid"], r["cid"]): r["replica"] for r in placement.route(probes, placed).collect()}
    assert got == {(q, q % 2): (q // 2) % 3 if q % 2 == 0 else 0 for q in range(40)}


def test_slices_hold_all_points(spark):
    assigned = spark.createDataFrame([(i, 0 if i < 70 else i % 3) for i in range(100)], "id bigint, cid bigint")
    s = placement.slices(assigned, 16, 4)
    rows_ = s.collect()
    assert sum(r["n_points"] for r in rows_) == 100 and max(r["n_points"] for r in rows_) == 16
    load = placement.slice_load(s, spark.createDataFrame([(0, 10), (1, 1), (2, 1)], "cid bigint, freq bigint")).collect()
    assert sum(r["n_rows"] for r in load) == 10 * (70 + 10) + 10 + 10 and max(r["n_rows"] for r in load) < 2 * sum(r["n_rows"] for r in load) / 4


def naive_lines(codes, most):
    """Pairs by falling count; each grows by the code that goes best with all its codes, among frequent pairs only."""
    from collections import Counter
    from itertools import combinations

    out = set()
    for cid in {c for c, _ in codes}:
        n = Counter(p for c, code in codes if c == cid for p in combinations(list(enumerate(code)), 2))
        n = dict(sorted(((p, x) for p, x in n.items() if x >= 2), key=lambda x: (-x[1], x[0][0], x[0][1]))[: cooc.PAIRS_PER_LINE * most])
        both = lambda a, b: n.get((min(a, b), max(a, b)), 0)  # noqa: B023, E731
        every, made = sorted({x for p in n for x in p}), []
        for a, b in n:
            line = [a, b]
            while len(line) < 4:
                can = [x for x in every if x[0] not in {y[0] for y in line} and both(a, x)]
                if not can:
                    break
                line.append(max(can, key=lambda x: (min(both(x, y) for y in line), tuple(-z for z in x))))  # noqa: B023
            if len(line) == 4 and len(made) < most and sorted(line) not in made:
                made.append(sorted(line))
        out |= {(cid, i, s, m, k) for i, line in enumerate(made) for s, (m, k) in enumerate(line)}
    return out


def test_mined_lines_as_by_hand(spark, blobs):
    ix = rule_index(frame(spark, blobs[0][:500]), 6, 8, 4)
    codes = [(r["cid"], list(r["code"])) for r in ix.lists.collect()]
    assert {tuple(r) for r in cooc.mine_lines(ix.lists, 12).select("cid", "line", "slot", "m", "k").collect()} == naive_lines(codes, 12)


def test_training_as_by_hand(spark, blobs):
    """Each trained cluster's centroid is the mean of the vectors that lists put there; each word that of its parts."""
    v, _ = blobs
    base = floats(spark, v)
    ix = build(base, "IVF12,PQ4x4")
    c = {r["cid"]: np.array(r["c"]) for r in ix.centroids.collect()}
    near = np.array([min(c, key=lambda j: ((x - c[j]) ** 2).sum()) for x in v])
    lists = {r["id"]: (r["cid"], list(r["code"])) for r in ix.lists.collect()}
    assert [lists[i][0] for i in range(len(v))] == near.tolist()
    assert max(np.abs(v[near == j].mean(0) - c[j]).max() for j in c) < 3  # data spread by 30
    words = np.zeros((4, 16, 4))
    for r in ix.codebook.collect():
        words[r["m"], r["k"]] = r["w"]
    r = np.stack([v[i] - c[near[i]] for i in range(len(v))]).reshape(len(v), 4, 4)
    code = ((r[:, :, None, :] - words[None]) ** 2).sum(3).argmin(2)
    assert [lists[i][1] for i in range(len(v))] == code.tolist()
    one = ((r - np.take_along_axis(words[None], code[:, :, None, None], 2)[:, :, 0]) ** 2).sum()
    assert one < 0.5 * (r**2).sum()


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def naive_levels(lists, centroids, book, fine, v):
    """The vector that each list row's codes stand for."""
    words = {name: {(r["m"], r["k"]): list(r["w"]) for r in b.collect()} for name, b in (("code", book), ("fine", fine))}
    c = {r["cid"]: list(r["c"]) for r in centroids.collect()}
    return {r["id"]: np.array(c[r["cid"]]) + sum(np.concatenate([words[n][m, k] for m, k in enumerate(r[n])]) for n in words) for r in lists.collect()}


@pytest.mark.parametrize("spec, metric", [("IVF8,PQ2x4+8", "l2"), ("PQ2x4+4", "l2"), ("IVF8,PQ4x4+8", "ip")])
def test_second_level_as_by_hand(spark, tmp_path, units, spec, metric):
    """Saved, loaded and searched: with all candidates the best by both levels, and more of the true ones than by the first alone."""
    v, q = units
    build(floats(spark, v), spec, metric).save(str(tmp_path / "i"))
    ix = Index.load(spark, str(tmp_path / "i"))
    stands = naive_levels(ix.lists, ix.centroids, ix.codebook, ix.fine, v)
    every = np.stack([stands[i] for i in range(len(v))])
    got = rows(ix.search(floats(spark, q, "qid"), SearchParams(10, 8, -(-len(v) // 10))))
    want = brute_floats(every, q, 10, metric)
    assert [(a, round(d, 7)) for a, _, _, d in got] == [(a, round(d, 7)) for a, _, _, d in sorted(want)]
    truth = brute_floats(v, q, 10, metric)
    plain = rows(build(floats(spark, v), spec.split("+")[0], metric).search(floats(spark, q, "qid"), SearchParams(10, 8)))
    assert recall(rows(ix.search(floats(spark, q, "qid"), SearchParams(10, 8, 4))), truth) > recall(plain, truth)


def test_projection_keeps_near_ones(spark, tmp_path):
    """Vectors of 3 axes in 16 dimensions, with little besides: their projections have the same neighbours."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 3)) @ rng.normal(size=(3, 16)) * 10 + 5 + rng.normal(size=(1500, 16)) * 1e-4
    q = v[:20] + 0.01
    build(floats(spark, v), "PCA3,Flat").save(str(tmp_path / "i"))
    ix = Index.load(spark, str(tmp_path / "i"))
    got = rows(ix.search(floats(spark, q, "qid"), "k=10"))
    assert recall(got, brute_floats(v, q, 10)) >= 0.98
    ids = {(a, r): i for a, r, i, _ in got}
    assert all(ids[i, 1] == i for i in range(20))
    whole = build(floats(spark, v), "PCA3,IVF8,PQ3x6+3")
    assert recall(rows(whole.search(floats(spark, q, "qid"), "k=10,nprobe=8,factor=20")), brute_floats(v, q, 10)) >= 0.5
    with pytest.raises(ValueError, match="no 17 axes"):
        build(floats(spark, v), "PCA17,Flat")


def test_second_level_of_nothing(spark):
    empty = spark.createDataFrame([], "qid bigint, v array<int>")
    ix = rule_index(frame(spark, np.random.default_rng(3).integers(0, 9, (60, 8))), 4, 2, 4, 4)
    assert ix.search(empty, "k=3,nprobe=2").count() == 0
