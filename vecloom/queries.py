"""Queries of the search engine over `embeddings`, and the same in SQL.

SQL can't train by k-means, so queries with SQL use the rule index: 16 centroids (vec_id below 16), 16 words per part
(residuals of the next 16 ids), 8 parts of 8 dimensions; vectors times 127, truncated. Queries are the vectors whose
vec_id is divisible by 20, searched against all vectors with 4 probes for the 10 nearest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import coarse, cooc, evaluate, placement, pq, project, search
from vecloom.params import IndexSpec, SearchParams, parse_index, parse_search
from vecloom.plans.index import Index, add, build, refined, rule_index
from vecloom.session import scratch, stored
from vecloom.sources import logs, vecs

NLIST, M, DSUB, KSUB, NPROBE, K, UNITS, FINE = 16, 8, 8, 16, 4, 10, 8, 16
SPECS = ("Flat", "PQ32", "PQ16x4", "IVF4096,Flat", "IVF4096,PQ16", "IVF4096,PQ32", "IVF4096,PQ8+16", "PCA80,Flat", "PCA32,IVF64,PQ8x6+16")
SEARCHES = ("", "nprobe=32", "k=100, nprobe=8", "factor=2,k=5")

# --- Shared plans ------------------------------------------------------------------------------------------------


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), V.quantize(F.col("embedding")).alias("v"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as they are: float vectors."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def query_set(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 20 = 0").select(F.col("id").alias("qid"), "v")


class Plan:
    """The rule index of one call, with its query set, probes and tables. floats: over the embeddings as they are stored."""

    def __init__(self, spark: SparkSession, sf_dir: str, floats: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.base = raw(spark, sf_dir) if floats else base(spark, sf_dir)
        self.queries = query_set(self.base)

    @property
    def index(self) -> Index:
        if not hasattr(self, "_index"):
            self._index = rule_index(self.base, NLIST, M, KSUB)
        return self._index

    @property
    def centroids(self) -> DataFrame:
        return self.base.where(F.col("id") < NLIST).select(F.col("id").alias("cid"), F.col("v").alias("c"))

    def probes(self) -> DataFrame:
        return search.probes(self.queries, self.centroids, NPROBE)

    def sizes(self) -> DataFrame:
        return placement.cluster_sizes(coarse.assign(self.base, self.centroids))

    def work(self) -> DataFrame:
        return placement.cluster_work(self.sizes(), placement.probe_frequency(self.probes()))

    def fixed_placement(self) -> DataFrame:
        """By rule: the hotter half of the clusters has two replicas; replica r of the cluster of rank n is on unit (n + 3r) mod UNITS."""
        ranked = placement.cluster_rank(self.work())
        copies = F.when(F.col("rank") <= NLIST // 2, F.array(*map(F.lit, (0, 1)))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
        return ranked.select("cid", F.explode(copies).alias("replica"), "rank").select("cid", "replica", ((F.col("rank") - 1 + 3 * F.col("replica")) % UNITS).alias("unit"))

    def routed(self) -> DataFrame:
        return placement.route(self.probes().select("qid", "cid"), self.fixed_placement())

    def tables(self, metric: str = "l2") -> DataFrame:
        return pq.tables(self.probes().select("qid", "cid", "r"), self.index.codebook, "r", metric)

    def lines(self) -> DataFrame:
        return cooc.modal_lines(self.index.lists)


def _long(df: DataFrame, keys: list[str], array: str, pos: str, value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array).alias(pos, value)).select(*keys, F.col(pos).cast("bigint").alias(pos), F.col(value).cast("bigint").alias(value))


# --- Queries -----------------------------------------------------------------------------------------------------


def flat_knn(p: Plan):
    return search.flat_knn(p.base, p.queries, K)


def flat_knn_ip(p: Plan):
    return search.flat_knn(p.base, p.queries, K, "ip")


def query_slice(p: Plan):
    """Rows 100 to 199 of the base, an id range that reaches the scan as a filter."""
    return _long(p.base.where("id BETWEEN 100 AND 199"), ["id"], "v", "d", "x")


def coarse_assign(p: Plan):
    return coarse.assign(p.base, p.centroids).select("id", "cid", F.col("d").alias("dist"))


def coarse_probe(p: Plan):
    return coarse.probe(p.queries, p.centroids, NPROBE, "qid", keep=False).select("qid", "rank", "cid", F.col("d").alias("dist"))


def residual(p: Plan):
    return _long(p.probes(), ["qid", "cid"], "r", "d", "r")


def residual_int8(p: Plan):
    """Residuals as a one-byte store wraps them, and clamped to a byte."""
    df = p.probes().select("qid", "cid", F.posexplode(F.arrays_zip(V.wrap_int8(F.col("r")).alias("w"), V.clamp_int8(F.col("r")).alias("c"))).alias("d", "x"))
    return df.select("qid", "cid", F.col("d").cast("bigint").alias("d"), F.col("x.w").cast("bigint").alias("wrapped"), F.col("x.c").cast("bigint").alias("clamped"))


def centroid_distances(p: Plan):
    return coarse.centroid_distances(p.centroids).select("a", "b", F.col("d").alias("dist"))


def centroid_neighbors(p: Plan):
    return coarse.centroid_neighbors(p.centroids).select("cid", "rank", "neighbor", F.col("d").alias("dist"))


def lloyd_step(p: Plan):
    return _long(coarse.lloyd_step(p.base, p.centroids), ["cid", "n"], "c", "d", "x")


def pq_encode(p: Plan):
    return _long(p.index.lists, ["cid", "id"], "code", "m", "k")


def code_address(p: Plan):
    return _long(pq.addresses(p.index.lists, KSUB), ["id"], "address", "m", "address")


def codebook_quant(p: Plan):
    return _long(pq.quantize_codebook(p.index.codebook, 0.5).select(F.col("m").cast("bigint").alias("m"), F.col("k").cast("bigint").alias("k"), "w"), ["m", "k"], "w", "j", "w")


def codebook_minmax(p: Plan):
    return pq.codebook_range(p.index.codebook).select(F.col("min_w").cast("bigint").alias("min_w"), F.col("max_w").cast("bigint").alias("max_w"))


def _lut(p: Plan, metric: str):
    t = p.tables(metric) if metric == "l2" else pq.tables(p.queries.select("qid", "v"), p.index.codebook, "v", "ip")
    keys = ["qid", "cid"] if metric == "l2" else ["qid"]
    return _long(t, keys, "lut", "at", "l").withColumn("m", F.expr(f"at div {KSUB}")).withColumn("k", F.col("at") % KSUB).drop("at")


def lut_l2(p: Plan):
    return _lut(p, "l2")


def lut_ip(p: Plan):
    return _lut(p, "ip")


def adc_scan(p: Plan):
    return search.adc_scan(p.index.lists, p.probes(), p.index.codebook, M, KSUB)


def adc_scan_uint16(p: Plan):
    """As adc_scan with table entries that wrap at 16 bits."""
    return search.adc_scan(p.index.lists, p.probes(), p.index.codebook, M, KSUB, clip=16)


def ivfpq_search(p: Plan):
    return p.index.search(p.queries, SearchParams(K, NPROBE))


def ivfpq_plan(p: Plan):
    """The same search as DataFrame operations only."""
    return search.top_k(adc_scan(p), K)


def ivfpq_ip(p: Plan):
    """Greatest products: each candidate's table sum of the query and its own code, plus the query's product with the centroid."""
    ix = p.index
    return search.ivf_search(ix.lists, p.queries, ix.centroids, K, NPROBE, ix.codebook, "ip")


def ivf_flat(p: Plan):
    return add(p.base, IndexSpec(NLIST), p.centroids, None).search(p.queries, SearchParams(K, NPROBE))


def pq_flat(p: Plan):
    """Codes of the vectors themselves, all of them searched."""
    words = p.base.where((F.col("id") >= NLIST) & (F.col("id") < NLIST + KSUB))
    book = words.select(F.explode(F.sequence(F.lit(0), F.lit(M - 1))).alias("m"), (F.col("id") - NLIST).cast("int").alias("k"), "v").select("m", "k", V.subvector(F.col("v"), F.col("m"), DSUB).alias("w"))
    return add(p.base, IndexSpec(0, M, 4), None, book).search(p.queries, SearchParams(K))


def topk_merge(p: Plan):
    """The best lists of two halves of the lists (by id), merged."""
    ix = p.index
    halves = [search.ivf_search(ix.lists.where(f"id % 2 = {i}"), p.queries, ix.centroids, K, NPROBE, ix.codebook) for i in (0, 1)]
    return search.merge_top_k(halves, K)


def segment_union_topk(p: Plan):
    """Flat search of three segments by id range, united and cut."""
    cuts = ("id < 100", "id >= 100 AND id < 250", "id >= 250")
    return search.merge_top_k([search.flat_knn(p.base.where(c), p.queries, K) for c in cuts], K)


def cluster_sizes(p: Plan):
    return p.sizes()


def probe_frequency(p: Plan):
    return placement.probe_frequency(p.probes())


def cluster_work(p: Plan):
    return p.work()


def average_work(p: Plan):
    return placement.average_work(p.work(), UNITS)


def cluster_rank(p: Plan):
    return placement.cluster_rank(p.work()).select("cid", "work", "rank")


def replica_route(p: Plan):
    return p.routed()


def unit_offsets(p: Plan):
    return placement.unit_offsets(p.fixed_placement(), p.sizes())


def unit_load(p: Plan):
    return placement.unit_load(p.routed(), p.sizes())


def placement_balance(p: Plan):
    return placement.balance(placement.unit_load(p.routed(), p.sizes()))


def _placed(p: Plan) -> DataFrame:
    return placement.placement(p.work(), coarse.centroid_neighbors(p.centroids, placement.NEAR), UNITS, 1_366_000)


def placement_greedy(p: Plan):
    return _placed(p)


def placement_check(p: Plan):
    """Clusters that the greedy placement leaves out: none."""
    return placement.unplaced(p.centroids.select("cid"), _placed(p))


def recall_at(p: Plan):
    truth = search.flat_knn(p.base, p.queries, 1).select("qid", "id")
    return evaluate.recall_at(ivfpq_search(p), truth, (1, 10))


def operating_points(p: Plan):
    """Probes 1, 2, 4, 8 and 16 of the flat lists: cost is the vectors scanned, gain 1-recall@1; the settings that none beats."""
    truth = search.flat_knn(p.base, p.queries, 1).select("qid", "id")
    flat, sizes = add(p.base, IndexSpec(NLIST), p.centroids, None), p.sizes()
    near = coarse.probe(p.queries, p.centroids, NLIST, "qid", keep=False).join(sizes, "cid")
    rows = None
    for n in (1, 2, 4, 8, 16):
        cost = near.where(F.col("rank") <= n).agg(F.sum("n_points").alias("cost"))
        one = evaluate.recall_at(flat.search(p.queries, SearchParams(1, n)), truth, (1,)).join(cost).select(F.lit(n).cast("bigint").alias("nprobe"), "cost", F.col("recall_1").alias("recall"))
        rows = one if rows is None else rows.unionAll(one)
    return evaluate.operating_points(rows)


def cooc_pairs(p: Plan):
    return cooc.pairs(p.index.lists).select("cid", *(F.col(c).cast("bigint").alias(c) for c in ("m1", "k1", "m2", "k2", "n")))


def cooc_encode(p: Plan):
    """Addresses of re-encoded vectors, joined by commas."""
    e = cooc.encode(p.index.lists, p.lines(), M, KSUB)
    return e.select("cid", "id", F.array_join(F.transform("address", lambda x: x.cast("string")), ",").alias("address"))


def cooc_lut(p: Plan):
    s = cooc.line_sums(p.tables(), p.lines(), KSUB)
    return s.select("qid", "cid", F.col("line").cast("bigint").alias("line"), F.col("mask").cast("bigint").alias("mask"), F.col("s").cast("bigint").alias("s"))


def cooc_scan(p: Plan):
    """Distances from re-encoded vectors: the same rows as adc_scan."""
    t = stored(p.tables().select("qid", "cid", "lut"), "tables")
    return cooc.scan(cooc.encode(p.index.lists, p.lines(), M, KSUB), t, cooc.line_sums(t, p.lines(), KSUB), M, KSUB)


def cooc_hit_rate(p: Plan):
    return cooc.hit_rate(cooc.encode(p.index.lists, p.lines(), M, KSUB))


def index_scan(p: Plan):
    """The index saved, loaded and read: every vector's cluster and codes."""
    at = scratch(p.spark, "index")
    p.index.save(at)
    return _long(Index.load(p.spark, at).lists, ["cid", "id"], "code", "m", "k")


def index_search_saved(p: Plan):
    """The search on the index as loaded: only files of probed clusters are read."""
    at = scratch(p.spark, "index")
    p.index.save(at)
    return Index.load(p.spark, at).search(p.queries, f"nprobe={NPROBE},k={K}")


def vec_scan(p: Plan):
    """The base written as fvecs and read back; ids are record numbers."""
    at = scratch(p.spark, "vecs")
    vecs.write_vecs(p.base.orderBy("id").select("v"), at, "fvecs")
    return _long(vecs.read_vecs(p.spark, at, "fvecs"), ["id"], "v", "d", "x")


def _through(p: Plan, kind: str, to: str, change=lambda x: x):
    """The base written as a file of `kind`, its elements changed and cast, and read back."""
    at = scratch(p.spark, kind)
    vecs.write_vecs(p.base.orderBy("id").select(F.transform("v", lambda x: change(x).cast(to)).alias("v")), at, kind)
    return _long(vecs.read_vecs(p.spark, at, kind), ["id"], "v", "d", "x")


def ivecs_scan(p: Plan):
    return _through(p, "ivecs", "int")


def bvecs_scan(p: Plan):
    """Absolute values, since bytes have no sign."""
    return _through(p, "bvecs", "smallint", F.abs)


def fbin_scan(p: Plan):
    return _through(p, "fbin", "float")


def ibin_scan(p: Plan):
    return _through(p, "ibin", "int")


def i8bin_scan(p: Plan):
    return _through(p, "i8bin", "tinyint")


def truth_scan(p: Plan):
    """The exact search's best lists written as a truth file and read back: id is the query's number in the file."""
    at = scratch(p.spark, "truth")
    best = search.flat_knn(p.base, p.queries, K).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("b"))
    lists = [F.transform("b", lambda x: x["id"].cast("int")).alias("ids"), F.transform("b", lambda x: x["dist"].cast("float")).alias("dists")]
    vecs.write_vecs(best.orderBy("qid").select(*lists), at, "truth")
    back = vecs.read_vecs(p.spark, at, "truth").select("id", F.posexplode(F.arrays_zip("ids", "dists")).alias("rank", "b"))
    return back.select("id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("b.ids").cast("bigint").alias("neighbor"), F.col("b.dists").cast("bigint").alias("dist"))


def cluster_lines_scan(p: Plan):
    """Lines written as text, a file for each cluster, and read back."""
    at = scratch(p.spark, "lines")
    logs.write_cluster_lines(p.lines(), at)
    return logs.cluster_lines(p.spark, at).select(*(F.col(c).cast("bigint").alias(c) for c in ("cid", "line", "slot", "m", "k")))


def replay_merge(p: Plan):
    """Best lists of each unit (id mod UNITS) dumped as matrices, read back and merged: the same rows as the search."""
    best = W.partitionBy("qid", "unit").orderBy("dist", "id")
    found = adc_scan(p).withColumn("unit", F.col("id") % UNITS).withColumn("n", F.row_number().over(best)).where(F.col("n") <= K)
    at = scratch(p.spark, "dump")
    logs.dump_lists(found.select(F.expr("qid div 20").alias("qid"), "unit", "id", "dist"), p.queries.count(), UNITS, at)
    back = logs.replay_lists(p.spark, at, K)
    return search.top_k(back.select((F.col("qid") * 20).alias("qid"), "id", "dist"), K)


def ivfpqr_search(p: Plan):
    """A second level of codes: 40 candidates a query by the first, ranked by both."""
    return rule_index(p.base, NLIST, M, KSUB, FINE).search(p.queries, SearchParams(K, NPROBE, 4))


def ivfpqr_float(p: Plan):
    return _six(ivfpqr_search(p))


def projected_knn(p: Plan):
    """Exact search of projections on 16 axes by rule: the vectors with ids 16 to 31; vector 0 stands for the mean."""
    rows = p.base.where("id = 0 OR id BETWEEN 16 AND 31").select(F.when(F.col("id") == 0, project.MEAN).otherwise(F.col("id") - 16).cast("int").alias("axis"), F.col("v").alias("w"))
    return add(p.base, IndexSpec(axes=16), None, None, axes=rows).search(p.queries, SearchParams(K)).withColumn("dist", F.col("dist").cast("bigint"))


def index_specs(p: Plan):
    """What index specifications say."""
    each = [(s, parse_index(s)) for s in SPECS]
    return p.spark.createDataFrame([(s, i.nlist, i.m, i.nbits, i.fine, i.axes, i.precomputed_terms) for s, i in each], "spec string, nlist bigint, m bigint, nbits bigint, fine bigint, axes bigint, terms bigint")


def search_params(p: Plan):
    """What search parameters say; names that aren't given have their usual values."""
    return p.spark.createDataFrame([(s, x.k, x.nprobe, x.factor) for s, x in ((s, parse_search(s)) for s in SEARCHES)], "params string, k bigint, nprobe bigint, factor bigint")


def log_scan(p: Plan):
    """Unit loads written as a run log and read back."""
    at = scratch(p.spark, "log")
    placement.unit_load(p.routed(), p.sizes()).select(F.format_string("query dpu_process %d : %d", "unit", "n_rows").alias("value")).write.text(at)
    return logs.unit_lines(p.spark, at)


def log_argmax(p: Plan):
    """Unit loads as counters in blocks; all counters of the block with most rows."""
    at = scratch(p.spark, "counters")
    text = F.concat(F.format_string("=== DPU#%d\nins_rows: %d\nins_", "unit", "n_rows"), F.format_string("probes: %d\n", "n_probes"))
    placement.unit_load(p.routed(), p.sizes()).coalesce(1).orderBy("unit").select(text.alias("value")).write.text(at)
    return logs.argmax_block(logs.counter_blocks(p.spark, at), "rows").select("name", "n")


def _six(df: DataFrame) -> DataFrame:
    """Distances to six places. They are ranked before, by all their digits."""
    return df.withColumn("dist", F.round("dist", 6) + F.lit(0.0))


def flat_knn_float(p: Plan):
    return _six(search.flat_knn(p.base, p.queries, K))


def flat_ip_float(p: Plan):
    return _six(search.flat_knn(p.base, p.queries, K, "ip"))


def ivf_flat_float(p: Plan):
    return _six(ivf_flat(p))


def ivf_all_probes_float(p: Plan):
    """With all probes the lists hold everything: the same rows as the exact search."""
    return _six(add(p.base, IndexSpec(NLIST), p.centroids, None).search(p.queries, SearchParams(K, NLIST)))


def ivfpq_float(p: Plan):
    return _six(ivfpq_search(p))


def ivfpq_plan_float(p: Plan):
    """The same as DataFrame operations only."""
    return _six(ivfpq_plan(p))


def refined_float(p: Plan):
    """50 candidates a query by codes, ranked by their exact distances."""
    return _six(refined(p.index, p.base, p.queries, SearchParams(K, NPROBE), 5))


def ivf_join_float(p: Plan):
    """The float search with queries that meet the lists in an exchange, as for query sets of more than one block."""
    ix = p.index
    return _six(search.ivf_join(ix.lists, p.queries, ix.centroids, K, NPROBE, ix.codebook))


def ivf_join(p: Plan):
    return search.ivf_join(add(p.base, IndexSpec(NLIST), p.centroids, None).lists, p.queries, p.centroids, K, NPROBE)


def load_sorted(p: Plan):
    """Unit loads by falling rows, as a chart would show them: (place, unit, n_rows)."""
    return placement.sorted_load(unit_load(p))


def slices(p: Plan):
    """Clusters cut in slices of at most 32 points each, dealt to units: (cid, slice, unit, n_points)."""
    return placement.slices(coarse.assign(p.base, p.centroids), 32, UNITS)


def slice_load(p: Plan):
    """Rows to scan of each unit when every probe of a cluster goes to all its slices."""
    return placement.slice_load(slices(p), placement.probe_frequency(p.probes()))


def mine_lines(p: Plan):
    """Lines of codes that often occur together, at most 8 a cluster."""
    return cooc.mine_lines(p.index.lists, 8).select(*(F.col(c).cast("bigint").alias(c) for c in ("cid", "line", "slot", "m", "k")))


def sweep(p: Plan):
    """Settings of a search (batch, nprobe, k) with what does not depend on the machine: probes and list rows that they meet."""
    return evaluate.sweep(p.index, p.queries, (5, 10, 25), (1, 4, 16), (1, 10))


def unit_sweep(p: Plan):
    """Balance of the rule's placement for numbers of units: (units, max_rows, mean_rows)."""
    return evaluate.unit_sweep(p.probes().select("qid", "cid"), p.sizes(), (2, 4, 8, 16))


def kmeans_train(p: Plan):
    """A trained coarse quantiser: vectors of each cluster."""
    return placement.cluster_sizes(build(p.base, f"IVF{NLIST},Flat").lists)


def pq_train(p: Plan):
    """A trained codebook: words of each part."""
    return build(p.base, "IVF16,PQ8x4").codebook.groupBy(F.col("m").cast("bigint").alias("m")).agg(F.count("*").alias("n_words"))


def trained_recall(p: Plan):
    """A trained index over every vector, its candidates compared exactly: share of the true 10 nearest that it finds."""
    ix = build(p.base, "IVF16,PQ16x6")
    got = refined(ix, p.base, p.queries, SearchParams(K, 8), 10)
    return evaluate.overlap(got, search.flat_knn(p.base, p.queries, K), K)


def lineitem_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, price, discount and tax of all lineitem rows in whole units; the id is made of the row's four keys."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole = lambda c, s: F.floor(F.col(c) * F.lit(s)).cast("int")
    ident = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")
    return li.select(ident.alias("id"), F.array(whole("l_quantity", 100), whole("l_extendedprice", 0.1), whole("l_discount", 10_000), whole("l_tax", 10_000)).alias("v"))


def lineitem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IVF-flat with 64 rule centroids and 8 probes over all lineitem rows; queries are the rows whose id is divisible by 20."""
    v = lineitem_vectors(spark, sf_dir)
    first = v.orderBy("id").limit(64)
    starts = stored(first.select((F.row_number().over(W.orderBy("id")) - 1).cast("bigint").alias("cid"), F.col("v").alias("c")), "starts")
    return add(v, IndexSpec(64), starts, None).search(query_set(v), SearchParams(K, 8))


_ALL = (
    flat_knn, flat_knn_ip, query_slice, coarse_assign, coarse_probe, residual, residual_int8, centroid_distances, centroid_neighbors, lloyd_step, pq_encode, code_address, codebook_quant,
    codebook_minmax, lut_l2, lut_ip, adc_scan, adc_scan_uint16, ivfpq_search, ivfpq_plan, ivfpq_ip, ivf_flat, pq_flat, topk_merge, segment_union_topk, cluster_sizes, probe_frequency,
    cluster_work, average_work, cluster_rank, replica_route, unit_offsets, unit_load, placement_balance, placement_greedy, placement_check, recall_at, operating_points, cooc_pairs,
    cooc_encode, cooc_lut, cooc_scan, cooc_hit_rate, ivf_join, load_sorted, slices, slice_load, mine_lines, sweep, unit_sweep, index_scan, index_search_saved, vec_scan, ivecs_scan, bvecs_scan, fbin_scan, ibin_scan, i8bin_scan,
    truth_scan, cluster_lines_scan, replay_merge, ivfpqr_search, projected_knn, index_specs, search_params, log_scan, log_argmax, kmeans_train, pq_train, trained_recall,
)
_FLOAT = (flat_knn_float, flat_ip_float, ivf_flat_float, ivf_all_probes_float, ivfpq_float, ivfpq_plan_float, refined_float, ivf_join_float, ivfpqr_float)
QUERIES = {f.__name__: (lambda spark, sf_dir, f=f: f(Plan(spark, sf_dir))) for f in _ALL} | {"lineitem_search": lineitem_search}
QUERIES |= {f.__name__: (lambda spark, sf_dir, f=f: f(Plan(spark, sf_dir, True))) for f in _FLOAT}

# --- The same in SQL ---------------------------------------------------------------------------------------------

_CTE = {
    "e": "SELECT vec_id AS id, u.d, CAST(trunc(CAST(embedding[u.d + 1] AS DOUBLE) * 127) AS BIGINT) AS x FROM embeddings, (SELECT unnest(range(64)) AS d) u",
    "cen": "SELECT id AS cid, d, x FROM e WHERE id < 16",
    "ad": "SELECT e.id, cen.cid, CAST(SUM((e.x - cen.x) * (e.x - cen.x)) AS BIGINT) AS dist FROM e JOIN cen USING (d) GROUP BY 1, 2",
    "rk": "SELECT id, cid, dist, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS rank FROM ad",
    "asg": "SELECT id, cid, dist FROM rk WHERE rank = 1",
    "res": "SELECT e.id, asg.cid, e.d, e.x - cen.x AS r FROM e JOIN asg ON e.id = asg.id JOIN cen ON cen.cid = asg.cid AND cen.d = e.d",
    "cb": "SELECT d // 8 AS m, id - 16 AS k, d % 8 AS j, r AS w FROM res WHERE id >= 16 AND id < 32",
    "cd": "SELECT res.id, cb.m, cb.k, SUM((r - w) * (r - w)) AS dist FROM res JOIN cb ON res.d // 8 = cb.m AND res.d % 8 = cb.j GROUP BY 1, 2, 3",
    "code": "SELECT id, m, k FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY dist, k) AS n FROM cd) WHERE n = 1",
    "pr": "SELECT id AS qid, cid, rank, dist FROM rk WHERE id % 20 = 0 AND rank <= 4",
    "qr": "SELECT pr.qid, pr.cid, e.d, e.x - cen.x AS r FROM pr JOIN e ON e.id = pr.qid JOIN cen ON cen.cid = pr.cid AND cen.d = e.d",
    "lut": "SELECT qr.qid, qr.cid, cb.m, cb.k, CAST(SUM((r - w) * (r - w)) AS BIGINT) AS l FROM qr JOIN cb ON qr.d // 8 = cb.m AND qr.d % 8 = cb.j GROUP BY 1, 2, 3, 4",
    "lutip": "SELECT e.id AS qid, cb.m, cb.k, CAST(SUM(e.x * w) AS BIGINT) AS l FROM e JOIN cb ON e.d // 8 = cb.m AND e.d % 8 = cb.j WHERE e.id % 20 = 0 GROUP BY 1, 2, 3",
    "adc": "SELECT lut.qid, code.id, CAST(SUM(l) AS BIGINT) AS dist FROM asg JOIN code USING (id) JOIN lut ON lut.cid = asg.cid AND lut.m = code.m AND lut.k = code.k GROUP BY 1, 2",
    "flat": "SELECT q.id AS qid, b.id, CAST(SUM((q.x - b.x) * (q.x - b.x)) AS BIGINT) AS dist FROM e q JOIN e b ON q.d = b.d WHERE q.id % 20 = 0 GROUP BY 1, 2",
    "rem": "SELECT res.id, res.d, res.r - cb.w AS x FROM res JOIN code ON code.id = res.id AND code.m = res.d // 8 JOIN cb ON cb.m = code.m AND cb.k = code.k AND cb.j = res.d % 8",
    "fb": "SELECT d // 4 AS m, id - 32 AS k, d % 4 AS j, x AS w FROM rem WHERE id >= 32 AND id < 48",
    "fd": "SELECT rem.id, fb.m, fb.k, SUM((x - w) * (x - w)) AS dist FROM rem JOIN fb ON rem.d // 4 = fb.m AND rem.d % 4 = fb.j GROUP BY 1, 2, 3",
    "fc": "SELECT id, m, k FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY dist, k) AS n FROM fd) WHERE n = 1",
    "rec": "SELECT rem.id, rem.d, e.x - rem.x + fb.w AS x FROM rem JOIN e ON e.id = rem.id AND e.d = rem.d JOIN fc ON fc.id = rem.id AND fc.m = rem.d // 4 JOIN fb ON fb.m = fc.m AND fb.k = fc.k AND fb.j = rem.d % 4",
    "sz": "SELECT cid, COUNT(*) AS n_points FROM asg GROUP BY 1",
    "fq": "SELECT cid, COUNT(*) AS freq FROM pr GROUP BY 1",
    "wk": "SELECT cid, COALESCE(n_points, 0) AS n_points, COALESCE(freq, 0) AS freq, COALESCE(n_points, 0) * COALESCE(freq, 0) AS work FROM sz FULL JOIN fq USING (cid)",
    "cr": "SELECT cid, work, row_number() OVER (ORDER BY work DESC, cid) AS rank FROM wk",
    "pl": "SELECT cid, replica, (rank - 1 + 3 * replica) % 8 AS unit FROM cr, (SELECT unnest([0, 1]) AS replica) r WHERE replica = 0 OR rank <= 8",
    "rt": "SELECT t.qid, t.cid, t.replica, pl.unit FROM (SELECT qid, cid, (row_number() OVER (PARTITION BY cid ORDER BY qid) - 1) % n AS replica FROM pr JOIN (SELECT cid, COUNT(*) AS n FROM pl GROUP BY 1) USING (cid)) t JOIN pl ON pl.cid = t.cid AND pl.replica = t.replica",
    "ul": "SELECT unit, COUNT(*) AS n_probes, COUNT(DISTINCT qid) AS n_queries, CAST(SUM(n_points) AS BIGINT) AS n_rows FROM rt JOIN sz USING (cid) GROUP BY 1",
    "ln": "SELECT cid, m // 4 AS line, m % 4 AS slot, m, k FROM (SELECT asg.cid, m, k, row_number() OVER (PARTITION BY asg.cid, m ORDER BY COUNT(*) DESC, k) AS n FROM code JOIN asg USING (id) GROUP BY asg.cid, m, k) WHERE n = 1",
    "mt": "SELECT asg.cid, code.id, code.m, code.k, ln.line, CASE WHEN ln.k = code.k THEN 1 ELSE 0 END AS hit, ln.slot FROM code JOIN asg USING (id) JOIN ln ON ln.cid = asg.cid AND ln.m = code.m",
    "mg": "SELECT cid, id, line, SUM(hit) AS n, CAST(SUM(hit * (1 << slot)) AS BIGINT) AS mask FROM mt GROUP BY 1, 2, 3",
    "en": "SELECT mt.cid, mt.id, 0 AS late, m * 16 + k AS address FROM mt JOIN mg USING (id, line) WHERE NOT (mg.n >= 2 AND hit = 1) UNION ALL SELECT cid, id, 1, 128 + line * 16 + mask FROM mg WHERE n >= 2",
}


def _top(source: str, order: str = "dist, id") -> str:
    return f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {source}) WHERE rank <= 10"


#: Distances from what both levels of codes stand for, of the 40 best by the first.
_TWO_LEVELS = "(SELECT c.qid, c.id, {0} AS dist FROM (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {1}, id) AS n FROM adc) WHERE n <= 40) c JOIN e ON e.id = c.qid JOIN rec ON rec.id = c.id AND rec.d = e.d GROUP BY 1, 2)"

_SQL = {
    "flat_knn": _top("flat"),
    "flat_knn_ip": _top("(SELECT q.id AS qid, b.id, CAST(SUM(q.x * b.x) AS BIGINT) AS dist FROM e q JOIN e b ON q.d = b.d WHERE q.id % 20 = 0 GROUP BY 1, 2)", "dist DESC, id"),
    "query_slice": "SELECT id, d, x FROM e WHERE id BETWEEN 100 AND 199",
    "coarse_assign": "SELECT id, cid, dist FROM asg",
    "coarse_probe": "SELECT qid, rank, cid, dist FROM pr",
    "residual": "SELECT qid, cid, d, r FROM qr",
    "residual_int8": "SELECT qid, cid, d, ((r + 128) % 256 + 256) % 256 - 128 AS wrapped, greatest(least(r, 127), -128) AS clamped FROM qr",
    "centroid_distances": "SELECT id AS a, cid AS b, dist FROM ad WHERE id < 16",
    "centroid_neighbors": "SELECT id AS cid, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS rank, cid AS neighbor, dist FROM ad WHERE id < 16 AND id <> cid",
    "lloyd_step": "SELECT cid, n, d, CAST(s // n AS BIGINT) AS x FROM (SELECT cid, d, COUNT(*) AS n, CAST(SUM(x) AS BIGINT) AS s FROM e JOIN asg USING (id) GROUP BY 1, 2)",
    "pq_encode": "SELECT asg.cid, code.id, m, k FROM code JOIN asg USING (id)",
    "code_address": "SELECT id, m, m * 16 + k AS address FROM code",
    "codebook_quant": "SELECT m, k, j, CAST(greatest(least(trunc(w * 0.5), 127), -128) AS BIGINT) AS w FROM cb",
    "codebook_minmax": "SELECT MIN(w) AS min_w, MAX(w) AS max_w FROM cb",
    "lut_l2": "SELECT qid, cid, m, k, l FROM lut",
    "lut_ip": "SELECT qid, m, k, l FROM lutip",
    "adc_scan": "SELECT qid, id, dist FROM adc",
    "adc_scan_uint16": "SELECT lut.qid, code.id, CAST(SUM(l & 65535) AS BIGINT) AS dist FROM asg JOIN code USING (id) JOIN lut ON lut.cid = asg.cid AND lut.m = code.m AND lut.k = code.k GROUP BY 1, 2",
    "ivfpq_search": _top("adc"),
    "ivfpq_plan": _top("adc"),
    "ivfpq_ip": _top("(SELECT pr.qid, code.id, CAST(SUM(l) AS BIGINT) + MAX(qc.p) AS dist FROM pr JOIN asg ON asg.cid = pr.cid JOIN code ON code.id = asg.id JOIN lutip ON lutip.qid = pr.qid AND lutip.m = code.m AND lutip.k = code.k JOIN (SELECT e.id AS qid, cen.cid, CAST(SUM(e.x * cen.x) AS BIGINT) AS p FROM e JOIN cen USING (d) GROUP BY 1, 2) qc ON qc.qid = pr.qid AND qc.cid = pr.cid GROUP BY 1, 2)", "dist DESC, id"),
    "ivf_flat": _top("(SELECT flat.* FROM flat JOIN asg USING (id) JOIN pr ON pr.qid = flat.qid AND pr.cid = asg.cid)"),
    "pq_flat": "WITH w AS (SELECT d // 8 AS m, id - 16 AS k, d % 8 AS j, x AS w FROM e WHERE id >= 16 AND id < 32), pd AS (SELECT e.id, w.m, w.k, CAST(SUM((x - w) * (x - w)) AS BIGINT) AS l FROM e JOIN w ON e.d // 8 = w.m AND e.d % 8 = w.j GROUP BY 1, 2, 3), pc AS (SELECT id, m, k FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY l, k) AS n FROM pd) WHERE n = 1), pf AS (SELECT q.id AS qid, pc.id, CAST(SUM(q.l) AS BIGINT) AS dist FROM pc JOIN pd q ON q.m = pc.m AND q.k = pc.k WHERE q.id % 20 = 0 GROUP BY 1, 2) " + _top("pf"),
    "topk_merge": _top("adc"),
    "segment_union_topk": _top("flat"),
    "cluster_sizes": "SELECT cid, n_points FROM sz",
    "probe_frequency": "SELECT cid, freq FROM fq",
    "cluster_work": "SELECT cid, n_points, freq, work FROM wk",
    "average_work": "SELECT CAST(SUM(work) AS BIGINT) AS total_work, CAST((SUM(work) + 7) // 8 AS BIGINT) AS avg_work FROM wk",
    "cluster_rank": "SELECT cid, work, rank FROM cr",
    "replica_route": "SELECT qid, cid, CAST(replica AS BIGINT) AS replica, CAST(unit AS BIGINT) AS unit FROM rt",
    "unit_offsets": "SELECT CAST(unit AS BIGINT) AS unit, cid, n_points, CAST(COALESCE(SUM(n_points) OVER (PARTITION BY unit ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM pl JOIN sz USING (cid)",
    "unit_load": "SELECT CAST(unit AS BIGINT) AS unit, n_probes, n_queries, n_rows FROM ul",
    "placement_balance": "SELECT MAX(n_rows) AS max_rows, MIN(n_rows) AS min_rows, CAST((SELECT unit FROM ul ORDER BY n_rows DESC, unit LIMIT 1) AS BIGINT) AS max_unit, CAST((SELECT unit FROM ul ORDER BY n_rows, unit LIMIT 1) AS BIGINT) AS min_unit, CAST(SUM(n_rows) AS BIGINT) AS sum_rows, COUNT(*) AS n_units, MAX(n_probes) AS max_probes, MAX(n_queries) AS max_queries FROM ul",
    "placement_check": "SELECT cid FROM cen WHERE false",
    "recall_at": "SELECT COUNT(*) AS n_queries, round(SUM(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) / COUNT(*), 6) AS recall_1, round(SUM(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) / COUNT(*), 6) AS recall_10 FROM (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM flat) WHERE n = 1) t LEFT JOIN (" + _top("adc") + ") r USING (qid, id)",
    "operating_points": "WITH p AS (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe), t AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM flat) WHERE n = 1), c AS (SELECT nprobe, CAST(SUM(n_points) AS BIGINT) AS cost FROM p JOIN rk ON rk.rank <= nprobe JOIN sz USING (cid) WHERE rk.id % 20 = 0 GROUP BY 1), h AS (SELECT nprobe, round(SUM(CASE WHEN EXISTS (SELECT 1 FROM rk JOIN asg ON asg.cid = rk.cid WHERE rk.id = t.qid AND rk.rank <= nprobe AND asg.id = t.id) THEN 1 ELSE 0 END) / COUNT(*), 6) AS recall FROM p, t GROUP BY 1), m AS (SELECT nprobe, cost, recall, MAX(recall) OVER (ORDER BY cost, recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c JOIN h USING (nprobe)) SELECT CAST(nprobe AS BIGINT) AS nprobe, cost, recall FROM m WHERE best IS NULL OR recall > best",
    "cooc_pairs": "SELECT asg.cid, a.m AS m1, a.k AS k1, b.m AS m2, b.k AS k2, COUNT(*) AS n FROM code a JOIN code b ON a.id = b.id AND a.m < b.m JOIN asg ON asg.id = a.id GROUP BY 1, 2, 3, 4, 5",
    "cooc_encode": "SELECT cid, id, string_agg(CAST(address AS VARCHAR), ',' ORDER BY late, address) AS address FROM en GROUP BY 1, 2",
    "cooc_lut": "SELECT qid, lut.cid, line, mask, CAST(SUM(l * ((mask >> slot) & 1)) AS BIGINT) AS s FROM lut JOIN ln ON ln.cid = lut.cid AND ln.m = lut.m AND ln.k = lut.k, (SELECT unnest(range(16)) AS mask) GROUP BY 1, 2, 3, 4",
    "cooc_scan": "SELECT qid, id, dist FROM adc",
    "cooc_hit_rate": "SELECT COUNT(*) AS n_vectors, CAST(SUM(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_hit, CAST(SUM(n) AS BIGINT) AS n_adds FROM (SELECT id, SUM(late) AS c, COUNT(*) AS n FROM en GROUP BY 1)",
    "ivf_join": _top("(SELECT flat.* FROM flat JOIN asg USING (id) JOIN pr ON pr.qid = flat.qid AND pr.cid = asg.cid)"),
    "load_sorted": "SELECT row_number() OVER (ORDER BY n_rows DESC, unit) AS place, CAST(unit AS BIGINT) AS unit, n_rows FROM ul",
    "slices": "SELECT cid, slice, CAST((row_number() OVER (ORDER BY n_points DESC, cid, slice) - 1) % 8 AS BIGINT) AS unit, n_points FROM (SELECT cid, slice, COUNT(*) AS n_points FROM (SELECT cid, (row_number() OVER (PARTITION BY cid ORDER BY id) - 1) // 32 AS slice FROM asg) GROUP BY 1, 2)",
    "slice_load": "SELECT CAST(unit AS BIGINT) AS unit, CAST(SUM(freq) AS BIGINT) AS n_probes, CAST(SUM(freq * n_points) AS BIGINT) AS n_rows FROM (SELECT cid, (row_number() OVER (ORDER BY n_points DESC, cid, slice) - 1) % 8 AS unit, n_points FROM (SELECT cid, slice, COUNT(*) AS n_points FROM (SELECT cid, (row_number() OVER (PARTITION BY cid ORDER BY id) - 1) // 32 AS slice FROM asg) GROUP BY 1, 2)) JOIN fq USING (cid) GROUP BY 1",
    "sweep": "SELECT CAST(b.batch AS BIGINT) AS batch, CAST(p.nprobe AS BIGINT) AS nprobe, CAST(k.k AS BIGINT) AS k, COUNT(*) AS probes, CAST(SUM(n_points) AS BIGINT) AS list_rows, CAST(SUM(least(n_points, k)) AS BIGINT) AS kept FROM (SELECT unnest([5, 10, 25]) AS batch) b, (SELECT unnest([1, 4, 16]) AS nprobe) p, (SELECT unnest([1, 10]) AS k) k JOIN (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY id) AS n FROM rk WHERE id % 20 = 0) r ON r.n <= b.batch AND r.rank <= p.nprobe JOIN sz USING (cid) GROUP BY 1, 2, 3",
    "unit_sweep": "SELECT CAST(units AS BIGINT) AS units, CAST(MAX(n) AS BIGINT) AS max_rows, round(SUM(n) / units, 6) AS mean_rows FROM (SELECT units, cid % units AS unit, CAST(SUM(n_points) AS BIGINT) AS n FROM (SELECT unnest([2, 4, 8, 16]) AS units), pr JOIN sz USING (cid) GROUP BY 1, 2) GROUP BY units",
    "index_scan": "SELECT asg.cid, code.id, m, k FROM code JOIN asg USING (id)",
    "index_search_saved": _top("adc"),
    "vec_scan": "SELECT id, d, x FROM e",
    "ivecs_scan": "SELECT id, d, x FROM e",
    "bvecs_scan": "SELECT id, d, abs(x) AS x FROM e",
    "fbin_scan": "SELECT id, d, x FROM e",
    "ibin_scan": "SELECT id, d, x FROM e",
    "i8bin_scan": "SELECT id, d, x FROM e",
    "truth_scan": "SELECT qid // 20 AS id, rank, id AS neighbor, dist FROM (" + _top("flat") + ")",
    "cluster_lines_scan": "SELECT cid, line, slot, m, k FROM ln",
    "replay_merge": _top("adc"),
    "ivfpqr_search": _top(_TWO_LEVELS.format("CAST(SUM((e.x - rec.x) * (e.x - rec.x)) AS BIGINT)", "dist")),
    "projected_knn": "WITH pj AS (SELECT e.id, a.id AS i, CAST(SUM((e.x - o.x) * a.x) AS BIGINT) AS x FROM e JOIN e o ON o.d = e.d AND o.id = 0 JOIN e a ON a.d = e.d AND a.id BETWEEN 16 AND 31 GROUP BY 1, 2), pd AS (SELECT q.id AS qid, b.id, CAST(SUM((q.x - b.x) * (q.x - b.x)) AS BIGINT) AS dist FROM pj q JOIN pj b ON b.i = q.i WHERE q.id % 20 = 0 GROUP BY 1, 2) " + _top("pd"),
    "index_specs": "SELECT spec, nlist, m, nbits, fine, axes, nlist * m * (CAST(1 AS BIGINT) << nbits) AS terms FROM (SELECT spec, " + ", ".join(f"CAST(COALESCE(NULLIF(regexp_extract(spec, '{x}', 1), ''), '{y}') AS BIGINT) AS {c}" for c, x, y in (("nlist", r"IVF(\d+)", 0), ("m", r"PQ(\d+)", 0), ("nbits", r"PQ\d+x(\d+)", 8), ("fine", r"\+(\d+)", 0), ("axes", r"PCA(\d+)", 0))) + f" FROM (SELECT unnest({list(SPECS)}) AS spec))",
    "search_params": "SELECT params, " + ", ".join(f"CAST(COALESCE(NULLIF(regexp_extract(params, '\\b{c}=(\\d+)', 1), ''), '{y}') AS BIGINT) AS {c}" for c, y in (("k", 10), ("nprobe", 1), ("factor", 4))) + f" FROM (SELECT unnest({list(SEARCHES)}) AS params)",
    "log_scan": "SELECT CAST(unit AS BIGINT) AS unit, n_rows AS n FROM ul",
    "log_argmax": "SELECT unnest(['rows', 'probes']) AS name, unnest([n_rows, n_probes]) AS n FROM (SELECT * FROM ul ORDER BY n_rows DESC, unit LIMIT 1)",
}


def _whole(sql: str, floats: bool = False) -> str:
    parts = _CTE | _FLOAT_CTE if floats else _CTE
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + f" SELECT * FROM ({sql})"


#: The same over floats: no whole numbers, and ties to nine places.
_FLOAT_CTE = {
    "e": "SELECT vec_id AS id, u.d, CAST(embedding[u.d + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS d) u",
    "ad": "SELECT e.id, cen.cid, SUM((e.x - cen.x) * (e.x - cen.x)) AS dist FROM e JOIN cen USING (d) GROUP BY 1, 2",
    "lut": "SELECT qr.qid, qr.cid, cb.m, cb.k, SUM((r - w) * (r - w)) AS l FROM qr JOIN cb ON qr.d // 8 = cb.m AND qr.d % 8 = cb.j GROUP BY 1, 2, 3, 4",
    "lutip": "SELECT e.id AS qid, cb.m, cb.k, SUM(e.x * w) AS l FROM e JOIN cb ON e.d // 8 = cb.m AND e.d % 8 = cb.j WHERE e.id % 20 = 0 GROUP BY 1, 2, 3",
    "adc": "SELECT lut.qid, code.id, SUM(l) AS dist FROM asg JOIN code USING (id) JOIN lut ON lut.cid = asg.cid AND lut.m = code.m AND lut.k = code.k GROUP BY 1, 2",
    "flat": "SELECT q.id AS qid, b.id, SUM((q.x - b.x) * (q.x - b.x)) AS dist FROM e q JOIN e b ON q.d = b.d WHERE q.id % 20 = 0 GROUP BY 1, 2",
}


def _top_float(source: str, order: str = "round(dist, 9), id") -> str:
    return "SELECT qid, rank, id, round(dist, 6) + 0.0 AS dist FROM (" + _top(source, order) + ")"


_FLOAT_SQL = {
    "flat_knn_float": _top_float("flat"),
    "flat_ip_float": _top_float("(SELECT q.id AS qid, b.id, SUM(q.x * b.x) AS dist FROM e q JOIN e b ON q.d = b.d WHERE q.id % 20 = 0 GROUP BY 1, 2)", "round(dist, 9) DESC, id"),
    "ivf_flat_float": _top_float("(SELECT flat.* FROM flat JOIN asg USING (id) JOIN pr ON pr.qid = flat.qid AND pr.cid = asg.cid)"),
    "ivf_all_probes_float": _top_float("flat"),
    "ivfpq_float": _top_float("adc"),
    "ivfpq_plan_float": _top_float("adc"),
    "ivf_join_float": _top_float("adc"),
    "ivfpqr_float": _top_float(_TWO_LEVELS.format("SUM((e.x - rec.x) * (e.x - rec.x))", "round(dist, 9)")),
    "refined_float": _top_float("(SELECT flat.* FROM flat JOIN (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS n FROM adc) WHERE n <= 50) c USING (qid, id))"),
}

ORACLE_SQL = {name: _whole(sql) for name, sql in _SQL.items()} | {name: _whole(sql, True) for name, sql in _FLOAT_SQL.items()}
ORACLE_SQL["lineitem_search"] = """
WITH v AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS id, CAST(floor(l_quantity * 100) AS BIGINT) AS a, CAST(floor(l_extendedprice * CAST(0.1 AS DOUBLE)) AS BIGINT) AS b, CAST(floor(l_discount * 10000) AS BIGINT) AS c, CAST(floor(l_tax * 10000) AS BIGINT) AS d FROM lineitem),
q AS (SELECT * FROM v WHERE id % 20 = 0),
s AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cid, a, b, c, d FROM (SELECT * FROM v ORDER BY id LIMIT 64)),
va AS (SELECT v.id, arg_min(cid, ((v.a-s.a)*(v.a-s.a) + (v.b-s.b)*(v.b-s.b) + (v.c-s.c)*(v.c-s.c) + (v.d-s.d)*(v.d-s.d)) * 64 + cid) AS cid FROM v, s GROUP BY 1),
qp AS (SELECT q.id AS qid, cid, row_number() OVER (PARTITION BY q.id ORDER BY (q.a-s.a)*(q.a-s.a) + (q.b-s.b)*(q.b-s.b) + (q.c-s.c)*(q.c-s.c) + (q.d-s.d)*(q.d-s.d), cid) AS n FROM q, s),
f AS (SELECT qp.qid, v.id, CAST((q.a-v.a)*(q.a-v.a) + (q.b-v.b)*(q.b-v.b) + (q.c-v.c)*(q.c-v.c) + (q.d-v.d)*(q.d-v.d) AS BIGINT) AS dist FROM qp JOIN q ON q.id = qp.qid JOIN va USING (cid) JOIN v ON v.id = va.id WHERE n <= 8)
SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM f) WHERE rank <= 10"""
