"""Near-duplicate join on word shingles: a MinHash LSH forest finds candidates, exact Jaccard counts decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import append, cut, documents, fresh_path, gathered, unused

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
#: Texts below one node of a tree that one task compares; those of a larger node go in pairs of blocks.
NODE_TEXTS = 8192
#: Texts of a block, and bytes of their texts; a candidate group of more is compared block by block.
BLOCK = 512
BLOCK_BYTES = 8 << 20
#: Columns of the shingle matrix that are multiplied at once.
COLUMNS = 4096
#: Rows of numbers that a task handles, about, and rows of signatures.
PART_ROWS = 100_000
PART_TEXTS = 5_000
SEED = 1


def shortest_prefix(recall: float = RECALL, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which any pair at the threshold is found with the target recall, whatever else is known of it.

    Two texts of similarity s share the first k values of a tree's signature with probability s^k, so one of the trees
    brings them together with 1 - (1 - s^k)^trees. No prefix need be shortened further than this.
    """
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def least_estimate(threshold: float = THRESHOLD, values: int = TREES * DEPTH) -> float:
    """Estimated similarity below which two texts aren't tied: the threshold less five standard deviations of the estimate."""
    p = threshold + (1 - threshold) / 16
    return threshold - 5 * (p * (1 - p) / values) ** 0.5 * 16 / 15


def shingles(data: bytes, words: int = WORDS):
    """Sorted different 64-bit hashes of runs of `words` words (parted by ASCII white space); of all words if there are fewer; none without words."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    parts = data.split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(h))
    out, base = np.zeros(len(h) - k + 1, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        out *= base
        out += h[i : len(out) + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signatures(sets: list, trees: int, depth: int, seed: int = SEED):
    """For each set of shingles (labels, sketch): each tree's `depth` MinHash values as 16-bit numbers, big-endian, and
    four bits of every value; (None, None) without shingles.

    Labels in order of their bytes are the leaves of the tree's trie from left to right; the first 2 * k bytes are the
    path to a node of depth k.
    """
    import numpy as np

    rng, n = np.random.default_rng(seed), trees * depth
    a = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, n, np.uint32)
    out = []
    for s in sets:
        if not len(s):
            out.append((None, None))
            continue
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            z = np.multiply.outer(a, x[i : i + 1024])
            z += b[:, None]
            np.minimum(low, z.min(1), out=low)
        value = (low * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(">u2")
        bits = np.zeros(-(-n // 16) * 16, np.uint8)
        bits[:n] = value & 15
        labels = value.reshape(trees, depth)
        out.append(([t.tobytes() for t in labels], (bits[::2] | bits[1::2] << 4).tobytes()))
    return out


def estimates(x, y, values: int):
    """Similarity of sketches x and y (rows of 64-bit words), by the share of equal four-bit values."""
    import numpy as np

    d = x ^ y
    d |= d >> np.uint64(1)
    d &= np.uint64(0x5555555555555555)
    d |= d >> np.uint64(2)
    d &= np.uint64(0x1111111111111111)
    return ((1 - np.bitwise_count(d).sum(1) / values) - 1 / 16) * (16 / 15)


def below_nodes(group, side, node, sketch, k: int, trees: int, values: int, threshold: float):
    """What the nodes of depth k bring together: (ties as pairs of rows, pairs found by each row, pairs that should have been).

    group: the node of each row, in order; side: the block it is from (only rows of different sides are compared where
    there are two); node: the text. Texts of a node whose estimated similarity is high enough are tied by a spanning
    forest: for m texts at most m - 1 ties, however many pairs. A pair of similarity s is found in trees * s^k trees on
    average, so each time counts 1 / (trees * s^k) as a pair that there is, and this times 1 - (1 - s^k)^trees as one that
    the prefixes of this depth find.
    """
    import numpy as np

    n = len(group)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
    root, ties = np.arange(n), []
    there, found = np.zeros(n), np.zeros(n)
    least, i, step = least_estimate(threshold, values), np.arange(n), 0
    while True:
        step += 1
        i = i[i + step < end[i]]
        if not len(i):
            return ties, there, found
        some = i[(side[i] < 0) | (side[i] != side[i + step])]
        for at in range(0, len(some), 1 << 16):
            x = some[at : at + (1 << 16)]
            y = x + step
            s = estimates(sketch[x], sketch[y], values)
            near = s >= least
            x, y, s = x[near], y[near], s[near]
            same = node[x] == node[y]
            x, y, s = x[~same], y[~same], s[~same]
            one = s >= threshold - 0.05
            p = s[one].clip(threshold, 1) ** k
            for rows in (x[one], y[one]):  # each has a row once at most
                there[rows] += 1 / (trees * p)
                found[rows] += (1 - (1 - p) ** trees) / (trees * p)
            fresh = np.flatnonzero(root[x] != root[y])
            for u, v in zip(x[fresh].tolist(), y[fresh].tolist()):
                a, b = u, v
                while root[a] != a:
                    a = int(root[a])
                while root[b] != b:
                    b = int(root[b])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    ties.append((u, v))
            while len(fresh) and (root[root] != root).any():
                root = root[root]


def forest(texts: DataFrame, trees: int, depth: int, threshold: float, recall: float, node_texts: int | None = None) -> DataFrame:
    """Ties (a, b) between candidates, for texts (h1, labels, sketch).

    Each tree is a trie of its labels, kept in sorted order: a node of depth k is a run of labels with one prefix.
    Matching starts at whole signatures. After each depth a text's recall is estimated from the similarities of what it
    has met there; texts short of the target, and those that have met nothing, have their prefixes shortened by one
    value in all trees, until the depth at which even a lone pair at the threshold reaches it. A node is looked at if
    any text below it is still short. Only labels that share the shortest prefix with another text's leave the first
    exchange, so a text without near ones costs one row a tree. Nodes of more than node_texts texts are looked at
    in pairs of blocks.
    """
    spark, shortest, values, node_texts = texts.sparkSession, shortest_prefix(recall, threshold, trees, depth), trees * depth, node_texts or NODE_TEXTS
    path = lambda k: F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * k})"))
    leaves = texts.select("h1", F.posexplode("labels").alias("tree", "label")).select("h1", "tree", path(shortest).alias("node"))
    shared = leaves.groupBy("node").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low < high").select("node")
    matched = leaves.join(shared, "node").select("h1", "tree").join(texts.select("h1", "sketch", "labels"), "h1").select("h1", "tree", F.get("labels", F.col("tree")).alias("label"), "sketch")
    at = fresh_path(spark, "near-dup-trie")
    gathered(matched, trees * texts.count(), 10 * PART_ROWS).write.parquet(at)
    matched, done, ties = spark.read.parquet(at), None, []
    n = matched.count()
    for k in range(depth, shortest - 1, -1):
        rows = matched.withColumn("node", path(k))
        rows = rows.withColumn("short", F.lit(True)) if done is None else rows.join(done, "h1", "left").withColumn("short", F.col("done").isNull()).drop("done")
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.max("short").alias("short")).where("short AND n > 1").select("node", F.ceil(F.col("n") / node_texts).cast("int").alias("blocks"))
        rows = rows.select("h1", "sketch", "node").join(nodes, "node").withColumn("mine", F.pmod(F.xxhash64("h1", F.lit(5)), F.col("blocks")).cast("int"))
        rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("node", F.least("mine", "with").alias("x"), F.greatest("mine", "with").alias("y"), F.when(F.col("mine") == F.col("with"), -1).otherwise((F.col("mine") > F.col("with")).cast("int")).alias("side"), "h1", "sketch")

        def look(batches, k=k):
            import numpy as np
            import pyarrow as pa

            def one(t):
                keys = [t.column(i).to_numpy() for i in range(3)]
                group = np.concatenate([[0], np.any([c[1:] != c[:-1] for c in keys], 0).cumsum()])
                h1, sketch = t.column(4).to_numpy(), np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint64).reshape(t.num_rows, -1)
                pairs, there, found = below_nodes(group, t.column(3).to_numpy(), h1, sketch, k, trees, values, threshold)
                seen = np.flatnonzero(there) if k > shortest else np.zeros(0, np.int64)
                u, v = np.array(pairs, np.int64).reshape(-1, 2).T
                a, b = np.concatenate([h1[u], h1[seen]]), pa.array(np.concatenate([h1[v], h1[seen]]), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate([np.zeros(len(u)), there[seen]])), pa.array(np.concatenate([np.zeros(len(u)), found[seen]]))], ["a", "b", "there", "found"])

            kept, size = [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                kept.append(b)
                size += b.num_rows
                last = [b.column(i)[b.num_rows - 1].as_py() for i in range(3)]
                if size < 1 << 15 or [kept[0].column(i)[0].as_py() for i in range(3)] == last:
                    continue
                t = pa.Table.from_batches(kept).combine_chunks()
                own = np.all([t.column(i).to_numpy() == last[i] for i in range(3)], 0)
                cut_at = int(own.argmax())
                yield one(t.slice(0, cut_at))
                rest = t.slice(cut_at).combine_chunks().to_batches()
                kept, size = rest, t.num_rows - cut_at
            if kept:
                yield one(pa.Table.from_batches(kept).combine_chunks())

        rows = gathered(rows.repartition(F.col("node"), F.col("x"), F.col("y")), n, PART_ROWS // 4).sortWithinPartitions("node", "x", "y", "h1")
        got = cut(rows.mapInArrow(look, "a bigint, b bigint, there double, found double"))
        ties.append(got.where("a <> b").select("a", "b"))
        if k > shortest:
            enough = got.where("a = b").groupBy(F.col("a").alias("h1")).agg(F.sum("there").alias("there"), F.sum("found").alias("found")).where(F.col("found") >= recall * F.col("there")).select("h1")
            done = cut(gathered((enough if done is None else enough.unionByName(done.select("h1"))).distinct().withColumn("done", F.lit(True)), n, PART_ROWS))
    out = ties[0]
    for t in ties[1:]:
        out = out.unionByName(t)
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for edges (a, b) of numbers.

    Rounds of large star (each node's larger neighbours are tied to its least) and small star (its smaller ones are),
    until nothing changes: about log of the longest path rounds. A node's minimum is an aggregate with partial sums,
    and the join that follows is one that Spark splits at hot nodes. Each round is checkpointed.
    """
    e = cut(gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), edges.count(), PART_ROWS))

    def sums(x):
        return x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = sums(e)
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        e = cut(gathered(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), last[0], PART_ROWS))
        now = sums(e)
        if now == last:
            break
        last = now
    labels = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return cut(gathered(labels.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()), last[0], PART_ROWS))


def links_within(sets: list, copies, other: int, threshold: float = THRESHOLD):
    """Exact links among texts: (weight of links of each text, least linked text of the text's component).

    sets: shingle sets; those from number `other` on are a second block, and only pairs across the two count (all
    pairs if other is 0). Shingles of two texts at least become columns of a 0/1 matrix; its products count common
    shingles, a slice of columns at a time.
    """
    import numpy as np

    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = new.cumsum() - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    if len(column):
        column = np.concatenate([[0], (column[1:] != column[:-1]).cumsum()])
    common = np.zeros((n, n) if not other else (other, n - other), np.float32)
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [s, s + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(column[y - 1]) - s + 1)), np.float32)
        m[row[x:y], column[x:y] - s] = 1
        common += m[: other or n] @ m[other:].T
    common = np.rint(common).astype(np.int64)
    all_of = size[: other or n, None] + size[None, other:] - common
    linked = common >= np.ceil(threshold * all_of - 1e-9)
    if not other:
        np.fill_diagonal(linked, False)
        weight = linked @ copies
    else:
        weight = np.concatenate([linked @ copies[other:], linked.T @ copies[:other]])
        whole = np.zeros((n, n), bool)
        whole[:other, other:] = linked
        linked = whole | whole.T
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == label).all():
            return weight, label
        label = low


def compare(table, words: int, threshold: float):
    """Rows (h1, h2, links, other) of one candidate group or pair of blocks: `other` is the h1 of a text of the same component."""
    import numpy as np
    import pyarrow as pa

    h1, h2 = table.column("h1").to_pylist(), table.column("h2").to_pylist()
    side, n, data = table.column("side").to_pylist(), table.column("n").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    first = {}
    for i, key in enumerate(zip(h1, h2)):
        first.setdefault(key, i)  # a row that occurs twice counts once
    at = sorted(first.values(), key=lambda i: (side[i], h1[i], h2[i]))
    # Blocks x and y may be one, and by hash either can be without texts; the texts alone don't tell which it is.
    two = table.num_rows > 0 and table.column("x")[0].as_py() != table.column("y")[0].as_py()
    other = sum(side[i] == 0 for i in at) if two else 0
    if two and not 0 < other < len(at) or len(at) < 2:
        return pa.table({k: pa.array([], pa.int64()) for k in ("h1", "h2", "links", "other")})
    weight, label = links_within([shingles(data[i], words) for i in at], np.array([n[i] for i in at], np.int64), other, threshold)
    keep = [k for k in range(len(at)) if weight[k]]
    return pa.table({
        "h1": pa.array([h1[at[k]] for k in keep], pa.int64()), "h2": pa.array([h2[at[k]] for k in keep], pa.int64()),
        "links": pa.array([int(weight[k]) for k in keep], pa.int64()), "other": pa.array([h1[at[label[k]]] for k in keep], pa.int64()),
    })


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_class, h1, h2, first.

    Two rows are linked if the Jaccard similarity of their sets of word shingles is `threshold` at least, or their
    texts are equal. n_links: rows linked with this one. class_id: the least doc_id of all rows that links connect with
    it, n_class their number; first: whether its text holds that least doc_id (the least h1, h2 of such). h1, h2: hash of
    the text. Null texts count as empty; texts without words are linked with equal texts only; null doc_ids come last.

    Equal texts are one node with a count, so copies are never compared, whatever their ids. The LSH forest ties texts
    that share a prefix and whose sketches are alike; texts that ties connect are a candidate group, within which all
    pairs are compared exactly, by products of 0/1 matrices in tasks of two blocks at most (of 512 texts and 8 MB): pairs
    are counted, not made into rows. A pair is missed only if no path of ties brings it into one group.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text"), "bytes": F.octet_length("text").cast("bigint")})

    def make():
        import pyarrow as pa

        def apply(texts):
            labels, sketches = zip(*signatures([shingles(t, words) for t in texts.cast(pa.binary()).to_pylist()], trees, depth))
            return [pa.array(labels, pa.list_(pa.binary())), pa.array(sketches, pa.binary())]

        return apply

    at = fresh_path(spark, "near-dup-signatures")
    append(base, [("labels", "array<binary>"), ("sketch", "binary")], "text", make).drop("text").write.parquet(at)
    signed = spark.read.parquet(at)
    # Copies are one row from here on, dropped before the exchange.
    at = fresh_path(spark, "near-dup-texts")
    once = signed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("bytes").alias("bytes"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    gathered(once, signed.count(), PART_TEXTS).write.parquet(at)
    texts = spark.read.parquet(at)
    copies = texts.drop("labels", "sketch")
    groups = connected(forest(texts.select("h1", "labels", "sketch"), trees, depth, threshold, recall))
    nodes = groups.withColumnRenamed("node", "h1").join(copies, "h1")
    sizes = nodes.groupBy("label").agg(F.greatest(F.count("*") / block, F.sum("bytes") / BLOCK_BYTES).alias("size"))
    nodes = nodes.join(sizes, "label").withColumn("blocks", F.ceil("size").cast("int"))
    nodes = cut(gathered(nodes.withColumn("mine", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int")).drop("size"), groups.count(), PART_ROWS))
    moved = int(nodes.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0)
    # One row of each candidate text, since ids may repeat or be null; then one for each pair of blocks that the text is in.
    chosen = base.join(nodes, (base.h1 == nodes.h1) & (base.h2 == nodes.h2) & base.doc_id.eqNullSafe(nodes.least)).select(nodes.h1, nodes.h2, "label", "blocks", "mine", "n", "text")
    chosen = chosen.groupBy("h1", "h2", "label", "blocks", "mine", "n").agg(F.first("text").alias("text"))
    pairs = chosen.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "h1", "h2", "n", "text", "label", F.least("mine", "with").alias("x"), F.greatest("mine", "with").alias("y"), (F.col("mine") > F.col("with")).cast("int").alias("side")
    )
    found = cut(gathered(pairs.groupBy("label", "x", "y").applyInArrow(lambda t: compare(t, words, threshold), "h1 bigint, h2 bigint, links bigint, other bigint"), moved, BLOCK_BYTES // 4))
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    classes = connected(found.select(F.col("h1").alias("a"), F.col("other").alias("b")))
    whole = copies.join(links, ["h1", "h2"], "left").join(classes.select(F.col("node").alias("h1"), "label"), "h1", "left")
    # Texts without links are classes of their own; the label of any other class is one of its h1.
    alone = whole.where("links IS NULL").select("h1", "h2", F.col("least").alias("class_id"), F.col("n").alias("n_class"), (F.col("n") - 1).alias("n_links"), F.lit(True).alias("first"))
    linked = whole.where("links IS NOT NULL")
    heads = linked.groupBy("label").agg(F.sum("n").alias("n_class"), F.min(F.struct(F.col("least").isNull().alias("o"), "least", "h1", "h2")).alias("head"))
    linked = linked.join(heads, "label").select(
        "h1", "h2", F.col("head.least").alias("class_id"), "n_class", (F.col("links") + F.col("n") - 1).alias("n_links"), ((F.col("h1") == F.col("head.h1")) & (F.col("h2") == F.col("head.h2"))).alias("first")
    )
    return signed.select("doc_id", "h1", "h2").join(alone.unionByName(linked), ["h1", "h2"]).select("doc_id", "class_id", "n_links", "n_class", "h1", "h2", "first")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class of near_duplicates, the one with the least doc_id; of rows that are equal in it and the text, one."""
    box, h1, h2 = (unused(docs, x) for x in ("document_", "h1_", "h2_"))
    found = near_duplicates(docs, doc_id, text, **options)
    heads = cut(found.where("first AND doc_id <=> class_id").select(F.col("class_id").alias("id_"), F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct())
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(box), F.xxhash64(t).alias(h1), F.xxhash64(F.lit(7), t).alias(h2), F.col(f"`{doc_id}`").alias("key_"))
    kept = rows.join(heads, (rows[h1] == heads[h1]) & (rows[h2] == heads[h2]) & rows["key_"].eqNullSafe(heads["id_"])).select(rows[h1], rows[h2], "id_", box)
    return gathered(kept.groupBy(h1, h2, "id_").agg(F.first(box).alias(box)).select(f"{box}.*"), heads.count(), PART_TEXTS)


def op8_near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: class id, number of links and size of the class."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_class")
