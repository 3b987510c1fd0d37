"""Frequent combinations of codes: mining, re-encoding, tables of partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.session import checked

#: Items of a line; a table has a sum for each subset of them.
SLOTS = 4
#: Frequent pairs of a cluster that mining looks at, for each line that it may make.
PAIRS_PER_LINE = 16
#: Elements of a block of comparisons in a worker.
CELLS = 1 << 22


def items(codes: DataFrame) -> DataFrame:
    return codes.select("cid", "id", F.posexplode("code").alias("m", "k"))


def pairs(codes: DataFrame) -> DataFrame:
    """(cid, m1, k1, m2, k2, n): how often two codes occur together in vectors of a cluster. m * (m - 1) / 2 pairs a vector, counted before the shuffle."""
    at = F.transform("code", lambda k, m: F.struct(m.alias("m"), k.alias("k")))
    both = F.flatten(F.transform(at, lambda x: F.transform(F.filter(at, lambda y: y["m"] > x["m"]), lambda y: F.struct(x["m"].alias("m1"), x["k"].alias("k1"), y["m"].alias("m2"), y["k"].alias("k2")))))
    return codes.select("cid", F.explode(both).alias("p")).groupBy("cid", "p.m1", "p.k1", "p.m2", "p.k2").agg(F.count("*").alias("n"))


def modal_lines(codes: DataFrame) -> DataFrame:
    """(cid, line, slot, m, k): line j of a cluster is made of the most frequent codes of sub-quantisers 4j to 4j + 3."""
    counts = items(codes).groupBy("cid", "m", "k").agg(F.count("*").alias("n"))
    top = counts.groupBy("cid", "m").agg(F.min(F.struct((-F.col("n")).alias("o"), "k"))["k"].alias("k"))
    return top.select("cid", F.expr(f"m div {SLOTS}").alias("line"), F.expr(f"m % {SLOTS}").alias("slot"), "m", "k")


def mine_lines(codes: DataFrame, most: int = 256, least: int = 2) -> DataFrame:
    """Lines from frequent pairs: a pair that occurs `least` times or more, with the two codes that most often go with
    all its codes so far (ties: the lowest). Of each cluster the PAIRS_PER_LINE * most most frequent pairs are looked
    at; Spark cuts them on both sides of the shuffle, so a task gets a bounded number of each cluster.
    """
    by = W.partitionBy("cid").orderBy(F.desc("n"), "m1", "k1", "m2", "k2")
    frequent = pairs(codes).where(F.col("n") >= least).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= PAIRS_PER_LINE * most).drop("rank")

    def one(table):
        import pyarrow as pa

        n: dict = {}
        for r in table.to_pylist():
            n[(r["m1"], r["k1"]), (r["m2"], r["k2"])] = r["n"]
        near: dict = {}
        for (a, b), c in n.items():
            near.setdefault(a, {})[b] = c
            near.setdefault(b, {})[a] = c
        out, seen, cid = [], set(), table.column("cid")[0].as_py()
        for (a, b), _ in sorted(n.items(), key=lambda x: (-x[1], x[0])):
            if len(seen) == most:
                break
            line = [a, b]
            while len(line) < SLOTS:
                more = {x: min(near[y].get(x, 0) for y in line) for x in near[a] if x[0] not in {y[0] for y in line}}
                best = max(sorted(more), key=more.get, default=None)
                if best is None:
                    break
                line.append(best)
            key = tuple(sorted(line))
            if len(key) == SLOTS and key not in seen:
                out += [(cid, len(seen), s, m, k) for s, (m, k) in enumerate(key)]
                seen.add(key)
        return pa.table([pa.array(c, pa.int64() if i == 0 else pa.int32()) for i, c in enumerate(zip(*out))] if out else [pa.array([], pa.int64() if i == 0 else pa.int32()) for i in range(5)], names=["cid", "line", "slot", "m", "k"])

    return frequent.groupBy("cid").applyInArrow(one, "cid bigint, line int, slot int, m int, k int")


def load_lines(lines: DataFrame) -> dict:
    """Lines of each cluster: cid to (line numbers, sub-quantiser of each slot, code of each slot); -1 in empty slots.

    At most nlist * most * SLOTS rows by the parameters of index and mining; their bytes are checked.
    """
    import numpy as np

    t = lines.select(*(F.col(c).cast("bigint") for c in ("cid", "line", "slot", "m", "k"))).toArrow()
    cid, line, slot, m, k = (t.column(i).to_numpy() for i in range(5))
    checked(4 * cid.nbytes, "lines")
    order, out = np.argsort(cid, kind="stable"), {}
    cids, first = np.unique(cid[order], return_index=True)
    for c, on in zip(cids.tolist(), np.split(order, first[1:])):
        names, at = np.unique(line[on], return_inverse=True)
        ms, ks = np.full((len(names), SLOTS), -1, np.int64), np.full((len(names), SLOTS), -1, np.int64)
        ms[at, slot[on]], ks[at, slot[on]] = m[on], k[on]
        out[c] = (names, ms, ks)
    return out


def match(code, lines: tuple, ksub: int):
    """(flat addresses, addresses of each row, combinations of each row) of codes (n, m) of one cluster with its lines.

    Lines come in order of their matches with the whole code, then of their number; one takes the matching codes that
    are still free if these are two at least.
    """
    import numpy as np

    names, ms, ks = lines
    n, m = code.shape
    free, cached = np.ones((n, m), bool), np.full((n, 0), -1, np.int64)
    if len(names):
        hit = (code[:, ms.clip(0)] == ks) & (ms >= 0)
        count = hit.sum(2)
        order = np.argsort(-count, axis=1, kind="stable")
        rounds = int((count >= 2).sum(1).max(initial=0))
        cached, every = np.full((n, rounds), -1, np.int64), np.arange(n)
        for r in range(rounds):
            j = order[:, r]
            on = hit[every, j] & free[every[:, None], ms[j].clip(0)]
            on &= ((on.sum(1) > 1) & (count[every, j] >= 2))[:, None]
            row, slot = np.nonzero(on)
            free[row, ms[j[row], slot]] = False
            mask = (on << np.arange(SLOTS)).sum(1)
            cached[:, r] = np.where(mask > 0, m * ksub + (names[j] << SLOTS) + mask, -1)
    hits = (cached >= 0).sum(1)
    both = np.concatenate([np.where(free, code + np.arange(m) * ksub, -1), np.sort(cached, axis=1)], 1)
    return both[both >= 0], (both >= 0).sum(1), hits


def encode(codes: DataFrame, lines: DataFrame, m: int, ksub: int) -> DataFrame:
    """(cid, id, address, cached): addresses of plain codes and of combinations; lossless for distances.

    Codes of a vector that two or more slots of one line match become the address of that subset of the line, m * ksub +
    16 * line + mask; a code that lines share goes to the one with most matches, then the lowest. Lines are broadcast
    once, under a checked size; vectors aren't shuffled, and the rows of a cluster in a batch are matched together.
    """
    shared = codes.sparkSession.sparkContext.broadcast(load_lines(lines))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        none = (np.zeros(0, np.int64), np.zeros((0, SLOTS), np.int64), np.zeros((0, SLOTS), np.int64))
        for b in batches:
            if not b.num_rows:
                continue
            cid, code = b.column(0).to_numpy(), kernels.matrix(b.column(2), "int64")
            order = np.argsort(cid, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(cid[order]) != 0, [True]]))
            flat, sizes, hits = [], [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                mine = shared.value.get(int(cid[order[lo]]), none)
                step = max(1, CELLS // max(1, len(mine[0]) * SLOTS))
                for s in range(lo, hi, step):
                    for got, part in zip((flat, sizes, hits), match(code[order[s : min(hi, s + step)]], mine, ksub)):
                        got.append(part)
            offsets = np.concatenate([[0], np.concatenate(sizes).cumsum()])
            address = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
            rows = pa.array(order)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), address, pa.array(np.concatenate(hits), pa.int32())], ["cid", "id", "address", "cached"])

    return codes.select(F.col("cid").cast("bigint").alias("cid"), "id", "code").mapInArrow(run, "cid bigint, id bigint, address array<int>, cached int")


def line_sums(luts: DataFrame, lines: DataFrame, ksub: int) -> DataFrame:
    """(qid, cid, line, mask, s): sums of table entries for each subset of a line, for tables (qid, cid, lut)."""
    at = luts.join(lines, "cid").select("qid", "cid", "line", "slot", F.get("lut", F.col("m") * ksub + F.col("k")).alias("x"))
    masks = at.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << SLOTS) - 1))))
    bit = F.expr("shiftright(mask, slot) & 1")
    return masks.groupBy("qid", "cid", "line", "mask").agg(F.sum(F.col("x") * bit).alias("s"))


def scan(encoded: DataFrame, luts: DataFrame, sums: DataFrame, m: int, ksub: int) -> DataFrame:
    """(qid, id, dist) from re-encoded vectors: as many additions as addresses."""
    kind = luts.schema["lut"].dataType.elementType.simpleString()
    tail = sums.groupBy("qid", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "mask", "s"))), lambda x: x["s"]).alias("tail"))
    table = luts.join(tail, ["qid", "cid"], "left").select("qid", "cid", F.concat("lut", F.coalesce("tail", F.array().cast(f"array<{kind}>"))).alias("table"))
    return encoded.join(table, "cid").select("qid", "id", F.aggregate("address", F.lit(0).cast(kind), lambda s, a: s + F.get("table", a)).alias("dist"))


def hit_rate(encoded: DataFrame) -> DataFrame:
    """One row: vectors, vectors with a combination, additions saved."""
    return encoded.agg(F.count("*").alias("n_vectors"), F.sum((F.col("cached") > 0).cast("bigint")).alias("n_hit"), F.sum(F.size("address").cast("bigint")).alias("n_adds"))
