"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import documents, unused

#: Documents of a cell, the part of a shard that one task permutes.
CELL_ROWS = 16_384
#: Cells of all shards together, at most; beyond that they grow with the rows.
MOST_CELLS = 8192


def hypergeometric(good: int, bad: int, draws: int, rng) -> int:
    """Good ones among `draws` without replacement, exact for counts of any size (numpy's stops at 1e9)."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    u, up, down = rng.random() - p, (mode, p), (mode, p)
    while u > 0 and (up[0] < high or down[0] > low):  # from the mode outwards
        if up[0] < high:
            k, q = up
            up = (k + 1, q * (good - k) / (k + 1) * (draws - k) / (bad - draws + k + 1))
            u -= up[1]
            if u <= 0:
                return up[0]
        if down[0] > low:
            k, q = down
            down = (k - 1, q * k / (good - k + 1) * (bad - draws + k) / (draws - k + 1))
            u -= down[1]
            if u <= 0:
                return down[0]
    return mode


def _split(cells, draws: int, rng):
    """How many of `draws` rows, drawn from the cells' rows without replacement, each cell gives."""
    import numpy as np

    if int(cells.sum()) < 10**9:
        return rng.multivariate_hypergeometric(cells, draws, method="marginals") if draws else np.zeros_like(cells)
    out, left = np.zeros_like(cells), int(cells.sum())
    for i, n in enumerate(cells.tolist()):
        left -= n
        out[i] = hypergeometric(n, left, draws, rng)
        draws -= int(out[i])
    return out


class Matrix:
    """The communication matrix, row by row: rows of each partition that go to each cell, as a uniform permutation deals them.

    Row sums are the partitions' counts and column sums the cells' sizes, exactly. The partitions are halved in turn,
    as in a tree; at each node one multivariate hypergeometric draw tells what of each cell comes from the left half.
    A node's draw depends on the seed and the node alone, so any task finds its own row in as many draws as the tree
    is high, and no one holds the whole matrix. Draws for nodes of 1e9 rows and more are slow, and few: the driver
    makes them once.
    """

    def __init__(self, rows: list[int], cells: list[int], seed: int):
        import numpy as np

        assert sum(rows) == sum(cells)
        self.seed, self.cells, self.large = seed, np.array(cells, np.int64), {}
        self.upto = np.concatenate([[0], np.cumsum(np.array(rows, np.int64))])
        todo = [(0, len(rows), self.cells)]
        while todo:
            a, b, v = todo.pop()
            if b - a > 1 and int(v.sum()) >= 10**9:
                m = (a + b) // 2
                self.large[(a, b)] = left = self._left(a, b, v)
                todo += [(a, m, left), (m, b, v - left)]

    def _left(self, a: int, b: int, v):
        import numpy as np

        if (a, b) in self.large:
            return self.large[(a, b)]
        return _split(v, int(self.upto[(a + b) // 2] - self.upto[a]), np.random.default_rng([self.seed, 0, a, b]))

    def row(self, p: int):
        """(rows of partition p for each cell, rows of all partitions before it for each cell)."""
        a, b, v, before = 0, len(self.upto) - 1, self.cells, self.cells * 0
        while b - a > 1:
            m, left = (a + b) // 2, self._left(a, b, v)
            if p < m:
                b, v = m, left
            else:
                a, v, before = m, v - left, before + left
        return v, before


def shuffle_to_shards(df: DataFrame, shards: int = 8, seed: int = 17, cell_rows: int = CELL_ROWS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All rows of df with shard (0 to shards - 1) and slot (gapless from 0 there), uniformly shuffled, in slot order within tasks.

    Shards' row counts differ by one at most. A shard is made of cells of about cell_rows rows (more where there would
    be over MOST_CELLS), each permuted by one task, which holds a number for each row but not the rows. A first job
    counts the rows of each partition; these counts are broadcast, and each task draws its row of the matrix of exact
    counts from partitions to cells. Partitions permute their rows and deal them out; cells permute again. Draws depend
    on the seed and the partition's or cell's number only, so a task that runs again sends the same rows. df must give
    the same partitions whenever it is computed, as a scan of files or a checkpoint does. Nulls, ties and repeated rows
    are rows as any other; an empty df stays empty. Columns named as the new ones are replaced.
    """
    names = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    counts = {r[0]: r[1] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}  # one row a partition
    total = sum(counts.values())
    per = [total // shards + (s < total % shards) for s in range(shards)]
    cells: list[tuple[int, int, int]] = []  # shard, first slot, size
    for s, n in enumerate(per):
        k = min(max(1, -(-n // cell_rows)), max(1, MOST_CELLS // shards))
        for i in range(k):
            cells.append((s, n * i // k, n * (i + 1) // k - n * i // k))
    parts = sorted(counts)
    place = {p: i for i, p in enumerate(parts)}
    plan = df.sparkSession.sparkContext.broadcast((place, Matrix([counts[p] for p in parts], [c[2] for c in cells], seed)))
    cell, index = unused(df, "cell"), unused(df, "row_in_cell")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        p, at = TaskContext.get().partitionId(), 0
        place, matrix = plan.value
        if p not in place:
            return
        send, start = matrix.row(place[p])
        order = np.random.default_rng([seed, 1, p]).permutation(int(send.sum()))
        ends = send.cumsum()
        for b in batches:
            spot = order[at : at + b.num_rows]
            at += b.num_rows
            to = np.searchsorted(ends, spot, side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to.astype(np.int32)), pa.array(spot - (ends - send)[to] + start[to])], [*names, cell, index])

    def settle(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        c = TaskContext.get().partitionId()
        order = None
        for b in batches:
            if order is None:
                s, first, size = cells[c]
                order = np.random.default_rng([seed, 2, c]).permutation(size) + first
            at = b.column(len(names) + 1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(np.full(b.num_rows, s, np.int32)), pa.array(order[at])], [*names, shard, slot])

    dealt = df.mapInArrow(deal, f"{kinds}, `{cell}` int, `{index}` bigint")
    return dealt.repartitionById(len(cells), F.col(f"`{cell}`")).mapInArrow(settle, f"{kinds}, `{shard}` int, `{slot}` bigint").sortWithinPartitions(slot)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `rows`. Whole rows, all columns, are exchanged; the digest is of what arrives."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_to_shards(documents(spark, sf_dir)).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
