"""Cost-balanced packing of documents into fixed-length sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import documents
from vecloom.llm.tokens import encoder, tokenizer_path

#: Bytes of texts whose ids are packed together. Ids take about as many bytes, four times as many at most.
GROUP_BYTES = 8 << 20
#: Groups that one task packs, one after the other: it holds one at a time, so tasks needn't be as many as groups.
TASK_GROUPS = 64
#: Groups whose sequences have numbers of their own; beyond (67 TB of text) groups grow.
MOST_GROUPS = (1 << 23) - 1
#: Chunks of a generation that the encoder remembers here, less than where nothing but ids is made.
REMEMBERED = 320_000


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as ids plus end_id, cut every `capacity` ids: doc_id, start, length, doc_tokens, ids (binary, unsigned 32-bit)."""
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def run(batches):
        import pyarrow as pa

        enc, last = encoder(path, REMEMBERED), int(end_id).to_bytes(4, "little")
        for b in batches:
            kinds = [b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            rows: list[tuple] = []
            size = 0
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(t.as_py()) + last
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    piece = ids[4 * s : 4 * (s + capacity)]
                    rows.append((key, s, len(piece) // 4, n, piece))
                size += len(ids)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")


def assign(lengths, capacity: int, linear: float, quadratic: float):
    """(sequence, offset) of each piece: pieces in descending length go to the sequence of least cost among those with room.

    A piece of n tokens costs linear * n + quadratic * n * n, as attention within a document does. Sequences with the
    same free space share a heap by (cost, number); a segment tree over free space finds the least cost among those
    with room in O(log capacity). There are as many sequences at first as the tokens need; where a piece finds no
    room, one more opens. Ties go to the lowest number; pieces of equal length keep their order.
    """
    import heapq

    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    width = 1 << int(capacity).bit_length()
    none = (float("inf"), -1)
    tree = [none] * (2 * width)
    heaps: list[list] = [[] for _ in range(capacity + 1)]

    def fix(free: int) -> None:
        i = width + free
        tree[i] = heaps[free][0] if heaps[free] else none
        i >>= 1
        while i:
            best = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
            i >>= 1

    def least(free: int):
        i, best = width + free, none
        while i:
            if tree[i] < best:
                best = tree[i]
            while i & 1:
                i >>= 1
            if not i:
                break
            i += 1
        return best

    used: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def put(piece: int, n: int, seq: int, cost: float) -> None:
        sequence[piece], offset[piece] = seq, used[seq]
        used[seq] += n
        if free := capacity - used[seq]:
            heapq.heappush(heaps[free], (cost + linear * n + quadratic * n * n, seq))
            fix(free)

    first = -(-int(lengths.sum()) // capacity)
    whole = int((lengths == capacity).sum())
    used = [0] * first
    for seq in range(whole, first):
        heaps[capacity].append((0.0, seq))
    heapq.heapify(heaps[capacity])
    fix(capacity)
    for k, piece in enumerate(order.tolist()):
        n = int(lengths[piece])
        if k < whole:
            put(piece, n, k, 0.0)
            continue
        cost, seq = least(n)
        if seq < 0:
            used.append(0)
            put(piece, n, len(used) - 1, 0.0)
            continue
        free = capacity - used[seq]
        heapq.heappop(heaps[free])
        fix(free)
        put(piece, n, seq, cost)
    return sequence, offset


def pack(pieces: DataFrame, groups: int, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 1024, keep_ids: bool = True, tasks: int | None = None) -> DataFrame:
    """pieces with ids_crc32, sequence_id and offset; each of `groups` hash groups is packed by itself.

    Pieces are exchanged with their ids, so a task holds whole sequences; it gives the rows of a sequence one after
    the other, by offset. length and ids_crc32 are those of the ids that arrived there. With keep_ids false the ids
    are left out at the end. A task gets several groups in order, TASK_GROUPS at most, and holds one at a time; fewer
    where the cluster has room for more tasks. Their number changes nothing in the rows.

    sequence_id is the group's number times 2^40 plus the sequence's number there. Rows are put in order first, so a
    task that runs again gives the same sequences. Pieces are spread by a hash of the whole row: one document's many
    pieces go to many groups. Rows equal in all columns (repeated null ids, say) stay together and are told apart only
    by their order.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]
    df = pieces.select(*names, F.pmod(F.xxhash64(*names), F.lit(groups)).cast("int").alias("pack_group"))
    kind = df.schema["doc_id"].dataType.simpleString()
    tasks = tasks or max(-(-groups // TASK_GROUPS), min(groups, 4 * df.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, of = [], None
        for b in batches:
            group = b.column(5).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and group[lo] != of:
                    yield from packed(held, of)
                    held = []
                of = int(group[lo])
                held.append(pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in b.columns[:5]], names))
        if held:
            yield from packed(held, of)

    def packed(held, group):
        import zlib

        import numpy as np
        import pyarrow as pa

        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids = table.column(4).chunk(0)
        ends = np.frombuffer(ids.buffers()[1], np.int32 if pa.types.is_binary(ids.type) else np.int64)[ids.offset : ids.offset + len(ids) + 1]
        seq, off = assign(np.diff(ends) // 4, capacity, linear, quadratic)
        first, order = np.int64(group) << 40, np.lexsort((off, seq))
        for s in range(0, len(order), 1000):
            at = order[s : s + 1000]
            doc, start, _, doc_tokens, ids = table.take(pa.array(at)).combine_chunks().to_batches()[0].columns
            held = ids.to_pylist()
            length, crc = (pa.array([f(x) for x in held], pa.int64()) for f in (lambda x: len(x) // 4, zlib.crc32))
            columns = {"doc_id": doc, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": doc_tokens}
            columns |= ({"ids": ids} if keep_ids else {}) | {"sequence_id": pa.array(seq[at] + first), "offset": pa.array(off[at])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    spread = df.repartitionById(tasks, F.col("pack_group") % tasks)
    kinds = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, " + "ids binary, " * keep_ids + "sequence_id bigint, offset bigint"
    return spread.sortWithinPartitions("pack_group", F.desc("length"), *names).mapInArrow(run, kinds)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Packs all documents: one row per piece with its ids, their ids_crc32, its sequence_id and offset there.

    A null or empty text is its end id alone. Null and repeated doc_ids are kept as they are. An empty table packs into
    no sequences. Columns besides doc_id and text are left out.
    """
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = df.agg(F.sum(F.octet_length("text").cast("bigint") + 1)).first()[0] or 0
    return pack(pieces(df, path, capacity, end_id), max(1, min(MOST_GROUPS, -(-size // GROUP_BYTES))), capacity, keep_ids=keep_ids)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row per piece with its ids."""
    return pack_documents(documents(spark, sf_dir), tokenizer_path())
