"""Vector files as a Spark data source: spark.read.format("vecs").option("kind", "fvecs").load(path).

kind: fvecs, ivecs, bvecs (each record has its dimension before its values), fbin, ibin, i8bin (a header of count and
dimension), truth (a header, all ids, then all distances). Options start and limit read a range of records; records
are dealt to tasks by byte ranges. Columns: id (record number over the files in order of name), v; truth: id, ids, dists.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from contextlib import ExitStack
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Element's numpy type, Spark element type, whether each record has a dimension before it.
KINDS = {
    "fvecs": ("<f4", "float", True), "ivecs": ("<i4", "int", True), "bvecs": ("u1", "smallint", True),
    "fbin": ("<f4", "float", False), "ibin": ("<i4", "int", False), "i8bin": ("i1", "tinyint", False), "truth": ("<i4", "int", False),
}
#: Bytes that one task reads, about.
SPLIT = 64 << 20


def _fs(path: str):
    """(pyarrow file system, path) of a local path or of a URI that pyarrow knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}") if scheme == "file" else fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    f, p = _fs(path)
    info = f.get_file_info(p)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"{path}: no such file")
    if info.is_file:
        return [(p, info.size)]
    found = [x for x in f.get_file_info(fs.FileSelector(p)) if x.is_file and x.base_name[0] not in "._"]
    return [(x.path, x.size) for x in sorted(found, key=lambda x: x.path)]


def layout(kind: str, path: str, size: int, head: bytes) -> tuple[int, int, int]:
    """(records, dimension, bytes before the first record); a file that doesn't add up is refused."""
    import numpy as np

    item, own = np.dtype(KINDS[kind][0]).itemsize, KINDS[kind][2]
    if own:
        if not size:
            return 0, 0, 0
        if len(head) < 4:
            raise ValueError(f"{path}: no header")
        d = struct.unpack("<i", head[:4])[0]
        n, rest = divmod(size, 4 + d * item) if 0 < d < 1_000_000 else (0, 0)
        first = 0
    else:
        if len(head) < 8:
            raise ValueError(f"{path}: no header")
        n, d = struct.unpack("<ii", head[:8])
        rest, first = size - 8 - n * d * item * (2 if kind == "truth" else 1), 8
    if not 0 < d < 1_000_000:
        raise ValueError(f"{path}: dimension {d}")
    if rest or n < 0:
        raise ValueError(f"{path}: {size} bytes are no whole number of records")
    return n, d, first


class Range(InputPartition):
    def __init__(self, file: str, n: int, d: int, first: int, a: int, b: int, ident: int):
        self.file, self.n, self.d, self.first, self.a, self.b, self.ident = file, n, d, first, a, b, ident


class Reader(DataSourceReader):
    def __init__(self, options):
        self.kind, self.path = options.get("kind", "fvecs"), options["path"]
        self.start, self.limit = int(options.get("start", 0)), int(options.get("limit", -1))
        if self.kind not in KINDS:
            raise ValueError(f"kind {self.kind!r}: one of {', '.join(KINDS)}")

    def partitions(self):
        import numpy as np

        f, _ = _fs(self.path)
        out, seen = [], 0
        stop = self.start + self.limit if self.limit >= 0 else float("inf")
        for file, size in _files(self.path):
            with f.open_input_file(file) as h:
                n, d, first = layout(self.kind, file, size, h.read(8))
            step = max(1, SPLIT // (4 + d * np.dtype(KINDS[self.kind][0]).itemsize)) if d else 1
            a, b = max(0, self.start - seen), min(n, stop - seen)
            out += [Range(file, n, d, first, x, int(min(b, x + step)), seen + x) for x in range(a, int(max(a, b)), step)]
            seen += n
        return out or [Range("", 0, 1, 0, 0, 0, 0)]

    def read(self, p: Range):
        import numpy as np
        import pyarrow as pa

        if not p.file:
            return
        kind, _, own = KINDS[self.kind]
        item, (f, _) = np.dtype(kind).itemsize, _fs(self.path)
        wide = {"u1": pa.int16(), "i1": pa.int8(), "<i4": pa.int32(), "<f4": pa.float32()}

        def lists(x, to):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, p.d, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()).cast(to))

        with f.open_input_file(p.file) as h:
            for a in range(p.a, p.b, 10_000):
                b = min(p.b, a + 10_000)
                width = (4 if own else 0) + p.d * item
                raw = np.frombuffer(h.read_at((b - a) * width, p.first + a * width), np.uint8).reshape(b - a, width)
                if own:
                    if (raw[:, :4].copy().view("<i4") != p.d).any():
                        raise ValueError(f"{p.file}: records have different dimensions")
                    raw = raw[:, 4:]
                columns = [pa.array(np.arange(p.ident + a - p.a, p.ident + b - p.a)), lists(raw.copy().view(kind), wide[kind])]
                if self.kind == "truth":
                    far = np.frombuffer(h.read_at((b - a) * p.d * 4, 8 + (p.n + a) * p.d * 4), "<f4")
                    columns.append(lists(far, pa.float32()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "dists"] if self.kind == "truth" else ["id", "v"])


class Written(WriterCommitMessage):
    def __init__(self, task: int, file: str):
        self.task, self.file = task, file


class Writer(DataSourceArrowWriter):
    """A file per task, of any kind; ids aren't stored, record numbers are read as such.

    A task writes a hidden file; the commit gives the files of all tasks names that follow those in the folder, in the
    tasks' order, so an append comes after what is there. Kinds with a header get it when the task knows its count: the
    values lie in a hidden file till then (truth: ids and distances in one each) and are copied after it, a block at a
    time. An abort takes the hidden files away, and so does a commit with those of attempts that failed.
    """

    COPIED = 8 << 20

    def __init__(self, options, overwrite: bool):
        self.kind, self.path, self.overwrite, self.job = options.get("kind", "fvecs"), options["path"], overwrite, uuid.uuid4().hex
        if self.kind not in KINDS:
            raise ValueError(f"kind {self.kind!r}: one of {', '.join(KINDS)}")

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        from vecloom.functions import kernels

        f, p = _fs(self.path)
        f.create_dir(p)
        (kind, _, own), task, n, d = KINDS[self.kind], TaskContext.get(), 0, None
        columns = {"ids": np.dtype("<i4"), "dists": np.dtype("<f4")} if self.kind == "truth" else {"v": np.dtype(kind)}
        file = f"{p}/_{self.job}-{task.taskAttemptId()}"
        values = [file] if own else [f"{file}-{c}" for c in columns]
        with ExitStack() as opened:
            out = [opened.enter_context(f.open_output_stream(x)) for x in values]
            for b in batches:
                if not b.num_rows:
                    continue
                for h, (name, kind) in zip(out, columns.items()):
                    column = b.column(b.schema.get_field_index(name))
                    if column.null_count or column.flatten().null_count:
                        raise ValueError("vectors and their elements can't be null")
                    if len(sizes := set(np.diff(column.offsets.to_numpy()).tolist()) | ({d} if d else set())) > 1:
                        raise ValueError(f"vectors have different dimensions: {sorted(sizes)[:2]}")
                    v = kernels.matrix(column, kind)
                    if kind.kind in "iu" and (v != kernels.matrix(column)).any():
                        raise ValueError(f"{self.kind} can't hold all elements")
                    d = v.shape[1]
                    rows = np.empty((len(v), (4 if own else 0) + d * kind.itemsize), np.uint8)
                    if own:
                        rows[:, :4] = np.frombuffer(struct.pack("<i", d), np.uint8)
                    rows[:, 4 if own else 0 :] = np.ascontiguousarray(v).view(np.uint8).reshape(len(v), -1)
                    h.write(rows.tobytes())
                n += b.num_rows
        if not own and n:
            with f.open_output_stream(file) as h:
                h.write(struct.pack("<ii", n, d))
                for x in values:
                    with f.open_input_stream(x) as v:
                        while block := v.read(self.COPIED):
                            h.write(block)
        if not own:
            for x in values:
                f.delete_file(x)
        return Written(task.partitionId(), file if own or n else "")

    def commit(self, messages) -> None:
        f, p = _fs(self.path)
        there = [file for file, _ in _files(self.path)]
        if self.overwrite:
            for file in there:
                f.delete_file(file)
            there = []
        batch = max((int(m[1]) for x in there if (m := re.search(r"/part-(\d+)-\d+\.\w+$", x))), default=-1) + 1
        for m in sorted((m for m in messages if m and m.file), key=lambda m: m.task):
            f.move(m.file, f"{p}/part-{batch:05d}-{m.task:05d}.{self.kind}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        f, p = _fs(self.path)
        if f.get_file_info(p).type == fs.FileType.Directory:
            for x in f.get_file_info(fs.FileSelector(p)):
                if x.base_name.startswith(f"_{self.job}"):
                    f.delete_file(x.path)


class Vecs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        kind = KINDS[self.options.get("kind", "fvecs")][1]
        return "id bigint, ids array<int>, dists array<float>" if self.options.get("kind") == "truth" else f"id bigint, v array<{kind}>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: one without is in the default file system of Spark's configuration, as for Spark's own sources."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().replace("file:/", "file:///", 1)


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs", start: int = 0, limit: int = -1) -> DataFrame:
    spark.dataSource.register(Vecs)
    return spark.read.format("vecs").option("kind", kind).option("start", start).option("limit", limit).load(qualified(spark, path))


def write_vecs(df: DataFrame, path: str, kind: str = "fvecs", mode: str = "append") -> None:
    """df (v; truth: ids, dists), in the order of its partitions. mode append: after the records that are there; overwrite: in their place."""
    df.sparkSession.dataSource.register(Vecs)
    df.select(*(("ids", "dists") if kind == "truth" else ("v",))).write.format("vecs").option("kind", kind).mode(mode).save(qualified(df.sparkSession, path))
