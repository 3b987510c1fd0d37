"""Product quantisation: codebooks, codes, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.functions import vectors as V
from vecloom.session import checked


def load_codebook(codebook: DataFrame):
    """(m, ksub, dsub) array of codebook (m, k, w). Its size is a parameter of the index."""
    import numpy as np

    rows = sorted((r["m"], r["k"], list(r["w"])) for r in codebook.select("m", "k", "w").collect())
    if not rows:
        raise ValueError("the codebook is empty")
    m, k = rows[-1][0] + 1, max(r[1] for r in rows) + 1
    if len(rows) != m * k:
        raise ValueError("the codebook lacks words")
    w = np.array([r[2] for r in rows], np.float64).reshape(m, k, -1)
    checked(w.nbytes, "codebook")
    return w


def encode(df: DataFrame, codebook: DataFrame, r: str = "r", out: str = "code") -> DataFrame:
    """df with the code of column r: for each part the nearest word, the lowest at ties. One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(load_codebook(codebook))
    names = [c for c in df.columns if c != out]
    at = names.index(r)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != out) + f", {out} array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value.shape[0]
        for b in batches:
            if b.num_rows:
                code = kernels.encode(kernels.matrix(b.column(at)), shared.value).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, m, dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def remainders(df: DataFrame, codebook: DataFrame, r: str = "r", code: str = "code", out: str = "rest") -> DataFrame:
    """df with what its codes leave over of column r: r less the words of its code. One pass, no shuffle."""
    kind = V.kind_of((df, r), (codebook, "w"))
    shared = df.sparkSession.sparkContext.broadcast(load_codebook(codebook))
    names = [c for c in df.columns if c != out]
    at, by = names.index(r), names.index(code)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != out) + f", {out} array<{kind}>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x = kernels.matrix(b.column(at)) - kernels.decode(kernels.matrix(b.column(by), "int64"), shared.value)
                x = x.astype(np.int64) if kind == "bigint" else x
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, out])

    return df.select(*names).mapInArrow(run, schema)


def quantize_codebook(codebook: DataFrame, scale: float = 1.0) -> DataFrame:
    """Words as numbers of eight bits: scaled, truncated toward zero, clamped."""
    return codebook.withColumn("w", V.clamp_int8(V.quantize(F.col("w"), scale)))


def codebook_range(codebook: DataFrame) -> DataFrame:
    return codebook.select(F.explode("w").alias("x")).agg(F.min("x").alias("min_w"), F.max("x").alias("max_w"))


def addresses(codes: DataFrame, ksub: int) -> DataFrame:
    return codes.withColumn("address", V.code_address(F.col("code"), ksub))


def tables(queries: DataFrame, codebook: DataFrame, r: str = "r", metric: str = "l2", out: str = "lut") -> DataFrame:
    """df with the table of column r: entry m * ksub + k is the squared distance (ip: the product) of part m and word k, whole where both are."""
    kind = V.kind_of((queries, r), (codebook, "w"))
    shared = queries.sparkSession.sparkContext.broadcast(load_codebook(codebook))
    names = [c for c in queries.columns if c != out]
    at = names.index(r)
    schema = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes if n != out) + f", {out} array<{kind}>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                t = kernels.lut(kernels.matrix(b.column(at)), shared.value, metric)
                t = np.rint(t).astype(np.int64) if kind == "bigint" else t
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, t.shape[1], dtype=np.int32)), pa.array(t.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, out])

    return queries.select(*names).mapInArrow(run, schema)
