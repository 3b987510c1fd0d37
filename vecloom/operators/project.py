"""Projection of vectors on a few axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import kernels
from vecloom.session import checked

#: Number of the row of an axes table that holds the vectors' mean.
MEAN = -1


def principal_axes(sample: DataFrame, n: int, v: str = "v") -> DataFrame:
    """(axis, w): the n axes of greatest variance of a bounded sample, axis from 0, and its mean as axis MEAN."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    f = sample.select(array_to_vector(F.col(v).cast("array<double>")).alias("f"))
    d = len(f.first()["f"])
    if n > d:
        raise ValueError(f"vectors of {d} dimensions have no {n} axes")
    pc = PCA(k=n, inputCol="f", outputCol="p").fit(f).pc.toArray()  # d rows, a parameter
    mean = f.select(Summarizer.mean(F.col("f")).alias("m")).first()["m"].toArray()
    rows = [(MEAN, mean.tolist()), *((i, pc[:, i].tolist()) for i in range(n))]
    return sample.sparkSession.createDataFrame(rows, "axis int, w array<double>")


def load_axes(axes: DataFrame):
    """(mean, matrix with a row for each axis). Their size is a parameter of the index."""
    import numpy as np

    rows = {r["axis"]: list(r["w"]) for r in axes.select("axis", "w").collect()}
    if sorted(rows) != list(range(MEAN, len(rows) - 1)):
        raise ValueError("the axes lack some")
    w = np.array([rows[i] for i in range(len(rows) - 1)], np.float64)
    checked(w.nbytes, "axes")
    return np.array(rows[MEAN], np.float64), w


def project(vectors: DataFrame, axes: DataFrame, v: str = "v") -> DataFrame:
    """vectors with column v as the products of v less the mean with each axis, as doubles. One pass, no shuffle.

    A row's numbers don't depend on the rows beside it, so equal vectors have equal projections.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(load_axes(axes))
    names = vectors.columns
    at = names.index(v)
    schema = ", ".join(f"`{n}` {'array<double>' if n == v else t}" for n, t in vectors.dtypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        mean, w = shared.value
        for b in batches:
            if b.num_rows:
                x = kernels.matrix(b.column(at)) - mean
                x = np.stack([(x * a).sum(1) for a in w], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(b.columns)], names)

    return vectors.mapInArrow(run, schema)
