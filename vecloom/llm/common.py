"""Shared helpers: input columns, shared scratch folder, per-process caches, labelled samples."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.session import shared_folder, stored

#: White space between words, as the character class of the word contract `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows, unless the session's owner has chosen a number: whole texts of 10,000 rows take some 300 MB more of an executor.

    For applications (the registered queries, the pipeline); operators leave the session as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll and spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, also set as the checkpoints' folder where none is."""
    at, sc = shared_folder(spark), spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def gathered(df: DataFrame, amount: int, per: int) -> DataFrame:
    """df in partitions of about `per` of its `amount` (rows or bytes), two for each core at least, where it has more: not a file for each of many nearly empty tasks."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-amount // per)))


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: lineage ends there and the rows survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def portions(batch, column: int, rows: int = 1000, size: int = 2 << 20):
    """An Arrow batch in slices of at most `rows` rows and about `size` bytes in one text column (a longer text alone)."""
    import numpy as np
    import pyarrow.compute as pc

    if batch.num_rows <= 1:
        return [batch] if batch.num_rows else []
    upto = np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64).cumsum()])
    out, at = [], 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1))
        out.append(batch.slice(at, end - at))
        at = end
    return out


def cache(name: str, make):
    """A value made once in a worker process. Functions travel by value, so module globals do not last over tasks."""
    store = sys.__dict__.setdefault("_vecloom_cache", {})
    if name not in store:
        store[name] = make()
    return store[name]


def crc_fold(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `mod`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % F.lit(mod)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or the first of `name`_, `name`__, ... that no column of df has (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of all texts of a labelled sample, at most.
SAMPLE_BYTES = 64 << 20


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, fold: tuple[int, int], per_class: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` labelled documents of each class and `most_bytes` of text, fold[1] of crc32 mod fold[0] held out.

    The bounds are these parameters, not a share of the corpus. Rows are drawn in the order of a hash of the id; where
    their texts are larger in all than most_bytes, those that fit in that order are taken, each whole. So
    every run draws the same ones. Ids with contradicting labels and null labels or ids are left out; of the
    documents that share an id one is taken. Only the drawn ids (2 * per_class of them) are broadcast.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y_max")).where("y = y_max").drop("y_max")
        .where((crc_fold(fold[0]) != fold[1]))
    )
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    drawn = [ids.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    drawn = drawn[0].unionAll(drawn[1])
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")), "sample")
    left, over = most_bytes, []
    for r in sorted(rows.select("doc_id", F.octet_length("text").alias("n"), order.alias("h")).collect(), key=lambda r: (r["h"], r["doc_id"])):  # 2 * per_class rows
        if r["n"] <= left:
            left -= r["n"]
        else:
            over.append(r["doc_id"])
    return rows.where(~F.col("doc_id").isin(over)) if over else rows


def append(df: DataFrame, fields: list[tuple[str, str]], column: str, make) -> DataFrame:
    """df with columns that `make` computes from one text column, in Arrow batches, a few megabytes of text at a time.

    make() runs once a task and gives a function from that column's Arrow array to the new columns' arrays.
    fields: (name, Spark type) of the new columns; columns of df with these names, in any case, are replaced.
    """
    new = {name.lower() for name, _ in fields}
    clash = [c for c in df.columns if c.lower() in new and c != column]
    names = [c for c in df.columns if c not in clash]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {t}" for n, t in fields])
    at, all_names = names.index(column), [*names, *(n for n, _ in fields)]

    def run(batches):
        import pyarrow as pa

        apply = make()
        for whole in batches:
            for b in portions(whole, at):
                yield pa.RecordBatch.from_arrays([*b.columns, *apply(b.column(at))], all_names)

    return df.mapInArrow(run, schema)
