"""Exact token-length histogram and what its suffix sums answer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import append, cut, documents
from vecloom.llm.tokens import encoder, tokenizer_path

#: Lengths of a block of the two-level suffix sum.
BLOCK = 4096


def with_token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of ids of each whole text; null and empty texts have 0."""

    def make():
        import pyarrow as pa

        enc = encoder(path)
        return lambda texts: [pa.array([len(enc.encode(t.as_py())) // 4 for t in texts], pa.int64())]

    return append(docs, [(out, "bigint")], text, make)


def length_histogram(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(length, n_docs): documents by encoded length. It has as many rows as there are different lengths."""
    return with_token_counts(docs.select(text), path, text, "length").groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, over all documents:

    n_docs, n_tokens of documents of length L; docs_at_least, tokens_at_least: those of L and longer; docs_total and
    tokens_total; truncated_total: tokens if every document is cut to L; quantile: share of documents of length <= L.
    Null ids, ties and repeated rows count as often as they occur; an empty table gives no rows. Sums are made within
    blocks of BLOCK lengths and then over blocks, so no task gets the whole histogram.
    """
    h = cut(histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}")))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    over = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    both = W.partitionBy()
    # One row a block: the longest document's length over BLOCK.
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t_above"),
        F.sum("d").over(both).alias("docs_total"), F.sum("t").over(both).alias("tokens_total"),
    )
    within = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    out = h.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", "docs_total", "tokens_total",
        (F.sum("n_docs").over(within) + F.col("d_above")).alias("docs_at_least"),
        (F.sum("n_tokens").over(within) + F.col("t_above")).alias("tokens_at_least"),
    )
    return out.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> dict[int, dict]:
    """Totals for context limits that need not be lengths of the histogram: documents and tokens over the limit, truncated total."""
    if not limits:
        return {}
    total = sums.agg(F.max("docs_total").alias("d"), F.max("tokens_total").alias("t")).first()
    out = {}
    for limit, row in zip(limits, sums.agg(*(F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("length") > n, F.col("length"))).alias(f"l{n}") for n in limits)).first()):
        d, t = (row[0], row[1]) if row else (0, 0)
        out[limit] = {"docs_over": d, "tokens_over": t, "truncated_total": (total["t"] or 0) - t + d * limit}
    return out


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents doesn't exceed."""
    rank = sums.agg(F.max("docs_total")).first()[0]
    if rank is None:
        return None
    need = max(1, math.ceil(q * rank))
    return sums.where(F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs") >= need).agg(F.min("length")).first()[0]


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each encoded length of `documents`."""
    return suffix_sums(length_histogram(documents(spark, sf_dir), tokenizer_path()))
