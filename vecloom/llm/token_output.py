"""Token ids in ORC: integer run-length encoded columns in stripes, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.common import documents, fresh_path
from vecloom.llm.tokens import encoder, tokenizer_path

#: Documents of a file, about; more where there would be over MOST_FILES.
FILE_ROWS = 16_384
MOST_FILES = 20_000
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.dictionary.key.threshold": "0",
}


def write_tokens(docs: DataFrame, to: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", file_rows: int = FILE_ROWS) -> None:
    """Encodes whole texts, appends end_id and writes (doc_id, n_tokens, ids array<int>) as ORC in ascending doc_id order.

    Texts, not ids, are exchanged: by ranges of (doc_id, hash of the text), so that a repeated or null id (nulls come
    first) can spread over files; file k holds lower ids than file k + 1. A null or empty text is its end id alone.
    An empty table gives files without rows. Stripes can be read in parallel; a reader that looks for a document
    skips files and stripes by their doc_id ranges and Bloom filters.
    """
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    files = min(MOST_FILES, max(1, -(-docs.select(doc_id).count() // file_rows)))
    kind = df.schema["doc_id"].dataType.simpleString()
    df = df.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc, last = encoder(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = [enc.encode(t.as_py()) + last for t in part.column(1)]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), lists], ["doc_id", "n_tokens", "ids"])

    df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>").write.options(**ORC).orc(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, file: from the files' own contents.

    Files are in order by the number in their names. Totals of files (one row a file) give each file's first start; running sums within a
    file, which has a bounded number of rows, give the rest.
    """
    raw = spark.read.orc(at)
    kind = raw.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column(1)
            offsets, flat = lists.offsets.to_numpy().astype(np.int64), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), b.column(2), b.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file", "at"])

    # Within one file's splits, monotonically_increasing_id follows the rows' order; a file of several splits has them in order too.
    rows = raw.select("doc_id", "ids", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.select("doc_id", "ids", "file", F.struct("block", F.monotonically_increasing_id().alias("i")).alias("at"))
    rows = rows.mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, file string, at struct<block: bigint, i: bigint>")
    sizes = raw.groupBy(F.input_file_name().alias("file")).agg(F.sum("n_tokens").alias("n")).collect()  # one row a file; ids aren't read
    first, total = [], 0
    for r in sorted(sizes, key=lambda r: int(re.search(r"part-(\d+)", r["file"])[1])):
        first.append((r["file"], total))
        total += r["n"]
    starts = spark.createDataFrame(first, "file string, first bigint")
    within = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(F.broadcast(starts), "file").select(
        "doc_id", (F.coalesce(F.sum("n_tokens").over(within), F.lit(0)) + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def find_tokens(spark: SparkSession, at: str, ids: list) -> DataFrame:
    """Rows of some documents: the pushed-down predicate skips stripes and row groups by index and Bloom filter."""
    return spark.read.orc(at).where(F.col("doc_id").isin(ids))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as ORC in the shared folder and reads the files back."""
    to = fresh_path(spark, "tokens-orc")
    write_tokens(documents(spark, sf_dir), to, tokenizer_path())
    return read_tokens(spark, to)
