import zlib

from vecloom.llm.common import append, labelled_sample, unused


def test_labelled_sample(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(200)] + [(5, "another text"), (None, "no id"), (7, None)]
    labels = [(i, i % 2) for i in range(0, 150)] + [(None, 1), (3, 0), (160, None), (161, 7), (999, 1), (11, 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = labelled_sample(spark, str(tmp_path), "toxic", (5, 0), 1000).collect()
    ids = [r["doc_id"] for r in rows]
    # 3 has both labels; 5 has two texts and is taken once; 160, 161 have no label; 999 has no document.
    assert sorted(ids) == [i for i in range(150) if i != 3 and zlib.crc32(str(i).encode()) % 5] and all(r["y"] == r["doc_id"] % 2 for r in rows)
    few = labelled_sample(spark, str(tmp_path), "toxic", (5, 0), 10).collect()
    assert sum(r["y"] for r in few) <= 10 and len(few) <= 20 and {r["doc_id"] for r in few} <= set(ids)
    assert labelled_sample(spark, str(tmp_path), "toxic", (5, 0), 0).count() == 0


def test_unused(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert unused(df, "a") == "a__" and unused(df, "b") == "b"


def test_append_on_no_rows(spark):
    import pyarrow as pa

    df = spark.createDataFrame([], "text string, x int")
    assert append(df, [("n", "bigint")], "text", lambda: lambda t: [pa.array([0] * len(t), pa.int64())]).collect() == []
