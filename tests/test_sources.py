import struct

import numpy as np
import pytest

from vecloom.sources import logs
from vecloom.sources.vecs import read_vecs, write_vecs


def records(kind, rows):
    return b"".join(struct.pack("<i", len(r)) + np.array(r, kind).tobytes() for r in rows)


def rows(df):
    return [(r["id"], list(r["v"])) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("kind, dtype, values", [("fvecs", "<f4", [[0.5, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]), ("ivecs", "<i4", [[1, -2, 3, 4]] * 3), ("bvecs", "u1", [[0, 127, 128, 255]] * 2)])
def test_records_with_dimension(spark, tmp_path, kind, dtype, values):
    p = tmp_path / f"x.{kind}"
    p.write_bytes(records(dtype, values))
    assert rows(read_vecs(spark, str(p), kind)) == list(enumerate(values))
    assert rows(read_vecs(spark, f"file://{p}", kind, 1, 1)) == [(1, values[1])]


@pytest.mark.parametrize("kind, dtype", [("fbin", "<f4"), ("ibin", "<i4"), ("i8bin", "i1")])
def test_files_with_header(spark, tmp_path, kind, dtype):
    v = np.array([[-128, -1, 127], [1, 2, 3], [4, 5, 6]])
    p = tmp_path / "x.bin"
    p.write_bytes(struct.pack("<ii", 3, 3) + v.astype(dtype).tobytes())
    assert rows(read_vecs(spark, str(p), kind)) == list(enumerate(v.tolist()))
    assert rows(read_vecs(spark, str(p), kind, 1, 1)) == [(1, [1, 2, 3])]
    assert rows(read_vecs(spark, str(p), kind, 2)) == [(2, [4, 5, 6])]


def test_truth(spark, tmp_path):
    p = tmp_path / "truth.bin"
    p.write_bytes(struct.pack("<ii", 2, 2) + np.array([[7, 8], [9, 1]], "<i4").tobytes() + np.array([[0.5, 1], [2, 3]], "<f4").tobytes())
    got = [(r["id"], list(r["ids"]), list(r["dists"])) for r in read_vecs(spark, str(p), "truth").orderBy("id").collect()]
    assert got == [(0, [7, 8], [0.5, 1.0]), (1, [9, 1], [2.0, 3.0])]


@pytest.mark.parametrize("kind, data", [("fvecs", struct.pack("<i", 0)), ("fvecs", struct.pack("<i", 1_000_000)), ("fvecs", records("<f4", [[1, 2]]) + b"x"), ("fbin", struct.pack("<ii", 2, 2) + b"1234"), ("bvecs", b"ab"), ("ibin", b"abc")])
def test_bad_files(spark, tmp_path, kind, data):
    p = tmp_path / "bad"
    p.write_bytes(data)
    with pytest.raises(Exception, match="dimension|no whole number|no header"):
        read_vecs(spark, str(p), kind).count()


def test_write_and_read(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "array(cast(id as float), float(1), float(2)) AS v").repartitionByRange(5, "id").sortWithinPartitions("id")
    write_vecs(df.select("v"), str(tmp_path / "out"))
    assert rows(read_vecs(spark, str(tmp_path / "out"))) == [(i, [float(i), 1.0, 2.0]) for i in range(1000)]
    (tmp_path / "empty.fvecs").write_bytes(b"")
    assert rows(read_vecs(spark, str(tmp_path / "empty.fvecs"))) == []


def test_logs(spark, tmp_path):
    (tmp_path / "a").write_text("noise\nquery dpu_process 3 : 17\nquery dpu_process 4 : 5\n")
    assert [tuple(r) for r in logs.unit_lines(spark, str(tmp_path / "a")).orderBy("unit").collect()] == [(3, 17), (4, 5)]
    (tmp_path / "b").write_text("head\n=== DPU#0.0\nins_main: 5\nins_load: 7\n=== DPU#0.1\nins_main: 9\nins_load: 1\n=== DPU#0.2\nins_main: 9\nins_load: 2\n")
    c = logs.counter_blocks(spark, str(tmp_path / "b"))
    assert sorted((r["block"], r["name"], r["n"]) for r in c.collect()) == [(0, "load", 7), (0, "main", 5), (1, "load", 1), (1, "main", 9), (2, "load", 2), (2, "main", 9)]
    assert sorted((r["name"], r["n"]) for r in logs.argmax_block(c, "main").collect()) == [("load", 1), ("main", 9)]
    (tmp_path / "m").write_text("1 2 -1\n\n4  5\n")
    assert [tuple(r) for r in logs.matrix_rows(spark, str(tmp_path / "m")).select("pos", "x").collect()] == [(0, 1), (1, 2), (2, -1), (0, 4), (1, 5)]
    pack = lambda *x: " ".join(str(m << 8 | k) for m, k in x)
    (tmp_path / "c").write_text(pack((0, 1), (1, 2), (2, 3), (3, 4)) + "\n" + pack((0, 1), (0, 2), (2, 3), (3, 4)) + "\n" + pack((0, 1)) + "\n")
    assert [(r["cid"], r["slot"], r["m"], r["k"]) for r in logs.cluster_lines(spark, str(tmp_path / "c"), 5).orderBy("slot").collect()] == [(5, i, i, i + 1) for i in range(4)]


def test_append_and_overwrite(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "v array<float>").coalesce(1)
    at = str(tmp_path / "a b" / "out")
    write_vecs(frame([1.0, 2.0], [3.0, 4.0], [5.0, 6.0]).repartition(3).sortWithinPartitions("v"), at)
    write_vecs(frame([7.0, 8.0], [9.0, 10.0]), at)
    got = [v for _, v in rows(read_vecs(spark, at))]
    assert sorted(got[:3]) == [[1, 2], [3, 4], [5, 6]] and got[3:] == [[7, 8], [9, 10]]
    write_vecs(frame([0.5, 0.25]), at, mode="overwrite")
    assert rows(read_vecs(spark, at)) == [(0, [0.5, 0.25])]


def test_failed_write_leaves_nothing(spark, tmp_path):
    at = tmp_path / "out"
    with pytest.raises(Exception, match="different dimensions"):
        write_vecs(spark.createDataFrame([([1.0],), ([2.0, 3.0],)], "v array<float>").coalesce(1), str(at))
    assert not [x for x in at.iterdir() if not x.name.endswith(".crc")] if at.exists() else True


def test_paths_take_the_default_file_system(spark, tmp_path):
    from vecloom.sources.vecs import qualified

    assert qualified(spark, str(tmp_path / "x")) == f"file://{tmp_path}/x"


@pytest.mark.parametrize("kind, element, values", [("fbin", "float", [[0.5, -1.0], [2.0, 3.0], [4.0, 5.5]]), ("ibin", "int", [[1, -2], [3, 2**31 - 1], [5, 6]]), ("i8bin", "tinyint", [[-128, 127], [0, 1], [2, 3]])])
def test_write_with_header(spark, tmp_path, kind, element, values):
    """Files have their own header; tasks without rows leave none; an append comes after."""
    at = str(tmp_path / "out")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v array<{element}>").repartitionByRange(8, "i")
    write_vecs(df, at, kind)
    write_vecs(df.coalesce(1), at, kind)
    got = [v for _, v in rows(read_vecs(spark, at, kind))]
    assert sorted(got[:3]) == sorted(values) and sorted(got[3:]) == sorted(values)
    assert {x.name.split(".")[-1] for x in (tmp_path / "out").iterdir() if x.name[0] not in "._"} == {kind}
    assert not [x for x in (tmp_path / "out").iterdir() if x.name[0] == "_"]
    one = next(x for x in (tmp_path / "out").iterdir() if x.name.startswith("part"))
    n, d = struct.unpack("<ii", one.read_bytes()[:8])
    assert d == 2 and len(one.read_bytes()) == 8 + n * d * np.dtype({"float": "f4", "int": "i4", "tinyint": "i1"}[element]).itemsize


def test_write_truth(spark, tmp_path):
    df = spark.createDataFrame([([7, 8], [0.5, 1.0]), ([9, 1], [2.0, 3.0])], "ids array<int>, dists array<float>").coalesce(1)
    write_vecs(df, str(tmp_path / "t"), "truth")
    got = [(r["id"], list(r["ids"]), list(r["dists"])) for r in read_vecs(spark, str(tmp_path / "t"), "truth").orderBy("id").collect()]
    assert got == [(0, [7, 8], [0.5, 1.0]), (1, [9, 1], [2.0, 3.0])]


@pytest.mark.parametrize("kind, value", [("bvecs", 256), ("bvecs", -1), ("i8bin", 128), ("ivecs", 2**31)])
def test_elements_that_a_kind_cannot_hold(spark, tmp_path, kind, value):
    with pytest.raises(Exception, match="can't hold"):
        write_vecs(spark.createDataFrame([([1, value],)], "v array<bigint>"), str(tmp_path / "x"), kind)


def test_cluster_lines_through_files(spark, tmp_path):
    lines = [(c, j, s, (s + j) % 8, 31 * c + s) for c in (0, 3) for j in range(3) for s in range(4)]
    logs.write_cluster_lines(spark.createDataFrame(lines, "cid bigint, line bigint, slot int, m int, k int").repartition(5), str(tmp_path / "l"))
    assert sorted(tuple(r) for r in logs.cluster_lines(spark, str(tmp_path / "l")).collect()) == lines


def test_replay(spark, tmp_path):
    """Lists of some units only, one longer than what is replayed, a query without any; rows of large files are numbered over all parts."""
    found = [(0, 0, 5, 9), (0, 0, 6, 3), (0, 2, 1, 4), (2, 0, 8, 7), (2, 0, 9, 7), (2, 0, 4, 1)]
    logs.dump_lists(spark.createDataFrame(found, "qid bigint, unit bigint, id bigint, dist bigint"), 3, 4, str(tmp_path / "d"))
    got = logs.replay_lists(spark, str(tmp_path / "d"), 2).collect()
    assert sorted((r["qid"], r["unit"], r["id"], r["dist"]) for r in got) == [(0, 0, 5, 9), (0, 0, 6, 3), (0, 2, 1, 4), (2, 0, 4, 1), (2, 0, 8, 7)]
    assert (next((tmp_path / "d" / "lists").glob("part*.txt"))).read_text().splitlines() == ["3 6 9 5 -1 -1 1 4 7 8 7 9 -1 -1", "", "4 1 -1 -1", ""]
    (tmp_path / "m").write_text("".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        m = logs.matrix_rows(spark, str(tmp_path / "m"))
        assert m.rdd.getNumPartitions() > 1 and m.where("row = x").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
