"""Run logs and replay dumps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines `query dpu_process <unit> : <n>` as (unit, n); other lines are left out."""
    p = r"query dpu_process (\d+) : (\d+)"
    t = spark.read.text(path)
    return t.where(F.col("value").rlike(p)).select(F.regexp_extract("value", p, 1).cast("bigint").alias("unit"), F.regexp_extract("value", p, 2).cast("bigint").alias("n"))


def counter_blocks(spark: SparkSession, path: str, head: str = "=== DPU#") -> DataFrame:
    """Counters `ins_<name>: <n>` of blocks that begin with `head`: (file, block, name, n), blocks from 0 in order.

    Blocks are split by the reader, at their heads: a block is a record, so none is numbered in a window over all lines.
    """
    t = spark.read.option("lineSep", head).text(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    found = t.select("file", "at", F.explode(F.regexp_extract_all("value", F.lit(r"ins_([a-z_]+):\s*(\d+)"), F.lit(0))).alias("c"))
    pair = r"ins_([a-z_]+):\s*(\d+)"
    return found.select("file", F.dense_rank().over(_per("file", "at")).cast("bigint").alias("block"), F.regexp_extract("c", pair, 1).alias("name"), F.regexp_extract("c", pair, 2).cast("bigint").alias("n")).withColumn("block", F.col("block") - 1)


def _per(key: str, order: str):
    from pyspark.sql import Window as W

    return W.partitionBy(key).orderBy(order)


def argmax_block(counters: DataFrame, name: str) -> DataFrame:
    """All counters of the block in which `name` is greatest (the first at ties)."""
    best = counters.where(F.col("name") == name).agg(F.min(F.struct((-F.col("n")).alias("o"), "file", "block")).alias("b"))
    return counters.join(F.broadcast(best), (F.col("file") == F.col("b.file")) & (F.col("block") == F.col("b.block"))).select("file", "block", "name", "n")


def _numbers(value: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(value), r"\s+"), lambda s: s != ""), lambda s: s.cast("bigint"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): lines of one text file, numbered from 0 over all its parts. Only counts, one a part, are gathered."""
    from pyspark.sql import Window as W

    t = spark.read.text(path).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = t.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("first"))
    return t.join(F.broadcast(first), "part").select((F.col("first") + F.col("at")).alias("row"), "value")


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """A whitespace matrix as (row, pos, x), rows from 0 in order of the file. One file, one row of text per record."""
    return _lines(spark, path).select("row", F.posexplode(_numbers(F.col("value"))).alias("pos", "x"))


def cluster_lines(spark: SparkSession, path: str, cid: int | None = None) -> DataFrame:
    """Lines of four packed items as (cid, line, slot, m, k); lines with another number of items or a repeated sub-quantiser are left out.

    One file for cluster `cid`; without cid a folder with one in each of its folders cid=<number>. A file is a record:
    it has as many lines as a cluster may, a parameter of mining.
    """
    t = spark.read.text(path, wholetext=True)
    rows = F.transform(F.split("value", "\n"), _numbers)
    good = F.filter(rows, lambda x: (F.size(x) == 4) & (F.size(F.array_distinct(F.transform(x, lambda y: F.shiftright(y, 8)))) == 4))
    own = F.lit(cid) if cid is not None else F.col("cid")
    each = t.select(own.cast("bigint").alias("cid"), F.posexplode(good).alias("line", "items")).select("cid", F.col("line").cast("bigint").alias("line"), F.posexplode("items").alias("slot", "x"))
    return each.select("cid", "line", "slot", F.shiftright("x", 8).alias("m"), F.col("x").bitwiseAND(F.lit(255)).alias("k"))


def write_cluster_lines(lines: DataFrame, path: str) -> None:
    """lines (cid, line, slot, m, k) as text, a folder cid=<number> for each cluster, lines in order of their number."""
    packed = F.shiftleft(F.col("m").cast("bigint"), 8).bitwiseOR(F.col("k").cast("bigint"))
    text = lines.groupBy("cid", "line").agg(F.array_sort(F.collect_list(F.struct("slot", packed.alias("x")))).alias("items"))
    text = text.select("cid", "line", F.array_join(F.transform("items", lambda i: i["x"].cast("string")), " ").alias("value"))
    text.repartition("cid").sortWithinPartitions("cid", "line").select("cid", "value").write.partitionBy("cid").text(path)


#: What ends a list in a dump, in place of a distance.
END = -1


def dump_lists(found: DataFrame, queries: int, units: int, path: str) -> None:
    """Best lists (qid, unit, id, dist) of a search, as three whitespace matrices to replay the merge from.

    path/units: for each query, a flag for each unit that has a list for it; path/offsets: where that list begins;
    path/lists: for each unit its lists one after the other, as pairs of distance and id, nearest first, each ended by a pair
    of END. qid and unit count from 0 without gaps; distances are whole numbers. The format has a line for each unit, so
    it is for looking into a search of some queries; stored() keeps lists of any size.
    """
    from pyspark.sql import Window as W

    pair = lambda d, i: F.concat_ws(" ", d.cast("string"), i.cast("string"))
    each = found.groupBy("qid", "unit").agg(F.array_sort(F.collect_list(F.struct("dist", "id"))).alias("best"))
    before = F.coalesce(F.sum(F.size("best") + 1).over(W.partitionBy("unit").orderBy("qid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = each.select("qid", "unit", before.alias("begin"), F.concat_ws(" ", F.transform("best", lambda x: pair(x["dist"], x["id"])), pair(F.lit(END), F.lit(END))).alias("value"))
    spark = found.sparkSession

    def rows(n: int, key: str, other: str, made, name: str) -> None:
        of = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("at"), "begin", "value"))).alias("x"))
        every = spark.range(n).withColumnRenamed("id", key).join(of, key, "left").withColumn("x", F.coalesce("x", F.array()))
        every.select(key, made.alias("value")).coalesce(1).sortWithinPartitions(key).select("value").write.text(f"{path}/{name}")

    def by_unit(value):
        at = F.map_from_entries(F.transform("x", lambda y: F.struct(y["at"].cast("bigint"), value(y).cast("bigint"))))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(units - 1).cast("bigint")), lambda u: F.coalesce(F.try_element_at(at, u), F.lit(0)).cast("string")), " ")

    rows(queries, "qid", "unit", by_unit(lambda y: F.lit(1)), "units")
    rows(queries, "qid", "unit", by_unit(lambda y: y["begin"]), "offsets")
    rows(units, "unit", "qid", F.array_join(F.transform("x", lambda y: y["value"]), " "), "lists")


def replay_lists(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(qid, unit, id, dist) from the three matrices of dump_lists, `most` pairs of a list at most. Lists end before END."""
    from pyspark.sql import Window as W

    flags = matrix_rows(spark, f"{path}/units").where("x <> 0").select(F.col("row").alias("qid"), F.col("pos").alias("unit"))
    begins = matrix_rows(spark, f"{path}/offsets").select(F.col("row").alias("qid"), F.col("pos").alias("unit"), F.col("x").alias("begin"))
    numbers = _lines(spark, f"{path}/lists").select(F.col("row").alias("unit"), _numbers(F.col("value")).alias("x")).where(F.size("x") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(x) div 2 - 1")), lambda i: F.struct(F.get("x", 2 * i).alias("dist"), F.get("x", 2 * i + 1).alias("id")))
    stored = numbers.select(F.col("unit").cast("int").alias("unit"), F.posexplode(pairs).alias("at", "p")).select("unit", F.col("at").cast("bigint").alias("at"), "p.dist", "p.id")
    wanted = flags.join(begins, ["qid", "unit"]).select("qid", "unit", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pos"), "begin").withColumn("at", F.col("begin") + F.col("pos"))
    met = wanted.join(stored, ["unit", "at"]).withColumn("end", F.min(F.when(F.col("dist") == END, F.col("pos"))).over(W.partitionBy("qid", "unit")))
    return met.where("end IS NULL OR pos < end").select("qid", F.col("unit").cast("bigint").alias("unit"), "id", "dist")
