"""Helpers shared by the corpus operators: tables cut from their lineage, running sums and components.

Nothing here collects data that grows with the input to the driver.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders written by `written`, newest last, by application: a pipeline drops those of finished stages.
_TABLES: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Where neither it nor the context has one, a folder of our own is made, but only if all run on this machine.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str, held: bool = True) -> str:
    """A fresh path in the shared folder, to be dropped by `release` if `held`."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if held:
        _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, with no lineage, safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the working tables written so far: for a pipeline, once a stage's result is stored and read from there."""
    gone = _TABLES.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches of the session hold `rows` rows at most: whole texts are long, and workers hold a batch several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(spark.conf.get(name))
    if not 0 < have <= rows:
        spark.conf.set(name, str(rows))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc32_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def row_key(*cols: str) -> Column:
    """A key equal for rows that agree in all `cols`, nulls included."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(cols)])), 256)


def blocks_for(rows: int, per_block: int = 256, most: int = 65536) -> int:
    """How many blocks a running sum is cut into: enough to spread any table, few enough for one small window."""
    return max(1, min(most, -(-rows // per_block)))


def components(edges: DataFrame, nodes_checkpoint: str = "cc", rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of undirected `edges` (a, b), as rows (node, root).

    Alternating large-star and small-star steps: each joins every node to the smallest of its
    neighbours, so that stars form in a logarithmic number of rounds. A node with very many
    neighbours is never gathered in one task: minima are pre-aggregated and joined back. Each round is a
    written table. Nodes that have no edge are absent. Nulls, loops and repeated edges are ignored.
    """
    spark = edges.sparkSession
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), nodes_checkpoint)
    before = None
    for _ in range(rounds):
        # large star: of u's neighbours and itself the least is m; every larger neighbour is linked to m
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), f"{nodes_checkpoint}-m")
        large = both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, f"{nodes_checkpoint}-l")
        # small star: the smaller neighbours of u are linked to the least of them, and so is u
        small = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), f"{nodes_checkpoint}-s")
        joined = large.join(small, large.a == small.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = written(joined.unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), nodes_checkpoint)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return written(star.unionByName(star.select(F.col("root").alias("node"), "root").distinct()), nodes_checkpoint)


def maybe_in(df: DataFrame, keys: DataFrame, of: Column, out: str) -> DataFrame:
    """Adds boolean `out`: false only where the hash `of` (a long) is not among the longs of `keys` (one column).

    A bitmap of the keys, 16 bits a key but 16 MB at most whatever the size of `keys`, is broadcast. What it lets through
    by chance must be sorted out by a join, which this makes small.
    """
    (name,) = keys.columns
    bits = 1 << max(15, min(27, (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    rows = keys.select(place(F.col(name)).alias("p")).groupBy(F.shiftright("p", 15).alias("__part"))
    table = written(rows.agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("__map")), "bitmap")
    marked = df.withColumn("__bit", place(of)).withColumn("__part", F.shiftright("__bit", 15)).join(F.broadcast(table), "__part", "left")
    byte = F.conv(F.hex(F.substring("__map", (F.floor((F.col("__bit") % 32768) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")) % 2 == 1
    return marked.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__bit", "__part", "__map")


def before_in_block(df: DataFrame, block: list[str], order: list[Column], size: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows that come earlier in the same block."""
    w = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
