import random

import pytest
from pyspark.sql import functions as F

from symgraph.llm import common as C


def test_components_match_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(5, 5), (None, 1), (2, None), (7, 8), (8, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root}
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bitmaps_lose_nothing(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919).alias("h"))
    for n in (0, 1, 700):
        keys = df.limit(n).select(F.col("h").alias("k"))
        out = C.maybe_in(df, keys, F.col("h"), "maybe")
        assert out.count() == 3000 and keys.join(out.where("maybe"), F.col("k") == F.col("h"), "left_anti").isEmpty()
        assert out.where("maybe").count() <= n + 300
    nulls = spark.createDataFrame([(None,), (1,)], "h long")
    assert C.maybe_in(nulls, nulls.select(F.col("h").alias("k")), F.col("h"), "maybe").where("maybe").count() == 2


def test_written_and_released(spark):
    df = C.written(spark.range(5), "t")
    assert df.count() == 5
    C.release(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert C.blocks_for(0) == 1 and C.blocks_for(10**9) == 65536


def test_row_key(spark):
    rows = spark.createDataFrame([(1, None), (1, ""), (None, "1"), (1, None)], "a long, b string").select(C.row_key("a", "b").alias("k"))
    assert rows.distinct().count() == 3


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        C.shared_dir(Session)
