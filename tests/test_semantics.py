import itertools
import random

from pyspark.sql import functions as F

import symgraph
from symgraph import star
from symgraph.functions import shared
from symgraph.functions import text as T
from symgraph.operators import search as S
from symgraph.operators import traverse as V
from symgraph.operators import views as W
from symgraph.operators.resolve import enclosing_class, follow
from symgraph.plans import plan as P

EDGES = "src string, dst string, kind string"


def test_anchor_files_have_a_pattern_of_their_own(spark):
    paths = ["src/a.ts", "tests/a.py", "a/test/b.ts", "src/a.test.ts", "scratchpad/x.py", "docs/spec/a.ts", "fixtures/a.py", "a\\Tests\\b.py", "src/contest.ts", "x/scratch"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.is_peripheral_anchor(F.col("p")).alias("a")).collect()
    assert {r.p for r in rows if r.a} == {"tests/a.py", "a/test/b.ts", "src/a.test.ts", "scratchpad/x.py", "a\\Tests\\b.py", "x/scratch"}


def test_flow_anchors():
    told = lambda q: P.explore_flow(q).anchors
    assert told("how does buildGraph flow into walker.ts, then charge (refund)?") == ("buildGraph", "walker.ts", "charge", "refund")
    assert told("show all changes that break src/parse") == ("show", "changes", "break", "src/parse")
    assert told("a b2c snake_case " + " ".join(f"Name{i}" for i in range(9))) == ("snake_case", *[f"Name{i}" for i in range(7)])


def test_exported_ranks_before_a_shorter_name(spark):
    rows = [("1", "class", "Thing", "a/b.py", "Thing", False), ("2", "class", "Thing", "a/c.py", "mod.Thing", True), ("3", "class", "Thing", "tests/d.py", "T", True)]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, file_path string, qualified_name string, exported boolean")
    assert S.resolve_anchor(nodes, "thing") == ("ambiguous", ["2", "1", "3"]) or S.resolve_anchor(nodes, "thing")[1] == ["1"]
    assert S.resolve_anchor(nodes.withColumn("qualified_name", F.concat(F.lit("m."), "qualified_name")), "thing") == ("ambiguous", ["2", "1", "3"])
    ids, missing = S.free_form(nodes.withColumn("name", F.concat("name", "id")), "where does Thing2 go")
    assert ids[0] == "2" and missing == []


def test_blast_radius_tells_what_no_test_refers_to(spark):
    nodes = spark.createDataFrame([(f"n{i}", "variable" if i == 5 else "function", f"f{i % 5}") for i in range(9)], "id string, kind string, file_path string")
    edges = spark.createDataFrame([(f"n{i}", "n0", "call") for i in range(1, 9)] * 2 + [("n1", "n2", "import"), ("n2", "n3", "owns")], EDGES)
    anchors = spark.createDataFrame([("n0",), ("n2",), ("n3",), ("n5",)], "id string")
    got = {r.id: tuple(r)[1:] for r in V.blast_radius(nodes, edges, anchors, spark.createDataFrame([("n2",)], "id string")).collect()}
    assert got == {"n0": (16, 5, "f0,f1,f2", True), "n2": (1, 1, "f1", False), "n3": (0, 0, "", True), "n5": (0, 0, "", False)}


def plain_paths(edges, a, b, depth):
    """All shortest paths with their kinds, by trying every walk."""
    walks = [((a,), ())]
    for _ in range(depth + 1):
        hits = [w for w in walks if w[0][-1] == b]
        if hits:
            return sorted(hits)
        walks = [((*n, d), (*k, e)) for n, k in walks for s, d, e in edges if s == n[-1] and d not in n]
    return []


def test_shortest_paths_match_all_walks(spark):
    rng = random.Random(5)
    names = [f"v{i}" for i in range(9)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("ab")) for _ in range(22)]
    pairs = list(itertools.product(names[:5], names[3:])) + [("v0", "nowhere")]
    df, ps = spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "source string, target string")
    for depth in (1, 4):
        got = {}
        for r in V.shortest_paths(df, ps, depth).collect():
            got.setdefault((r.source, r.target), []).append((tuple(r.nodes), tuple(r.kinds)))
        assert {k: sorted(v) for k, v in got.items()} == {p: w for p in pairs if (w := plain_paths(edges, *p, depth))}


def test_containment_has_no_depth_limit(spark):
    deep = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "owns") for i in range(9)] + [("n9", "n3", "owns")], EDGES)
    roots = spark.createDataFrame([("n0",)], "id string")
    assert W.owners(deep, roots).count() == 10
    symbols = spark.createDataFrame([(f"n{i}", "class" if i == 0 else "function") for i in range(10)], "id string, kind string")
    held = deep.where("src <> 'n9'").select(F.col("src").alias("parent_id"), F.col("dst").alias("child_id"), "kind", F.lit(1).alias("seq"))
    assert [(r.id, r.class_id) for r in enclosing_class(symbols, held, spark.createDataFrame([("n9",)], "id string")).collect()] == [("n9", "n0")]


def test_chains_are_followed_to_their_end(spark):
    n = 11
    symbols = spark.createDataFrame([(f"m{i}", f"m{i}", "f", "class", None) for i in range(n)], "id string, name string, file_path string, kind string, declared_type array<string>")
    held = spark.createDataFrame([(f"m{i}", f"m{i + 1}", "has_member", i) for i in range(n - 1)], "parent_id string, child_id string, kind string, seq long")
    bases = spark.createDataFrame([("r", [f"m{i}" for i in range(n)], 1, "m0"), ("x", ["m0", "gone"], 1, "m0")], "ref string, chain array<string>, hop int, cur string")
    types = spark.createDataFrame([], "file_path string, type string, target string")
    assert [(r.ref, r.cur) for r in follow(bases, symbols, held, types).collect()] == [("r", f"m{n - 1}")]


def test_the_stored_graph_follows_its_files(spark, tmp_path):
    made = lambda s, d: s.read.parquet(f"{d}/t.parquet")
    for n in (3, 5):
        spark.range(n).selectExpr("cast(id as string) as id").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
        if n == 5:
            (tmp_path / "another").write_text("")
        assert [star.stored(spark, str(tmp_path), "t", made, "id", ["id"]).count() for _ in range(2)] == [n, n]


def test_working_tables_are_released(spark):
    df = shared.materialized(spark.range(3), "t")
    assert df.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    shared.release(spark)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_names_of_the_package():
    assert all(hasattr(symgraph, n) for n in symgraph.__all__)
