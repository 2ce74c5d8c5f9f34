import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from symgraph.functions import text as T
from symgraph.operators import evidence as E
from symgraph.operators import traverse as V
from symgraph.streaming.watch import Rebuilder, bursts, watch


def plain_region(nodes, edges, anchors, depth, cap, per_file, most, direction):
    """The sequential version: a queue, first come first served."""
    steps = {}
    for i, (a, b, k) in enumerate(edges):
        if direction in ("outgoing", "both"):
            steps.setdefault(a, []).append((0, i, b, (a, b, k)))
        if direction in ("incoming", "both"):
            steps.setdefault(b, []).append((1, i, a, (a, b, k)))
    dist, held, met, queue = dict.fromkeys(anchors, 0), {}, [], deque(anchors)
    while queue:
        x = queue.popleft()
        if dist[x] >= depth:
            continue
        for _, _, y, e in sorted(steps.get(x, []), key=lambda s: s[:2]):
            if y not in nodes:
                continue
            if e not in met:
                met.append(e)
            if y in dist or len(dist) >= cap:
                continue
            if dist[x] + 1 >= 2 and held.get(nodes[y], 0) >= per_file:
                continue
            held[nodes[y]] = held.get(nodes[y], 0) + 1
            dist[y] = dist[x] + 1
            queue.append(y)
    kept = [e for e in met if e[0] in dist and e[1] in dist]
    rank = lambda e: 0 if dist[e[0]] == 0 or dist[e[1]] == 0 else max(dist[e[0]], dist[e[1]])
    return dist, sorted(kept, key=rank)[:most]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_region_matches_the_sequential_version(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{i}": f"f{rng.randrange(4)}" for i in range(40)}
    edges = list(dict.fromkeys((f"n{rng.randrange(44)}", f"n{rng.randrange(44)}", rng.choice(["call", "owns"])) for _ in range(110)))
    direction = ["outgoing", "both", "incoming"][seed % 3]
    nd = spark.createDataFrame([(a, b) for a, b in nodes.items()], "id string, file_path string")
    ed = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, kind string, seq long")
    roots = spark.createDataFrame([("q", "n0", 0), ("q", "n1", 1)], "root string, id string, place int")
    found, kept, omitted = V.region(nd, ed, roots, V.Limits(3, 18, 3, 15), direction)
    dist, want = plain_region(nodes, edges, ["n0", "n1"], 3, 18, 3, 15, direction)
    assert {r.id: r.distance for r in found.collect()} == dist
    assert {(r.src, r.dst, r.kind) for r in kept.collect()} == set(want)
    assert omitted.collect() is not None


def test_paths_and_maximal(spark):
    edges = spark.createDataFrame([("a", "b", "call"), ("a", "c", "call"), ("b", "d", "call"), ("c", "d", "call"), ("c", "d", "renders"), ("a", "d", "owns"), ("d", "a", "call")], "src string, dst string, kind string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("b", "c"), ("d", "zz")], "source string, target string")
    got = sorted((r.source, r.target, "".join(r.nodes), r.kinds) for r in V.shortest_paths(edges, pairs, 4, ["call", "renders"]).collect())
    assert got == [("a", "a", "a", []), ("a", "d", "abd", ["call", "call"]), ("a", "d", "acd", ["call", "call"]), ("a", "d", "acd", ["call", "renders"]), ("b", "c", "bdac", ["call"] * 3)]
    assert V.shortest_paths(edges, pairs, 2, ["call"], most=1).where("target = 'd'").count() == 1
    flows = {"".join(r.nodes) for r in V.flows(edges, ["a", "b", "d"]).collect()}
    assert flows == {"abd", "bda", "dab"}


def test_impact_via_and_kinds(spark):
    edges = spark.createDataFrame([("a", "x", "call"), ("a", "x", "import"), ("b", "a", "owns"), ("c", "a", "inherit")], "src string, dst string, kind string")
    roots = spark.createDataFrame([("x", "x")], "root string, id string")
    assert sorted((r.id, r.depth, r.via) for r in V.impact(edges, roots).collect()) == [("a", 1, "call"), ("c", 2, "inherit")]
    assert {r.kind for r in V.of_kinds(edges, ["Calls", "OWN"]).collect()} == {"call", "owns"}


def test_text_functions(spark):
    assert T.terms("how does the config of UserStore work") == (["UserStore"], ["config"])
    assert T.terms("config") == (["config"], []) and T.terms("how it works") == (["how", "it", "works"], [])
    assert T.stem("orchestration") == "orchestr" and T.stem("gas") is None and T.prefix_ladder("resolution") == ["resoluti", "resolut", "resol"]
    assert T.strategy("what breaks if I change X") == "impact" and T.strategy("where is X defined") == "locate" and T.strategy("how does X work") == "flow"
    paths = ["tests/x.ts", "a/tests/x.ts", "a/x.spec.ts", "test_x.py", "x_test.py", "a/contest.py", "scratch/a.js"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(T.is_test_file(F.col("p")).alias("t"), T.is_peripheral(F.col("p")).alias("q"), T.language_of(F.col("p")).alias("l")).collect()
    assert [r.t for r in rows] == [False, True, True, True, True, False, False] and rows[0].q and rows[6].q and not rows[5].q and rows[2].l == "typescript"
    assert T.module_paths("a/b/__init__.py") == ["a/b/__init__", "a.b.__init__", "a/b", "a.b"]


def test_spans_budget_and_comments(spark):
    spans = spark.createDataFrame([("f", 2, 4), ("f", 7, 8), ("f", 20, 21), ("g", 1, 1)], "p string, lo int, hi int")
    assert sorted((r.p, r.lo, r.hi, r.n) for r in E.merge_spans(spans, ["p"]).collect()) == [("f", 2, 8, 2), ("f", 20, 21, 1), ("g", 1, 1, 1)]
    rows = pd.DataFrame({"id": list("abc"), "priority": [100, 50, 20], "kind": ["method", "class", "function"], "base": [40, 40, 40], "body": [400, 400, 4000]})
    assert dict(E.upgraded(rows, 400)[["id", "level"]].values) == {"a": "FULL", "b": "SIGNATURE", "c": "SNIPPET"}
    nodes = spark.createDataFrame(rows.assign(root="r"))
    assert {r.id: r.level for r in E.allocated(nodes, 400).collect()} == {"a": "FULL", "b": "SIGNATURE", "c": "SNIPPET"}
    assert {r.id: r.level for r in E.allocated(nodes, 20).collect()} == {"a": "SIGNATURE", "b": "SIGNATURE", "c": "OMIT"}
    assert E.doc_comment(["/**", " * Does it.", " */", "@x", "def f"], 4) == "Does it." and E.doc_comment(["x", "# a", "# b", "f"], 3) == "a\nb" and E.doc_comment(["x", "f"], 1) is None


def test_watching(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00.5"), ("a", "2024-01-01 00:00:05")], "path string, t string").select("path", F.to_timestamp("t").alias("ts"))
    assert sorted((r.n, r.paths) for r in bursts(events).collect()) == [(1, ["a"]), (2, ["a", "b"])]
    calls = []

    def rebuild(paths):
        calls.append(paths)
        if len(calls) > 1:
            raise ValueError
        return "built"

    handler = Rebuilder(rebuild)
    for _ in range(2):
        handler(bursts(events))
    assert handler.current == "built" and handler.failures == 1 and calls[0] == ["a", "b"]


def test_watch_stream(spark, tmp_path):
    import time

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    seen = []
    query, _ = watch(spark, str(tmp_path / "src"), lambda p: seen.append(p) or p, str(tmp_path / "cp"), "1 second")
    try:
        query.processAllAvailable()
        until = time.time() + 60
        for i in range(20):
            (tmp_path / f"src/n{i}.py").write_text("y = 2\n")
            time.sleep(1.6)
            if seen or time.time() > until:
                break
    finally:
        query.stop()
    assert seen and seen[0][0].startswith("n")
