"""Level-by-level traversal: regions, shortest paths, impact cones, and their presets.

All run for any number of roots in one job: rows carry their `root`, so a hundred anchors cost a few
times one. A level joins the frontier to the edges, drops what has been seen, and is stored before the next.
With `first`-wins semantics and caps, candidates carry their order (place of the parent, direction, edge order),
which makes a level's windows give what a queue would.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.shared import materialized
from symgraph.functions.text import kind_key

from .graph import REFERENCE_KINDS, STRUCTURE_KINDS

# Limits of requests, and defaults.
DEPTH, MOST_DEPTH, NODES, MOST_NODES, PATHS, MOST_PATHS, EDGES, PER_FILE = 3, 6, 100, 200, 10, 20, 120, 30


@dataclass
class Limits:
    depth: int = DEPTH
    nodes: int | None = None
    per_file: int | None = None
    edges: int | None = None

    def bounded(self) -> Limits:
        return Limits(min(self.depth, MOST_DEPTH), min(self.nodes or NODES, MOST_NODES), self.per_file or PER_FILE, self.edges or EDGES)


def of_kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Edges of the kinds, without regard to case and plural; all if none are given."""
    if not kinds:
        return edges
    wanted = [k.lower()[:-1] if k.lower().endswith("s") else k.lower() for k in kinds]
    return edges.where(kind_key(F.col("kind")).isin(wanted))


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(id, nbr, dir, src, dst, kind, order): each edge as steps from an end to the other."""
    order = F.col("seq") if "seq" in edges.columns else F.struct("kind", "src", "dst")
    e = edges.withColumn("order", order)
    out = e.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(0).alias("dir"), "src", "dst", "kind", "order")
    into = e.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(1).alias("dir"), "src", "dst", "kind", "order")
    return {"outgoing": out, "incoming": into}.get(direction) if direction != "both" else out.unionByName(into)


def distances(edges: DataFrame, roots: DataFrame, depth: int | None, direction: str = "outgoing", kinds: list[str] | None = None) -> DataFrame:
    """(root, id, depth, via): least distance from each root (0 for itself), and the least kind of an edge that
    reaches it at that distance. No caps; `roots` has (root, id); without a `depth` levels go on until one is empty.

    A level starts from its frontier, a stored table of known size: a small one is broadcast to the edges, which then stay
    where they are, and a large one is joined by shuffle. The edges are never aggregated or copied as a whole.
    """
    e = steps(of_kinds(edges, kinds), direction).select("id", "nbr", "kind")
    frontier = roots.select("root", "id").distinct().select("root", "id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("via"))
    found = frontier = materialized(frontier, "level0")
    for level in count(1) if depth is None else range(1, depth + 1):
        reached = frontier.select("root", "id").join(e, "id").groupBy("root", F.col("nbr").alias("id")).agg(F.min("kind").alias("via"))
        new = reached.join(found.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(level).cast("long").alias("depth"), "via")
        if level == depth:
            return found.unionByName(new)
        frontier = materialized(new, f"level{level}")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def impact(edges: DataFrame, roots: DataFrame, depth: int = DEPTH, kinds: list[str] | None = None) -> DataFrame:
    """(root, id, depth, via): what refers to the roots, directly or not."""
    return distances(edges, roots, depth, "incoming", kinds or REFERENCE_KINDS).where("depth > 0")


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, id, depth) within `depth` in either direction, and the distinct edges met on the way."""
    found = materialized(distances(edges, roots, depth, "both"), "neighbourhood")
    inner = found.where(F.col("depth") < depth).select("root", "id")
    met = inner.join(steps(edges, "both"), "id").select("root", "src", "dst", "kind").distinct()
    return found, met


def region(nodes: DataFrame, edges: DataFrame, roots: DataFrame, limits: Limits | None = None, direction: str = "outgoing", kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bounded breadth-first region of each root set: nodes (root, id, distance, place), kept edges (root, src, dst, kind,
    prio) and omitted counts (root, omitted).

    `roots` has (root, id, place). Neighbours must be nodes; from the second level on, at most `per_file` nodes
    of a file are admitted, anchors not counted; at most `nodes` in all. Edges with both ends admitted are ranked: those
    that touch an anchor first, then by the greater distance, then as met; `edges` of them stay.
    """
    lim = (limits or Limits()).bounded()
    known = nodes.select(F.col("id").alias("nbr"), "file_path")
    e = materialized(steps(of_kinds(edges, kinds), direction).join(known, "nbr"), "steps")
    start = roots.select("root", "id", F.lit(0).cast("long").alias("distance"), F.col("place").cast("long").alias("place"))
    found = frontier = materialized(start, "region0")
    counts = materialized(roots.select("root", F.lit("").alias("file_path"), F.lit(0).cast("long").alias("held")).limit(0), "held")
    met = None
    for level in range(1, lim.depth + 1):
        cand = frontier.select("root", "id", "place").join(e, "id")
        cand = cand.withColumn("ord", F.struct("place", "dir", "order")).withColumn("level", F.lit(level))
        cand = materialized(cand, "cand")
        met = cand if met is None else met.unionByName(cand)
        first = cand.groupBy("root", "nbr", "file_path").agg(F.min("ord").alias("ord"))
        first = first.join(found.select("root", F.col("id").alias("nbr")), ["root", "nbr"], "left_anti")
        if level >= 2:
            by_file = Window.partitionBy("root", "file_path").orderBy("ord", "nbr")
            first = first.withColumn("nth", F.row_number().over(by_file)).join(counts, ["root", "file_path"], "left")
            first = first.where(F.col("nth") + F.coalesce("held", F.lit(0)) <= lim.per_file).drop("nth", "held")
        already = found.groupBy("root").agg(F.count("*").alias("already"))
        new = first.join(already, "root").withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("ord", "nbr")))
        new = new.where(F.col("nth") + F.col("already") <= lim.nodes)
        new = materialized(new.select("root", F.col("nbr").alias("id"), F.lit(level).cast("long").alias("distance"), F.col("nth").cast("long").alias("place"), "file_path"), "admitted")
        if new.isEmpty():
            break
        more = new.groupBy("root", "file_path").agg(F.count("*").alias("held"))
        counts = materialized(counts.unionByName(more).groupBy("root", "file_path").agg(F.sum("held").alias("held")), "held")
        frontier = new.drop("file_path")
        found = found.unionByName(frontier)
    found = materialized(found, "region")
    ends = found.select("root", "id", "distance")
    both = met.groupBy("root", "src", "dst", "kind").agg(F.min(F.struct("level", "ord")).alias("at"))
    both = both.join(ends.select("root", F.col("id").alias("src"), F.col("distance").alias("da")), ["root", "src"]).join(ends.select("root", F.col("id").alias("dst"), F.col("distance").alias("db")), ["root", "dst"])
    prio = F.when((F.col("da") == 0) | (F.col("db") == 0), F.lit(0)).otherwise(F.greatest("da", "db"))
    ranked = both.withColumn("prio", prio).withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("prio", "at", "src", "dst", "kind")))
    kept = ranked.where(F.col("nth") <= lim.edges).select("root", "src", "dst", "kind", "prio")
    omitted = ranked.groupBy("root").agg(F.greatest(F.lit(0), F.count("*") - lim.edges).cast("long").alias("omitted"))
    return found, kept, omitted


def ranked_edges(edges: DataFrame, dist: DataFrame, most: int = EDGES) -> DataFrame:
    """Distinct edges between nodes of `dist` (root, id, depth), anchors' first, at most `most` a root."""
    e = edges.select("src", "dst", "kind").distinct()
    both = e.join(dist.select("root", F.col("id").alias("src"), F.col("depth").alias("da")), "src").join(dist.select("root", F.col("id").alias("dst"), F.col("depth").alias("db")), ["root", "dst"])
    prio = F.when((F.col("da") == 0) | (F.col("db") == 0), F.lit(0)).otherwise(F.greatest("da", "db")).cast("long")
    ranked = both.withColumn("prio", prio).withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("prio", "src", "dst", "kind")))
    return ranked.where(F.col("nth") <= most).select("root", "src", "dst", "kind", "prio")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int, kinds: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(source, target, nodes, kinds): all shortest outgoing paths of each pair (source, target), of `depth` steps at most.

    Parallel edges make paths of their own; no path meets a node twice; a pair of one node has the path of that
    node. `most` keeps the first of each pair by node names. Pairs are one job. Distances are found from both ends, half the
    depth each, so that only what lies on a shortest path becomes a path: halves from where the two meet, then joined.
    """
    e = of_kinds(edges, kinds).select("src", "dst", "kind")
    pairs = materialized(pairs.select("source", "target").distinct(), "pairs")
    half = -(-depth // 2)
    ends = lambda c: pairs.select(F.col(c).alias("root"), F.col(c).alias("id")).distinct()
    ahead = materialized(distances(edges, ends("source"), half, "outgoing", kinds).select(F.col("root").alias("source"), F.col("id").alias("mid"), F.col("depth").alias("a")), "ahead")
    back = materialized(distances(edges, ends("target"), depth - half, "incoming", kinds).select(F.col("root").alias("target"), F.col("id").alias("mid"), F.col("depth").alias("b")), "back")
    met = pairs.join(ahead, "source").join(back, ["target", "mid"])
    least = met.groupBy("source", "target").agg(F.min(F.col("a") + F.col("b")).alias("n"))
    # a path of n steps meets in one node: the last that the source's half can reach
    met = met.join(least, ["source", "target"]).where((F.col("a") + F.col("b") == F.col("n")) & (F.col("a") == F.least(F.col("n"), F.lit(half))))
    met = materialized(met.select("source", "target", "mid", "a", "b"), "met")

    def halves(root: str, near: str, far: str, labels: DataFrame, n: str, size: int, forward: bool) -> DataFrame:
        """(root, mid, nodes, kinds) from `mid` towards the root, against the labels; the nearer node first in order of the path."""
        at = met.select(root, "mid", F.col("mid").alias("end"), F.col(n).alias("left"), F.array("mid").alias("nodes"), F.array().cast("array<string>").alias("kinds")).distinct()
        done, live = at.where("left = 0"), at.where("left > 0")
        to = labels.select(root, F.col("mid").alias("to"), F.col(n).alias("at"))
        for level in range(size):
            step = live.join(e.select(F.col(near).alias("to"), F.col(far).alias("end"), "kind"), "end").join(to, [root, "to"]).where(F.col("at") == F.col("left") - 1)
            grown = (lambda a, b: F.concat(b, F.array(a))) if forward else (lambda a, b: F.concat(F.array(a), b))
            step = step.select(root, "mid", F.col("to").alias("end"), (F.col("left") - 1).alias("left"), grown(F.col("to"), F.col("nodes")).alias("nodes"), grown(F.col("kind"), F.col("kinds")).alias("kinds"))
            step = materialized(step, f"paths{level}")
            done, live = done.unionByName(step.where("left = 0")), step.where("left > 0")
        return done.select(root, "mid", "nodes", "kinds")

    first = halves("source", "src", "dst", ahead, "a", half, False)
    last = halves("target", "dst", "src", back, "b", depth - half, True).select("target", "mid", F.col("nodes").alias("nodes2"), F.col("kinds").alias("kinds2"))
    out = met.select("source", "target", "mid").join(first, ["source", "mid"]).join(last, ["target", "mid"])
    out = out.select("source", "target", F.concat("nodes", F.slice("nodes2", F.lit(2), F.size("nodes2"))).alias("nodes"), F.concat("kinds", "kinds2").alias("kinds"))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.array_join("nodes", ">"), F.array_join("kinds", ">")))
        out = out.withColumn("nth", nth).where(F.col("nth") <= min(most, MOST_PATHS)).drop("nth")
    return out


def maximal_paths(paths: DataFrame) -> DataFrame:
    """Paths that are no contiguous part of a longer one."""
    told = paths.withColumn("told", F.concat(F.lit(">"), F.array_join("nodes", ">"), F.lit(">"))).withColumn("n", F.size("nodes"))
    longer = told.select(F.col("told").alias("other"), F.col("n").alias("m"))
    return told.join(longer, (F.col("m") > F.col("n")) & F.col("other").contains(F.col("told")), "left_anti").drop("told", "n")


def flows(edges: DataFrame, anchors: list[str], depth: int = DEPTH, maximal: bool = True) -> DataFrame:
    """One shortest call path of each ordered pair of anchors (eight at most), without those that are part of another."""
    spark = edges.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in anchors for b in anchors if a != b], "source string, target string")
    found = shortest_paths(edges, pairs, min(depth, 4), ["call", "instantiate", "renders"], most=1)
    return maximal_paths(found) if maximal else found


def expand(edges: DataFrame, roots: DataFrame, preset: str) -> DataFrame:
    """(root, id, depth): the neighbourhoods that locate, flow and impact questions look at."""
    if preset == "locate":
        return distances(edges, roots, 1, "both", ["import", "inherit", "implement", *STRUCTURE_KINDS]).drop("via")
    if preset == "flow":
        return distances(edges, roots, 3, "both", ["call", "instantiate"]).drop("via")
    if preset == "impact":
        return distances(edges, roots, 3, "incoming").drop("via")
    raise ValueError(f"unknown preset {preset!r}")


PRESET_NODES = {"locate": 50, "flow": 70, "impact": 60}


def blast_radius(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """(id, n_refs, n_files, files): for each anchor (id) its incoming references, and the files they come from, the first three
    by name; with `tested` (id) also `untested`: whether it is of a kind that tests refer to and none does."""
    refs = edges.where(F.col("kind").isin(REFERENCE_KINDS)).join(anchors.select(F.col("id").alias("dst")), "dst", "left_semi")
    at = refs.join(nodes.select(F.col("id").alias("src"), "file_path"), "src").groupBy(F.col("dst").alias("id"), "file_path").agg(F.count("*").alias("n"))
    total = at.groupBy("id").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_files"))
    three = at.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("file_path"))).where("nth <= 3")
    three = three.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))
    out = anchors.select("id").join(total.join(three, "id"), "id", "left").fillna({"n_refs": 0, "n_files": 0, "files": ""})
    if tested is None:
        return out
    bare = nodes.where(F.col("kind").isin("function", "method", "class", "interface")).join(anchors.select("id"), "id", "left_semi").select("id").join(tested.select("id"), "id", "left_anti")
    return out.join(bare.select("id", F.lit(True).alias("untested")), "id", "left").fillna({"untested": False})


def descendants(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, id, depth): all that the roots contain, themselves included."""
    return distances(edges, roots, depth, "outgoing", STRUCTURE_KINDS).drop("via")
