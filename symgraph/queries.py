"""The registered queries over the star-schema graph and tables, each with the DuckDB SQL of its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph import code, star
from symgraph.functions import text as T
from symgraph.functions.shared import shared_dir
from symgraph.operators import evidence as E
from symgraph.operators import graph as G
from symgraph.operators import search as S
from symgraph.operators import traverse as V
from symgraph.operators import views as W
from symgraph.operators.model import scope_members
from symgraph.sources.extract import build

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
REFS = "('call','import','inherit','implement','type_use','instantiate','renders')"


def query(sql: str | None = None, recursive: bool = False, star_graph: bool = True):
    """Register a query under its function's name, with its SQL over sg_nodes and sg_edges or the tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head, body = f"WITH {'RECURSIVE ' if recursive else ''}{star.CTE}", sql.strip()
            ORACLE_SQL[f.__name__] = (head + (", " + body[5:] if body.startswith("WITH ") else " " + body)) if star_graph else body
        return f

    return add


def _roots(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "root string, id string")


# --- reading the graph


@query("SELECT 'nodes' AS what, count(*) AS n FROM sg_nodes UNION ALL SELECT 'edges', count(*) FROM sg_edges UNION ALL SELECT 'edges:' || kind, count(*) FROM sg_edges GROUP BY kind")
def graph_stats(spark, d):
    return G.stats(star.nodes(spark, d), star.edges(spark, d))


@query("SELECT kind, count(*) AS n FROM sg_nodes GROUP BY kind")
def kind_counts(spark, d):
    return W.kind_counts(star.nodes(spark, d))


@query("SELECT n.id, n.name FROM sg_edges e JOIN sg_nodes n ON n.id = e.src WHERE e.dst = 'p:1' AND e.kind = 'call'")
def callers_of(spark, d):
    return G.callers_of(star.nodes(spark, d), star.edges(spark, d), "p:1").select("id", "name")


@query("SELECT n.id, n.name FROM sg_edges e JOIN sg_nodes n ON n.id = e.dst WHERE e.src = 'o:1' AND e.kind = 'call'")
def callees_of(spark, d):
    return G.callees_of(star.nodes(spark, d), star.edges(spark, d), "o:1").select("id", "name")


@query("SELECT n.id, n.name FROM sg_edges e JOIN sg_nodes n ON n.id = e.dst WHERE e.src = 'c:1' AND e.kind = 'has_member'")
def members_of(spark, d):
    return G.members_of(star.nodes(spark, d), star.edges(spark, d), "c:1").select("id", "name")


@query("SELECT n.id, n.name FROM sg_edges e JOIN sg_nodes n ON n.id = e.dst WHERE e.src = 'p:1' AND e.kind = 'import'")
def imports_of(spark, d):
    return G.imports_of(star.nodes(spark, d), star.edges(spark, d), "p:1").select("id", "name")


@query("SELECT src, dst, kind FROM sg_edges WHERE src = 'n:1' AND kind = 'owns'")
def edges_from_kind(spark, d):
    return G.edges_from(star.edges(spark, d), "n:1", "owns").select("src", "dst", "kind")


@query("SELECT src, dst, kind FROM sg_edges WHERE dst = 's:1'")
def incoming_edges(spark, d):
    return G.edges_to(star.edges(spark, d), "s:1").select("src", "dst", "kind")


@query("SELECT id, kind, name, file_path FROM sg_nodes WHERE id = 'n:3'")
def get_node(spark, d):
    return G.get_node(star.nodes(spark, d), "n:3")


@query(
    """WITH p AS (SELECT dst AS src, min(src) AS dst FROM sg_edges WHERE kind IN ('owns','has_member') GROUP BY dst),
    r(id, depth) AS (SELECT 'o:1', 0 UNION ALL SELECT p.dst, depth + 1 FROM r JOIN p ON p.src = r.id WHERE depth < 50)
    SELECT depth::BIGINT AS depth, id FROM r WHERE depth > 0""",
    recursive=True,
)
def inheritance_chain(spark, d):
    up = star.edges(spark, d).where(F.col("kind").isin("owns", "has_member")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("inherit").alias("kind"))
    return G.parent_chain(up, "o:1")


@query(
    """WITH b AS (SELECT src AS a, dst AS b FROM sg_edges UNION SELECT dst, src FROM sg_edges),
    r(id, depth) AS (SELECT 'n:1', 0 UNION SELECT b.b, depth + 1 FROM r JOIN b ON b.a = r.id WHERE depth < 2)
    SELECT id, min(depth)::BIGINT AS depth FROM r GROUP BY id""",
    recursive=True,
)
def neighborhood_d2(spark, d):
    return V.neighbourhood(star.edges(spark, d), _roots(spark, "n:1"), 2)[0].select("id", "depth")


@query(
    """WITH b AS (SELECT src AS a, dst AS b FROM sg_edges UNION SELECT dst, src FROM sg_edges),
    r(id, depth) AS (SELECT 'n:1', 0 UNION SELECT b.b, depth + 1 FROM r JOIN b ON b.a = r.id WHERE depth < 1)
    SELECT DISTINCT e.src, e.dst, e.kind FROM sg_edges e WHERE e.src IN (SELECT id FROM r) OR e.dst IN (SELECT id FROM r)""",
    recursive=True,
)
def neighborhood_edges_d2(spark, d):
    return V.neighbourhood(star.edges(spark, d), _roots(spark, "n:1"), 2)[1].select("src", "dst", "kind")


@query(
    f"""SELECT DISTINCT e.dst AS id FROM sg_edges e JOIN sg_nodes n ON n.id = e.src JOIN sg_nodes c ON n.file_path = replace(c.id, ':', '')
    WHERE e.kind IN {REFS} AND c.file_path = 'n1'"""
)
def test_covered(spark, d):
    nodes = star.nodes(spark, d)
    tests = nodes.where(F.col("file_path") == "n1").select(F.replace("id", F.lit(":"), F.lit("")).alias("file_path"))
    marked = nodes.join(tests.withColumn("is_test", F.lit(True)), "file_path", "left")
    return G.test_covered(marked, star.edges(spark, d), F.coalesce("is_test", F.lit(False)))


@query(
    "SELECT 'o:' || l_orderkey AS src, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_orderkey",
)
def unresolved_summary(spark, d):
    refs = star.table(spark, d, "lineitem").select(F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"), F.col("l_partkey").alias("p_partkey"))
    return G.unresolved_by_symbol(refs, star.table(spark, d, "part").where("p_size < 25"), "p_partkey")


@query("SELECT dst AS id, kind, string_agg(DISTINCT src, ',' ORDER BY src) AS sources FROM sg_edges GROUP BY dst, kind")
def reverse_index(spark, d):
    return S.incoming_index(star.edges(spark, d)).select("id", "kind", F.array_join("sources", ",").alias("sources"))


# --- traversal


@query(
    """WITH r(id, d) AS (SELECT 'c:1', 0 UNION SELECT e.dst, d + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM sg_edges) e ON e.src = r.id WHERE d < 3)
    SELECT id, min(d)::BIGINT AS depth FROM r GROUP BY id""",
    recursive=True,
)
def region_uncapped(spark, d):
    return V.distances(star.edges(spark, d), _roots(spark, "c:1"), 3).select("id", "depth")


def _level(n: int) -> str:
    """SQL of a level of the capped region: candidates in order of their parents, four a file at most, sixty nodes in all."""
    held = " UNION ALL ".join(f"SELECT file_path FROM l{i}" for i in range(1, n))
    seen = " UNION ALL ".join(["SELECT 'c:1' AS id", *(f"SELECT id FROM l{i}" for i in range(1, n))])
    return f"""c{n} AS (SELECT e.dst AS id, e.file_path, min(struct_pack(a := p.place, b := e.kind, c := e.src)) AS ord FROM l{n - 1} p JOIN e ON e.src = p.id WHERE e.dst NOT IN ({seen}) GROUP BY e.dst, e.file_path),
    k{n} AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ord, id){f" + (SELECT count(*) FROM ({held}) h WHERE h.file_path = c{n}.file_path)" if n > 1 else " * 0"} AS used FROM c{n}),
    l{n} AS (SELECT * FROM (SELECT id, file_path, row_number() OVER (ORDER BY ord, id) AS place FROM k{n} WHERE used <= 4) WHERE place + (SELECT count(*) FROM ({seen})) <= 60)"""


@query(
    f"""WITH e AS (SELECT e.src, e.dst, e.kind, n.file_path FROM sg_edges e JOIN sg_nodes n ON n.id = e.dst), l0 AS (SELECT 'c:1' AS id, '' AS file_path, 0::BIGINT AS place),
    {_level(1)}, {_level(2)}, {_level(3)}
    SELECT 'c:1' AS root, * FROM (SELECT id, 0::BIGINT AS distance, place FROM l0 UNION ALL SELECT id, 1, place FROM l1 UNION ALL SELECT id, 2, place FROM l2 UNION ALL SELECT id, 3, place FROM l3)"""
)
def region_file_cap(spark, d):
    roots = _roots(spark, "c:1").withColumn("place", F.lit(0))
    return V.region(star.nodes(spark, d), star.edges(spark, d), roots, V.Limits(depth=3, nodes=60, per_file=4))[0]


_IMPACT = """WITH e AS (SELECT DISTINCT src, dst FROM sg_edges WHERE kind IN ('call', 'import')),
    r(root, id, d) AS ({roots} UNION SELECT r.root, e.src, d + 1 FROM r JOIN e ON e.dst = r.id WHERE d < 3)
    SELECT root, id, min(d)::BIGINT AS depth FROM r WHERE d > 0 GROUP BY root, id"""


@query(
    """WITH r(id, d) AS (SELECT 'c:1', 0 UNION SELECT e.dst, d + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM sg_edges) e ON e.src = r.id WHERE d < 3),
    m AS (SELECT id, min(d) AS d FROM r GROUP BY id),
    x AS (SELECT DISTINCT e.src, e.dst, e.kind, CASE WHEN a.d = 0 OR b.d = 0 THEN 0 ELSE greatest(a.d, b.d) END AS prio FROM sg_edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst)
    SELECT src, dst, kind, prio::BIGINT AS prio FROM (SELECT *, row_number() OVER (ORDER BY prio, src, dst, kind) AS nth FROM x) WHERE nth <= 120""",
    recursive=True,
)
def region_edge_rank(spark, d):
    edges = star.edges(spark, d)
    return V.ranked_edges(edges, V.distances(edges, _roots(spark, "c:1"), 3)).drop("root")


@query(_IMPACT.format(roots="SELECT 's:1', 's:1', 0"), recursive=True)
def impact_cone(spark, d):
    return V.impact(star.edges(spark, d), _roots(spark, "s:1")).select("root", "id", "depth")


@query(_IMPACT.format(roots="SELECT 's:' || s_suppkey, 's:' || s_suppkey, 0 FROM supplier WHERE s_nationkey = 1"), recursive=True)
def impact_batch(spark, d):
    key = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string"))
    roots = star.table(spark, d, "supplier").where("s_nationkey = 1").select(key.alias("root"), key.alias("id"))
    return V.impact(star.edges(spark, d), roots).select("root", "id", "depth")


@query(
    """WITH p(e, nodes, d) AS (SELECT 'n:1', ['n:1'], 0 UNION ALL SELECT x.dst, list_append(nodes, x.dst), d + 1 FROM p JOIN sg_edges x ON x.src = p.e
        WHERE d < 4 AND p.e <> 's:1' AND NOT list_contains(nodes, x.dst)),
    h AS (SELECT * FROM p WHERE e = 's:1')
    SELECT array_to_string(nodes, '>') AS path, count(*) AS n FROM h WHERE d = (SELECT min(d) FROM h) GROUP BY ALL""",
    recursive=True,
)
def path_all_shortest(spark, d):
    pairs = spark.createDataFrame([("n:1", "s:1")], "source string, target string")
    found = V.shortest_paths(star.edges(spark, d), pairs, 4)
    return found.groupBy(F.array_join("nodes", ">").alias("path")).agg(F.count("*").alias("n"))


@query(
    f"""WITH top AS (SELECT dst AS id FROM sg_edges WHERE kind = 'call' GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 20),
    x AS (SELECT e.dst AS id, n.file_path FROM sg_edges e JOIN top ON top.id = e.dst JOIN sg_nodes n ON n.id = e.src WHERE e.kind IN {REFS}),
    f AS (SELECT id, list_sort(list(DISTINCT file_path)) AS fs, count(*) AS n FROM x GROUP BY id)
    SELECT id, n AS n_refs, len(fs)::BIGINT AS n_files, array_to_string(fs[1:3], ',') AS files FROM f""",
)
def blast_radius(spark, d):
    edges = star.edges(spark, d)
    top = edges.where("kind = 'call'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(20).select("id")
    return V.blast_radius(star.nodes(spark, d), edges, top)


@query(
    """WITH o AS (SELECT DISTINCT e.src, e.dst FROM sg_edges e WHERE e.kind = 'call'),
    a AS (SELECT src AS id FROM o WHERE src IN ('o:1', 'o:2', 'o:3') UNION SELECT min(dst) FROM o WHERE src IN ('o:1', 'o:2', 'o:3') GROUP BY src)
    SELECT x.id AS source, y.id AS target, x.id || '>' || y.id AS path FROM a x JOIN a y ON x.id <> y.id JOIN o ON o.src = x.id AND o.dst = y.id""",
)
def flow_pairs(spark, d):
    edges = star.edges(spark, d)
    first = edges.where("kind = 'call' and src in ('o:1', 'o:2', 'o:3')").groupBy("src").agg(F.min("dst").alias("dst")).collect()
    anchors = sorted({r.src for r in first} | {r.dst for r in first})
    return V.flows(edges, anchors).select("source", "target", F.array_join("nodes", ">").alias("path"))


_EXPAND = """WITH e AS (SELECT DISTINCT src, dst FROM sg_edges WHERE kind IN ({kinds})), b AS ({both}),
    r(id, d) AS (SELECT '{start}', 0 UNION SELECT b.b, d + 1 FROM r JOIN b ON b.a = r.id WHERE d < {depth})
    SELECT id, min(d)::BIGINT AS depth FROM r GROUP BY id"""
_BOTH = "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e"


@query(_EXPAND.format(kinds="'import','owns','has_member'", both=_BOTH, start="c:1", depth=1), recursive=True)
def expand_locate(spark, d):
    return V.expand(star.edges(spark, d), _roots(spark, "c:1"), "locate").select("id", "depth")


@query(_EXPAND.format(kinds="'call'", both=_BOTH, start="o:1", depth=3), recursive=True)
def expand_flow(spark, d):
    return V.expand(star.edges(spark, d), _roots(spark, "o:1"), "flow").select("id", "depth")


@query(_EXPAND.format(kinds="'call','import','owns','has_member'", both="SELECT dst AS a, src AS b FROM e", start="p:1", depth=3), recursive=True)
def expand_impact(spark, d):
    return V.expand(star.edges(spark, d), _roots(spark, "p:1"), "impact").select("id", "depth")


# --- search


def _searched(spark, d):
    return S.prepared(star.nodes(spark, d))


@query("SELECT id, name FROM sg_nodes WHERE lower(name) = lower('Customer#000000001') OR lower(name) = (SELECT min(lower(name)) FROM sg_nodes WHERE kind = 'function')")
def name_exact(spark, d):
    nodes = star.nodes(spark, d)
    first = nodes.where("kind = 'function'").agg(F.min(F.lower("name"))).first()[0]
    return S.by_name(nodes, "Customer#000000001").unionByName(S.by_name(nodes, first or "")).select("id", "name")


@query("SELECT id, name FROM sg_nodes WHERE starts_with(lower(name), 'cu')")
def name_prefix(spark, d):
    return S.starting_with(star.nodes(spark, d), "cu").select("id", "name")


@query("SELECT id, name, lower(name) = 'widget' AS exact FROM sg_nodes WHERE contains(lower(name), 'widget')")
def name_substring(spark, d):
    return S.match(star.nodes(spark, d), "name", "widget").select("id", "name", "exact")


@query("SELECT id, name FROM sg_nodes WHERE kind = 'function' AND contains(lower(name), 'idge')")
def trigram_match(spark, d):
    nodes = star.nodes(spark, d).where("kind = 'function'")
    return S.trigram_match(nodes, S.trigram_index(nodes), "idge").select("id", "name")


_POINTS = """CASE WHEN contains(lower(name), '{t}') THEN (CASE WHEN lower(name) = '{t}' THEN 8 WHEN starts_with(lower(name), '{t}') THEN 6 ELSE 4 END) + (CASE WHEN lower(name) = '{t}' THEN 6 ELSE 3 END) ELSE 0 END
    + CASE WHEN contains(lower(file_path), '{t}') THEN (CASE WHEN kind IN ('class', 'function') THEN 5 ELSE 2 END) ELSE 0 END"""


def _qualified(spark, d):
    return star.nodes(spark, d).withColumn("qualified_name", F.concat_ws("::", "file_path", "name"))


@query("SELECT id FROM sg_nodes WHERE lower(file_path || '::' || name) = 'c1::o' || (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 1) OR lower(file_path || '::' || name) = 'n1::customer#000000001'")
def qualified_name_exact(spark, d):
    first = star.table(spark, d, "orders").where("o_custkey = 1").agg(F.min("o_orderkey")).first()[0]
    nodes = _qualified(spark, d)
    return S.by_qualified_name(nodes, f"C1::o{first}").unionByName(S.by_qualified_name(nodes, "N1::Customer#000000001")).select("id")


@query("SELECT id, lower(file_path || '::' || name) = 'n1::c' AS exact FROM sg_nodes WHERE contains(lower(file_path || '::' || name), 'n1::c')")
def qualified_name_substring(spark, d):
    return S.match(_qualified(spark, d), "qualified_name", "N1::C").select("id", "exact")


@query("SELECT id, name FROM sg_nodes WHERE name = 'Supplier#000000001' OR file_path || '::' || name = 'c1::O' || (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 1)")
def find_exact_case(spark, d):
    first = star.table(spark, d, "orders").where("o_custkey = 1").agg(F.min("o_orderkey")).first()[0]
    nodes = _qualified(spark, d)
    wrong = G.find_by_name(nodes, "supplier#000000001").unionByName(G.find_by_qualified_name(nodes, f"c1::o{first}"))
    return G.find_by_name(nodes, "Supplier#000000001").unionByName(G.find_by_qualified_name(nodes, f"c1::O{first}")).unionByName(wrong).select("id", "name")


@query(f"SELECT id, 'widgetqz' AS token, 1::BIGINT AS stage, (0.5 * p)::DOUBLE AS points FROM (SELECT id, {_POINTS.format(t='widget')} AS p FROM sg_nodes) WHERE p > 0")
def discover_ladder(spark, d):
    """A token that nothing matches falls back on its longest prefix that something does, at half the points."""
    return S.cascade(_searched(spark, d), "widgetqz").select("id", "token", F.col("stage").cast("long").alias("stage"), "points")


@query("SELECT unnest(['s:1', 'zzzz', 'c:2']) AS spec, unnest([true, false, true]) AS bound", star_graph=False)
def anchors_all(spark, d):
    ids, dropped = S.resolve_all(star.nodes(spark, d), ["s:1", "zzzz", "c:2", "s:1"])
    return spark.createDataFrame([*((i, True) for i in ids), *((i, False) for i in dropped)], "spec string, bound boolean")


@query("SELECT kind, CASE WHEN kind IN ('function', 'method', 'class') THEN ends_with(name, '1') END AS covered, count(*) AS n FROM sg_nodes GROUP BY ALL")
def test_state(spark, d):
    """Covered, not covered, or of a kind that no test refers to."""
    return star.nodes(spark, d).groupBy("kind", E.covered(F.col("kind"), F.col("name").endswith("1")).alias("covered")).agg(F.count("*").alias("n"))


@query("SELECT id FROM sg_nodes WHERE contains(lower(file_path), 'n1')")
def path_substring(spark, d):
    return S.match(star.nodes(spark, d), "file_path", "n1").select("id")


@query(
    "SELECT upper(event_type) || ' ' || json_extract_string(props, '$.k') AS endpoint, max(event_id) AS id FROM events GROUP BY ALL", star_graph=False
)
def endpoint_lookup(spark, d):
    e = star.table(spark, d, "events").select("event_id", F.col("event_type").alias("api_method"), F.get_json_object("props", "$.k").alias("api_path"))
    return S.endpoints(e.withColumnRenamed("event_id", "id"), F.col("id"))


@query("SELECT id, name FROM sg_nodes WHERE kind = 'class' AND (name LIKE '%7' OR name LIKE '%Service')")
def service_lookup(spark, d):
    return S.services(_searched(spark, d).withColumn("is_service", F.col("name").endswith("7"))).select("id", "name")


_RANK = """SELECT h.id, round(((p * CASE WHEN n >= 2 THEN 1 + (n - 1) * 0.5 ELSE 1 END + CASE WHEN f >= 2 THEN (f - 1) * 8 ELSE 0 END)
        * CASE WHEN kind IN ('class', 'function', 'method') THEN 1.4 ELSE 1 END + CASE WHEN kind <> 'file' AND length(name) <= 12 THEN 2 ELSE 0 END)::DOUBLE, 6) AS score
    FROM h JOIN g ON h.id = g.id JOIN ff ON ff.file_path = g.file_path"""


@query(
    f"""WITH s AS (SELECT id, 'red' AS t, {_POINTS.format(t='red')} AS p FROM sg_nodes UNION ALL SELECT id, 'widget', {_POINTS.format(t='widget')} FROM sg_nodes),
    k AS (SELECT * FROM s WHERE p > 0), g AS (SELECT * FROM sg_nodes),
    h AS (SELECT id, sum(p) AS p, count(DISTINCT t) AS n FROM k GROUP BY id),
    ff AS (SELECT file_path, count(DISTINCT t) AS f FROM k JOIN g USING (id) GROUP BY file_path) {_RANK}"""
)
def discover_score(spark, d):
    return S.discover(star.nodes(spark, d), "red widget", None).select("id", F.round("score", 6).alias("score"))


@query(
    """WITH t(token, term, stage) AS (VALUES ('rings', 'rings', 0), ('rings', 'ring', 1), ('boltz', 'boltz', 0)),
    hit AS (SELECT DISTINCT token, stage, id FROM t JOIN sg_nodes ON contains(lower(name), term) OR contains(lower(file_path), term)),
    pool AS (SELECT id, name FROM sg_nodes WHERE starts_with(lower(name), 'bo') ORDER BY name, id LIMIT 600),
    fz AS (SELECT id, name, least(CASE WHEN levenshtein('boltz', substr(lower(name), 1, 5)) <= 1 THEN levenshtein('boltz', substr(lower(name), 1, 5)) ELSE 99 END,
        CASE WHEN levenshtein('boltz', lower(name)) <= 1 THEN levenshtein('boltz', lower(name)) ELSE 99 END) AS d FROM pool),
    al AS (SELECT * FROM hit UNION ALL SELECT 'boltz', 9, id FROM (SELECT * FROM fz WHERE d < 99 ORDER BY d, name, id LIMIT 12)
           UNION ALL SELECT 'rings', 9, id FROM sg_nodes WHERE false)
    SELECT token, stage::BIGINT AS stage, id FROM al a WHERE stage = (SELECT min(stage) FROM al b WHERE b.token = a.token)"""
)
def discover_cascade(spark, d):
    nodes = _searched(spark, d)
    return S.cascade(nodes, "rings").unionByName(S.cascade(nodes, "boltz")).select("token", F.col("stage").cast("long").alias("stage"), "id")


@query(
    """WITH pool AS (SELECT id, name FROM sg_nodes WHERE starts_with(lower(name), 'sm') ORDER BY name, id LIMIT 600),
    z AS (SELECT id, name, CASE WHEN levenshtein('smoll', substr(lower(name), 1, 5)) <= 1 THEN levenshtein('smoll', substr(lower(name), 1, 5))
        WHEN levenshtein('smoll', lower(name)) <= 1 THEN levenshtein('smoll', lower(name)) END AS d FROM pool)
    SELECT id, (CASE WHEN d = 0 THEN 6 ELSE 4 - d END)::DOUBLE AS points FROM z WHERE d IS NOT NULL ORDER BY d, name, id LIMIT 12"""
)
def discover_fuzzy(spark, d):
    return S.fuzzy(star.nodes(spark, d), "smoll").select("id", F.col("points").cast("double").alias("points"))


@query(
    """WITH q(spec) AS (SELECT unnest(['s:1', 'supplier#000000002', 'zzzz', (SELECT min(lower(name)) FROM sg_nodes WHERE kind = 'function')])),
    m AS (SELECT spec, id, CASE WHEN id = spec THEN 0 ELSE 1 END AS stage FROM q JOIN sg_nodes ON id = spec OR lower(name) = spec),
    b AS (SELECT spec, count(*) AS n, min(id) AS first_id FROM m WHERE stage = (SELECT min(stage) FROM m x WHERE x.spec = m.spec) GROUP BY spec)
    SELECT q.spec, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(CASE WHEN n > 10 THEN 10 ELSE n END, 0) AS n, first_id FROM q LEFT JOIN b USING (spec)"""
)
def anchor_waterfall(spark, d):
    nodes = star.nodes(spark, d)
    first = nodes.where("kind = 'function'").agg(F.min(F.lower("name"))).first()[0]
    rows = [(spec, *S.resolve_anchor(nodes, spec)) for spec in ("s:1", "supplier#000000002", "zzzz", first)]
    return spark.createDataFrame([(spec, status, len(ids), min(ids, default=None)) for spec, status, ids in rows], "spec string, status string, n long, first_id string")


def _count(kind: str) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in T.PLAN_WORDS[kind])


@query(
    f"""WITH s AS (SELECT conv_id, turn, {_count('locate')} AS l, {_count('flow')} AS f, {_count('impact')} AS i FROM conversations)
    SELECT conv_id, turn, CASE WHEN i > f AND i > l THEN 'impact' WHEN f > l THEN 'flow' ELSE 'locate' END AS strategy FROM s""",
    star_graph=False,
)
def plan_strategy(spark, d):
    return star.table(spark, d, "conversations").select("conv_id", "turn", T.strategy_column(F.col("text")).alias("strategy"))


_STOP = ", ".join(f"'{w}'" for w in sorted(T.HARD_STOPWORDS))


@query(
    f"""WITH w AS (SELECT unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z0-9_/]', ' ', 'g')), ' +')) AS token FROM conversations)
    SELECT token, count(*) AS n FROM w WHERE length(token) > 1 AND token NOT IN ({_STOP}) GROUP BY token""",
    star_graph=False,
)
def tokenize(spark, d):
    return star.table(spark, d, "conversations").select(F.explode(T.token_column(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# --- model and resolution analogues


@query(
    """WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events),
    r AS (SELECT DISTINCT user_id, sec // 86400 * 86400 AS lo, sec // 86400 * 86400 + 86399 AS hi FROM e UNION SELECT DISTINCT user_id, sec // 3600 * 3600, sec // 3600 * 3600 + 3599 FROM e)
    SELECT event_id AS point, arg_min(lo, hi - lo) AS range, min(hi - lo) AS size FROM e JOIN r USING (user_id) WHERE sec BETWEEN lo AND hi GROUP BY event_id""",
    star_graph=False,
)
def innermost_scope(spark, d):
    e = star.table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    whole = lambda n: (F.floor(F.col("at") / n) * n).cast("long")
    ranges = None
    for n in (86400, 3600):
        one = e.select("user_id", whole(n).alias("lo"), (whole(n) + n - 1).alias("hi")).distinct()
        ranges = one if ranges is None else ranges.unionByName(one)
    return G.innermost(ranges.withColumn("range", F.col("lo")), e.withColumnRenamed("event_id", "point"), "user_id")


@query(
    """WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
    s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    m AS (SELECT c_custkey, s_suppkey, CASE WHEN s_suppkey = c_custkey THEN 1 WHEN s_nationkey = c_nationkey THEN 2 ELSE 3 END AS prio FROM c JOIN s ON c.n_regionkey = s.n_regionkey OR s_suppkey = c_custkey)
    SELECT c_custkey AS ref, arg_min(s_suppkey, prio::BIGINT * 1000000000 + s_suppkey) AS target, CASE min(prio) WHEN 1 THEN 'scope' WHEN 2 THEN 'qualified_name' ELSE 'global_fallback' END AS method FROM m GROUP BY c_custkey""",
    star_graph=False,
)
def scope_walk_resolve(spark, d):
    from symgraph.operators.resolve import first_match_wins

    nation = star.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    c = star.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ref"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    s = star.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("target"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    # the first supplier of a nation and of a region stand for all of them, so no join is larger than its references
    own = c.join(s.select("target"), F.col("ref") == F.col("target")).select("ref", "target", F.lit("scope").alias("method"), F.lit(1).alias("priority"))
    near = c.join(s.groupBy("nation").agg(F.min("target").alias("target")), "nation").select("ref", "target", F.lit("qualified_name").alias("method"), F.lit(2).alias("priority"))
    far = c.join(s.groupBy("region").agg(F.min("target").alias("target")), "region").select("ref", "target", F.lit("global_fallback").alias("method"), F.lit(3).alias("priority"))
    return first_match_wins([own, near, far], "ref", "target")


_HREFS = r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


@query(_HREFS, star_graph=False)
def html_hrefs(spark, d):
    return star.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(
    rf"""WITH h AS (SELECT DISTINCT href FROM ({_HREFS})), p AS (SELECT page_id, '/' || regexp_extract(url, '//[^/]+/([a-z]+)/', 1) AS tail FROM pages)
    SELECT href, count(*) AS n, min(page_id) AS first_page FROM h JOIN p ON length(tail) > 1 AND ends_with(href, tail) GROUP BY href""",
    star_graph=False,
)
def import_suffix_match(spark, d):
    pages = star.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("tail")).where("tail <> ''")
    # a suffix that is a whole path segment is an equi-join on the last segment
    hrefs = html_hrefs(spark, d).select("href").distinct().where(F.col("href").contains("/")).withColumn("tail", F.element_at(F.split("href", "/"), -1))
    return hrefs.join(pages, "tail").groupBy("href").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(
    rf"""WITH h AS (SELECT DISTINCT href FROM ({_HREFS}) WHERE href LIKE '/%')
    SELECT 'external::' || substr(href, 2) AS id, CASE WHEN regexp_matches(substr(href, 2, 1), '[A-Z]') THEN 'class' ELSE 'variable' END AS kind FROM h
    WHERE string_split(href, '/')[2] NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)""",
    star_graph=False,
)
def external_mint(spark, d):
    hrefs = html_hrefs(spark, d).select("href").distinct().where(F.col("href").startswith("/")).withColumn("first", F.get(F.split("href", "/"), 1))
    known = star.table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("first")).distinct()
    name = F.substring("href", 2, 1 << 20)
    return hrefs.join(known, "first", "left_anti").select(F.concat(F.lit("external::"), name).alias("id"), F.when(name.rlike("^[A-Z]"), "class").otherwise("variable").alias("kind"))


@query("SELECT method, CASE WHEN method IS NULL THEN 'structural' WHEN method = 'R' THEN 'low' ELSE 'high' END AS confidence, count(*) AS n FROM sg_edges GROUP BY ALL")
def method_confidence(spark, d):
    tag = T.confidence_tag(F.when(F.col("method") == "R", "global_fallback").otherwise(F.col("method")))
    return star.edges(spark, d).groupBy("method", tag.alias("confidence")).agg(F.count("*").alias("n"))


# --- extraction and resolution, over the tables as a program (symgraph/code.py)

_P, _W, _J = ("'{0}' || s_nationkey || '/{1}' || s_suppkey || '{2}'".format(*x) for x in (("n", "s", ".py"), ("web/n", "w", ".ts"), ("java/n", "J", ".java")))
_BASE, _ITEM, _REPO = "'n' || {n} || '/base.py'", "'web/n' || {n} || '/item.ts'", "'java/n' || {n} || '/Repo' || {n} || '.java'"
_OF = f"""WITH f AS (SELECT s_suppkey AS s, s_nationkey AS n, {_P} AS p, {_W} AS w, {_J} AS j, 'web/n' || s_nationkey || '/p' || s_suppkey || '.html' AS h,
    {_BASE.format(n='s_nationkey')} || '::Base' || s_nationkey AS base, {_ITEM.format(n='s_nationkey')} || '::Item' || s_nationkey AS item, {_REPO.format(n='s_nationkey')} || '::Repo' || s_nationkey AS repo FROM supplier),
    g AS (SELECT n_nationkey AS n, {_BASE.format(n='n_nationkey')} AS b, {_ITEM.format(n='n_nationkey')} AS i, {_REPO.format(n='n_nationkey')} AS r FROM nation)"""


def _union(rows: str) -> str:
    return " UNION ALL ".join(f"SELECT {r}" for r in rows.strip().split("\n"))


@query(
    f"{_OF} "
    + _union(
        """p || '::' || p AS from_id, base AS to_id, 'import' AS kind, 'import' AS method FROM f
p || '::' || p, 'external::json::json', 'import', 'import' FROM f
p || '::Sup' || s, base, 'inherit', 'import' FROM f
p || '::Sup' || s || '::run', p || '::Sup' || s || '::step', 'call', 'scope' FROM f
p || '::Sup' || s || '::step', p || '::helper' || s, 'call', 'scope' FROM f
p || '::helper' || s, base, 'call', 'import' FROM f
p || '::helper' || s, base || '::ping', 'call', 'scope' FROM f
p || '::helper' || s, 'external::builtin::print', 'call', 'global_fallback' FROM f
p || '::helper' || s, 'external::json::json::dumps', 'call', 'import' FROM f
w || '::' || w, item, 'import', 'import' FROM f
w || '::Store' || s, item, 'type_use', 'import' FROM f
w || '::Store' || s || '::load', item || '::show', 'call', 'scope' FROM f
w || '::Store' || s || '::load', w || '::Store' || s || '::clear', 'call', 'scope' FROM f
w || '::Store' || s || '::clear', item, 'instantiate', 'import' FROM f
j || '::J' || s, repo, 'inherit', 'global_fallback' FROM f
j || '::J' || s || '::save', repo || '::put', 'call', 'scope' FROM f
h || '::' || h, w || '::' || w, 'import', 'import' FROM f
i || '::Item' || n || '::show', 'external::builtin::console::log', 'call', 'global_fallback' FROM g"""
    ),
    star_graph=False,
)
def code_references(spark, d):
    """What every reference of the program is bound to, and how."""
    out = build(code.sources(spark, d))[0].resolved
    return out.select(F.col("from_symbol_id").alias("from_id"), F.col("to_symbol_id").alias("to_id"), "kind", F.col("resolution_method").alias("method"))


@query(
    f"{_OF} "
    + _union(
        """p || '::' || p AS id, 'file' AS kind FROM f
p || '::Sup' || s, 'class' FROM f
p || '::Sup' || s || '::' || unnest(['run', 'step']), 'function' FROM f
p || '::helper' || s, 'function' FROM f
w || '::' || w, 'file' FROM f
w || '::Store' || s, 'class' FROM f
w || '::Store' || s || '::item', 'variable' FROM f
w || '::Store' || s || '::' || unnest(['load', 'clear']), 'method' FROM f
j || '::' || j, 'file' FROM f
j || '::J' || s, 'class' FROM f
j || '::J' || s || '::repo', 'variable' FROM f
j || '::J' || s || '::save', 'method' FROM f
h || '::' || h, 'file' FROM f
h || '::root', 'variable' FROM f
b || '::' || b, 'file' FROM g
b || '::Base' || n, 'class' FROM g
b || '::Base' || n || '::ping', 'function' FROM g
i || '::' || i, 'file' FROM g
i || '::Item' || n, 'class' FROM g
i || '::Item' || n || '::show', 'method' FROM g
r || '::' || r, 'file' FROM g
r || '::Repo' || n, 'class' FROM g
r || '::Repo' || n || '::put', 'method' FROM g
'::project', 'project'
unnest(['external::builtin::console', 'external::builtin::print']), 'function'
unnest(['external::builtin::console::log', 'external::json::json::dumps']), 'method'
'external::json::json', 'variable'"""
    ),
    star_graph=False,
)
def code_symbols(spark, d):
    """All symbols of the program, those outside it included."""
    return build(code.sources(spark, d))[0].symbols.select("id", "kind")


@query(f"{_OF} SELECT 'unresolved_reference' AS kind, 'info' AS severity, p AS file_path, 'cannot resolve missing' || s || '.go' AS message FROM f", star_graph=False)
def code_diagnostics(spark, d):
    return build(code.sources(spark, d))[0].diagnostics.select("kind", "severity", "file_path", "message")


@query(
    f"{_OF}, c AS (SELECT n, count(*) AS k FROM f GROUP BY n) SELECT {_BASE.format(n='n')} || '::Base' || n AS id, 3 * k AS n_refs, k AS n_files, false AS untested FROM c",
    star_graph=False,
)
def code_blast_radius(spark, d):
    """What refers to the classes that suppliers' files import, where the suppliers' files are taken to be tests."""
    model = build(code.sources(spark, d))[0]
    nodes, edges = G.build(model.symbols, model.containments, model.resolved)
    used = edges.where("kind = 'import' and dst rlike '::Base[0-9]+$'").select(F.col("dst").alias("id")).distinct()
    tested = G.test_covered(nodes, edges, F.col("file_path").rlike(r"/s[0-9]+\.py$"))
    return V.blast_radius(nodes, edges, used, tested).drop("files")


# --- routes, models, visibility, errors: the second program of symgraph/code.py

_S = """WITH f AS (SELECT s_suppkey AS s, 'api/s' || s_suppkey || '.py' AS a, 'nest/c' || s_suppkey || '.ts' AS c, 'web/r' || s_suppkey || '.js' AS r, 'ui/v' || s_suppkey || '.jsx' AS v,
    'ui/box' || s_suppkey || '.js' AS x, 'jv/K' || s_suppkey || '.java' AS j, 'bad/b' || s_suppkey || '.py' AS b FROM supplier)"""
#: Symbols of each file but its own: path, names from the outermost, kind, kind of the scope, exported, visibility, table, service.
_OWN = """a, 'Row' || s, 'class', 'global', true, 'public', 'rows' || s, false
a, 'Row' || s || '::__tablename__', 'variable', 'class', true, 'public', NULL, false
a, 'read' || s, 'function', 'global', true, 'public', NULL, false
a, 'save' || s, 'function', 'global', true, 'public', NULL, false
a, '_own' || s, 'function', 'global', false, 'private', NULL, false
a, '__very' || s, 'function', 'global', true, 'public', NULL, false
c, 'Desk' || s, 'class', 'global', true, 'public', NULL, false
c, 'Desk' || s || '::all', 'method', 'class', true, 'public', NULL, false
c, 'Desk' || s || '::#hidden', 'method', 'class', true, 'private', NULL, false
c, 'Mail' || s, 'class', 'global', false, 'public', NULL, true
r, 'show' || s, 'function', 'global', false, 'public', NULL, false
r, 'list' || s, 'variable', 'global', false, 'public', NULL, false
v, 'View' || s, 'function', 'global', true, 'public', NULL, false
x, 'Box' || s, 'function', 'global', true, 'public', NULL, false
j, 'K' || s, 'class', 'global', true, 'public', NULL, false
j, 'K' || s || '::a', 'variable', 'class', false, 'private', NULL, false
j, 'K' || s || '::b', 'method', 'class', false, 'protected', NULL, false
j, 'K' || s || '::c', 'method', 'class', true, 'public', NULL, false
b, 'good' || s, 'function', 'global', true, 'public', NULL, false
b, 'last' || s, 'function', 'global', true, 'public', NULL, false"""
_FILES = "SELECT unnest([a, c, r, v, x, j, b]) AS p FROM f"
_OF_S = f"{_S}, own(p, chain, kind, scope, exported, visibility, table_name, is_service) AS ({' UNION ALL '.join(f'SELECT {r} FROM f' for r in _OWN.splitlines())})"


@query(f"{_OF_S} SELECT p || '::' || chain AS id, kind, exported, visibility, table_name, is_service FROM own UNION ALL SELECT p || '::' || p, 'file', true, 'public', NULL, false FROM ({_FILES})", star_graph=False)
def code_features(spark, d):
    """All symbols but the project's, with what languages and frameworks say of them; the rest of a file in error is read."""
    symbols = build(code.features(spark, d))[0].symbols.where("kind <> 'project'")
    return symbols.select("id", "kind", "exported", "visibility", "table_name", F.coalesce("is_service", F.lit(False)).alias("is_service"))


@query(
    f"""{_S} SELECT 'GET /s/' || s AS endpoint, a || '::read' || s AS id FROM f UNION ALL SELECT 'POST /f/' || s, a || '::save' || s FROM f UNION ALL SELECT 'GET /n/' || s || '/all', c || '::Desk' || s || '::all' FROM f
    UNION ALL SELECT 'GET /e/' || s, r || '::show' || s FROM f UNION ALL SELECT 'POST /e/' || s, r || '::list' || s FROM f""",
    star_graph=False,
)
def code_endpoints(spark, d):
    """The handlers of routes as four frameworks declare them."""
    return S.endpoints(build(code.features(spark, d))[0].symbols, F.col("seq"))


@query(
    f"""{_S} SELECT v || '::' || v AS from_id, x || '::Box' || s AS to_id, 'import' AS kind, 'import' AS method FROM f UNION ALL SELECT v || '::View' || s, x || '::Box' || s, 'renders', 'import' FROM f
    UNION ALL SELECT b || '::last' || s, b || '::good' || s, 'call', 'scope' FROM f""",
    star_graph=False,
)
def code_feature_references(spark, d):
    """Bound references: elements of the host language are none, and a file in error keeps those that can be read."""
    out = build(code.features(spark, d))[0].resolved
    return out.select(F.col("from_symbol_id").alias("from_id"), F.col("to_symbol_id").alias("to_id"), "kind", F.col("resolution_method").alias("method"))


@query(
    f"""{_S} SELECT a || '::Row' || s AS id, 1 AS n, 'Base' AS names FROM f UNION ALL SELECT a || '::' || a, 2, 'app.get,bp.route' FROM f UNION ALL SELECT r || '::' || r, 2, 'app.get,router.post' FROM f""",
    star_graph=False,
)
def code_unbound(spark, d):
    """The unbound references of each symbol."""
    return G.unresolved_references(build(code.features(spark, d))[0].unresolved).select("id", "n", F.array_join("names", ",").alias("names"))


@query(
    f"""{_OF_S} SELECT p || '::' || regexp_extract(chain, '^(.*)::', 1) AS parent_id, p || '::' || chain AS child_id, CASE kind WHEN 'method' THEN 'has_member' ELSE 'owns' END AS kind FROM own WHERE scope = 'class'
    UNION ALL SELECT '::project', p || '::' || p, 'owns' FROM ({_FILES})""",
    star_graph=False,
)
def code_containments(spark, d):
    """What holds what: top-level symbols are not linked to their file."""
    return build(code.features(spark, d))[0].containments.select("parent_id", "child_id", "kind")


@query(f"{_OF_S} SELECT p || '::' || chain AS owner, CASE kind WHEN 'class' THEN 'class' ELSE 'function' END AS kind FROM own WHERE kind <> 'variable' UNION ALL SELECT p || '::' || p, 'global' FROM ({_FILES})", star_graph=False)
def code_scopes(spark, d):
    """A scope for each file, class and function."""
    return build(code.features(spark, d))[0].scopes.select(F.col("owner_symbol_id").alias("owner"), "kind")


@query(f"{_OF_S} SELECT p || '::' || chain AS id, scope AS kind FROM own", star_graph=False)
def code_scope_members(spark, d):
    """The kind of the innermost scope of each symbol."""
    model = build(code.features(spark, d))[0]
    return scope_members(model.symbols, model.scopes).join(model.scopes.select(F.col("id").alias("scope_id"), "kind"), "scope_id").select("id", "kind")


@query(
    f"""{_S} SELECT 'parsed' AS what, count(*) AS n FROM f UNION ALL SELECT 'reused', 6 * count(*) FROM f UNION ALL SELECT 'symbols', 27 * count(*) + 2 FROM f UNION ALL SELECT 'bound', 4 * count(*) FROM f""",
    star_graph=False,
)
def code_rebuilt(spark, d):
    """A second build after one file of each supplier has changed: files read and reused, symbols, and what is bound anew."""
    before = code.features(spark, d)
    stored = build(before)[1]
    other = F.when(F.col("file_path").startswith("bad/"), F.concat("source", F.lit("    print(1)\n"))).otherwise(F.col("source"))
    after = before.withColumn("source", F.replace(other, F.lit("return good"), F.lit("good"))).withColumn("content_hash", F.sha1("source"))
    model, _, counts = build(after, stored=stored)
    numbers = spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "what string, n long")
    for what, rows in (("symbols", model.symbols), ("bound", model.resolved)):
        numbers = numbers.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n"))
    return numbers


#: A path; whether it is a test (coverage), peripheral in discovery, peripheral among anchors; its language.
_PATHS = """'src/a{k}.ts', false, false, false, 'typescript'
'src/tests/a{k}.ts', true, true, true, 'typescript'
'tests/a{k}.ts', false, true, true, 'typescript'
'src/a{k}.spec.tsx', true, true, true, 'tsx'
'pkg/test_a{k}.py', true, true, false, 'python'
'pkg/a{k}_test.py', true, true, false, 'python'
'mocks/a{k}.java', false, true, false, 'java'
'lib/scratch/a{k}.js', false, true, true, 'javascript'
'lib/scratchpad{k}.jsx', false, true, false, 'jsx'
'scratchpad{k}.html', false, true, true, 'html'
'SRC/Test/A{k}.TS', true, true, true, 'typescript'
'docs/read{k}.md', false, false, false, NULL"""


@query(
    f"""SELECT replace(t, '{{k}}', s_suppkey::VARCHAR) AS path, is_test, peripheral, peripheral_anchor, language
    FROM supplier, (VALUES {', '.join(f'({r})' for r in _PATHS.splitlines())}) v(t, is_test, peripheral, peripheral_anchor, language)""",
    star_graph=False,
)
def path_classes(spark, d):
    """What a file's path says of it."""
    forms = F.array(*[F.lit(r.split("'")[1]) for r in _PATHS.splitlines()])
    paths = star.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.explode(forms).alias("t")).select(F.replace("t", F.lit("{k}"), F.col("k")).alias("path"))
    p = F.col("path")
    return paths.select("path", T.is_test_file(p).alias("is_test"), T.is_peripheral(p).alias("peripheral"), T.is_peripheral_anchor(p).alias("peripheral_anchor"), T.language_of(p).alias("language"))


# --- views


@query("SELECT DISTINCT e.src, e.dst, e.kind FROM sg_edges e JOIN sg_nodes a ON a.id = e.src JOIN sg_nodes b ON b.id = e.dst WHERE a.kind <> 'project' AND b.kind <> 'project' AND e.src <> e.dst")
def flat_view(spark, d):
    return W.flat(star.nodes(spark, d), star.edges(spark, d))


@query(f"SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM sg_edges e JOIN sg_nodes a ON a.id = e.src JOIN sg_nodes b ON b.id = e.dst WHERE e.kind IN {REFS} AND a.file_path <> b.file_path")
def module_view(spark, d):
    return W.module(star.nodes(spark, d), star.edges(spark, d))


@query(
    """SELECT DISTINCT 'b:' || p_brand AS from_service, 'n:' || s_nationkey AS to_service FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    star_graph=False,
)
def service_view(spark, d):
    brand = F.concat(F.lit("b:"), F.col("p_brand"))
    owned = star.table(spark, d, "part").select(brand.alias("src"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("dst"), F.lit("owns").alias("kind"), F.lit(None).cast("string").alias("method"))
    roots = owned.select(F.col("src").alias("id")).distinct().unionByName(star.nodes(spark, d).where("kind = 'file'").select("id"))
    return W.service(star.edges(spark, d).where("kind <> 'call'").unionByName(owned), roots)


@query("SELECT DISTINCT 'api:' || upper(event_type) || ':' || json_extract_string(props, '$.k') AS endpoint, 'u:' || user_id AS handler FROM events", star_graph=False)
def api_view(spark, d):
    e = star.table(spark, d, "events").select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("api_method"), F.get_json_object("props", "$.k").alias("api_path"))
    return W.api(e)


@query("SELECT DISTINCT 'c:' || o_custkey AS user, 'p:' || l_partkey AS model FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def data_view(spark, d):
    models = star.nodes(spark, d).where("kind = 'function'")
    calls = star.edges(spark, d).where("kind <> 'import'")
    return W.data(calls, models.select("id"), star.nodes(spark, d).where(F.col("id").startswith("c:")).select("id"))


@query(
    """WITH e AS (SELECT DISTINCT src, dst FROM sg_edges WHERE kind IN ('call', 'import')),
    a AS (SELECT 'c:1' AS id UNION ALL SELECT dst FROM sg_edges WHERE src = 'c:1' AND kind = 'has_member'),
    l1 AS (SELECT DISTINCT 'c:1' AS from_id, dst AS to_id FROM e WHERE src IN (SELECT id FROM a)), l2 AS (SELECT DISTINCT src AS from_id, dst AS to_id FROM e WHERE src IN (SELECT to_id FROM l1))
    SELECT 1::BIGINT AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2"""
)
def flow_trace(spark, d):
    return W.flow_trace(star.edges(spark, d), "c:1", 3)


@query("SELECT DISTINCT * FROM (SELECT 'made' AS direction, e.kind, n.id, n.name FROM sg_edges e JOIN sg_nodes n ON n.id = e.dst WHERE e.src = 'p:1' AND e.kind IN ('call', 'import') UNION ALL SELECT 'received', e.kind, n.id, n.name FROM sg_edges e JOIN sg_nodes n ON n.id = e.src WHERE e.dst = 'p:1' AND e.kind IN ('call', 'import'))")
def inspector(spark, d):
    return W.inspector(star.nodes(spark, d), star.edges(spark, d), "p:1")


@query(
    """WITH s AS (SELECT id FROM sg_nodes WHERE kind = 'class' AND contains(lower(name), '00001')),
    h AS (SELECT DISTINCT e.src AS id FROM sg_edges e JOIN s ON s.id = e.dst WHERE e.kind = 'owns'), g AS (SELECT DISTINCT e.src AS id FROM sg_edges e JOIN h ON h.id = e.dst WHERE e.kind = 'owns')
    SELECT id FROM s UNION SELECT id FROM h UNION SELECT id FROM g"""
)
def dashboard_filter(spark, d):
    return W.filtered(star.nodes(spark, d), star.edges(spark, d), "00001", ["class"]).select("id")


# --- evidence


@query(
    """WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT // 60 AS lo, floor(epoch(ts))::BIGINT // 60 + (floor(value)::BIGINT % 7) AS hi FROM events),
    m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
    i AS (SELECT *, sum(CASE WHEN lo <= prev + 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM i GROUP BY user_id, island""",
    star_graph=False,
)
def span_merge(spark, d):
    e = star.table(spark, d, "events")
    # a time without a zone is UTC, whatever the session's zone; minutes are cut towards zero
    if dict(e.dtypes)["ts"] == "timestamp_ntz":
        seconds = F.unix_date(F.col("ts").cast("date")).cast("long") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    else:
        seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    minute = F.call_function("div", seconds, F.lit(60))
    return E.merge_spans(e.select("user_id", minute.alias("lo"), (minute + F.floor("value").cast("long") % 7).alias("hi")), ["user_id"])


@query(
    """WITH p AS (SELECT p_brand AS root, 'p:' || p_partkey AS id, p_size::BIGINT AS priority, length(p_name)::BIGINT AS cost FROM part),
    c AS (SELECT *, sum(cost) OVER (PARTITION BY root) - coalesce(sum(cost) OVER (PARTITION BY root ORDER BY priority, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p)
    SELECT root, id, CASE WHEN rest > 300 THEN 'OMIT' ELSE 'SIGNATURE' END AS level FROM c""",
    star_graph=False,
)
def budget_downgrade(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_brand").alias("root"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("long").alias("priority"), F.length("p_name").cast("long").alias("cost"))
    return E.downgraded(p, 300, ["root"]).select("root", "id", "level")


@query(
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY size DESC, id) AS i FROM
        (SELECT p_brand || '/' || (p_partkey // 1250) AS root, 'p:' || p_partkey AS id, p_size AS size, p_size::BIGINT * 40 AS body, length(p_name)::BIGINT AS base FROM part)),
    r(root, i, id, level, total) AS (SELECT root, 0::BIGINT, '', '', sum(base)::BIGINT FROM p GROUP BY root UNION ALL
        SELECT r.root, p.i, p.id, CASE WHEN total + body <= 8000 THEN 'FULL' WHEN total + least(800, body) <= 8000 THEN 'SNIPPET' ELSE 'SIGNATURE' END,
            total + CASE WHEN total + body <= 8000 THEN body WHEN total + least(800, body) <= 8000 THEN least(800, body) ELSE 0 END FROM r JOIN p ON p.root = r.root AND p.i = r.i + 1)
    SELECT root, id, level FROM r WHERE i > 0""",
    recursive=True,
)
def budget_greedy(spark, d):
    p = star.table(spark, d, "part")
    ident = F.concat(F.lit("p:"), F.col("p_partkey").cast("string"))
    # results of fifty nodes: parts of a brand by key
    group = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 1250).cast("string"))
    rows = p.select(group.alias("root"), ident.alias("id"), F.col("p_size").cast("long").alias("priority"), F.lit("function").alias("kind"), F.length("p_name").cast("long").alias("base"), (F.col("p_size") * 40).cast("long").alias("body"))
    return E.allocated(rows, 2000)


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    SELECT doc_id AS edge, min(line)::BIGINT AS line FROM l WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') GROUP BY doc_id""",
    star_graph=False,
)
def callsite_first_match(spark, d):
    docs = star.table(spark, d, "documents")
    lines = E.source_lines(docs.select(F.col("doc_id").alias("file_path"), F.col("text").alias("source")))
    edges = docs.select(F.col("doc_id").alias("edge"), F.lit("the").alias("name"), F.col("doc_id").alias("file_path"), F.lit(0).alias("lo"), F.lit(1 << 30).alias("hi"))
    return E.first_match(lines, edges).select("edge", F.col("line").cast("long").alias("line"))


@query(
    "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id AS id, array_to_string(l[3:7], chr(10)) AS text, trim(l[3]) AS signature FROM x WHERE len(l) >= 3", star_graph=False
)
def source_slice(spark, d):
    docs = star.table(spark, d, "documents")
    lines = E.source_lines(docs.select(F.col("doc_id").alias("file_path"), F.col("text").alias("source")))
    ranges = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_path"), F.lit(2).alias("lo"), F.lit(6).alias("hi"))
    return E.sliced(lines, ranges).select("id", "text", "signature")


@query("SELECT doc_id AS file_path, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id", star_graph=False)
def line_numbers(spark, d):
    lines = E.source_lines(star.table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.col("text").alias("source")))
    shown = E.numbered(lines)
    return shown.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(F.length("shown") - F.length((F.col("line") + 1).cast("string")) - 1).alias("chars"))


@query(
    """WITH r(id, d) AS (SELECT 'c:1', 0 UNION SELECT e.dst, d + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM sg_edges) e ON e.src = r.id WHERE d < 3), m AS (SELECT id, min(d) AS d FROM r GROUP BY id)
    SELECT id, CASE WHEN d = 0 THEN 'anchor' WHEN d <= 1 THEN 'direct_neighbor' ELSE 'transitive_neighbor' END AS role FROM m""",
    recursive=True,
)
def role_assign(spark, d):
    return V.distances(star.edges(spark, d), _roots(spark, "c:1"), 3).select("id", E.role("region", F.col("depth")).alias("role"))


@query("SELECT sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents", star_graph=False)
def token_estimate(spark, d):
    return star.table(spark, d, "documents").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


# --- storage and increments


@query("SELECT sha1(text) AS hash, max(doc_id) AS doc_id FROM documents GROUP BY 1", star_graph=False)
def dedupe_last_wins(spark, d):
    docs = star.table(spark, d, "documents").select(F.sha1("text").alias("hash"), "doc_id")
    return G.last_wins(docs, "hash", F.col("doc_id"))


def _cache(spark, d):
    docs = star.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha1("text").alias("content_hash"), (F.col("doc_id") % 2 == 0).alias("stored"))
    stored = docs.where("stored").select("path", F.when(F.col("path").endswith("8"), F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"), F.lit(2).alias("pipeline_version"))
    return docs.select("path", "content_hash"), stored


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 8", star_graph=False)
def cache_hits(spark, d):
    from symgraph.sources.store import cached

    return cached(*_cache(spark, d), version=2)[0].select("path")


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 10 <> 8)", star_graph=False)
def cache_misses(spark, d):
    from symgraph.sources.store import cached

    return cached(*_cache(spark, d), version=2)[1].select("path")


@query("SELECT doc_id, source FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id + 1000000, 'src1' FROM documents WHERE source = 'src2'", star_graph=False)
def update_partial(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", "source")
    new = docs.where("source = 'src2'").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("src1").alias("source"))
    return G.replace_file(docs, new, "src1", "source")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id""",
    star_graph=False,
)
def debounce_sessions(spark, d):
    from symgraph.streaming.watch import bursts

    e = star.table(spark, d, "events").select("user_id", F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return bursts(e, "30 minutes", keys=["user_id"]).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT id, kind, name, file_path FROM sg_nodes")
def store_roundtrip(spark, d):
    from symgraph.sources.store import Store

    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save({"nodes": star.nodes(spark, d)})
    return store.load()["nodes"]


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", star_graph=False)
def metadata_json(spark, d):
    return star.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1", star_graph=False)
def metadata_variant(spark, d):
    e = star.table(spark, d, "events").select(F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"))


