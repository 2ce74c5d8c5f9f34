import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from symgraph import queries as Q
from symgraph import star
from tests.oracle import DIR, compare, connected

#: Queries that may find nothing in the smallest tables.
EMPTY = {"callers_of", "callees_of", "members_of", "imports_of", "flow_pairs", "discover_fuzzy", "import_suffix_match", "data_view", "unresolved_summary", "impact_batch"}


@pytest.fixture(scope="module")
def con():
    return connected()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    compare(spark, con, Q.QUERIES[name], Q.ORACLE_SQL[name], least=0 if name in EMPTY else 1)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, DIR).count() > 0


def test_the_entry_works_without_the_corpus_operators(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/symgraph", tmp_path / "symgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_cone' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_data_view_has_every_model(spark):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    owner = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{DIR}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    got = [(r.user, r.model) for r in Q.QUERIES["data_view"](spark, DIR).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(f"c:{owner[r.l_orderkey]}", f"p:{r.l_partkey}") for r in lines}
    assert {m for _, m in got} == {f"p:{r.l_partkey}" for r in lines}


def test_reverse_index_has_every_kind(spark):
    want = {}
    for r in star.edges(spark, DIR).collect():
        want.setdefault((r.dst, r.kind), set()).add(r.src)
    got = {(r.id, r.kind): r.sources for r in Q.QUERIES["reverse_index"](spark, DIR).collect()}
    assert got == {k: ",".join(sorted(v)) for k, v in want.items()}
    assert {k for _, k in got} == {"owns", "has_member", "call", "import"}


def test_span_merge_of_open_spans(spark, tmp_path):
    """Events without a value or a time, times before 1970 and a session in another zone, against the SQL; no two are equal, so it leaves no ties."""
    con = duckdb.connect()
    con.sql("""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-03-31 00:00:10.5' + to_seconds((i * 7919 % 20000)::BIGINT) AS ts, i % 5 AS user_id, 'view' AS event_type,
        CASE WHEN i % 3 = 0 THEN NULL ELSE (i % 11)::DOUBLE END AS value, '{}' AS props FROM range(300) t(i)
        UNION ALL SELECT 1000 + i, TIMESTAMP '1969-12-31 23:00:00.25' + to_seconds(i * 67), 9, 'view', 1.0, '{}' FROM range(100) t(i)
        UNION ALL SELECT 2000, NULL, 9, 'view', 1.0, '{}'""")
    con.sql("DELETE FROM events WHERE event_id NOT IN (SELECT min(event_id) FROM events GROUP BY user_id, floor(epoch(ts))::BIGINT // 60, floor(value)::BIGINT % 7)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        compare(spark, con, lambda s, _: Q.QUERIES["span_merge"](s, str(tmp_path)), Q.ORACLE_SQL["span_merge"], least=20)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_span_merge_of_events_that_repeat(spark, tmp_path):
    """Equal events change nothing but the counts; the SQL leaves their order open twice, and there may differ from itself."""
    spark.read.parquet(f"{DIR}/events.parquet").createOrReplaceTempView("once")
    spark.sql("SELECT e.* FROM once e CROSS JOIN range(40)").write.parquet(f"{tmp_path}/events.parquet")
    once, many = (sorted((r.user_id, r.lo, r.hi, r.n * k) for r in Q.QUERIES["span_merge"](spark, d).collect()) for d, k in ((DIR, 40), (str(tmp_path), 1)))
    assert once == many
