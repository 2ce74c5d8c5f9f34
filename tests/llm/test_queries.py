import pytest

from symgraph.llm import queries as Q
from tests.oracle import compare, connected


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    compare(spark, connected(), Q.QUERIES[name], Q.ORACLE_SQL[name])


def test_all_ten_are_registered():
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{i}" for i in range(1, 11)}
