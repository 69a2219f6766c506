import pytest
from sqlcheck import same

from trailmine.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["p1_patterns", "p5_seen", "p6_runs", "p7_counts"])
def test_query_equals_its_sql(spark, data, name):
    got, want = same(spark, data, queries()[name], oracle_sql()[name])
    assert got == want and got


def test_all_have_names():
    assert set(oracle_sql()) <= set(queries())
    assert {f"p{k}_found" for k in (1, 3, 4, 5, 6, 7, 8, 10)} <= set(queries())
