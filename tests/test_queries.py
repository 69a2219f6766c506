import pytest
from sqlcheck import same

from trailmine.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["collapse", "ngrams_closed", "surprise_scores", "seqs_closed", "findings_measure", "pairing_tools", "summary_session", "lens_target"])
def test_query_equals_its_sql(spark, data, name):
    got, want = same(spark, data, queries()[name], oracle_sql()[name])
    assert got == want and got


def test_all_have_names():
    assert set(oracle_sql()) <= set(queries())
