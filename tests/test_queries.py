import pytest
from oracle import check

from recordforge.jobs.queries import ORACLE_SQL, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship_counts_add_up(spark, sf):
    for r in flagship(spark, sf).collect():
        assert r.completed + r.duplicate + r.filtered + r.failed == r.total
