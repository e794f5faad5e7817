import pytest

from recollect.plans.queries import all_oracle_sql, all_queries
from tests.oracle import connect, expected, rows_of


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, data, con, name):
    cols, got = rows_of(all_queries()[name](spark, data))
    sql = all_oracle_sql().get(name)
    if sql is None:
        assert sum(got.values()) > 0
    else:
        want_cols, want = expected(con, sql)
        assert cols == want_cols
        assert got == want
