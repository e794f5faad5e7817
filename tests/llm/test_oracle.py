import pytest

from recollect.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, expected, rows_of


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, con, name):
    cols, got = rows_of(QUERIES[name](spark, data))
    if name not in ORACLE_SQL:
        assert sum(got.values()) > 0
    else:
        want_cols, want = expected(con, ORACLE_SQL[name])
        assert cols == want_cols
        assert got == want
