import pytest

from recollect.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.oracle import rows_of_df, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    assert rows_of_df(QUERIES[name](spark, SF)) == rows_of_sql(ORACLE_SQL[name], SF)
