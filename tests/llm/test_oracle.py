import os

import pytest

from quire.llm.queries import QUERIES, SQL
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, FOLDER, QUERIES[name], SQL[name])
