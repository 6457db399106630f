import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quire.queries import QUERIES, SQL
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, FOLDER, QUERIES[name], SQL[name])


def test_entry_names_every_query():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_a_library_of_the_optional_part():
    code = (
        "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e;"
        "from quire.queries import QUERIES, SQL; assert set(e.queries()) == set(QUERIES); assert set(e.oracle_sql()) == set(SQL)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
