"""Every registered query of the library against its SQL; those without SQL against plain loops in the other files."""

import os
import subprocess
import sys

import pytest
from conftest import DATA, same_as_sql

from plotwise.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_sql_only_for_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)
