from __future__ import annotations

import pytest

from chartspan.plans import catalog, documents, files, more, wide  # noqa: F401  the others add to the catalogue
from tests.conftest import DATA
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_as_sql(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, DATA), con, catalog.SQL[name]) == ""
