"""Every query of the library against its SQL; without SQL it has to give rows."""

import pytest

from quillspark.plans import catalog
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    if name in catalog.ORACLES:
        assert same(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf) >= 0
    else:
        assert catalog.QUERIES[name](spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
