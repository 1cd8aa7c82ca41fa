"""Every query of the retrieval engine against its SQL; those without SQL must give rows."""

import pytest

from heliograph import catalog
from tests.compare import same

DIR = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same(catalog.queries()[name](spark, DIR), ORACLES[name], DIR)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_without_sql(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
