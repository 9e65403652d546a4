"""Every query against its SQL; those without SQL must run and give rows."""

from __future__ import annotations

import pytest

from tesserae.plans import catalog
from tests.comparing import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert_same(df, sf_dir, catalog.ORACLE_SQL[name])
    else:
        assert df.take(1)
