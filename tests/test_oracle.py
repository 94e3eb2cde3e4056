"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import pytest

from contrasto.plans import catalog
from tests.conftest import DATA, canonical


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    a, b = canonical(got), canonical(want)
    assert list(a.columns) == list(b.columns)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head()
