"""Every registered query of the library's own operators against its SQL in DuckDB."""

import math
from decimal import Decimal

import pytest

from sievemark.plans import registry


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, duck):
    found = registry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in found.collect()]
    if name not in registry.oracle_sql():
        assert found.columns
        return
    asked = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in asked.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, got) == rows(names, asked.fetchall())
