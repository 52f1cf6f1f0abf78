"""Every registered query that has SQL gives the rows the SQL gives."""

import math
import re

import pytest

from tessera.plans import catalogue

from .conftest import SF


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if v is None else str(v)


def rows(columns, data):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: [(str(type(v)), str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    expected = duck.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_guarded_division_takes_every_line(spark, duck):
    large = SF.replace("sf0.001", "sf0.01")  # order numbers of the smallest tables end below 2000
    lines = f"read_parquet('{large}/lineitem.parquet')"
    n = duck.sql(f"select count(*) from {lines}").fetchall()[0][0]
    assert catalogue.QUERIES["guarded_division"](spark, large).count() == n
    assert len(duck.sql(re.sub(r"\blineitem\b", lines, catalogue.ORACLE["guarded_division"], count=1)).fetchall()) == n


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
