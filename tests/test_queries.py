"""Every query against its SQL on the smallest tables."""

import pytest
from conftest import DATA

from folioscope.plans import queries as catalogue

SQL = catalogue.oracle_sql()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    said = duck.execute(SQL[name])
    columns = [x[0] for x in said.description]
    assert _rows(df.columns, df.collect()) == _rows(columns, said.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "title"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_pushes_no_python(spark):
    plan = catalogue.queries()["search_title_075"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "PushedFilters" in plan
