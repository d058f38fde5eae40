import duckdb
import pytest

import __spark_entry__ as E
from folioscope.plans import catalog

SQL = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def db(data):
    import os

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    cur = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(x) for x in r) for r in df.select(*cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_plans_stay_out_of_python(spark, data):
    for name in SQL:
        if name in ("offline_candidates", "paragraph_merge"):  # the plug-in takes Python callables, the paragraphs are a fold
            continue
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name
