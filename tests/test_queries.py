import pytest

from resultlens.plans import catalogue
from .oracle import connect, same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_each_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    same(QUERIES[name](spark, sf), SQL[name], con)


def test_no_python_where_built_ins_do(spark, sf):
    import contextlib
    import io

    for name, query in QUERIES.items():
        if name.startswith("ops_") or name == "reward_from_parts":  # they parse statements
            continue
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            query(spark, sf).explain()
        assert not any(x in out.getvalue() for x in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct")) or name in ("sql_cross_join",), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
