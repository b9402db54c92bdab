"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from vecflow.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha1("\n".join(lines).encode()).hexdigest()


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.ORACLE_SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and df.columns == ["sum_of_block_means_x", "sum_of_block_means_y", "sum_of_block_means_z"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _digest(df.columns, rows) == _digest(rel.columns, rel.fetchall())


def test_entry_without_the_optional_part(monkeypatch):
    """Only the absence of the part itself is passed over; a failing import inside it is not."""
    def gone(name):
        raise ModuleNotFoundError(f"No module named {name!r}", name=name.removesuffix(".queries"))

    monkeypatch.setattr(E.importlib, "import_module", gone)
    assert E._optional("vecflow.llm.queries") is None and E._optional("corpus_pipeline") is None
    with pytest.raises(ModuleNotFoundError):
        E._optional("numpy")
    monkeypatch.setattr(E, "_llm", None)
    monkeypatch.setattr(E, "_pipeline", None)
    assert set(E.queries()) == set(catalog.QUERIES) and set(E.oracle_sql()) == set(catalog.ORACLE_SQL)
