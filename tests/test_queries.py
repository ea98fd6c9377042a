"""Every query with SQL against DuckDB at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}
NAMES = sorted(n for n in entry.oracle_sql() if n not in SLOW)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.7g}"
        return v.isoformat() if hasattr(v, "isoformat") else str(v)

    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
