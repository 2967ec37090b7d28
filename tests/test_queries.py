"""Every core query runs, and agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

from spreadwatch.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(found, names):
    """Rows with columns in order of their names, in an order that does not hang on a float's last place."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(r[i] for i in order) for r in found]
    return sorted(plain, key=lambda r: [f"{x:.4g}" if isinstance(x, float) else repr(x) for x in r])


def same(a, b):
    """Equal, or numbers that differ by one unit of the sixth place: results are rounded to it on either side."""
    return abs(a - b) <= 1.001e-6 + 1e-9 * max(abs(a), abs(b)) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLES:
        res = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        want = rows(res.fetchall(), names)
        assert len(want) == len(got)
        assert [] == [(a, b) for a, b in zip(want, got, strict=True) if not all(map(same, a, b))][:3]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 300
    assert set(entry.oracle_sql()) <= set(entry.queries())
