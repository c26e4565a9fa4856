"""Every core query with SQL, held against another engine on the small tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from sifthall import registry


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"""CREATE VIEW "{os.path.basename(f)[:-8]}" AS SELECT * FROM '{f}'""")
    return c


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(name, spark, data, db):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = Counter(plain(tuple(r)) for r in df.select(*columns).collect())
    result = db.execute(registry.SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    theirs = Counter(plain(tuple(r[i] for i in at)) for r in result.fetchall())
    assert ours == theirs


def test_every_query_runs(spark, data):
    for name in sorted(set(registry.QUERIES) - set(registry.SQL)):
        assert registry.QUERIES[name](spark, data).count() >= 0
