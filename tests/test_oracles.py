"""Every query against its oracle SQL in DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from winnowline.catalog import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, bool)) or v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])
