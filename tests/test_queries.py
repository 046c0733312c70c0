"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import duckdb
import pytest
from pyspark.sql import Row

from textweir.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (Row, list, tuple)):
        return tuple(plain(x) for x in v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    if name not in registry.ORACLES:
        assert got
        return
    res = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in res.fetchall())


def test_flagship_values(spark):
    """Acceptance values at sf 0.01."""
    got = {r.lang: (r.segments, r.distinct_texts, r.hits) for r in registry.QUERIES["corpus_cache_plan"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"de": (1314, 947, 333), "en": (5606, 4686, 1563), "es": (973, 854, 270), "fr": (1390, 1115, 377)}
