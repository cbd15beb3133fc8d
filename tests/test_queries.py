"""Every query against its SQL, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from tesserae import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_and_sql_agree(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(registry.oracle_sql()[name])
    given = [d[0] for d in answer.description]
    assert sorted(given) == columns
    expected = Counter(tuple(plain(row[given.index(c)]) for c in columns) for row in answer.fetchall())
    assert Counter(tuple(plain(row[c]) for c in columns) for row in df.collect()) == expected


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
