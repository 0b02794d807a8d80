"""Every query with an oracle gives the rows that DuckDB gives on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from tomelight.plans import analysis, catalogue, curation, exports, lexicon, markup, picks, relational, scoring, streams, structure, text, titles, upkeep  # noqa: F401
from tomelight.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def plain(x):
    return round(x, 4) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert rows
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        assert rows == Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())
