import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("LODESTONE_DRIVER_MEMORY", "4g")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import session

    return session(4, 4)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def compare(spark, names, queries, oracles, sf_dir):
    """Names of the queries whose rows differ from DuckDB's."""
    import decimal
    import math

    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 8) + 0.0
        if isinstance(v, decimal.Decimal):
            return float(v)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    wrong = []
    for name in names:
        df = queries[name](spark, sf_dir)
        columns = sorted(df.columns)
        got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        rel = con.sql(oracles[name])
        at = [rel.columns.index(c) for c in columns] if sorted(rel.columns) == columns else []
        want = sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())
        if got != want:
            wrong.append(name)
    return wrong
