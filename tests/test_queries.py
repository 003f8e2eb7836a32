"""Every analytics query against its SQL on the smallest tables, and no look-ahead in the event study."""

import datetime as dt
import math

import duckdb
import pytest

from opplens.operators import bars, study
from opplens.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v.replace(tzinfo=None)) if isinstance(v, dt.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_later_bars_do_not_change_earlier_signals(spark):
    ticks = spark.read.parquet(f"{DATA}/events.parquet")
    all_ = study.signals(bars.resample(ticks, "1 hour"), 5)
    cut = ticks.agg({"ts": "max"}).first()[0].replace(minute=0, second=0, microsecond=0) - dt.timedelta(days=5)
    early = study.signals(bars.resample(ticks.where(f"ts < timestamp_ntz'{cut}'"), "1 hour"), 5)
    assert set(map(tuple, all_.where(f"bar_ts < timestamp_ntz'{cut}'").collect())) == set(map(tuple, early.collect()))
