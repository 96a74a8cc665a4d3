"""Registered queries run, and agree with their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from parimart.plans import ORACLE_SQL, QUERIES, round_trip_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["C6_asof_devig", "C5_prior_history", "E12_residual_drift", "G1_settle_bets", "H5_curve_features", "J3_wide", "K5_calibration_bins", "N3_share_feed", "A8_flatten_odds_json", "I4_horse_card"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


ROUND_TRIPS = [n for n in entry.queries() if n.split("_")[0] in "A1 A2 A3 A4 A6 A11 A12 A17 A24 G7 H14 I8 I16 J10 L1 L3 L4 L8 L9 S2 S6 S15 S17 U2 U4 U5 U6".split()]


def test_round_trips_are_registered():
    assert len(ROUND_TRIPS) == 27 and callable(round_trip_queries.a1)


@pytest.mark.parametrize("name", SAMPLE + ROUND_TRIPS)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect()) == want


def _close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7))
    return str(a) == str(b)


def _order(row):
    return tuple(("" if v is None else f"{v:.4g}") if isinstance(v, float) else str(v) for v in row)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL) - set(SAMPLE) - set(ROUND_TRIPS)))
def test_every_other_query_matches_its_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns, key=lambda c: (dict(df.dtypes)[c] in ("double", "float"), c))
    cur = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(cols)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=_order)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_order)
    assert len(got) == len(want)
    assert all(_close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
