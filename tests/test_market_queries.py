"""Every query with an SQL twin gives the same rows as it; the others give rows of a stable shape."""

import datetime
import math

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return round(float(x), 7) + 0.0 if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_names_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_caps_take_every_customer(spark, db):
    got = {(r.book, r.ticker): r.weight for r in QUERIES["d8_concentration_caps"](spark, SF).collect()}
    rows = db.execute("SELECT c_nationkey, c_custkey, round(c_acctbal / 1000, 3) FROM customer").fetchall()
    total = {}
    for book, _, score in rows:
        total[book] = total.get(book, 0) + max(float(score), 0)
    expected = {(book, str(k)): min(float(score) / total[book], 0.25, 0.05 + k % 4 * 0.05) for book, k, score in rows if score > 0}
    assert got == pytest.approx(expected, abs=1e-8) and any(int(t) % 5 for _, t in got)


def test_funds_follow_every_ticker(spark, db):
    got = {r.fund for r in QUERIES["st7_d12_fund_nav"](spark, SF).select("fund").distinct().collect()}
    groups = {(int(b[0].removeprefix("Brand#")) - 1) // 5 + 1 for b in db.execute("SELECT DISTINCT p_brand FROM part").fetchall()}
    assert len(groups) > 1 and got == {f"{kind} {k}" for kind in ("equal", "tilted") for k in groups}
