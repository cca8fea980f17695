"""A session for all tests, and a comparison of a query's rows with those of its SQL."""

import math
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from gradus.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, 8, **{"spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if v is None or isinstance(v, (bool, int)):
        return v
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def sql():
    """Run SQL over the standard tables: column names and rows."""
    con = duckdb.connect()
    for f in sorted(Path(DATA).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")

    def run(text):
        r = con.execute(text)
        return [d[0] for d in r.description], r.fetchall()

    return run


@pytest.fixture(scope="session")
def check(spark, sql):
    """Assert that a query and its SQL give the same columns and the same rows, repeats counted."""

    def run(query, text):
        df = query(spark, DATA)
        names, rows = sql(text)
        assert sorted(df.columns) == sorted(names)
        ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, rows)
        assert ours == theirs, f"only ours: {list((ours - theirs).items())[:3]}; only SQL: {list((theirs - ours).items())[:3]}"
        return sum(ours.values())

    return run
