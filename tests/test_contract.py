"""The driver contract, and a sample of queries against DuckDB."""

import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(__file__), "..")
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry_module  # noqa: E402
from check import canon, connect  # noqa: E402

DATA = "/root/testdata/sf0.001"
SAMPLE = ["ic_by_date", "carry_signal", "resample_last", "risk_parity_weights", "stationary_bootstrap", "coverage_check", "used_by_transitive", "price_panel"]


def test_every_query_has_sql():
    from isochrone.plans import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 136
    assert set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_a_shared_folder_is_needed_off_one_machine():
    from types import SimpleNamespace

    from isochrone.functions.spark import shared_dir

    session = lambda master, root: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: root), sparkContext=SimpleNamespace(master=master))
    for master in ("local-cluster[3,2,3000]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="share"):
            shared_dir(session(master, None), "x")
    assert shared_dir(session("yarn", "hdfs://a/b"), "x").startswith("hdfs://a/b/isochrone/x-")
    assert shared_dir(session("local[4]", None), "x").startswith("/tmp/")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    df = entry_module.queries()[name](spark, DATA)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(DATA).execute(entry_module.oracle_sql()[name])
    assert got == canon([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_panels_are_kept_and_rebuilt(spark):
    from isochrone.plans import panels

    first = panels.prio_d(spark, DATA)
    assert panels.prio_d(spark, DATA).inputFiles() == first.inputFiles()
    for key in [k for k in panels._STORED if k[2] == "prio_d"]:
        panels._STORED[key] = ("/tmp/isochrone-no-such-folder", panels._STORED[key][1])
    again = panels.prio_d(spark, DATA)
    assert again.exceptAll(first).count() == 0 and again.count() == first.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_entry(spark):
    df = entry_module.entry(spark)
    assert {"signal_name", "horizon", "ic_mean", "icir"} <= set(df.columns)
    assert df.count() > 0
