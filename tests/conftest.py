import os
import sys
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))


@pytest.fixture(scope="session")
def spark():
    from isochrone.functions.spark import scratch_folder

    session = (
        SparkSession.builder.master("local[4]").appName("isochrone-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{scratch_folder()}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """``series({asset: [values]}, start)``: daily rows; ``hourly=True`` makes timestamps."""

    def make(values, start=date(2024, 1, 1), column="value", hourly=False, business=False):
        rows = []
        for asset, xs in values.items():
            day = start
            for i, x in enumerate(xs):
                if hourly:
                    ts = datetime(start.year, start.month, start.day) + timedelta(hours=i)
                else:
                    while business and day.weekday() > 4:
                        day += timedelta(days=1)
                    ts = day
                    day += timedelta(days=1)
                rows.append((asset, ts, None if x is None else float(x)))
        kind = "timestamp" if hourly else "date"
        return spark.createDataFrame(rows, f"asset string, ts {kind}, {column} double")

    return make


def by_ts(df, column, *keys):
    """Values of a column in time order, per asset when there are several."""
    rows = df.orderBy(*keys, "ts").select(column).collect()
    return [r[0] for r in rows]
