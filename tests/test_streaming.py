import random
from datetime import datetime, timedelta

import pytest

from isochrone.streaming import alerts, bars, ingest, tables

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


class Landing:
    """A folder that rows arrive in."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def arrive(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return tables.landed(self.spark, self.path, self.spark.createDataFrame([], self.schema).schema)


ROWS = "id long, ts timestamp, asset string, value double"


def test_bars_with_late_rows(spark, tmp_path):
    landing = Landing(spark, tmp_path / "in", ROWS)
    landing.arrive([(1, at(0.1), "a", 5.0), (2, at(0.9), "a", 3.0), (3, at(0.5), "b", 1.0), (4, None, "a", 9.0), (5, at(0.2), "a", None)])
    stream = bars.BarStream(spark, landing.stream(), str(tmp_path / "out"), "1 hour", "2 hours", ["asset"], tie="id")
    stream.run()
    first = {(r["asset"], r["bar_start"]): tuple(r)[2:] for r in stream.read().collect()}
    assert first == {("a", at(0)): (5.0, 5.0, 3.0, 3.0, 2), ("b", at(0)): (1.0, 1.0, 1.0, 1.0, 1)}
    # late, but within the delay: the bar is written again; ties of ts go by id
    landing.arrive([(6, at(0.05), "a", 4.0), (7, at(0.9), "a", 8.0), (8, at(9), "a", 2.0)])
    stream.run()
    # the watermark is now at hour 7: hour 1 is closed, hour 8 is not
    landing.arrive([(9, at(1.5), "a", 100.0), (10, at(8.5), "a", 7.0)])
    progress = stream.run()
    got = {(r["asset"], r["bar_start"]): tuple(r)[2:] for r in stream.read().collect()}
    assert got == {**first, ("a", at(0)): (4.0, 8.0, 3.0, 8.0, 4), ("a", at(9)): (2.0, 2.0, 2.0, 2.0, 1), ("a", at(8)): (7.0, 7.0, 7.0, 7.0, 1)}
    assert tables.dropped_rows(progress) == 1


def test_bars_of_a_stream_equal_bars_of_the_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, at(i / 7 + rng.uniform(-2, 2)), rng.choice("abc"), float(rng.randint(1, 50))) for i in range(400)]
    landing = Landing(spark, tmp_path / "in", ROWS)
    stream = None
    for k in range(0, 400, 80):
        landing.arrive(rows[k : k + 80])
        stream = stream or bars.BarStream(spark, landing.stream(), str(tmp_path / "out"), "3 hours", "6 hours", ["asset"], tie="id")
        stream.run()
    want = bars.bars(spark.createDataFrame(rows, ROWS), "3 hours", "6 hours", ["asset"], tie="id").collect()
    assert sorted(map(tuple, stream.read().collect())) == sorted(map(tuple, want))


def test_failed_batch_is_stored_once(spark, tmp_path):
    landing = Landing(spark, tmp_path / "in", ROWS)
    landing.arrive([(i, at(i), "a", float(i)) for i in range(10)])
    stream = ingest.RawStream(spark, landing.stream(), str(tmp_path / "out"), ["asset", "ts"], "1 day")

    def lost(batch):
        raise RuntimeError("driver lost after the write")

    with pytest.raises(Exception, match="driver lost"):
        stream.run(after=lost)
    assert stream.read().count() == 10  # written, not committed
    stream.run()
    assert sorted(r["id"] for r in stream.read().collect()) == list(range(10))
    # rows sent again, in other batches and within one
    landing.arrive([(i, at(i), "a", float(i)) for i in range(5, 15)] + [(14, at(14), "a", 14.0), (99, None, "a", 1.0)])
    stream.run()
    again = ingest.RawStream(spark, landing.stream(), str(tmp_path / "out"), ["asset", "ts"], "1 day")
    again.run()
    assert sorted(r["id"] for r in again.read().collect()) == list(range(15))
    got = again.ranges(["asset"]).first()
    assert (got["cached_start"], got["cached_end"], got["row_count"]) == (at(0), at(14), 15)


def brute_alerts(rows, threshold, periods, expiry_days):
    out, seen = [], {}
    for key, ts, m in sorted((r for r in rows if None not in r)):
        last, start, n = seen.get(key, (None, None, 0))
        if last == ts:
            continue
        if last is not None and ts - last > timedelta(days=expiry_days):
            n = 0
        start, n = (ts if n == 0 else start, n + 1) if m < threshold else (None, 0)
        seen[key] = (ts, start, n)
        if n == periods:
            out.append((key, start, ts))
    return sorted(out)


def test_alerts_across_batches(spark, tmp_path):
    rng = random.Random(2)
    schema = "signal string, ts timestamp, ic double"
    rows = [(k, START + timedelta(days=30 * i), rng.choice([-0.2, -0.1, -0.06, -0.05, 0.1]) if rng.random() < 0.95 else None) for k in "abcdefgh" for i in range(40) if rng.random() < 0.85]
    rows += [(None, START, -1.0), rows[0], (rows[3][0], rows[3][1], -0.9)]
    landing, stream = Landing(spark, tmp_path / "in", schema), None
    for k in range(0, 1201, 200):
        part = [r for r in rows if timedelta(days=k) <= r[1] - START < timedelta(days=k + 200)]
        rng.shuffle(part)
        landing.arrive(part)
        stream = stream or alerts.AlertStream(spark, landing.stream(), str(tmp_path / "out"), expiry_days=70)
        stream.run()
    want = brute_alerts(rows, -0.05, 3, 70)
    assert len(want) > 5 and sorted(map(tuple, stream.read().collect())) == want
    assert sorted(map(tuple, alerts.alerts_of_table(spark.createDataFrame(rows, schema), expiry_days=70).collect())) == want


def test_expired_state_is_dropped(spark, tmp_path):
    schema = "signal string, ts timestamp, ic double"
    landing = Landing(spark, tmp_path / "in", schema)
    landing.arrive([("old", START, -1.0), ("old", START + timedelta(days=1), -1.0)])
    stream = alerts.AlertStream(spark, landing.stream(), str(tmp_path / "out"), expiry_days=5)
    stream.run()
    for day in (20, 40, 60):
        landing.arrive([("new", START + timedelta(days=day), 1.0)])
        progress = stream.run()
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1
    landing.arrive([("old", START + timedelta(days=61), -1.0)])
    stream.run()
    assert stream.read().count() == 0


def test_table_without_batches(spark, tmp_path):
    schema = spark.createDataFrame([], ROWS).schema
    empty = tables.BatchTable(spark, str(tmp_path / "none"), schema)
    assert empty.read().count() == 0 and empty.current(["id"]).columns == schema.fieldNames()
