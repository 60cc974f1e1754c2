"""Streams against batch: order of arrival, restarts, late rows, repeated deliveries."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from squallframe.operators import sequence
from squallframe.streaming import gusts
from squallframe.streaming.replay import closing, in_order, replay

START = datetime(2020, 1, 1)
DDL = "site int, time timestamp, gust double"


def hours(spark, rows):
    return spark.createDataFrame([(s, START + timedelta(hours=h), g) for s, h, g in rows], DDL)


@pytest.fixture(scope="module")
def readings(spark):
    values = [10.0, 50.0, 12.0, 45.0, 30.0, None, 60.0, 5.0, 41.0, 19.0]
    rows = [(s, h, values[(h + s * 3) % len(values)]) for s in range(3) for h in range(60) if (h + s) % 11]
    return hours(spark, rows)


def test_spike_fix_equals_batch_across_restarts(spark, readings):
    deliveries = [*in_order(readings, "time", 4), closing(readings, "time")]
    fixed, late = replay(deliveries, lambda s: gusts.fix_hourly_spikes(s, ["site"], "time", "gust"))
    want = sequence.fix_hourly_spikes(readings, ["site"], "time", "gust")
    assert late == 0
    got = sorted(map(tuple, fixed.where("site is not null").collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert set(got) != set(map(tuple, readings.collect()))  # some spikes were there


def test_spike_fix_takes_readings_out_of_order_within_the_delay(spark):
    first = hours(spark, [(1, 1, 50.0), (1, 2, 10.0)])
    then = hours(spark, [(1, 0, 12.0), (1, 3, 15.0), (1, 1, 99.0)])
    fixed, _ = replay([first, then, closing(first, "time")], lambda s: gusts.fix_hourly_spikes(s, ["site"], "time", "gust"))
    got = {r.time: r.gust for r in fixed.where("site is not null").collect()}
    assert [got[START + timedelta(hours=h)] for h in range(4)] == [12.0, 11.0, 10.0, 15.0]


def test_daily_maximum_waits_for_the_day_and_counts_late_rows(spark):
    parts = [
        hours(spark, [(1, 1, 5.0), (1, 30, 7.0), (2, 3, None)]),
        hours(spark, [(1, 2, 9.0), (1, 80, 1.0)]),  # hour 2 is behind, but within the delay
        hours(spark, [(1, 4, 100.0), (1, 81, 2.0)]),  # hour 4 is late by now
    ]
    daily, late = replay([*parts, closing(parts[0], "time")], lambda s: gusts.daily_maximum(s, ["site"], "time", "gust"))
    got = sorted((r.site, r.day.day, r.gust) for r in daily.where("site is not null").collect())
    assert got == [(1, 1, 9.0), (1, 2, 7.0), (1, 4, 2.0), (2, 1, None)]
    assert late == 1


def test_repeated_deliveries_give_each_row_once(spark, readings):
    rows = readings.withColumn("id", F.hash("site", "time"))
    parts = in_order(rows, "time", 3)
    out, _ = replay([parts[0], parts[0], parts[1], parts[0], parts[2], parts[2]], lambda s: gusts.first_of_each(s, ["id"], "time"))
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.collect()))


def test_an_empty_table_gives_none(spark):
    empty = hours(spark, [])
    out, late = replay(in_order(empty, "time"), lambda s: gusts.first_of_each(s, ["site"], "time"))
    assert out.count() == 0 and late == 0
