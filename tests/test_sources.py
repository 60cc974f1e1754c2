"""Readers on files, writers, compute-or-load."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from squallframe.session import settle, shared_folder
from squallframe.sources import scans, sinks


def test_daily_gust_file(spark, tmp_path):
    (tmp_path / "d.txt").write_text(
        "dc,1,GILES METEOROLOGICAL OFFICE  ,x ,WA ,-25.0,128.3,598,03/02/2010, 25.5,Y,270,Y,1530,Y,#\n"
        "dc,1,GILES METEOROLOGICAL OFFICE  ,x ,WA ,-25.0,128.3,598,04/02/2010,     ,Y,CALM,Y,    ,Y,#\n"
    )
    rows = scans.read_daily_gusts(spark, str(tmp_path / "d.txt"), {"GILES METEOROLOGICAL OFFICE": "Giles"}).orderBy("daily_date_lt").collect()
    assert [r["stn_name"] for r in rows] == ["Giles", "Giles"]
    assert (rows[0]["wind_gust"], rows[0]["wind_dir"], rows[0]["gust_time_lt"]) == (25.5, 270.0, dt.datetime(2010, 2, 3, 15, 30))
    assert (rows[1]["wind_gust"], rows[1]["wind_dir"], rows[1]["gust_time_lt"]) == (None, None, dt.datetime(2010, 2, 4))


def test_half_hourly_and_station_files(spark, tmp_path):
    (tmp_path / "h.txt").write_text("hm,1,A ,x,SA,-30,140,5,01/03/2011 10:30,90,Y,36.0,Y,1,#\n")
    r = scans.read_half_hourly(spark, str(tmp_path / "h.txt")).first()
    assert (r["time"], r["wind_gust"]) == (dt.datetime(2011, 3, 1, 10, 30), pytest.approx(10.0))
    folder = tmp_path / "stations"
    folder.mkdir()
    for no in ("023034", "016001"):
        (folder / f"DC02D_Data_{no}_99.txt").write_text(f"hm,{int(no)},S{no},-30,140,05/06/2001, 12.5,Y,#\n")
    rows = scans.read_station_daily(spark, str(folder), "016001").collect()
    assert [(r["file_station"], r["date"], r["wind_gust"]) for r in rows] == [("016001", dt.date(2001, 6, 5), 12.5)]


def test_sounding_report_and_track_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text(
        "r,94,01/01/2000 00:00,20.0,Y,10.0,Y,50,Y,10.0,Y,90,Y,1000,Y,30,Y,#\nr,94,01/01/2010 00:00,   ,Y,10.0,Y,50,Y,10.0,Y,90,Y,900,Y,30,Y,#\n"
    )
    s = scans.read_soundings(spark, str(tmp_path / "s.txt"), "1999-01-01", "2005-01-01").collect()
    assert len(s) == 1 and s[0]["ua"] == pytest.approx(10.0) and s[0]["va"] == pytest.approx(0.0, abs=1e-12)
    (tmp_path / "r.csv").write_text("Wind ID,Date/Time,Latitude,Longitude,Max Gust speed,Comments\n7,05/11/2012 13:20,-33,151,50,Trees DOWN\n")
    r = scans.read_reports(spark, str(tmp_path / "r.csv")).first()
    assert (r["comments"], r["sta_date_ceil"].hour, r["sta_wind"]) == ("trees down", 14, pytest.approx(25.7222))
    (tmp_path / "t.csv").write_text(
        "NAME,ID,TM,TYPE,SURFACE_CODE,LAT,LON,P,W,G\nA,03_U,2011-01-02 06:00,T,x,-15.5,120.5,990,,\nA,03_U, ,T,1,-15,120,990,,\nbroken\n"
    )
    t = scans.read_tracks(spark, str(tmp_path / "t.csv")).collect()
    assert [(x["storm_id"], x["lat"], x["sfc_code"]) for x in t] == [("2011_03_U", -15.5, None)]


def test_date_sequence_stops_at_the_end(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 20))], "a timestamp, b timestamp")
    assert [r["time"].hour for r in scans.date_sequence(df, "a", "b", 6).collect()] == [0, 6, 12, 18]


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "cube")
    df = spark.createDataFrame([("m", 2000, 1, 1.0), ("m", 2001, 2, 2.0)], "model string, year int, i int, cape double")
    sinks.write_partitioned(df, path, ["model", "year"], ["i"], {"cape": "J/kg"})
    sinks.write_partitioned(df.where("year = 2001").withColumn("cape", F.col("cape") * 10), path, ["model", "year"], ["i"])
    back = spark.read.parquet(path)
    assert {r["year"]: r["cape"] for r in back.collect()} == {2000: 1.0, 2001: 20.0}
    out = str(tmp_path / "cube2")
    sinks.append_variable(spark, path, out, {"wmax": F.sqrt(2 * F.col("cape"))}, ["model", "year"])
    assert spark.read.parquet(out).where("year = 2000").first()["wmax"] == pytest.approx(2**0.5)
    with pytest.raises(ValueError):
        sinks.append_variable(spark, path, path, {}, ["model"])


def test_units_are_kept_as_metadata(spark, tmp_path):
    path = str(tmp_path / "u")
    sinks.write_partitioned(spark.createDataFrame([(1, 2.0)], "year int, cape double"), path, ["year"], (), {"cape": "J/kg"})
    assert spark.read.parquet(path).schema["cape"].metadata == {"units": "J/kg"}


def test_model_scan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "grid")
    rows = [(m, y, -30.0 + k, 135.0, float(k)) for m in ("a", "b") for y in (2000, 2001) for k in range(5)]
    spark.createDataFrame(rows, "model string, year int, lat double, lon double, cape double").write.partitionBy("model", "year").parquet(path)
    df = scans.read_model(spark, path, "a", [2001], "sa_small").select("lat", "cape")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(lat)" in plan.replace("\n", " ")
    assert {r["lat"] for r in df.collect()} == {-30.0, -29.0, -28.0, -27.0, -26.0}


def test_text_export_and_load_or_build(spark, tmp_path):
    sinks.write_text_table(spark.createDataFrame([("a", None), ("b", 1.5)], "s string, v double").coalesce(1), str(tmp_path / "x"))
    text = "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    assert "a,NA" in text and "b,1.5" in text
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_settle_writes_to_the_shared_folder(spark):
    df = settle(spark.range(5))
    assert df.count() == 5 and all(shared_folder(spark) in f for f in df.inputFiles())
