"""Readers on small files, with splits smaller than the files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from raingrid import session
from raingrid.plans import flows
from raingrid.sources import mooring, sink, station

TEMP = """ Depth(M):           1     10     13 QUALITY SOURCE
 YYYYMMDD HHMM     SST   TEMP   TEMP QQQ SSS
 20030301 1200  21.500 -9.999 21.700 101 505
 20030302 1200  21.600 21.400 20.800 141 575
 Depth(M):           1     20 QUALITY SOURCE
 YYYYMMDD HHMM     SST   TEMP QQ SS
 20030320 1200  20.100 19.300 12 56
"""
WIND = """ Depth (M):       -4    -4    -4    -4 QUALITY and SOURCE
 YYYYMMDD HHMM  UWND  VWND  WSPD  WDIR SD SD
 20030301 1200  -6.2   1.3   6.4 -99.9 24 53
"""


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_headers_carry_over_splits(spark, tmp_path, small_splits):
    (tmp_path / "t8n90e_dy.ascii").write_text(TEMP)
    (tmp_path / "w8n90e_dy.ascii").write_text(WIND)
    rows = mooring.read_mooring_text(spark, f"file:{tmp_path}")
    got = {(r["variable"], r["ds"].isoformat(), r["name"], r["depth"]): (r["value"], r["q"], r["s"])
           for r in rows.collect()}
    assert len(got) == 3 + 3 + 2 + 4
    assert {r["station"] for r in rows.collect()} == {"8N90E"}
    assert got["temp", "2003-03-01", "TEMP", 10.0] == (None, 0, 0)
    assert got["temp", "2003-03-02", "TEMP", 10.0] == (21.4, 4, 7)
    assert got["temp", "2003-03-20", "TEMP", 20.0] == (19.3, 2, 6)
    assert got["wind", "2003-03-01", "UWND", -4.0] == (-6.2, 2, 5)
    assert got["wind", "2003-03-01", "WDIR", -4.0] == (None, 4, 3)


def test_merged_table(spark, tmp_path):
    (tmp_path / "t8n90e_dy.ascii").write_text(TEMP)
    (tmp_path / "w8n90e_dy.ascii").write_text(WIND)
    out = {r["Date"].isoformat(): r for r in flows.mooring_table(spark, f"file:{tmp_path}").collect()}
    assert out["2003-03-01"]["UWND"] == -6.2 and out["2003-03-01"]["WDIR"] is None
    assert out["2003-03-20"]["TEMP_20m"] == 19.3
    assert "2003-03-02" not in out  # its only target depth has low quality


def test_depth_columns(spark):
    head = " Depth(M):           1     10     13 QUALITY SOURCE"
    df = spark.createDataFrame([(head, ["a", "b", "c"])], "h string, t array<string>")
    depths = mooring.depth_columns(F.col("h"))
    row = df.select(depths.alias("m"), mooring.depth_value(F.col("t"), depths, 10).alias("x"),
                    mooring.depth_value(F.col("t"), depths, 20).alias("y")).first()
    assert row["m"] == {1.0: 0, 10.0: 1, 13.0: 2} and row["x"] == "b" and row["y"] is None


def test_sheet_rows(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text(
        "STASIUN,,\n\nTANGGAL,TN,RR\n01-01-2020,22,8888\n02-01-2020,-,1.5\n,,\n03-01-2020,1,1\n")
    (tmp_path / "b.csv").write_text("no header\n1,2\n")
    (tmp_path / "c.csv").write_text("TANGGAL,RR\n01-02-2020,3\nKETERANGAN : x\n02-02-2020,4\n")
    rows = station.read_sheet_text(spark, f"file:{tmp_path}", ("TANGGAL", "TN", "RR"))
    got = sorted((r["TANGGAL"], r["TN"], r["RR"]) for r in rows.collect())
    assert [g[0] for g in got] == ["01-01-2020", "01-02-2020", "02-01-2020"]
    assert got[1] == ("01-02-2020", None, "3") and got[2][1] is None


def test_station_csv(spark, tmp_path):
    head = "Date,Year,Month,Day,TN,TX,TAVG,RH_AVG,RR,SS,FF_X,DDD_X,FF_AVG,DDD_CAR\n"
    line = "2020-01-01,2020,1,1,22.1,x,26.0,80,8888.0,-,3,180,9999,S \n"
    (tmp_path / "2020.csv").write_text(head + line + line)
    (tmp_path / "2021.csv").write_text(head + "2021-01-01,2021,1,1,21,,,,,,,,,C\n")
    rows = station.read_station_csv(spark, f"file:{tmp_path}/*.csv").orderBy("ds").collect()
    assert len(rows) == 2
    first = rows[0]
    assert (first["ds"], first["TN"], first["TX"], first["RR"], first["SS"], first["FF_AVG"],
            first["DDD_CAR"]) == (dt.date(2020, 1, 1), 22.1, None, None, None, None, "S")


def test_station_csv_follows_each_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,TN,TX\n2020-01-01,20,30\n2020-01-02,21,31\n")
    (tmp_path / "b.csv").write_text("TX,Date,RR\n33,03-01-2020,1.5\n")
    rows = station.read_station_csv(spark, f"file:{tmp_path}/*.csv").orderBy("ds").collect()
    assert [(r["TN"], r["TX"], r["RR"]) for r in rows] == [(20, 30, None), (21, 31, None), (None, 33, 1.5)]


def test_station_flow(spark, tmp_path):
    head = "Date,Year,Month,Day,TN,TX,TAVG,RH_AVG,RR,SS,FF_X,DDD_X,FF_AVG,DDD_CAR\n"
    text = head
    for i in range(120):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=i)
        if i % 11 == 5:
            continue
        rr = "8888" if i % 4 == 0 else str(i % 13)
        text += f"{d},{d.year},{d.month},{d.day},22,{30 + i % 3},26,{70 + i % 20},{rr},6,4,{i % 360},2,N \n"
    (tmp_path / "station=Aceh").mkdir()
    (tmp_path / "station=Aceh" / "2020.csv").write_text(text)
    clean = flows.station_table(spark, f"file:{tmp_path}")
    rows = clean.collect()
    assert len(rows) == 120 and not any(v is None for r in rows for v in r)
    plan = {k: [{"alpha": 0.2, "beta": 0.05, "gamma": 0.1, "phi": 0.98, "m": 7, "kind": "add"}]
            for k in ("rr", "tavg", "rh")}
    out = flows.station_outlook(clean, 30, plan).collect()
    assert len(out) == 30 and all(r["decision"] for r in out)


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Fake())


def test_a_value_has_few_files_however_many_tasks_write(spark, tmp_path):
    rows = spark.range(0, 400, 1, 16).selectExpr("concat('s', id % 10) AS station", "id AS n")
    sink.write_series(rows, f"{tmp_path}/out", by=("station",))
    assert len(list(tmp_path.glob("out/station=*/*.csv"))) == 10
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 400
