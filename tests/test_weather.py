"""Station files, station lists, observed columns and point sources: odd rows and files."""

import datetime

import pytest

from catchment.sources import weather


def file(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder / name}"


def test_station_files(spark, tmp_path):
    day = lambda m, d: datetime.date(2020, m, d)
    rows = [("pcp", "a b/c", 1.5, -2.0, 3.0, day(3, d), float(d)) for d in (4, 2, 3)] + [("pcp", "é=1+%2", None, None, None, day(3, 3), None)]
    rows += [("tmp", "x", 1.0, 1.0, 1.0, day(1, 1), 2.0), ("tmp", "x", 1.0, 1.0, 1.0, day(12, 31), 2.0), (None, "x", 1.0, 1.0, 1.0, day(1, 1), 2.0), ("tmp", "x", 1.0, 1.0, 1.0, None, 2.0)]
    path = f"file://{tmp_path}/stations"
    shape = "kind string, station string, lat double, lon double, elev double, date date, value double"
    weather.write_stations(spark.createDataFrame(rows, shape).repartition(5), path)
    scanned = weather.scan_stations(spark, path)
    got = {(r["kind"], r["station"]): (r["lat"], r["lon"], r["start"], r["finish"]) for r in scanned.collect()}
    assert got == {("pcp", "a b/c"): (1.5, -2.0, day(3, 2), day(3, 4)), ("pcp", "é=1+%2"): (0.0, 0.0, day(3, 3), day(3, 3)), ("tmp", "x"): (1.0, 1.0, day(1, 1), day(12, 31))}
    assert {r["kind"]: (r["start"], r["finish"]) for r in weather.windows(scanned).collect()} == {"pcp": (day(3, 3), day(3, 3)), "tmp": (day(1, 1), day(12, 31))}
    window = weather.simulation_window(scanned).first()
    assert (window["start"], window["finish"], window["day_start"], window["day_end"]) == (day(3, 3), day(3, 3), 63, 63)
    whole = weather.simulation_window(scanned.where("kind = 'tmp'")).first()
    assert (whole["day_start"], whole["yrc_start"], whole["day_end"], whole["yrc_end"]) == (0, 2020, 0, 2020)
    none = weather.simulation_window(scanned.limit(0)).first()
    assert none["start"] is None and none["day_start"] is None and none["day_end"] is None


def test_station_lists(spark, tmp_path):
    good = file(tmp_path, "l.txt", "ID,NAME,LAT,LONG,ELEVATION\n1,b-1,1.5,2,3\n2,A-1,x,2,3\n3,b-1,1,1,1\n")
    got = [(r["place"], r["filename"], r["id"], r["lat"]) for r in weather.read_station_list(spark, good, "tmp").orderBy("place").collect()]
    assert got == [(1, "A1.tmp", 2, None), (2, "b1.tmp", 1, 1.5), (3, "b1.tmp", 3, 1.0)]
    for text in ("ID,NAME\n1,a\n", ""):
        with pytest.raises(ValueError):
            weather.read_station_list(spark, file(tmp_path, "bad.txt", text), "tmp")


def test_observed_columns(spark, tmp_path):
    path = file(tmp_path, "o.csv", "Date, flow ,q\n2000-01-01, 1.5 ,7\n2000-01-02,,8\n2000-01-03,x,9\n\n2000-01-05,4,1\n")
    assert [(r["k"], r["value"]) for r in weather.read_observed(spark, path, "flow").orderBy("k").collect()] == [(1, "1.5"), (2, ""), (3, "x")]
    assert weather.read_observed(spark, path, "Date").count() == 3
    for bad in (path, file(tmp_path, "e.csv", "")):
        with pytest.raises(ValueError):
            weather.read_observed(spark, bad, "none")


def test_plots_and_recalls(spark, tmp_path):
    plot = file(tmp_path, "p.csv", "Date,a, b \n2000-01-01,1,x\n2000-01-02,, 2.5\n")
    got = {(r["date"], r["series"]): (r["text"], r["value"]) for r in weather.read_plot(spark, plot).collect()}
    assert got == {("2000-01-01", "a"): ("1", 1.0), ("2000-01-01", "b"): ("x", None), ("2000-01-02", "a"): (None, None), ("2000-01-02", "b"): ("2.5", 2.5)}
    recall = file(tmp_path, "r.csv", "jday;flo\n1;2,5\n2;x\n3;4\n")
    rows = weather.read_recall(spark, recall, "jday int, flo double", 9)
    assert [tuple(r) for r in rows.orderBy("jday").collect()] == [(1, 2.5, 9), (2, None, 9), (3, 4.0, 9)]
