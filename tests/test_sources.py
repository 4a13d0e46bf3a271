import datetime as dt
import os

from lagscope.sources import measurements as ms
from lagscope.sources import prices as pr

HEADER = ("State Code,Parameter Name,State Name,County Name,Latitude,Longitude,Date GMT,Time GMT,"
          "Sample Measurement,Units of Measure,MDL\n")


def _line(param, state, county, lat, lon, date, time, value, unit="ppm"):
    q = lambda s: f'"{s}"' if "," in s else s
    return f"06,{q(param)},{state},{county},{lat},{lon},{date},{time},{value},{unit},0.1\n"


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HEADER + "".join(lines))


def make_tree(root):
    _write(f"{root}/gasses/co/hourly_42101_2019.csv", [
        _line("Carbon monoxide", "California", "Napa", "38.31012349", "-122.29642101", "2019-01-01", "3:00", "0.5"),
        _line("Carbon monoxide", "California", "NAPA", "38.3104", "-122.2964", "2019-01-01", "13:00", "0.7"),
        _line("Carbon monoxide", "California", "Napa", "38.3101", "-122.2964", "2019-01-02", "13:00", "abc"),
        _line("Carbon monoxide", "California", "Napa", "38.3101", "-122.2964", "2019-13-45", "13:00", "0.9"),
    ])
    _write(f"{root}/gasses/pm/hourly_88101_2019.csv", [
        _line("PM2.5", "California", "Napa", "38.3101", "-122.2964", "2019-01-01", "3:00", "12.0", "ug/m3"),
        _line("Sulfur dioxide & friends", "Oregon", "Lane", "44.0", "-123.0", "2019-01-01", "4:00", "1.0"),
    ])
    _write(f"{root}/gasses/pm/hourly_88101_2018.csv", [
        _line("PM2.5", "California", "Napa", "38.3101", "-122.2964", "2018-01-01", "3:00", "10.0", "ug/m3"),
    ])
    _write(f"{root}/toxics/voc/hourly_43000_2019.csv", [
        _line("1,3-Butadiene (total)", "Texas", "Harris", "29.7", "-95.3", "2019-01-01", "5:00", "0.02", "ppbC"),
    ])


def test_year_list():
    assert ms.year_list(2014, 2016) == [2014, 2015, 2016]
    assert ms.year_list(2019) == [2019]


def test_read_measurements_normalises(spark, tmp_path):
    root = str(tmp_path / "air")
    make_tree(root)
    df = ms.read_measurements(spark, root, ["gasses/*"], [2019])
    assert df.columns == ms.MEASUREMENT_COLUMNS
    got = df.collect()
    assert len(got) == 6  # 2018 file excluded, toxics excluded
    crit = {r.criteria for r in got}
    assert "Sulfur dioxide and friends" in crit and "PM2.5" in crit
    assert {r.county for r in got if r.state == "california"} == {"napa"}
    first = [r for r in got if r.value == 0.5][0]
    assert first.lat == 38.310123 and first.lon == -122.296421
    assert first.ts == dt.datetime(2019, 1, 1, 3, 0) and first.date == dt.date(2019, 1, 1)
    assert [r.ts.hour for r in got if r.value == 0.7] == [13]
    assert [r.value for r in got if r.date == dt.date(2019, 1, 2)] == [None]   # malformed number
    assert len([r for r in got if r.date is None]) == 1                         # malformed date


def test_overlapping_globs_scan_each_file_once(spark, tmp_path):
    root = str(tmp_path / "air")
    make_tree(root)
    paths = ms.resolve_paths(spark, ms.measurement_globs(root, ["gasses/*", "gasses/co"], [2019]))
    assert len(paths) == 2
    df = ms.read_measurements(spark, root, ["gasses/*", "gasses/co", "toxics/*"], [2019, 2018])
    assert df.count() == 8


def test_combine_and_inventory(spark, tmp_path):
    root = str(tmp_path / "air")
    make_tree(root)
    out = str(tmp_path / "landed")
    ms.combine_class_csvs(spark, root, out)
    landed = ms.read_measurement_table(spark, out, classes=["gasses"], years=[2019])
    assert landed.count() == 5  # the malformed-date row has no year partition value 2019
    assert set(r["class"] for r in landed.select("class").collect()) == {"gasses"}
    inv = {(r["class"], r.subclass): r.files for r in ms.source_inventory(spark, root).collect()}
    assert inv == {("gasses", "co"): 1, ("gasses", "pm"): 2, ("toxics", "voc"): 1}


def test_prices_with_and_without_header(spark, tmp_path):
    body = "20190102,50.5\n20190103,51.0\n20190104,\n20190107,49.0\n20190103,51.0\nnotadate,1\n"
    with_h = tmp_path / "with.csv"
    with_h.write_text("Date,Price\n" + body)
    no_h = tmp_path / "without.csv"
    no_h.write_text(body)
    a = pr.read_prices(spark, str(with_h)).orderBy("date").collect()
    b = pr.read_prices(spark, str(no_h), header=False).orderBy("date").collect()
    assert [r.date for r in a] == [r.date for r in b]
    assert [(r.date.day, r.price) for r in a] == [(2, 50.5), (3, 51.0), (4, None), (7, 49.0)]
    assert (a[0].year_str, a[0].month_str, a[0].day_str, a[0].year, a[0].dayofyear) == ("2019", "01", "02", 2019, 2)
    assert pr.read_prices(spark, str(with_h), years=[2020]).count() == 0


def test_typed_adapter_equals_raw_path(spark):
    from lagscope.sources import tables

    sf = "/root/testdata/sf0.001"
    for mode in ("flag", "measure"):
        a = tables.lineitem_measurements(spark, sf, criteria=mode)
        b = tables.lineitem_measurements_from_raw(spark, sf, criteria=mode)
        assert a.schema.simpleString() == b.schema.simpleString()
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
