"""Landing of files whose headers differ."""

import os

import pytest

from lagscope.sources import headers
from lagscope.sources import measurements as ms

ROW = {"Parameter Name": "Ozone", "State Name": "Utah", "County Name": "Weber", "Latitude": "1.5", "Longitude": "-2.5",
       "Date GMT": "2019-01-02", "Time GMT": "03:00", "Sample Measurement": "7.5", "Units of Measure": "ppm"}


def write(path, names, rows, quote='"'):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(f"{quote}{n}{quote}" for n in names) + "\n")
        f.writelines(line + "\n" for line in rows)


def line(names, **values):
    row = {**ROW, **values}
    return ",".join(f'"{row.get(n, "more")}"' for n in names)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "air")
    plain, turned = ms.RAW_COLUMNS, ms.RAW_COLUMNS[::-1]
    wide = ["State Code", *plain[4:], "", "State Code", *plain[:4]]
    write(f"{root}/gasses/ozone/a_2019.csv", plain, [line(plain, **{"Sample Measurement": str(v)}) for v in (1, 2)])
    write(f"{root}/gasses/ozone/b_2019.csv", turned, [line(turned, **{"Sample Measurement": "3"})], quote="")
    write(f"{root}/gasses/no2/c 1_2019.csv", wide, [line(wide, **{"Sample Measurement": "4", "Parameter Name": "NO2, x"}),
                                                   "only,two", line(wide) + ",too,many"])
    write(f"{root}/toxics/voc/d_2019.csv", plain[:-2], [line(plain[:-2])])
    write(f"{root}/toxics/voc/e_2019.csv", [*plain, "Latitude"], [line([*plain, "Latitude"])])
    open(f"{root}/toxics/voc/f_2019.csv", "w").close()
    return root


def test_values_land_under_their_own_names(spark, tree, tmp_path):
    out, rejects = str(tmp_path / "landed"), str(tmp_path / "rejects")
    ms.combine_class_csvs(spark, tree, out, rejects=rejects)
    got = sorted((r["class"], r.subclass, r.criteria, r.value, r.unit, r.lat, r.lon, r.county)
                 for r in ms.read_measurement_table(spark, out).collect())
    assert got == [("gasses", "no2", "NO2, x", 4.0, "ppm", 1.5, -2.5, "weber")] + [
        ("gasses", "ozone", "Ozone", v, "ppm", 1.5, -2.5, "weber") for v in (1.0, 2.0, 3.0)]
    bad = sorted((r.file.rsplit("/", 1)[1], r.record[:8], r.reason) for r in spark.read.parquet(rejects).collect())
    assert [b[0] for b in bad] == ["c%201_2019.csv", "c%201_2019.csv", "d_2019.csv", "e_2019.csv", "f_2019.csv"]
    assert all(b[2].startswith("not 12 fields") for b in bad[:2]) and {b[1] for b in bad[:2]} == {"only,two", '"more","'}
    assert "lacks ['Sample Measurement'" in bad[2][2] and bad[3][2] == "has ['Latitude'] more than once"
    assert "lacks" in bad[4][2]


def test_one_scan_per_header(spark, tree):
    paths = ms.resolve_paths(spark, [f"{tree}/gasses/*/*.csv"])
    found = headers.catalogue(spark, paths)
    assert sorted(len(f) for f in found.values()) == [1, 1, 1]
    write(f"{tree}/gasses/ozone/z_2020.csv", ms.RAW_COLUMNS, [line(ms.RAW_COLUMNS)] * 3)
    paths = ms.resolve_paths(spark, [f"{tree}/gasses/*/*.csv"])
    rows, _ = headers.read_by_header(spark, paths, ms.RAW_COLUMNS)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3 and rows.count() == 7


def test_no_readable_file(spark, tree):
    paths = ms.resolve_paths(spark, [f"{tree}/toxics/*/*.csv"])
    rows, rejects = headers.read_by_header(spark, paths, ms.RAW_COLUMNS)
    assert rows.columns == [*ms.RAW_COLUMNS, "file"] and rows.count() == 0 and rejects.count() == 3
    with pytest.raises(FileNotFoundError):
        headers.read_by_header(spark, [], ms.RAW_COLUMNS)
