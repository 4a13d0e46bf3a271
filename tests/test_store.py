"""The scenario store: only new files are read, half-written batches never."""

import glob
import os

import pytest

from lagscope.plans import scenarios
from lagscope.sources import measurements, sinks, store

HEAD = ",".join(f'"{c}"' for c in measurements.RAW_COLUMNS)


def write(root, cls, year, days, criterion="Ozone", value=lambda d, s: d + s, sites=(1, 2)):
    folder = f"{root}/gasses/{cls}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/h {cls}_{year}.csv", "w") as f:
        f.write(HEAD + "\n")
        for d in days:
            for s in sites:
                for hour in (1, 2):
                    f.write(f'"{criterion}","Utah","Weber",{s}.5,-{s}.25,{year}-01-{d:02d},{hour:02d}:00,{value(d, s)},"ppm{hour}"\n')


class Reads:
    """What the raw reader is asked for, and how many rows it gives."""

    def __init__(self, monkeypatch):
        self.paths, self.rows = [], 0
        real = measurements.read_raw_measurements

        def read(spark, paths, **kw):
            raw = real(spark, paths, **kw)
            self.paths += [os.path.basename(p) for p in paths]
            self.rows += raw.count()
            return raw

        monkeypatch.setattr(measurements, "read_raw_measurements", read)

    def taken(self):
        out = sorted(self.paths), self.rows
        self.paths, self.rows = [], 0
        return out


SC = scenarios.Scenario("g", ("gasses/*",), (2018, 2019, 2020), "national", scaled=False, persist=True)


def table(found):
    daily, labels = found
    return labels, sorted(tuple(r) for r in daily.select("date", *labels).collect())


def rebuilt(spark, root, sc=SC):
    """The same scenario without a store."""
    return table(scenarios.build_scenario(spark, root, scenarios.Scenario(**{**sc.__dict__, "persist": False})))


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "air+ %41")          # a path that an URI has to escape
    write(root, "ozone", 2018, range(1, 6))
    write(root, "co", 2018, range(1, 9), "CO", lambda d, s: d * s)
    return root, str(tmp_path / "store")


def test_added_file_alone_is_read(spark, tree, monkeypatch):
    root, kept = tree
    reads = Reads(monkeypatch)
    assert table(scenarios.build_scenario(spark, root, SC, kept)) == rebuilt(spark, root)
    reads.taken()
    again = table(scenarios.build_scenario(spark, root, SC, kept))
    assert reads.taken() == ([], 0) and len(again[1]) == 5
    write(root, "ozone", 2019, range(1, 9))
    write(root, "co", 2019, range(1, 9), "CO")
    more = table(scenarios.build_scenario(spark, root, SC, kept))
    assert reads.taken() == (["h co_2019.csv", "h ozone_2019.csv"], 64) and len(more[1]) == 13
    assert more == rebuilt(spark, root)


def test_new_criterion_shared_days_and_sites(spark, tree, monkeypatch):
    """A file whose (site, day, criterion) others have too: partials merge."""
    root, kept = tree
    scenarios.build_scenario(spark, root, SC, kept)
    write(root, "ozone2", 2018, range(3, 8), "Ozone", lambda d, s: 100 * s)
    write(root, "no2", 2018, range(1, 9), "NO2 (x)")
    got = table(scenarios.build_scenario(spark, root, SC, kept))
    assert got == rebuilt(spark, root) and got[0] == ["CO", "NO2_x", "Ozone"]
    sums = store.PartialStore(spark, f"{kept}/g").partials(store.list_files(spark, [f"{root}/gasses/*/*2018*.csv"]))
    one = sums.where("criteria = 'Ozone' AND date = '2018-01-03' AND lat = 1.5").first()
    assert (one._s, one._n, one._u) == (2 * 4 + 2 * 100, 4, "ppm1")


def test_changed_and_removed_files(spark, tree, monkeypatch):
    root, kept = tree
    scenarios.build_scenario(spark, root, SC, kept)
    reads = Reads(monkeypatch)
    write(root, "ozone", 2018, range(1, 8), value=lambda d, s: 1000 + d)
    got = table(scenarios.build_scenario(spark, root, SC, kept))
    assert reads.taken() == (["h ozone_2018.csv"], 28) and got == rebuilt(spark, root)
    os.remove(f"{root}/gasses/co/h co_2018.csv")
    reads.taken()
    got = table(scenarios.build_scenario(spark, root, SC, kept))
    assert reads.taken() == ([], 0) and got == rebuilt(spark, root) and got[0] == ["Ozone"]


@pytest.mark.parametrize("lost", ["batch", "daily"])
def test_interrupted_write_is_made_again(spark, tree, monkeypatch, lost):
    """Without its mark nothing is believed, be it batch or finished table."""
    root, kept = tree
    want = table(scenarios.build_scenario(spark, root, SC, kept))
    reads = Reads(monkeypatch)
    for mark in glob.glob(f"{kept}/g/{lost}-*/_COMPLETE"):
        os.remove(mark)
    for part in glob.glob(f"{kept}/g/daily-*/data/part-*") if lost == "daily" else []:
        os.remove(part)
    with pytest.raises(FileNotFoundError):
        sinks.read_scenario(spark, glob.glob(f"{kept}/g/{lost}-*")[0])
    assert table(scenarios.build_scenario(spark, root, SC, kept)) == want
    assert reads.taken()[1] == (52 if lost == "batch" else 0)


def test_job_that_dies_between_the_writes(spark, tree, monkeypatch):
    root, kept = tree

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(sinks, "mark_complete", dies)
    with pytest.raises(RuntimeError):
        scenarios.build_scenario(spark, root, SC, kept)
    monkeypatch.undo()
    assert table(scenarios.build_scenario(spark, root, SC, kept)) == rebuilt(spark, root)


def test_landed_table_grows(spark, tree, tmp_path):
    root, kept = tree
    landed = str(tmp_path / "landed")
    measurements.combine_class_csvs(spark, root, landed)
    first = table(scenarios.build_scenario(spark, None, SC, kept, table=landed))
    assert first == rebuilt(spark, root)
    more = str(tmp_path / "more")
    write(more, "ozone", 2019, range(1, 4))
    write(more, "co", 2019, range(1, 4), "CO")
    measurements.combine_class_csvs(spark, more, landed, mode="append")
    grown = table(scenarios.build_scenario(spark, None, SC, kept, table=landed))
    assert len(grown[1]) == len(first[1]) + 3 and len(glob.glob(f"{kept}/g/batch-*/_COMPLETE")) == 2


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scenarios.build_scenario(spark, str(tmp_path / "none"), SC, str(tmp_path / "store"))
