import glob
import os

import pytest

from fixtures import write_prices, write_tree

from lagscope.plans import jobs, scenarios
from lagscope.sources import measurements
from lagscope.streaming import ingest


def test_scenarios_and_store(spark, tmp_path):
    root = str(tmp_path / "air")
    write_tree(root)
    store = str(tmp_path / "store")
    daily, labels = scenarios.build_scenario(spark, root, "gasses_2014_2019", store)   # 2018-2019 present
    assert daily.count() == 180 and glob.glob(f"{store}/gasses_2014_2019/daily-*/_COMPLETE")
    sc = scenarios.Scenario("g", ("gasses/*",), (2018, 2019), "national", persist=True)
    daily, labels = scenarios.build_scenario(spark, root, sc, store)
    assert labels == ["Carbon_monoxide", "Nitrogen_dioxide_NO2", "PM2_5"]
    assert daily.count() == 180 and glob.glob(f"{store}/g/daily-*/data")
    again, labels2 = scenarios.build_scenario(spark, root, sc, store)   # reloaded from the store
    assert labels2 == labels and again.count() == 180
    site = scenarios.Scenario("gs", ("gasses/*",), (2019,), "site")
    sdaily, _ = scenarios.build_scenario(spark, root, site)
    assert sdaily.count() == 90 * 3


def test_correlation_jobs(spark, tmp_path):
    root = str(tmp_path / "air")
    write_tree(root)
    price = str(tmp_path / "price.csv")
    write_prices(price)
    auto = jobs.autocorrelation(spark, root, "gasses_2019", lags=[-10, 0, 10])
    rows = auto.collect()
    assert len(rows) == 3 * 3 * 3
    assert all(abs(r.r - 1.0) < 1e-12 for r in rows if r.series_x == r.series_y and r.lag == 0)
    out = str(tmp_path / "cors")
    gp = jobs.gas_price_2019(spark, root, price, out=out)
    assert gp.count() == 3 * 7 and spark.read.parquet(out).count() == 21
    tox = jobs.toxics_price_2019(spark, root, price)
    assert {r.series_x for r in tox.collect()} == {"1_3_Butadiene", "Benzene_and_co"}


def test_cost_and_heatmap_jobs(spark, tmp_path):
    root = str(tmp_path / "air")
    write_tree(root)
    price = str(tmp_path / "price.csv")
    write_prices(price, header=False)
    out = str(tmp_path / "scores")
    res = jobs.cost_scores(spark, root, price, year=2019, lag=10, out=out, price_header=False,
                           latest_priced=True).collect()
    assert len(res) == 3 and all(r.score is None or r.score > 0 for r in res)
    files = glob.glob(out + "/*.csv")
    assert len(files) == 1 and open(files[0]).readline().strip() == "lat,lon,score"
    hm_out = str(tmp_path / "heat")
    sc = scenarios.Scenario("gsite", ("gasses/*",), (2018, 2019), "site")
    scenarios.SCENARIOS["gsite"] = sc
    pts = jobs.heatmap(spark, root, year=2019, scenario="gsite", out=hm_out)
    w = jobs.heatmap(spark, root, year=2019, scenario="gsite", points=False)
    assert pts.count() == w.agg({"weight": "sum"}).first()[0]
    assert len(glob.glob(hm_out + "/*.csv")) == 1


def test_profile_job(spark, tmp_path):
    root = str(tmp_path / "air")
    write_tree(root)
    prof = jobs.profile_dataset(spark, root, [2019])
    assert [r.column for r in prof["schema"].collect()][:3] == ["criteria", "state", "county"]
    assert {r.unit for r in prof["units"].collect()} == {"ppm", "ppb", "ug/m3"}
    assert prof["scaled"].count() == 90 * 3
    vals = [v for r in prof["scaled"].collect() for v in r[3:]]
    assert max(abs(v) for v in vals) <= 1.0 + 1e-12


def test_prepared_tables(spark, tmp_path):
    root = str(tmp_path / "air")
    write_tree(root)
    long = measurements.read_measurements(spark, root, ["gasses/*"], [2019])
    prep, cols = scenarios.prepared_measurements(long)
    assert cols == ["Carbon_monoxide_sma12", "Nitrogen_dioxide_NO2_sma12", "PM2_5_sma12"]
    assert max(abs(v) for r in prep.collect() for v in r[3:]) <= 1.0 + 1e-12


def test_streaming_ingest_is_incremental(spark, tmp_path):
    root = str(tmp_path / "land")
    write_tree(root, years=(2018,), days=10)
    out = str(tmp_path / "landed")
    ckpt = str(tmp_path / "ckpt")
    ingest.ingest(spark, root, out, checkpoint=ckpt).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == 5 * 3 * 10 * 2
    write_tree(root, years=(2019,), days=10, seed=5)          # new yearly files land
    ingest.ingest(spark, root, out, checkpoint=ckpt).awaitTermination()
    table = measurements.read_measurement_table(spark, out, classes=["gasses"], years=[2019])
    assert spark.read.parquet(out).count() == 2 * first      # old files not re-read
    assert table.count() == 3 * 3 * 10 * 2


def test_command_line_jobs(spark, tmp_path):
    from lagscope.__main__ import main

    root = str(tmp_path / "air")
    write_tree(root)
    price = str(tmp_path / "price.csv")
    write_prices(price)
    out = str(tmp_path / "pc")
    assert main(["price-correlation", "--root", root, "--price", price, "--lags", "0", "10", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 3 * 2
    sc = str(tmp_path / "sc")
    assert main(["cost-scores", "--root", root, "--price", price, "--latest-priced", "--out", sc]) == 0
    assert spark.read.option("header", True).csv(sc).count() == 3


def test_scenario_from_landed_table_equals_raw(spark, tmp_path):
    root = str(tmp_path / "air")
    write_tree(root)
    landed = str(tmp_path / "landed")
    measurements.combine_class_csvs(spark, root, landed)
    sc = scenarios.Scenario("g19", ("gasses/*",), (2019,), "national", scaled=False)
    raw, labels = scenarios.build_scenario(spark, root, sc)
    tab, labels2 = scenarios.build_scenario(spark, None, sc, table=landed)
    assert labels == labels2
    a = sorted(tuple(r) for r in raw.collect())
    b = sorted(tuple(r) for r in tab.collect())
    assert len(a) == len(b) == 90
    for ra, rb in zip(a, b):
        assert ra[:3] == rb[:3] and all(abs(x - y) < 1e-9 for x, y in zip(ra[3:], rb[3:]))


def test_streaming_ingest_refuses_another_checkpoint(spark, tmp_path):
    root = str(tmp_path / "land2")
    write_tree(root, years=(2018,), days=3)
    out, first, other = (str(tmp_path / x) for x in ("landed2", "c1", "c2"))
    ingest.ingest(spark, root, out, first).awaitTermination()
    assert spark.read.parquet(out).count() == 5 * 3 * 3 * 2
    with pytest.raises(ValueError, match="checkpoint"):
        ingest.ingest(spark, root, out, other)


def test_files_with_swapped_columns_fail_or_land_by_name(spark, tmp_path):
    header = measurements.RAW_COLUMNS
    row = ["Ozone", "CA", "Napa", "1.5", "2.5", "2019-01-01", "1:00", "3.0", "ppm"]
    swapped = [header[i] for i in (0, 1, 2, 4, 3, 5, 6, 7, 8)]
    folder = tmp_path / "gasses" / "x"
    folder.mkdir(parents=True)
    (folder / "a_2019.csv").write_text(",".join(header) + "\n" + ",".join(row) + "\n")
    (folder / "b_2019.csv").write_text(",".join(swapped) + "\n" + ",".join(row) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        measurements.read_measurements(spark, str(tmp_path), ["gasses/*"], [2019]).collect()
    # landing reads each file by its own header
    measurements.combine_class_csvs(spark, str(tmp_path), str(tmp_path / "out"))
    landed = measurements.read_measurement_table(spark, str(tmp_path / "out")).collect()
    assert sorted((r.lat, r.lon, r.value) for r in landed) == [(1.5, 2.5, 3.0), (2.5, 1.5, 3.0)]


def test_jobs_write_text_and_csv(spark, tmp_path):
    root, price = str(tmp_path / "air"), str(tmp_path / "price.csv")
    write_tree(root)
    write_prices(price)
    out = str(tmp_path / "pc_text")
    jobs.gas_price_2019(spark, root, price, out=out, fmt="text")
    assert spark.read.text(out).first().value.startswith("((")
