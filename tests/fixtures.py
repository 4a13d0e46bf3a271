"""Synthetic landing trees for the file-based sources, scenarios and jobs
(the reference ships no raw inputs; the driver's tables are Parquet)."""

import datetime as dt
import os

import numpy as np

HEADER = ("State Code,Parameter Name,State Name,County Name,Latitude,Longitude,Date GMT,Time GMT,"
          "Sample Measurement,Units of Measure,MDL\n")
# (class, subclass, file id, parameter, unit)
SERIES = [("gasses", "co", "42101", "Carbon monoxide", "ppm"),
          ("gasses", "no2", "42602", "Nitrogen dioxide (NO2)", "ppb"),
          ("gasses", "pm", "88101", "PM2.5", "ug/m3"),
          ("toxics", "voc", "43000", "1,3-Butadiene", "ppbC"),
          ("toxics", "voc2", "43001", "Benzene & co", "ppbC")]
SITES = [("California", "Napa", 38.31012, -122.29642), ("Oregon", "Lane", 44.05211, -123.08675),
         ("Texas", "Harris", 29.76043, -95.36980)]


def write_tree(root, years=(2018, 2019), days=90, seed=0):
    rng = np.random.default_rng(seed)
    for cls, sub, fid, param, unit in SERIES:
        for y in years:
            path = os.path.join(root, cls, sub, f"hourly_{fid}_{y}.csv")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            lines = [HEADER]
            q = (lambda s: f'"{s}"' if "," in s else s)
            for state, county, lat, lon in SITES:
                for d in range(days):
                    day = dt.date(y, 1, 1) + dt.timedelta(days=d)
                    for h in (3, 13):
                        v = 10 + 5 * np.sin(d / 9.0) + rng.normal()
                        lines.append(f"06,{q(param)},{state},{county},{lat},{lon},{day:%Y-%m-%d},{h}:00,"
                                     f"{v:.4f},{unit},0.1\n")
            with open(path, "w") as f:
                f.write("".join(lines))


def write_prices(path, years=(2018, 2019), days=90, header=True, seed=1):
    rng = np.random.default_rng(seed)
    lines = ["Date,Price\n"] if header else []
    for y in years:
        for d in range(days):
            day = dt.date(y, 1, 1) + dt.timedelta(days=d)
            if day.weekday() < 5:
                lines.append(f"{day:%Y%m%d},{60 + 3 * np.cos(d / 7.0) + rng.normal():.2f}\n")
    with open(path, "w") as f:
        f.write("".join(lines))
