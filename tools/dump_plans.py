"""Write the formatted physical plans of selected registered queries to
docs/plans.md (scan pruning, pushed filters, exchanges, broadcasts).

usage: python tools/dump_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["tlcc_price", "tlcc_by_site", "tlcc_calendar", "pivot_mean", "cost_score", "deseason_monthly",
           "zscore_maxabs_chain", "ema_span3"]


def summary(plan: str) -> str:
    ops = re.findall(r"^\(\d+\) (\w+)", plan, flags=re.M)
    keep = [o for o in ops if o in ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
                                     "ShuffledHashJoin", "BroadcastNestedLoopJoin", "Window", "HashAggregate",
                                     "Generate", "Expand", "FlatMapGroupsInPandas", "Sort")]
    counts = {k: keep.count(k) for k in dict.fromkeys(keep)}
    return ", ".join(f"{k} x{v}" for k, v in counts.items())


def main() -> None:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or DEFAULT
    from lagscope.plans.catalog import QUERIES
    from lagscope.session import build_session

    import json
    import tempfile
    import time

    evdir = tempfile.mkdtemp(prefix="lagscope-events-")
    spark = build_session(extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + evdir})
    out = ["# Physical plans of selected queries", "",
           f"Generated by `tools/dump_plans.py` on `{sf}` (AQE initial plans; "
           "AQE may still switch joins at runtime from measured sizes).", "",
           "Statistics are scalar subqueries; the static plan prints one copy of the input pipeline per "
           "reference, but at runtime Catalyst merges them into one aggregate and reuses the input "
           "exchanges.  The *records read* line is measured from the event log while the query runs: "
           "it equals the table sizes when every table is scanned once.", ""]
    windows = {}
    for name in names:
        t0 = int(time.time() * 1000)
        QUERIES[name](spark, sf).toArrow()
        windows[name] = (t0, int(time.time() * 1000))
    spark.stop()
    records = {n: 0 for n in names}
    import glob

    import zstandard

    for f in glob.glob(evdir + "/*/events_*"):
        raw = open(f, "rb").read()
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode() if f.endswith(".zstd") else raw.decode()
        for line in text.splitlines():
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                t = e["Task Info"]["Launch Time"]
                for n, (a, b) in windows.items():
                    if a <= t <= b:
                        records[n] += e["Task Metrics"]["Input Metrics"]["Records Read"]
    spark = build_session()
    for name in names:
        df = QUERIES[name](spark, sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        plan = buf.getvalue()
        scans = re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/(\w+)\.parquet\]", plan)
        pushed = re.findall(r"PushedFilters: (\[.*\])", plan)
        schemas = re.findall(r"ReadSchema: (struct<.*>)", plan)
        out += [f"## {name}", "", f"- operators (static plan): {summary(plan)}",
                f"- records read at runtime: {records[name]:,}",
                f"- distinct scans: {', '.join(dict.fromkeys(scans))}"]
        seen = set()
        for t, sch, p in zip(scans, schemas, pushed):
            if (t, sch, p) not in seen:
                seen.add((t, sch, p))
                out.append(f"- `{t}` reads `{sch}`; pushed `{p}`")
        main, _, subs = plan.partition("===== Subqueries =====")
        nsub = len(re.findall(r"^Subquery:\d+", subs, flags=re.M))
        out += [f"- statistics subquery references in the static plan: {nsub}" if nsub else "- no subqueries"]
        out += ["", "<details><summary>formatted plan (main query)</summary>", "", "```", main.strip(), "```", "",
                "</details>", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main()
