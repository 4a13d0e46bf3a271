"""Command line for the analysis jobs (for ``spark-submit`` or ``python -m``).

    python -m lagscope autocorrelation --root R [--scenario S] [--lags ...] --out O
    python -m lagscope price-correlation --root R --price P [--scenario S] [--lags ...] --out O
    python -m lagscope cost-scores --root R --price P [--year Y] [--lag L] --out O
    python -m lagscope heatmap --root R [--year Y] [--factor F] --out O
    python -m lagscope profile --root R --years Y [Y ...] --out O
    python -m lagscope ingest --root R --out O [--checkpoint C]

Results are written (Parquet for correlations, single CSV for scores and
heat maps, Parquet per profile table); the session comes from
``SparkSession.builder`` so cluster settings apply.
"""

from __future__ import annotations

import argparse
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lagscope")
    sub = p.add_subparsers(dest="job", required=True)

    def common(s, price=False):
        s.add_argument("--root", required=True, help="measurement landing root (<root>/<class>/<subclass>/*.csv)")
        if price:
            s.add_argument("--price", required=True, help="daily price CSV (yyyyMMdd, price)")
            s.add_argument("--no-header", action="store_true", help="the price file has no header row")
        s.add_argument("--out", required=True)
        s.add_argument("--store", help="folder for materialised scenarios")

    a = sub.add_parser("autocorrelation")
    common(a)
    a.add_argument("--scenario", default="gasses_2014_2019")
    a.add_argument("--lags", type=int, nargs="+")
    a.add_argument("--format", choices=["parquet", "csv", "text"], default="parquet")
    c = sub.add_parser("price-correlation")
    common(c, price=True)
    c.add_argument("--scenario", default="gasses_2019")
    c.add_argument("--lags", type=int, nargs="+")
    c.add_argument("--format", choices=["parquet", "csv", "text"], default="parquet")
    s = sub.add_parser("cost-scores")
    common(s, price=True)
    s.add_argument("--year", type=int, default=2019)
    s.add_argument("--lag", type=int, default=10)
    s.add_argument("--latest-priced", action="store_true")
    h = sub.add_parser("heatmap")
    common(h)
    h.add_argument("--year", type=int, default=2019)
    h.add_argument("--factor", type=float, default=10.0)
    h.add_argument("--scenario", default="gasses_2014_2019_site")
    f = sub.add_parser("profile")
    common(f)
    f.add_argument("--years", type=int, nargs="+", required=True)
    f.add_argument("--classes", nargs="+", default=["gasses/*"])
    i = sub.add_parser("ingest")
    i.add_argument("--root", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--checkpoint", required=True, help="lasting shared folder, the same for every run into --out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from lagscope.plans import jobs

    spark = SparkSession.builder.appName(f"lagscope-{args.job}").getOrCreate()
    if args.job == "autocorrelation":
        kw = {"lags": args.lags} if args.lags else {}
        jobs.autocorrelation(spark, args.root, args.scenario, store=args.store, out=args.out, fmt=args.format,
                             **kw)
    elif args.job == "price-correlation":
        kw = {"lags": args.lags} if args.lags else {}
        jobs.price_correlation(spark, args.root, args.price, args.scenario, store=args.store, out=args.out,
                               price_header=not args.no_header, fmt=args.format, **kw)
    elif args.job == "cost-scores":
        jobs.cost_scores(spark, args.root, args.price, year=args.year, lag=args.lag, out=args.out,
                         latest_priced=args.latest_priced, price_header=not args.no_header)
    elif args.job == "heatmap":
        jobs.heatmap(spark, args.root, year=args.year, factor=args.factor, scenario=args.scenario,
                     store=args.store, out=args.out)
    elif args.job == "profile":
        for name, df in jobs.profile_dataset(spark, args.root, args.years, args.classes).items():
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
    elif args.job == "ingest":
        from lagscope.streaming.ingest import ingest

        ingest(spark, args.root, args.out, checkpoint=args.checkpoint).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
