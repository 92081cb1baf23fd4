"""Run catalogued queries from the command line.

    python -m rowsmith list
    python -m rowsmith run QUERY --tables DIR [--out PATH] [--format parquet|text] [--show N]

``run`` builds the query over the tables in DIR (one Parquet file or folder
per table) and writes the result to PATH (Parquet by default; ``text`` writes
tab-separated lines), or prints the first N rows with ``--show``. The session
comes from ``SparkSession.builder`` (spark-submit settings apply); locally it
defaults to all cores.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rowsmith")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the catalogued queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("--tables", required=True, help="folder holding <table>.parquet for every table")
    run.add_argument("--out", help="output path")
    run.add_argument("--format", choices=("parquet", "text"), default="parquet")
    run.add_argument("--show", type=int, default=0, help="print the first N rows instead of writing")
    a = ap.parse_args(argv)

    from rowsmith.plans.catalog import all_queries
    specs = all_queries()
    if a.cmd == "list":
        for name, spec in sorted(specs.items(), key=lambda kv: kv[1].operator):
            print(f"{spec.operator:4s} {name}")
        return 0

    if a.query not in specs:
        print(f"unknown query {a.query!r}; see `python -m rowsmith list`", file=sys.stderr)
        return 2
    if not a.out and not a.show:
        print("give --out PATH or --show N", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession
    from rowsmith.session import DEFAULT_CONF
    builder = SparkSession.builder.appName(f"rowsmith-{a.query}")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    df = specs[a.query].run(spark, a.tables)
    if a.show:
        df.show(a.show, truncate=False)
    else:
        if a.format == "parquet":
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
                      .alias("line")).write.mode("overwrite").text(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
