"""python -m meshloom list | run NAME [--tables DIR] [--out DIR]: run a registered query."""
from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    from .queries import QUERIES

    a = argparse.ArgumentParser(prog="meshloom", description=__doc__)
    sub = a.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query and show or write its result")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("--tables", default="/root/testdata/sf0.001")
    run.add_argument("--out", help="write Parquet here instead of showing the first rows")
    args = a.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"meshloom {args.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = QUERIES[args.name](spark, args.tables)
    if args.out:
        out.write.mode("overwrite").parquet(args.out)
    else:
        out.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
