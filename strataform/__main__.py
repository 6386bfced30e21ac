"""python -m strataform shape DIRECTORY [--at PATH] [--record-cap N]"""

from __future__ import annotations

import argparse

from .plans.analyze import analyze
from .plans.shape import Policy
from .sources.documents import JsonLines


def main() -> None:
    top = argparse.ArgumentParser(prog="strataform", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    shape = sub.add_parser("shape", help="report on the JSON lines under a directory")
    shape.add_argument("directory")
    shape.add_argument("--glob")
    shape.add_argument("--contains", help="only files whose path holds this")
    shape.add_argument("--at", help="the path of the part to look at")
    shape.add_argument("--record-cap", type=int, default=Policy().record_cap)
    shape.add_argument("--max-docs", type=int)
    args = top.parse_args()
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("strataform").getOrCreate()
    source = JsonLines(args.directory, glob=args.glob, at=args.at, keep=(lambda p: p.contains(args.contains)) if args.contains else None)
    print(analyze(source.read(spark), Policy(record_cap=args.record_cap, max_docs=args.max_docs), source.describe()).report())


if __name__ == "__main__":
    main()
