"""Command line: list the queries, run one over a folder of tables, check payloads.

python -m loomspark.cli queries | query NAME FOLDER [--limit N] [--out PATH] | schemas | validate SCHEMA FILE
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from loomspark.operators.contracts import SCHEMAS, issues
from loomspark.plans.queries import ORACLE_SQL, QUERIES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("folder")
    q.add_argument("--limit", type=int, default=20)
    q.add_argument("--out")
    sub.add_parser("schemas")
    v = sub.add_parser("validate")
    v.add_argument("schema", choices=sorted(SCHEMAS))
    v.add_argument("file")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "queries":
        for name in sorted(QUERIES):
            print(name, "sql" if name in ORACLE_SQL else "")
    elif args.command == "schemas":
        print("\n".join(sorted(SCHEMAS)))
    elif args.command == "validate":
        with open(args.file, encoding="utf-8") as f:
            found = list(issues(json.load(f), SCHEMAS[args.schema]))
        for path, message in found:
            print(path, message)
        return int(bool(found))
    else:
        spark = SparkSession.builder.getOrCreate()
        df = QUERIES[args.name](spark, args.folder)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.limit, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
