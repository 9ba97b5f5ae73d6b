"""Run a registered query: ``python -m peerpanel <query> <data_dir> [--out path] [--show n]``.

``--list`` prints the query names.  Results are written as Parquet with ``--out``
(the write is distributed; nothing is collected), otherwise the first rows are shown.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    from .plans.catalog import ORACLE, QUERIES

    ap = argparse.ArgumentParser(prog="python -m peerpanel")
    ap.add_argument("query", nargs="?")
    ap.add_argument("data_dir", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--out", help="write the result as Parquet to this path")
    ap.add_argument("--show", type=int, default=20, help="rows to show when not writing")
    ap.add_argument("--master", default=None, help="Spark master when no session is configured")
    ap.add_argument("--list", action="store_true", help="list the registered queries")
    ap.add_argument("--sql", action="store_true", help="print the query's oracle SQL and exit")
    args = ap.parse_args(argv)
    if args.list or not args.query:
        for name in sorted(QUERIES):
            print(f"{name}{'' if name in ORACLE else '  (model fit, no SQL form)'}")
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; --list shows them", file=sys.stderr)
        return 2
    if args.sql:
        print(ORACLE.get(args.query, "-- no SQL form (model fit)"))
        return 0
    from .session import ensure_checkpoint_dir, get_spark

    spark = get_spark(args.master)
    ensure_checkpoint_dir(spark)
    df = QUERIES[args.query](spark, args.data_dir)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
