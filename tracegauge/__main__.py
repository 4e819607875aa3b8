"""Run a registered query: python -m tracegauge QUERY --tables DIR [--out DIR --format parquet] [--dry-run]."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    from tracegauge.plans import catalog

    p = argparse.ArgumentParser(prog="tracegauge", description=__doc__)
    p.add_argument("query", choices=sorted(catalog.queries()), metavar="QUERY", help=", ".join(sorted(catalog.queries())))
    p.add_argument("--tables", required=True, help="folder of the Parquet tables")
    p.add_argument("--out", help="folder for the result (else the first rows are shown)")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--rows", type=int, default=20, help="rows shown without --out")
    p.add_argument("--dry-run", action="store_true", help="print the plan only")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"tracegauge {a.query}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = catalog.queries()[a.query](spark, a.tables)
    if a.dry_run:
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").format(a.format).save(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
