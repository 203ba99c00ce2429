"""Command line for the run-once jobs (what the reference's scripts do when run).

    python -m estatelens --listings PATH --format parquet --out DIR [--job all|small|medium|cheapest]
    python -m estatelens --testdata SF_DIR --out DIR

The listings come from any Spark source (``--format jdbc`` with ``--option
key=value`` pairs for url/dbtable/partitioning/credentials) or are derived from
the fixture tables (``--testdata``). ``--as-of`` fixes the run time."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import SparkSession

from estatelens.plans.jobs import run_all, run_cheapest_job, run_movers_job
from estatelens.sources import land_listings, listings_from_testdata, read_listings


def parse(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="estatelens", description=__doc__.splitlines()[0])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--listings", help="path of the listings table (omit for jdbc)", nargs="?", const="")
    src.add_argument("--testdata", help="folder of the fixture tables")
    p.add_argument("--format", default="parquet")
    p.add_argument("--option", action="append", default=[], help="reader option key=value (repeatable)")
    p.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    p.add_argument("--job", choices=["all", "small", "medium", "cheapest"], default="all")
    p.add_argument("--as-of", help="run time, ISO format (default: now)")
    p.add_argument("--land", help="first write the listings as this table, bucketed by id")
    p.add_argument("--buckets", type=int, help="buckets for --land; as many as the data's size asks for")
    args = p.parse_args(argv)
    if args.land and not args.buckets:
        p.error("--land needs --buckets")
    return args


def main(argv=None, spark: SparkSession | None = None) -> dict:
    args = parse(argv)
    # Checkpoints of the report packer go when nothing refers to them any more.
    spark = spark or SparkSession.builder.appName("estatelens").config(
        "spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    if args.testdata:
        listings = listings_from_testdata(spark, args.testdata)
    else:
        options = dict(kv.split("=", 1) for kv in args.option)
        listings = read_listings(spark, args.format, args.listings or None, options)
    if args.land:
        listings = land_listings(listings, args.land, args.buckets)
    as_of = datetime.fromisoformat(args.as_of) if args.as_of else datetime.now()
    if args.job == "all":
        result = run_all(listings, args.out, as_of)
    elif args.job == "cheapest":
        result = run_cheapest_job(listings, args.out, as_of)
    else:
        lo, hi, prefix = (0.0, 40.0, "movers_small") if args.job == "small" else (40.0, 60.0, "movers_medium")
        result = run_movers_job(listings, args.out, as_of, lo, hi, prefix=prefix)
    print(json.dumps(result, default=str))
    return result
