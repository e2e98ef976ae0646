"""python -m tracequarry: list the queries, run one over a folder of tables, print its plan, or look at the settings."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from tracequarry import config


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracequarry")
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--data", help="folder of the Parquet tables")
    parser.add_argument("--master")
    sub = parser.add_subparsers(dest="what", required=True)
    sub.add_parser("queries", help="names of all queries")
    sub.add_parser("settings", help="settings in effect, as JSON")
    for name, told in (("run", "a query's rows"), ("plan", "a query's physical plan"), ("sql", "a query's SQL")):
        one = sub.add_parser(name, help=told)
        one.add_argument("query")
        if name == "run":
            one.add_argument("--rows", type=int, default=20, help="rows to print")
            one.add_argument("--out", help="write all rows there as Parquet instead")
    args = parser.parse_args(argv)
    settings = config.load(args.config, {"data": args.data, "master": args.master})
    if args.what == "settings":
        print(json.dumps(asdict(settings), indent=1))
        return
    from tracequarry.plans import lookups, manual, registry, reports, rules, stores  # noqa: F401  the others add their queries to the registry

    if args.what == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return
    if args.query not in registry.QUERIES:
        parser.error(f"no query {args.query}")
    if args.what == "sql":
        print(registry.ORACLES.get(args.query, "none"))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(settings.master).config("spark.sql.shuffle.partitions", settings.shuffle_partitions).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if settings.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(settings.checkpoint_dir)
    rows = registry.QUERIES[args.query](spark, settings.data)
    if args.what == "plan":
        rows.explain("formatted")
    elif args.out:
        rows.write.parquet(args.out)
    else:
        rows.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
