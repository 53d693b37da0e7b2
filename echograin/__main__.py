"""``python -m echograin list``, ``python -m echograin run QUERY FOLDER [--out PATH]`` and
``python -m echograin recipe NAME INPUT OUTPUT [--json STEPS]``."""

from __future__ import annotations

import argparse

from .plans import catalog, recipes


def main() -> None:
    parser = argparse.ArgumentParser(prog="echograin")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(catalog.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="Parquet folder to write; without it some rows are shown")
    make = commands.add_parser("recipe", help="runs a named recipe, or steps given as JSON, on a Parquet table of pixels")
    make.add_argument("name", help=f"one of {', '.join(sorted(recipes.RECIPES))}, or json")
    make.add_argument("input")
    make.add_argument("output")
    make.add_argument("--json", default="[]", help='steps such as [{"to_db": {"bands": ["vv"]}}]')
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join([*sorted(catalog.QUERIES), *(f"recipe {name}" for name in sorted(recipes.RECIPES))]))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("echograin").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "recipe":
        steps = recipes.from_json(args.json) if args.name == "json" else recipes.recipe(args.name)
        recipes.run(spark.read.parquet(args.input), steps).write.mode("overwrite").parquet(args.output)
        return
    df = catalog.QUERIES[args.query](spark, args.folder)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show()


if __name__ == "__main__":
    main()
