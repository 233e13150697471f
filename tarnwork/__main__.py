"""Command line: ``python -m tarnwork list`` names the registered queries, ``python -m tarnwork run NAME --data DIR`` runs one."""

from __future__ import annotations

import argparse
import sys

from . import plans


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m tarnwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries, and which have SQL")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(plans.QUERIES), metavar="NAME")
    run.add_argument("--data", required=True, help="folder with one Parquet table a name")
    run.add_argument("--out", help="write the rows there instead of showing some; an existing path is an error")
    run.add_argument("--format", choices=("parquet", "json"), default="parquet")
    run.add_argument("--show", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    if given.command == "list":
        for name in sorted(plans.QUERIES):
            print(f"{name}{'' if name in plans.ORACLES else ' (no SQL)'}")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"tarnwork {given.name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = plans.QUERIES[given.name](spark, given.data)
    if given.out:
        found.write.mode("errorifexists").format(given.format).save(given.out)
    else:
        found.show(given.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
