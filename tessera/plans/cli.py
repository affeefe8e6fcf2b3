"""Command line: list detectors, run a registered query, check a submission.

    python -m tessera.plans.cli list
    python -m tessera.plans.cli query ap_pooled --data /data/sf0.1 --out /tmp/result
    python -m tessera.plans.cli check submission.csv
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Mapping


def merged(*layers: Mapping) -> dict:
    """Settings by precedence: the first layer that sets a value wins; unset values are dropped."""
    out: dict = {}
    for layer in reversed(layers):
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def load_settings(path: str | None) -> dict:
    """A JSON file of settings; its top level must be a mapping."""
    if not path:
        return {}
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    if not isinstance(held, dict):
        raise ValueError(f"{path} must hold a mapping")
    return held


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="detectors and queries")
    query = commands.add_parser("query", help="run a registered query")
    query.add_argument("name")
    query.add_argument("--data")
    query.add_argument("--out")
    query.add_argument("--config")
    check = commands.add_parser("check", help="check a submission; exit code 1 on an error")
    check.add_argument("path")
    check.add_argument("--sample", type=int, default=400)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from tessera.plans import registry
    from tessera.plans.detectors import list_detectors

    if args.command == "list":
        sys.stdout.write("\n".join([*list_detectors(), *sorted(registry.QUERIES)]) + "\n")
        return 0
    from pyspark.sql import SparkSession

    from tessera.ship import ship

    spark = ship(SparkSession.builder.getOrCreate())
    if args.command == "query":
        settings = merged({"data": args.data, "out": args.out}, load_settings(args.config), {"data": os.environ.get("TESSERA_DATA")})
        out = registry.QUERIES[args.name](spark, settings["data"])
        if "out" in settings:
            out.write.mode("overwrite").parquet(settings["out"])
        else:
            out.show(20, truncate=False)
        return 0
    from tessera.operators.priors import check_submission
    from tessera.sources.predictions import read_submission

    found = check_submission(read_submission(spark, args.path), sample=args.sample).collect()
    for row in found:
        sys.stdout.write(f"{row['level']}: {row['message']}\n")
    return int(any(row["level"] == "error" for row in found))


if __name__ == "__main__":
    sys.exit(main())
