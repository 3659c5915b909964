"""Command line: list and run queries, and check pipelines written in YAML."""

from __future__ import annotations

import argparse
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lorespark")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("--rows", type=int, default=20)
    for name in ("validate", "describe"):
        sub.add_parser(name).add_argument("file")
    sub.add_parser("list-steps")
    sub.add_parser("config").add_argument("files", nargs="+", help="YAML files, later ones over earlier ones")
    given = parser.parse_args(argv)

    from lorespark.plans import dag, load

    queries = load().QUERIES
    if given.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if given.command == "run":
        from pyspark.sql import SparkSession

        queries[given.query](SparkSession.builder.getOrCreate(), given.sf_dir).show(given.rows, truncate=80)
        return 0
    dag._register_operators()
    if given.command == "list-steps":
        print("\n".join(dag.STEPS.names()))
        return 0
    if given.command == "config":
        import yaml

        layers = {name: yaml.safe_load(Path(name).read_text()) or {} for name in given.files}
        for key, (value, source) in sorted(dag.effective(layers).items()):
            print(f"{key} = {value!r}  [{source}]")
        return 0
    pipeline = dag.load(Path(given.file).read_text())
    wrong = pipeline.validate()
    print("\n".join(wrong) if wrong else pipeline.describe() if given.command == "describe" else "valid")
    return int(bool(wrong))


if __name__ == "__main__":
    raise SystemExit(main())
