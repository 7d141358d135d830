"""The command line: `python -m tessera --store file:///data/store <command>`."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tessera.config import DEFAULT_DATABASE
from tessera.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="An associative memory on Spark.")
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--database", default=DEFAULT_DATABASE)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest", help="read all files under a folder")
    c.add_argument("folder")
    c.add_argument("--tags", default="")
    c.add_argument("--strategy", default="token", choices=("token", "fast", "llm"))
    c.add_argument("--defer-graph", action="store_true")
    c = sub.add_parser("watch", help="read new and changed files, once or again and again")
    c.add_argument("folder")
    c.add_argument("--every", type=float, default=0, help="seconds between looks; 0 looks once")
    c = sub.add_parser("retrieve", help="ranked chunks of a text")
    c.add_argument("text")
    c.add_argument("--top", type=int, default=10)
    c.add_argument("--hops", type=int, default=2)
    c.add_argument("--relationship", action="append")
    c = sub.add_parser("query", help="an answer with its evidence")
    c.add_argument("text")
    c = sub.add_parser("overview", help="a spoken overview")
    c.add_argument("text")
    c.add_argument("--form", default="dialogue", choices=("dialogue", "interview", "monologue"))
    for name, about in (("consolidate", "everything once"), ("worker", "what is due"), ("stats", "counts"), ("databases", "all databases"), ("benchmark", "the fixed queries"), ("compact", "tables without additions")):
        sub.add_parser(name, help=about)
    for name in ("create-database", "delete-database"):
        sub.add_parser(name).add_argument("name")
    c = sub.add_parser("serve", help="HTTP with JSON")
    c.add_argument("--port", type=int, default=8080)
    return p


def plain(value: object) -> object:
    return [r.asDict(recursive=True) for r in value.collect()] if isinstance(value, DataFrame) else value


def run(e: Engine, a: argparse.Namespace) -> object:
    """The result of one command, ready for JSON."""
    db = a.database
    commands = {
        "ingest": lambda: e.ingest(a.folder, db, strategy=a.strategy, tags=a.tags, defer_graph=a.defer_graph),
        "watch": lambda: e.watch(a.folder, db, a.every),
        "retrieve": lambda: e.retrieve([a.text], db, a.top, a.hops, a.relationship),
        "query": lambda: e.query_answer(a.text, db),
        "overview": lambda: {k: v for k, v in e.audio_overview(a.text, db, a.form).items() if k != "sound"},
        "consolidate": lambda: e.consolidate(db),
        "worker": lambda: e.run_due(db),
        "stats": e.stats,
        "databases": e.list_databases,
        "benchmark": lambda: e.benchmark(db),
        "compact": e.compact,
        "create-database": lambda: e.create_database(a.name),
        "delete-database": lambda: e.delete_database(a.name),
    }
    return plain(commands[a.command]())


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    if spark is None:
        spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.store)
    if a.command == "serve":
        from tessera.server import serve

        serve(e, a.port).serve_forever()
        return 0
    try:
        print(json.dumps(run(e, a), default=str, ensure_ascii=False))
    except (ValueError, LookupError) as x:
        print(json.dumps({"error": str(x)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
