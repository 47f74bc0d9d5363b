"""Command line: init, ingest, search, serve."""

from __future__ import annotations

import argparse
import sys

from .config import Settings
from .engine import MODES, Engine, session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioscope")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="create empty tables")
    take = commands.add_parser("ingest", help="watch the folder of documents")
    take.add_argument("--once", action="store_true", help="take in what is there and end")
    find = commands.add_parser("search", help="answer a question as JSON")
    find.add_argument("--query", required=True)
    find.add_argument("--top-k", type=int, default=3)
    find.add_argument("--mode", choices=MODES, default=MODES[0], help="by vectors, by words or by both")
    find.add_argument("--department", help="chunks of this department alone")
    find.add_argument("--language", help="chunks of this language code alone")
    learn = commands.add_parser("languages", help="learn languages from a table of labelled texts")
    learn.add_argument("--table", required=True, help="Parquet with columns text and lang")
    commands.add_parser("compact", help="put small batches in one")
    serve = commands.add_parser("serve", help="HTTP API")
    serve.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        engine = Engine(session(), Settings.from_environment()).init()
        if args.command == "ingest":
            engine.watch(once=args.once).awaitTermination()
        elif args.command == "search":
            print(engine.search_json(args.query, args.top_k, mode=args.mode, department=args.department, language=args.language))
        elif args.command == "languages":
            engine.learn_languages(engine.spark.read.parquet(args.table))
        elif args.command == "compact":
            engine.compact()
        elif args.command == "serve":
            from .server import serve

            serve(engine, args.port)
    except KeyboardInterrupt:
        return 0
    except Exception as e:
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
