"""``python -m archivolt.cli COMMAND``: the engine's stages and questions from a shell."""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from .config import load, load_questions
from .engine import Engine
from .session import build_session

STAGES = ("scan", "extract", "enrich", "bundle", "validate", "index", "drain")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="archivolt")
    parser.add_argument("--config", help="a TOML file of settings")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in (*STAGES, "report", "graph", "review"):
        commands.add_parser(name)
    commands.choices["scan"].add_argument("--no-hash", action="store_true", help="only look, do not hash")
    commands.choices["enrich"].add_argument("-n", type=int, help="records at most, the newest files first")
    commands.choices["drain"].add_argument("-n", type=int, help="records at most")
    commands.choices["drain"].add_argument("--budget", type=float, help="seconds after which no more records are begun")
    commands.add_parser("eval").add_argument("questions", help="a TOML file of questions")
    commands.add_parser("search").add_argument("text", nargs="+")
    commands.add_parser("concept").add_argument("id")
    walk = commands.add_parser("traverse")
    walk.add_argument("id")
    walk.add_argument("--hops", type=int, default=1)
    commands.add_parser("cypher").add_argument("text")
    args = parser.parse_args(argv)
    try:
        config = load(args.config)
    except (OSError, ValueError) as e:
        print(f"settings: {e}", file=sys.stderr)
        return 2
    engine = Engine(build_session(), config)
    run_id = uuid.uuid4().hex[:12]
    if args.command == "scan":
        out = engine.scan(run_id, not args.no_hash)
    elif args.command == "drain":
        out = engine.drain(run_id, args.n, args.budget)
    elif args.command == "enrich":
        out = engine.enrich(limit=args.n)
    elif args.command == "report":
        for name, rows in engine.report().items():
            print(name)
            rows.show(50, truncate=False)
        return 0
    elif args.command == "graph":
        tables = engine.graph_tables()
        out = {name: t[0].count() for name, t in {**tables.nodes, **tables.edges}.items()}
    elif args.command == "review":
        print(engine.entity_review())
        return 0
    elif args.command == "eval":
        out = engine.evaluate(load_questions(args.questions))
    elif args.command in STAGES:
        out = getattr(engine, args.command)()
    elif args.command == "search":
        out = engine.search_knowledge(" ".join(args.text))
    elif args.command == "concept":
        out = engine.get_concept(args.id)
    elif args.command == "traverse":
        out = engine.traverse(args.id, args.hops)
    else:
        out = engine.cypher(args.text)
    if isinstance(out, dict):
        print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    elif out is not None:
        out.show(200, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
