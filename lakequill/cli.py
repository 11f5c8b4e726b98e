"""Command line: ``python -m lakequill.cli VERB ...`` over a module that has ``build() -> Model``."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from .model import Model
from .plans import schema


def _model(name: str) -> Model:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function or "build")()


def _folder(args) -> list[str]:
    return sorted(f for f in os.listdir(args.dir) if f.endswith(".json"))


def _context(args):
    from pyspark.sql import SparkSession

    from .sources.context import Context

    return Context(SparkSession.builder.getOrCreate(), _model(args.model), args.root)


def _migrations(args) -> list[schema.Migration]:
    out, before = [], schema.EMPTY
    for name in _folder(args):
        after = schema.load_snapshot(os.path.join(args.dir, name))
        out.append(schema.Migration(name.removesuffix(".json"), schema.diff(before, after), after, before))
        before = after
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lakequill")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("init", "add", "apply", "list", "revert", "script", "ddl", "capabilities", "scaffold"):
        p = verbs.add_parser(verb)
        p.add_argument("--model", help="module[:function] that builds the model")
        p.add_argument("--dir", default="migrations", help="folder of snapshots, one a migration")
        p.add_argument("--root", help="store of tables")
        p.add_argument("--down", action="store_true")
        p.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    if args.verb == "init":
        os.makedirs(args.dir, exist_ok=True)
    elif args.verb == "add":
        known = _folder(args)
        schema.save_snapshot(schema.snapshot(_model(args.model)), os.path.join(args.dir, f"{len(known) + 1:04d}_{args.names[0]}.json"))
    elif args.verb == "list":
        print("\n".join(n.removesuffix(".json") for n in _folder(args)))
    elif args.verb == "script":
        print("\n".join(f"-- {m.id}\n{schema.script(m.changes, args.down)}" for m in _migrations(args)))
    elif args.verb == "ddl":
        print(";\n".join(schema.catalog_ddl(None, _model(args.model))) + ";")
    elif args.verb == "capabilities":
        print(json.dumps(schema.CAPABILITIES, indent=1))
    elif args.verb == "scaffold":
        print(schema.reverse_engineer(_context(args), args.names))
    else:
        migrator = schema.Migrator(_context(args), _migrations(args))
        if args.verb == "apply":
            print("\n".join(migrator.apply_pending()))
        elif args.names:
            print("\n".join(migrator.revert_to(args.names[0])))
        else:
            print(migrator.revert_last() or "nothing to revert")
    return 0


if __name__ == "__main__":
    sys.exit(main())
