"""Command line: list and run registered queries, write their results, show their plans.

    python -m docketry list
    python -m docketry run NAME --data DIR [--out DIR] [--limit N]
    python -m docketry explain NAME --data DIR
    python -m docketry validate --data DIR
"""

from __future__ import annotations

import argparse
import importlib
import sys

from docketry.plans import load
from docketry.registry import CORE
from docketry.session import local_session


def registries() -> list:
    load()
    try:  # the subpackage may be absent, or lack a library it needs
        return [CORE, importlib.import_module("docketry.llm.queries").LLM]
    except ImportError:
        return [CORE]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docketry")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for command in ("run", "explain"):
        p = sub.add_parser(command)
        p.add_argument("name")
        p.add_argument("--data", required=True)
        p.add_argument("--out")
        p.add_argument("--limit", type=int, default=20)
        p.add_argument("--cores", default="*")
    p = sub.add_parser("validate")
    p.add_argument("--data", required=True)
    p.add_argument("--cores", default="*")
    a = parser.parse_args(args)
    known = {n: (q, r.operators[n]) for r in registries() for n, q in r.queries.items()}
    if a.command == "list":
        for name, (_, operators) in sorted(known.items()):
            print(f"{name}  {' '.join(operators)}")
        return 0
    name = "graph_violations" if a.command == "validate" else a.name
    if name not in known:
        print(f"no query {name}", file=sys.stderr)
        return 2
    spark = local_session(cores=a.cores)
    df = known[name][0](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif a.command == "validate":
        rows = df.collect()
        for r in rows:
            print(*r)
        return int(any(r.severity == "error" for r in rows))
    elif a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(a.limit, truncate=False)
    return 0
