"""Command line: list the queries, run one over a folder of tables, show its plan or its SQL.

    python -m quillon list
    python -m quillon run NAME FOLDER [--out PATH] [--rows N]
    python -m quillon explain NAME FOLDER
    python -m quillon sql NAME

``--also MODULE`` before the verb adds the queries of a module.
"""

from __future__ import annotations

import argparse
import importlib

from quillon.plans import catalogue
from quillon.session import reachable, session


def known(also: list[str]) -> tuple[dict, dict]:
    """Queries and their SQL, those of the modules ``also`` included."""
    modules = [*catalogue.modules(), *map(importlib.import_module, also)]
    return {n: q for m in modules for n, q in m.QUERIES.items()}, {n: s for m in modules for n, s in m.ORACLE.items()}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__.splitlines()[0])
    parser.add_argument("--also", action="append", default=[], help="a module with more QUERIES and ORACLE")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list")
    for verb in ("run", "explain", "sql"):
        p = verbs.add_parser(verb)
        p.add_argument("name")
        if verb != "sql":
            p.add_argument("folder")
        if verb == "run":
            p.add_argument("--out"), p.add_argument("--rows", type=int, default=20)
    given = parser.parse_args(arguments)
    queries, sql = known(given.also)
    if given.verb == "list":
        print("\n".join(f"{n}{'' if n in sql else '  (no SQL)'}" for n in sorted(queries)))
        return 0
    if given.name not in queries:
        print(f"no query is named {given.name}")
        return 2
    if given.verb == "sql":
        print(sql.get(given.name, "this query has no SQL"))
        return 0
    df = queries[given.name](reachable(session()), given.folder)
    if given.verb == "explain":
        df.explain("formatted")
    elif given.out:
        df.write.mode("errorifexists").parquet(given.out)
    else:
        df.show(given.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
