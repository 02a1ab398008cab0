"""Commands: index, status, search, context, impact and map over a stored graph."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import display, search


def _json(df: DataFrame) -> list[str]:
    return [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="graphloom")
    top.add_argument("--store", required=True, help="folder of the graph")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("index")
    c.add_argument("roots", nargs="+")
    c.add_argument("--full", action="store_true", help="start anew")
    commands.add_parser("status")
    c = commands.add_parser("search")
    c.add_argument("query")
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--scope")
    for name, depth in (("context", 3), ("impact", 5)):
        c = commands.add_parser(name)
        c.add_argument("name", help="name of a node")
        c.add_argument("--depth", type=int, default=depth)
        if name == "context":
            c.add_argument("--scope")
    commands.add_parser("map")
    a = top.parse_args(argv)
    engine = Engine(spark or SparkSession.builder.getOrCreate(), a.store)
    if a.command == "index":
        print(*(f"{k}\t{v}" for k, v in engine.index_report(a.roots, full=a.full).items()), sep="\n")
    elif a.command == "status":
        row = engine.status()
        print(*(f"{k}\t{v}" for k, v in row.asDict().items()) if row else ["no graph"], sep="\n")
    elif a.command == "search":
        found = search.search_hybrid(engine.nodes, a.query, limit=a.limit, scope=a.scope, index=engine.full_text)
        print(*("\t".join(map(str, r)) for r in display.listing(found).collect()), sep="\n")
    elif a.command == "context":
        print(*_json(engine.context(engine.named(a.name), a.depth, a.scope).result()))
    elif a.command == "impact":
        nodes, score = engine.blast_radius(engine.named(a.name), a.depth)
        print(*_json(score), *("\t".join(map(str, r)) for r in display.affected_rows(nodes).collect()), sep="\n")
    else:
        print(*_json(engine.feature_map()), sep="\n")


if __name__ == "__main__":
    main()
