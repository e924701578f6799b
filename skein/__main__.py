"""Command line: python -m skein --root FOLDER index PATH... | search TEXT [-k N] [--mode MODE] | read REF [--begin N] [--end N] | drill | status | reindex-graph."""

from __future__ import annotations

import argparse
import sys

from skein import runtime
from skein.session import Engine


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="skein", description="Index markdown files and search them.")
    parser.add_argument("--root", required=True, help="folder of the tables")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("paths", nargs="+")
    index.add_argument("--force", action="store_true", help="index files that have not changed too")
    search = commands.add_parser("search")
    search.add_argument("text")
    search.add_argument("-k", type=int, default=10)
    search.add_argument("--mode", choices=("hybrid", "semantic", "keyword"), default="hybrid")
    read = commands.add_parser("read")
    read.add_argument("ref")
    read.add_argument("--begin", type=int, default=0)
    read.add_argument("--end", type=int)
    for name in ("drill", "status", "reindex-graph"):
        commands.add_parser(name)
    given = parser.parse_args(args)
    spark = runtime.session("skein")
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, given.root)
    if given.command == "index":
        out = engine.index(given.paths, given.force)
    elif given.command == "search":
        out = engine.search(spark.createDataFrame([("q", given.text)], "query_id string, text string"), given.k, given.mode).orderBy("rank")
    elif given.command == "read":
        out = engine.read(given.ref, given.begin, given.end)
    elif given.command == "reindex-graph":
        out = engine.reindex_graph().groupBy("rel_type").count()
    else:
        out = engine.drill() if given.command == "drill" else engine.status()
    for line in out.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
