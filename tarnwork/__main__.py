"""Command line for the core's queries: `python -m tarnwork QUERY DIRECTORY [--out FOLDER | --limit N]`, or `--list`."""

from __future__ import annotations

import argparse
import sys

from tarnwork.plans.catalog import collect
from tarnwork.runtime import session


def main(arguments: list[str]) -> int:
    """Exit status 0 when the query ran, 2 when it can't."""
    parser = argparse.ArgumentParser(prog="tarnwork")
    parser.add_argument("query", nargs="?")
    parser.add_argument("directory", nargs="?")
    parser.add_argument("--list", action="store_true", help="name all queries")
    parser.add_argument("--out", help="write the result as parquet instead of showing it")
    parser.add_argument("--limit", type=int, default=20, help="rows to show")
    options = parser.parse_args(arguments)
    queries, _ = collect()
    if options.list or not options.query:
        print("\n".join(sorted(queries)))
        return 0
    if options.query not in queries or not options.directory:
        print(f"no such query: {options.query}" if options.query not in queries else "a directory is needed", file=sys.stderr)
        return 2
    result = queries[options.query](session(), options.directory)
    if options.out:
        result.write.parquet(options.out)
    else:
        result.show(options.limit, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
