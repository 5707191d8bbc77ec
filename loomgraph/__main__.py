"""Command line over a stored graph: ``python -m loomgraph ROOT COMMAND [ARGUMENT ...]``.

Every public method of the facade is a command. Answers are JSON, one row a line, or with ``--page`` one envelope; texts
that no method or unit has are errors with status 2.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import bounded
from .query import GraphQuery


def commands() -> dict[str, inspect.Signature]:
    return {n.replace("_", "-"): inspect.signature(f) for n, f in inspect.getmembers(GraphQuery, inspect.isfunction) if not n.startswith("_")}


def argument(text: str):
    """Numbers and lists as such, all else as text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def answer(spark: SparkSession, root: str, command: str, arguments: list[str], page: int | None = None, offset: int = 0) -> list[str]:
    """The lines that a command prints."""
    if command not in commands():
        raise ValueError(f"no command {command}; one of {', '.join(commands())}")
    got = getattr(GraphQuery.open(spark, root), command.replace("-", "_"))(*map(argument, arguments))
    if not isinstance(got, DataFrame):
        return [json.dumps(got)]
    if page is None:
        return [r["json"] for r in bounded.as_json(got).toLocalIterator()]
    return [r["json"] for r in bounded.as_json(bounded.envelope(got, sorted(got.columns), page, offset)).collect()]


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command")
    parser.add_argument("arguments", nargs="*")
    parser.add_argument("--page", type=int)
    parser.add_argument("--offset", type=int, default=0)
    a = parser.parse_args(argv)
    try:
        for line in answer(SparkSession.builder.getOrCreate(), a.root, a.command, a.arguments, a.page, a.offset):
            print(line)
    except (TypeError, ValueError) as wrong:
        print(wrong, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
