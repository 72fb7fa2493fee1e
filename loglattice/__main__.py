"""``python -m loglattice QUERY``: a query over a file, or over standard input, as text."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile
from collections.abc import Iterator

from .errors import QueryError
from .plans import nodes as n
from .plans import planner
from .plans.grammar import Parser


def row_by_row(engine, query: str) -> bool:
    """Whether each line's result depends on that line alone, so that it can be shown before there are more."""
    ops = planner.spliced(Parser(query, engine.aliases).query().operators, engine.aliases)
    return not any(isinstance(op, (n.Aggregate, n.Sort, n.Total, n.Limit)) for op in ops)


def batches(fd: int, most: int = 1 << 22) -> Iterator[list[str]]:
    """The lines that have arrived, as soon as there are some."""
    rest = b""
    while data := os.read(fd, most):
        *lines, rest = (rest + data).split(b"\n")
        if lines:
            yield [x.decode("utf-8", "replace") for x in lines]
    if rest:
        yield [rest.decode("utf-8", "replace")]


def tell(result) -> None:
    """Why rows were dropped."""
    for row in result.errors().toLocalIterator():
        print(f"error: {row['error']}", file=sys.stderr)


def told(results, rows) -> Iterator:
    for result in results:
        yield from rows(result)
        tell(result)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loglattice", description="Search and aggregate log lines.")
    p.add_argument("query")
    p.add_argument("-f", "--file", help="text file; standard input without it")
    p.add_argument("-o", "--output", default=None, help="legacy, json, logfmt or format=TEMPLATE")
    p.add_argument("-m", "--format", default=None, help="the same as -o format=TEMPLATE")
    args = p.parse_args(argv)
    if args.output and args.format:
        p.error("only one of --output and --format can be given")
    mode, _, template = (args.output or (f"format={args.format}" if args.format else "legacy")).partition("=")
    if mode not in ("legacy", "json", "logfmt", "format"):
        p.error(f"unknown output '{mode}'")
    from pyspark.sql import SparkSession

    from .session import Engine
    from .sinks import render

    spark = SparkSession.builder.appName("loglattice").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    try:
        width = shutil.get_terminal_size().columns if sys.stdout.isatty() else None
        if not args.file and row_by_row(engine, args.query):
            results = (engine.query_lines(args.query, batch) for batch in batches(sys.stdin.fileno()))
            for line in render.record_lines(told(results, render.rows), mode, template, width):
                print(line, flush=True)
            return 0
        with tempfile.NamedTemporaryFile(suffix=".log") as held:
            if not args.file:
                shutil.copyfileobj(sys.stdin.buffer, held)
                held.flush()
            result = engine.query_text(args.query, args.file or f"file://{held.name}")
            for line in render.lines(result, mode, template, width):
                print(line)
            tell(result)
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
