"""Command line: map, set, dot, match, prefix, range, fuzzy, sort. Run as python -m dictspark.cli."""

from __future__ import annotations

import argparse
import logging
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from dictspark.operators import query
from dictspark.operators.dictionary import Dictionary, map_from_lines, set_from_lines
from dictspark.operators.graph import dot_lines
from dictspark.operators.linesort import sort_file
from dictspark.operators.query import Bounds
from dictspark.sources.text import read_lines

log = logging.getLogger("dictspark")


def _between(low: int, high: int):
    def check(text: str) -> int:
        if not low <= (n := int(text)) <= high:
            raise argparse.ArgumentTypeError(f"not from {low} to {high}: {text}")
        return n

    return check


def _without_effect(p: argparse.ArgumentParser, *options: tuple[str, str, int, int]) -> None:
    """Options that are taken for the sake of scripts that give them: caches, threads, files and folders of a sort are Spark's business."""
    p.add_argument("-w", "--work-directory", help="no effect on Spark")
    for short, long, low, high in options:
        p.add_argument(short, long, type=_between(low, high), help="no effect on Spark")


_IDLE = ("work_directory", "cache_size", "thread_count", "split_file_count", "parallel_task_count")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="dictspark", description="Ordered string dictionaries on Spark")
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("map", "build a map from lines key,value"), ("set", "build a set from lines")):
        p = sub.add_parser(name, help=what)
        p.add_argument("-f", "--file", required=True, help="text file or folder")
        p.add_argument("-o", "--out", required=True, help="folder of the dictionary; must not exist")
        p.add_argument("-s", "--sorted", action="store_true", help="the lines are in the order of insertion")
        _without_effect(p, ("-c", "--cache-size", 0, 1 << 40), ("-t", "--thread-count", 1, 32), ("-l", "--split-file-count", 1, 1000), ("-p", "--parallel-task-count", 2, 20))
        p.add_argument("--strict", action="store_true", help="leave out keys that come after a greater one")
    p = sub.add_parser("dot", help="write the minimal transducer as Graphviz text")
    p.add_argument("-f", "--file", required=True, help="dictionary")
    p.add_argument("-o", "--out", required=True, help="text file")
    for name, letter, text in (("match", "-q", "query"), ("prefix", "-p", "prefix"), ("range", "", "")):
        p = sub.add_parser(name)
        p.add_argument("-f", "--file", required=True, help="dictionary")
        if letter:
            p.add_argument(letter, f"--{text}", dest="text", required=True)
        for short, long, dest in (("-s", "--gt", "gt"), ("-a", "--ge", "ge"), ("-e", "--lt", "lt"), ("-b", "--le", "le")):
            p.add_argument(short, long, dest=dest)
    p = sub.add_parser("fuzzy")
    p.add_argument("-f", "--file", required=True, help="dictionary")
    p.add_argument("-z", "--fuzzy", dest="text", required=True)
    p.add_argument("-d", "--distance", type=_between(0, 100), required=True)
    p.add_argument("-l", "--same-prefix", type=_between(0, 1 << 30), default=0, help="first characters that must be equal")
    p.add_argument("-m", "--damerau", action="store_true", help="swapped neighbours are one edit")
    p = sub.add_parser("sort", help="sort lines by their trimmed text")
    p.add_argument("-f", "--file", required=True)
    p.add_argument("-o", "--out", required=True, help="folder; must not exist")
    p.add_argument("-i", "--ignore-empty", action="store_true")
    _without_effect(p, ("-t", "--thread-count", 1, 32), ("-s", "--split-file-count", 1, 1000), ("-p", "--parallel-task-count", 2, 20))
    return top


def _report(rows: DataFrame, began: float) -> int:
    """Prints the rows as they come, one at a time, and gives their number."""
    n = 0
    for row in rows.toLocalIterator():
        print(f"[{row['key']}]->[{row['value']}]" if "value" in row else f"[{row['key']}]")
        n += 1
    log.info("%d results in %.3f s", n, time.time() - began)
    return n


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 on success; 1 if match finds nothing or a DOT file cannot be written."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    spark = spark or SparkSession.builder.appName("dictspark").getOrCreate()
    began = time.time()
    if idle := [name for name in _IDLE if getattr(args, name, None) is not None]:
        log.info("no effect on Spark: %s", ", ".join(idle))
    if args.command in ("map", "set"):
        lines = read_lines(spark, args.file)
        d = (map_from_lines if args.command == "map" else set_from_lines)(lines, args.sorted, args.strict)
        d.save(args.out)
        return 0
    if args.command == "sort":
        sort_file(spark, args.file, args.out, not args.ignore_empty)
        return 0
    d = Dictionary.load(spark, args.file)
    if args.command == "dot":
        try:
            Path(args.out).write_text("\n".join(dot_lines(d)) + "\n", encoding="utf-8")
        except OSError as e:
            log.error("cannot write %s: %s", args.out, e)
            return 1
        return 0
    if args.command == "fuzzy":
        _report(query.fuzzy(d, args.text, args.distance, args.same_prefix, args.damerau), began)
        return 0
    bounds = Bounds(ge=args.ge, gt=args.gt, le=args.le, lt=args.lt)
    if args.command == "match":
        return 0 if _report(query.match(d, args.text, bounds), began) else 1
    _report(query.prefix(d, args.text, bounds) if args.command == "prefix" else query.range_(d, bounds), began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
