"""Command line: digests of request bodies, and the ranking of slow logs.

    python -m shapeloom [--json | --hash] [--explain] [--ndjson] [-i INDEX] FILE...
    python -m shapeloom slowlog [-p PHASE] [-s SORT] [-t TOP] [--json] FILE...
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import TextIO

from .functions.request import InvalidRequest, digest
from .operators.rank import PHASES, SORTS
from .options import INDEX_MODES, LEVELS, InvalidOption, Options

OK, INVALID, USAGE = 0, 1, 2


def _number(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise argparse.ArgumentTypeError(f"a number, not {text!r}")
    return int(text)


def _cap(text: str) -> int | None:
    return None if text == "none" else _number(text)


def _shared(p: argparse.ArgumentParser) -> None:
    p.add_argument("-n", "--normalization", choices=LEVELS, default="values")
    for name, default in (("clauses", 12), ("values", 5), ("length", 512)):
        p.add_argument(f"--max-{name}", type=_cap, default=default, metavar="N|none")
    p.add_argument("--hash-version", default="q4")
    p.add_argument("--hash-length", type=_number, default=12)
    p.add_argument("--agg-names", action="store_true")
    p.add_argument("--raw-index", action="store_true")
    p.add_argument("files", nargs="*", default=["-"])


def _options(a: argparse.Namespace) -> Options:
    return Options(a.normalization, a.max_clauses, a.max_values, a.max_length, INDEX_MODES[a.raw_index], a.agg_names, a.hash_version, a.hash_length)


def _text(name: str, stdin: TextIO) -> str:
    if name == "-":
        return stdin.read()
    with open(name, encoding="utf-8", newline="") as f:
        return f.read()


def _shown(found: dict, a: argparse.Namespace) -> str:
    if a.json:
        return json.dumps(found, ensure_ascii=False, indent=None if a.ndjson else 4)
    if a.hash:
        return found["hash"]
    if a.ndjson:
        return f"{found['hash']}\t{found['q']}"
    lines = [found["q"], f"  sig   {found['sig']}", f"  hash  {found['hash']}"]
    for rule in found.get("rules") or []:
        times = f" x{rule['count']}" if rule["count"] > 1 else ""
        lines.append(f"  {rule['rule']}{times}{' [' + ', '.join(rule['on']) + ']' if rule['on'] else ''}: {rule['why']}")
    return "\n".join(lines)


def _bodies(argv: list[str], stdin: TextIO, out: TextIO, err: TextIO) -> int:
    p = argparse.ArgumentParser("shapeloom")
    p.add_argument("-i", "--index")
    p.add_argument("-e", "--explain", action="store_true")
    how = p.add_mutually_exclusive_group()
    how.add_argument("-j", "--json", action="store_true")
    how.add_argument("--hash", action="store_true")
    p.add_argument("--ndjson", action="store_true")
    p.add_argument("-V", "--version", action="version", version="shapeloom 0.1")
    _shared(p)
    a = p.parse_args(argv)
    if a.ndjson and a.explain and not a.json:
        p.error("--ndjson --explain needs --json")
    options, failed = _options(a), 0
    for name in a.files:
        try:
            text = _text(name, stdin)
        except OSError as e:
            print(f"shapeloom: {e}", file=err)
            return USAGE
        for number, body in enumerate(text.split("\n") if a.ndjson else [text], 1):
            if a.ndjson and not body.strip():
                continue
            try:
                print(_shown(digest(body, a.index, options, a.explain), a), file=out)
            except InvalidRequest as e:
                failed += 1
                print(f"shapeloom: {name}{f' line {number}' if a.ndjson else ''}: {e}", file=err)
    return INVALID if failed else OK


def _slowlog(argv: list[str], stdin: TextIO, out: TextIO, err: TextIO) -> int:
    from functools import reduce

    from pyspark import StorageLevel
    from pyspark.sql import DataFrame, SparkSession

    from .operators import report
    from .operators.rank import counted, failures, ranked, read_records, readable, shapes
    from .sources import slowlog

    p = argparse.ArgumentParser("shapeloom slowlog")
    p.add_argument("-p", "--phase", choices=PHASES, default="query")
    p.add_argument("-s", "--sort", choices=list(SORTS), default="total")
    p.add_argument("-t", "--top", type=_cap, default=20, metavar="N|none")
    p.add_argument("-j", "--json", action="store_true")
    _shared(p)
    a = p.parse_args(argv)
    options = _options(a)
    spark = SparkSession.builder.getOrCreate()
    for name in a.files:
        if name != "-" and "://" not in name and not os.path.exists(name):
            print(f"shapeloom slowlog: can't read {name}", file=err)
            return USAGE
    files = [f for f in a.files if f != "-"]
    parts = [slowlog.read(spark, files)] if files else []
    parts += [slowlog.of_lines(spark, stdin)] if "-" in a.files else []
    # lines are parsed and digested once; what doesn't fit into memory is kept on disk
    read = read_records(reduce(DataFrame.unionByName, parts), a.phase, options).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = counted(read)
        if counts.failed:
            for r in slowlog.numbered(read, failures(read)).toLocalIterator():
                print(f"shapeloom slowlog: {r['file']} line {r['number']}: {r['error']}", file=err)
        if not counts.shapes:
            print(f"shapeloom slowlog: no search record in {report.plural(counts.lines, 'line')}", file=err)
            return INVALID
        rows = [r.asDict() for r in ranked(readable(shapes(read, "place")), a.sort, a.top).collect()]
    finally:
        read.unpersist()
    print(report.as_json(rows) if a.json else report.heading(counts) + report.table(rows, a.sort) + report.footer(counts.shapes, len(rows)), file=out, end="\n" if a.json else "")
    return INVALID if counts.failed else OK


def main(argv: list[str] | None = None, stdin: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    try:
        return _slowlog(argv[1:], stdin, out, err) if argv[:1] == ["slowlog"] else _bodies(argv, stdin, out, err)
    except InvalidOption as e:
        print(f"shapeloom: {e}", file=err)
        return USAGE


