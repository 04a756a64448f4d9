"""Command line: scan a folder into an index, query it, report its clones, show its statistics."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from kindred.config import PRESETS, EngineConfig
from kindred.engine import CloneEngine
from kindred.functions import scalars as S
from kindred.operators import clusters as C
from kindred.session import build_session


def compact(rows):
    """Lines like ``97% type-2 path:12``."""
    return rows.select(F.format_string("%.0f%% %s %s", F.col("similarity") * 100, "clone_type", "block_id").alias("line"))


def report_text(summary: dict, kinds: list[dict], form: str) -> str:
    if form == "json":
        return json.dumps({"summary": summary, "types": kinds}, default=str)
    lines = [("Files", summary["files"]), ("Blocks", summary["blocks"]), ("Clone pairs", summary["clone_pairs"]), ("Clusters", summary["clusters"])]
    lines += [(f"{k['clone_type']} blocks", k["blocks"]) for k in kinds]
    if form == "markdown":
        return "\n".join(["| | |", "|-|-|", *(f"| {a} | {b} |" for a, b in lines)])
    if form == "html":
        return "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in lines) + "</table>"
    return "\n".join(f"{a}: {b}" for a, b in lines)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kindred")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--config", help="JSON or TOML file")
    p.add_argument("--preset", choices=sorted(PRESETS))
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("folder")
    scan.add_argument("--output", required=True)
    scan.add_argument("--parser", default="lines", choices=["lines", "syntax"])
    query = sub.add_parser("query")
    query.add_argument("index")
    text = query.add_mutually_exclusive_group(required=True)
    text.add_argument("--code")
    text.add_argument("--file")
    query.add_argument("--language", default="typescript")
    query.add_argument("--limit", type=int, default=10)
    query.add_argument("--threshold", type=float, default=0.85)
    query.add_argument("--format", default="table", choices=["table", "json", "compact"])
    report = sub.add_parser("report")
    report.add_argument("index")
    report.add_argument("--format", default="console", choices=["console", "json", "markdown", "html"])
    report.add_argument("--max-pairs", type=int)
    report.add_argument("--max-percent", type=float)
    stats = sub.add_parser("stats")
    stats.add_argument("index")
    a = p.parse_args(args)

    config = PRESETS[a.preset] if a.preset else EngineConfig.load(a.config) if a.config else EngineConfig()
    spark = build_session(a.master)
    spark.sparkContext.setLogLevel("ERROR")
    engine = CloneEngine(spark, config)
    if a.command == "scan":
        blocks = engine.index_directory(a.folder, a.parser)
        engine.save(a.output)
        print(f"{blocks.select('file_path').distinct().count()} files, {blocks.count()} blocks")
        return 0
    engine.load(a.index)
    if a.command == "query":
        code = a.code if a.code is not None else open(a.file, encoding="utf-8").read()
        found = engine.query(code, a.language, a.limit, a.threshold)
        if a.format == "compact":
            print("\n".join(r.line for r in compact(found).collect()))
        elif a.format == "json":
            print("\n".join(found.toJSON().collect()))
        else:
            found.select("place", "block_id", S.format_percent(F.col("similarity")).alias("similarity"), "clone_type").show(a.limit, truncate=False)
        return 0
    if a.command == "stats":
        print(engine.stats().toJSON().first())
        return 0
    found, _ = engine.clusters(config.summary_similarity)
    summary = C.scan_summary(engine.index.blocks, found)
    print(report_text(summary.first().asDict(), [r.asDict() for r in C.by_type(found).collect()], a.format))
    if a.max_pairs is not None or a.max_percent is not None:
        gate = C.ci_gate(summary, a.max_pairs if a.max_pairs is not None else 1 << 62, a.max_percent if a.max_percent is not None else 100.0).first()
        return 0 if gate.passed else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
