"""Command line: scan, report, hotspots, explain."""

from __future__ import annotations

import argparse
import os
import sys

from scopelake import report
from scopelake.engine import DEPRIORITIZED, Engine
from scopelake.functions.catalogue import PROFILES, unit_profile
from scopelake.operators.rank import PRIORITIES
from scopelake.sources.trees import repository_root


# The names of commands and options.
def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scopelake")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("path", nargs="?")
    scan = sub.add_parser("scan", parents=[common])
    scan.add_argument("--out", default="tree.json")
    scan.add_argument("--format", choices=["json", "jsonl"], default="json")
    r = sub.add_parser("report", parents=[common])
    r.add_argument("--out", default=".scopelake")
    r.add_argument("--limit", type=int, default=50)
    r.add_argument("--profile", choices=sorted(PROFILES), default="general")
    r.add_argument("--format", choices=["json", "markdown", "both"], default="both")
    r.add_argument("--focus-path", action="append", default=[])
    r.add_argument("--deprioritize-path", action="append", default=[])
    r.add_argument("--no-default-deprioritize", action="store_true")
    r.add_argument("--fail-on", choices=["none", *PRIORITIES], default="none")
    r.add_argument("--tree-depth", type=int, default=3)
    r.add_argument("--tree-top", type=int, default=6)
    r.add_argument("--compact", action="store_true")
    r.add_argument("--include-tree", action="store_true")
    r.add_argument("--include-dependencies", action="store_true")
    h = sub.add_parser("hotspots", parents=[common])
    h.add_argument("--metric", action="append")
    h.add_argument("--limit", type=int, default=25)
    h.add_argument("--format", choices=["markdown", "json"], default="markdown")
    e = sub.add_parser("explain", parents=[common])
    e.add_argument("--file", required=True)
    e.add_argument("--format", choices=["markdown", "json"], default="markdown")
    return p


def shown(rows: list[dict], form: str) -> str:
    if form == "json":
        return report.dumps({"rankings": rows})
    return "\n".join(["| Rank | Score | Path | Why |", "| --- | --- | --- | --- |", *(f"| {r['rank']} | {r['score']} | `{report.location(r)}` | {r['reason']} |" for r in rows)]) + "\n"


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "scan" and a.format == "jsonl":
        print("jsonl is reserved", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("scopelake").getOrCreate()
    engine = Engine(spark, a.path or repository_root("."))
    if a.command == "scan":
        if a.out == "-":
            print(report.dumps(report.tree_json(engine)), end="")
        else:
            report.write_tree(engine, os.path.abspath(a.out))
        return 0
    if a.command == "report":
        low = ([] if a.no_default_deprioritize else DEPRIORITIZED) + a.deprioritize_path
        how = {"profile": a.profile, "limit": a.limit, "depth": a.tree_depth, "top": a.tree_top, "focus": a.focus_path, "deprioritized": low, "compact": a.compact, "include_tree": a.include_tree, "include_dependencies": a.include_dependencies}
        if a.out == "-":
            made = report.payload(engine, **how)
            print(report.dumps(made), end="")
            found = made["findings.json"]["findings"]
        else:
            report.write_report(engine, a.out, a.format, **how)
            found = [r.asDict() for r in engine.findings(a.limit, weights=a.profile, focus=a.focus_path, deprioritized=low).select("priority").collect()]
        return int(a.fail_on != "none" and any(PRIORITIES.index(f["priority"]) >= PRIORITIES.index(a.fail_on) for f in found))
    if a.command == "hotspots":
        weights = unit_profile(a.metric) if a.metric else "general"
        rows = engine.hotspots(a.limit, weights=weights)
    else:
        rows = engine.explain(a.file)
    print(shown([report.plain(r) for r in rows.collect()], a.format), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
