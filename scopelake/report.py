"""Reports: the small, limited results of the engine as files or one JSON text."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import functions as F

from scopelake import sinks
from scopelake.engine import DEPRIORITIZED, Engine
from scopelake.functions.catalogue import METRICS, PROFILES
from scopelake.functions.storage import new_folder

TITLES = {
    "tsx": "Rendering complexity gathered in one place",
    "typing": "Type safety given up",
    "coupling": "Many imports",
    "docs": "Large embedded data in a document",
    "python": "Python module with many ties",
    "maintainability": "Open markers in a hotspot",
    "size": "Large unit",
    "complexity": "Dense control flow",
}
ACTIONS = {
    "tsx": "Look for parts that only render and for state that can move out; keep behaviour under UI tests.",
    "typing": "Replace any and ignore directives by exact types where the value is known.",
    "coupling": "See which imports can be turned round, made local or dropped.",
    "docs": "Move embedded data to files of their own.",
    "python": "Look at what the module is responsible for before changing its imports.",
    "maintainability": "Settle each marker: do it, file it or delete it.",
    "size": "Look for parts that can be separated under existing tests.",
    "complexity": "Follow the control flow and simplify what tests cover.",
}
#: For components in a file of markup.
TSX_ACTION = "Take out children that only render, dialogs, hooks of actions and derived values; then run the type check and the tests of that screen."
# Of each artifact its name, the order it is read in, and how much of it an agent should load.
ARTIFACTS = {
    "manifest.json": ("manifest", 1, "full"),
    "report.md": ("report", 1, "full"),
    "findings.top.json": ("findings_top", 2, "full"),
    "action-plan.md": ("action_plan", 3, "full"),
    "tree.summary.json": ("tree_summary", 4, "full"),
    "findings.json": ("findings", 5, "top_n"),
    "hotspots.json": ("hotspots", 6, "top_n"),
    "metrics.schema.json": ("metrics_schema", 7, "reference"),
    "dependencies.json": ("dependencies", 8, "top_n"),
    "tree.json": ("tree", 9, "avoid_full_load"),
    "agent-skill.md": ("agent_skill", 10, "reference"),
}


def action(f: dict) -> str:
    """What to do first about a finding; markup has an action of its own."""
    markup = f["path"].endswith(".tsx") or ("::" in f["path"] and ".tsx" in f["path"])
    return TSX_ACTION if f["category"] == "tsx" and markup else ACTIONS[f["category"]]


def agent_prompt(category: str) -> str:
    return f"Look into this {category} finding: take its numbers as a hint, read the source and its tests, then propose or make the smallest change that keeps behaviour."


def dumps(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def number(x):
    """Whole numbers without a point, others to 4 places."""
    return int(x) if isinstance(x, float) and x.is_integer() else round(x, 4) if isinstance(x, float) else x


def plain(row) -> dict:
    def of(x):
        if hasattr(x, "asDict"):
            return {k: of(v) for k, v in x.asDict().items()}
        if isinstance(x, dict):
            return {k: of(v) for k, v in x.items()}
        return [of(y) for y in x] if isinstance(x, list) else number(x)

    return of(row)


def location(f: dict) -> str:
    return f"{f['path']}:{f['start_line']}-{f['end_line']}" if f["start_line"] and f["end_line"] else f["path"]


def nested(rows: list[dict]) -> list[dict]:
    """Adjacency rows (node_id, parent) as trees, in the order given."""
    by = {r["node_id"]: {**r, "children": []} for r in rows}
    top = []
    for r in by.values():
        (by[r["parent"]]["children"] if r["parent"] in by else top).append(r)
    return top


def tree_lines(nodes: list[dict], indent: int = 0) -> list[str]:
    out = []
    for n in nodes:
        out.append(f"{'  ' * indent}{n['path']}  loc={n['loc']} complexity={n['complexity']} files={n['file_count']} hotspot={n['score']}")
        out += tree_lines(n["children"], indent + 1)
    return out


def markdown(manifest: dict, findings: list[dict], n_ranked: int, summary: list[dict], focus: list[str], deprioritized: list[str]) -> str:
    count = lambda p: sum(f["priority"] == p for f in findings)
    out = ["# Code quality report", "", "## Summary", "", f"- Root: `{manifest['root_path']}`", f"- Profile: `{manifest['profile']}`", f"- Ranked hotspots: {n_ranked}"]
    out += [f"- Findings: {len(findings)} total, {count('high')} high, {count('medium')} medium.", f"- Focus paths: `{', '.join(focus) or 'none'}`", f"- Deprioritized paths: `{', '.join(deprioritized) or 'none'}`"]
    out += ["", "## Top targets", "", "| Rank | Priority | Path priority | Path | Why | Next |", "| --- | --- | --- | --- | --- | --- |"]
    for f in findings[:10]:
        evidence = ", ".join(f"{k}={v}" for k, v in f["evidence"].items()) or "metric signal"
        out.append(f"| {f['id']} | {f['priority']} | {f['path_priority']} | `{location(f)}` | {f['title']} ({evidence}) | {f['suggested_action']} |")
    return "\n".join([*out, "", "## Tree", "", "```text", *tree_lines(summary), "```", ""]) + "\n"


def action_plan(findings: list[dict], profile: str) -> str:
    out = ["# Action plan", "", f"Profile: `{profile}`", ""]
    for i, f in enumerate(findings[:5], 1):
        out += [f"{i}. {f['title']}", f"   Where: `{location(f)}`; priority={f['priority']}; path priority={f['path_priority']}.", f"   First: {f['suggested_action']}", ""]
    return "\n".join(out if findings else [*out, "No findings were generated for this scan.", ""])


GUIDE = """# Reading these files

Findings are signals, not bugs: read the source and its tests before changing anything.
Begin with report.md, then findings.top.json; load other files only for detail.  High
complexity asks for a look at control flow, high loc for separable parts, type escapes
for exact types.  Report a few targets with their evidence and how a change is verified.
"""


def metrics_schema() -> dict:
    return {"metrics": [{"name": n, "aggregation": a, "higher_is_riskier": h} for n, a, h in METRICS], "profiles": PROFILES}


def payload(engine: Engine, profile: str = "general", limit: int = 50, depth: int = 3, top: int = 6, focus: list[str] = (), deprioritized: list[str] = DEPRIORITIZED, compact: bool = False, include_tree: bool = False, include_dependencies: bool = False) -> dict:
    """Every artifact by file name.  Only limited results come to the driver, and the tree and graph on demand."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    how = {"weights": profile, "focus": list(focus), "deprioritized": list(deprioritized)}
    hot = [plain(r) for r in engine.hotspots(limit, **how).collect()]
    found = [plain(r) for r in engine.findings(limit, **how).collect()]
    for f in found:
        f["title"] = f"{TITLES[f['category']]} in {f['name']}"
        f["suggested_action"] = action(f)
        f["agent_prompt"] = agent_prompt(f["category"])
    summary = nested([plain(r) for r in engine.tree_summary(depth, top, **how).orderBy("depth", "parent", F.desc("score"), F.desc("loc"), "node_id").collect()])
    manifest = {"root_path": engine.root, "profile": profile, "generated_at": datetime.datetime.now(datetime.UTC).isoformat()}
    out = {
        "findings.top.json": {"findings": found[: min(limit, 20 if compact else 10)]},
        "tree.summary.json": {"tree": summary},
        "findings.json": {"findings": found},
        "hotspots.json": {"rankings": hot},
        "metrics.schema.json": metrics_schema(),
        "report.md": markdown(manifest, found, len(hot), summary, list(focus), list(deprioritized)),
        "action-plan.md": action_plan(found, profile),
        "agent-skill.md": GUIDE,
    }
    if include_tree:
        out["tree.json"] = tree_json(engine)
    if include_dependencies:
        nodes, edges = engine.dependencies()
        out["dependencies.json"] = {"nodes": [plain(r) for r in nodes.orderBy("id").collect()], "edges": [plain(r) for r in edges.orderBy("source", "target", "edge_kind", "label").collect()]}
    manifest["artifacts"] = artifacts({p: size_of(x) for p, x in {"manifest.json": manifest, **out}.items()})
    return {"manifest.json": manifest, **out}


def size_of(content) -> int:
    return len((content if isinstance(content, str) else dumps(content)).encode())


def artifacts(sizes: dict[str, int]) -> list[dict]:
    """The index of written artifacts, in the order they are read; the manifest's size is that without the index."""
    rows = [{"name": n, "path": p, "bytes": sizes[p], "read_order": order, "agent_load": load} for p, (n, order, load) in ARTIFACTS.items() if p in sizes]
    return sorted(rows, key=lambda r: (r["read_order"], r["path"]))


def tree_json(engine: Engine) -> dict:
    """The whole tree, nested, on the driver: for one text on the standard output.  write_report and ``scan`` write it from the tasks."""
    rows = engine.nodes().select("*", *sinks.tree_place()).orderBy("_path", "_number", "_body").drop("_path", "_number", "_body", "depth")
    return {"tree": nested([plain(r) for r in rows.collect()])}


def write_tree(engine: Engine, target: str) -> int:
    """The nested tree as one file, written by the tasks; gives its bytes."""
    folder = new_folder(engine.spark, "tree")
    sinks.write_tree(engine.nodes(), folder)
    return sinks.merged([folder], target)


def write_dependencies(engine: Engine, target: str) -> int:
    """Nodes and edges of the dependency graph as one file, written by the tasks; gives its bytes."""
    nodes, edges = engine.dependencies()
    folders = [new_folder(engine.spark, "graph-nodes"), new_folder(engine.spark, "graph-edges")]
    sinks.write_rows(nodes, folders[0], '{"nodes": [', "], ", "id")
    sinks.write_rows(edges, folders[1], '"edges": [', "]}\n", "source", "target", "edge_kind", "label")
    return sinks.merged(folders, target)


def write_report(engine: Engine, folder: str, formats: str = "both", include_tree: bool = False, include_dependencies: bool = False, **how) -> dict[str, str]:
    """The artifacts as files; tree and graph never come to the driver."""
    os.makedirs(folder, exist_ok=True)
    written, sizes = {}, {}
    wanted = lambda name: formats in ("both", "json" if name.endswith(".json") else "markdown")
    content = payload(engine, **how)
    manifest = {k: v for k, v in content.pop("manifest.json").items() if k != "artifacts"}
    for name, write in (("tree.json", write_tree if include_tree else None), ("dependencies.json", write_dependencies if include_dependencies else None)):
        if write and wanted(name):
            written[name] = os.path.join(folder, name)
            sizes[name] = write(engine, os.path.abspath(written[name]))
    sizes |= {n: size_of(x) for n, x in content.items() if wanted(n)} | ({"manifest.json": size_of(manifest)} if wanted("manifest.json") else {})
    for name, x in {"manifest.json": manifest | {"artifacts": artifacts(sizes)}, **content}.items():
        if wanted(name):
            written[name] = os.path.join(folder, name)
            with open(written[name], "w", encoding="utf-8") as f:
                f.write(dumps(x) if name.endswith(".json") else x)
    return written
