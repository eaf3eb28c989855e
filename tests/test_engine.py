import json

import pytest

from scopelake import cli, report
from scopelake.engine import Engine
from scopelake.operators.explorer import breadcrumb_trail
from scopelake.sources import flow

FILES = {
    "src/a.ts": 'import { b } from "./utils/b";\nimport React from "react";\nimport "@u/c";\nexport function a(x: number) { if (x) { return b(x); } return 0; }\n',
    "src/utils/b.ts": "export const b = (y) => y && y + 1;\nexport default b;\n",
    "src/utils/c.tsx": 'import b from "../utils/b";\nexport const C = () => <div onClick={() => b(1)}>hi</div>;\n',
    "src/m.py": "def f(x):\n    return [y for y in x if y]  # TODO\n",
    "src/bad.py": "broken(",
    "README.md": "# T\n\ntext\n",
    ".gitignore": "*.log\nsrc/skip.ts\n",
    "src/skip.ts": "let x = 1;",
    "tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@u/*": ["src/utils/*"]}} }',
    "node_modules/x/y.ts": "x",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return Engine(spark, str(root))


def test_nodes(engine):
    n = {r["node_id"]: r for r in engine.nodes().collect()}
    assert "node_modules/x/y.ts" not in n and "src/skip.ts" not in n and "src/bad.py" not in n
    files = [r for r in n.values() if r["node_type"] == "file" and r["path"].startswith("src/")]
    assert n["src"]["loc"] == sum(r["loc"] for r in files) and n["src"]["file_count"] == len(files) == 4
    assert n["src"]["complexity"] == max(r["complexity"] for r in files)
    assert n["src/a.ts::1"]["path"] == "src/a.ts::a" and n["src/a.ts::1"]["complexity"] == 2
    assert [r["path"] for r in engine.failed().collect()] == ["src/bad.py"]


def test_scores_and_ranks(engine):
    r = engine.ranked().collect()
    assert r and all(0 <= x["score"] <= 1 for x in r)
    hot = engine.hotspots(5, focus=["src/m.py"]).collect()
    assert [x["rank"] for x in hot] == [1, 2, 3, 4, 5]
    assert {x["path_priority"] for x in engine.ranked(focus=["src/m.py"]).collect()} == {"focused", "neutral"}
    assert engine.explain("src/utils").where("NOT path LIKE 'src/utils%'").count() == 0


def test_dependencies(engine):
    nodes, edges = engine.dependencies()
    e = {(r["source"], r["target"], r["edge_kind"]) for r in edges.collect()}
    assert ("src/a.ts", "src/utils/b.ts", "import") in e and ("src/a.ts", "src/utils/c.tsx", "import") in e
    assert ("src/utils/b.ts::b", "src/a.ts", "export") in e and ("src/utils/b.ts::default", "src/utils/c.tsx", "export") in e
    assert ("src/utils/c.tsx::C", "src/a.ts", "export") in e and ("src/a.ts", "react", "external") in e
    assert [r["id"] for r in nodes.where("type = 'external'").collect()] == ["react"]


def test_report_files(engine, tmp_path):
    made = report.write_report(engine, str(tmp_path / "out"), include_tree=True)
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert [a["path"] for a in manifest["artifacts"]][:3] == ["manifest.json", "report.md", "findings.top.json"] and "tree.json" in made
    assert {(a["name"], a["agent_load"]) for a in manifest["artifacts"]} >= {("tree", "avoid_full_load"), ("agent_skill", "reference"), ("findings", "top_n")}
    assert "agent_prompt" in json.loads((tmp_path / "out" / "findings.json").read_text())["findings"][0]
    size = {a["path"]: a["bytes"] for a in manifest["artifacts"]}
    assert size["findings.json"] == len((tmp_path / "out" / "findings.json").read_bytes())
    with pytest.raises(ValueError):
        report.payload(engine, profile="none")


def test_cli(engine, spark, tmp_path, capsys):
    assert cli.main(["hotspots", engine.root, "--metric", "loc", "--limit", "2", "--format", "json"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["rankings"]) == 2
    assert cli.main(["report", engine.root, "--out", str(tmp_path / "r"), "--fail-on", "low"], spark) == 1
    assert cli.main(["scan", engine.root, "--format", "jsonl"], spark) == 2


def test_search_summary_and_context(engine):
    assert {r["path"] for r in engine.search("B.TS").collect()} >= {"src", "src/utils", "src/utils/b.ts"}
    s = {r["node_id"]: r for r in engine.tree_summary(2, 2).collect()}
    assert all(r["parent"] is None or r["parent"] in s for r in s.values())
    c = engine.context().first()
    assert (c["file_count"], c["folder_count"]) == (9, 2)
    assert [r["name"] for r in engine.listing().collect()] == ["node_modules", "src", "README.md", "tsconfig.json"]


def test_overlay_and_scope_graph(spark):
    text = 'import { join as j } from "path";\nconst top = 1;\nfunction outer(p) {\n  const local = p + top;\n  function inner() {\n    console.log(local);\n    return local + p + top + j("a") + missing;\n  }\n  return inner();\n}\n'
    f = spark.createDataFrame([("a.ts", text), ("b.md", "x")], "path string, content string")
    t = {(r["name"], r["category"]) for r in flow.overlay(f, (6, 7)).collect()}
    assert t == {("console", "builtin"), ("local", "capture"), ("p", "param"), ("top", "module"), ("j", "importExternal"), ("missing", "unresolved")}
    g = {r["name"]: r for r in flow.scope_graph(f).collect()}
    assert g["inner"]["captured"] == ["local", "p"] and g["outer"]["declared"] == ["inner", "local", "p"]


def test_data_flow(spark):
    f = spark.createDataFrame([("c.ts", "const x = 10;\nconst y = x + 5;\ntry { a(); } catch (e) { }\nif (x) { c(); } else { d(); }\n")], "path string, content string")
    nodes, edges = flow.data_flow(f)
    kinds = [r["type"] for r in nodes.collect()]
    assert kinds.count("variable") == 2 and kinds.count("try") == 1
    by = {r["id"]: r["type"] for r in nodes.collect()}
    assert sorted((by[r["source"]], by[r["target"]]) for r in edges.where("type = 'control-flow'").collect()) == [("if_branch", "else_branch"), ("try", "catch")]
    assert edges.where("type = 'data'").count() == 2


def test_imports_by_alias_are_internal(spark):
    f = spark.createDataFrame([("src/a.ts", 'import { x } from "@/b";\nimport { y } from "@/gone";\nimport z from "./c";\nconst s = x + y + z;\n'), ("src/b.ts", "export const x = 1;\n")], "path string, content string")
    rows = spark.createDataFrame([(0, "@/*", ["src/*"])], "ord int, pattern string, targets array<string>")
    t = {r["name"]: (r["category"], r["tooltip"]) for r in flow.overlay(f, (4, 4), None, f.select("path"), "", rows).collect()}
    assert t == {"x": ("importInternal", "Import (internal): @/b"), "y": ("importExternal", "Import (external): @/gone"), "z": ("importInternal", "Import (internal): ./c")}
    assert {r["name"]: r["category"] for r in flow.overlay(f, (4, 4)).collect()}["x"] == "importExternal"


def test_configuration_above_the_scanned_folder(spark, tmp_path):
    (tmp_path / "app" / "src").mkdir(parents=True)
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["app/src/*"], "#/*": ["*"], "@lib/*": ["lib/*"]}}}')
    (tmp_path / "app" / "src" / "b.ts").write_text("export const x = 1;\n")
    (tmp_path / "app" / "a.ts").write_text('import { x } from "@app/b";\nimport { x as y } from "#/app/src/b";\nimport { z } from "@lib/b";\nconst s = x + y + z;\n')
    e = Engine(spark, str(tmp_path / "app"))
    edges = sorted((r["source"], r["target"]) for r in e.dependencies()[1].where("edge_kind <> 'export'").collect())
    assert edges == [("a.ts", "@lib/b"), ("a.ts", "src/b.ts"), ("a.ts", "src/b.ts")]
    assert {r["name"]: r["category"] for r in e.overlay("a.ts", (4, 4)).collect()} == {"x": "importInternal", "y": "importInternal", "z": "importExternal"}


def test_the_way_down_to_a_range(spark):
    #       id, parent, depth, start, end, preorder
    rows = [(0, None, 0, 1, 100, 0), (1, 0, 1, 1, 100, 1), (2, 1, 2, 10, 50, 2), (3, 1, 2, 10, 60, 3), (4, 2, 3, 10, 50, 4), (5, 4, 4, 20, 30, 5), (6, 2, 3, 40, 45, 6), (7, 5, 5, 20, 30, 7)]
    s = spark.createDataFrame([("a.ts", *r) for r in rows], "path string, scope_id long, parent_id long, depth long, start_line long, end_line long, preorder long")
    up = {r[0]: r[1] for r in rows}
    closed = []
    for node in up:
        at, n = node, 0
        while at is not None:
            closed.append((node, at, n))
            at, n = up[at], n + 1
    c = spark.createDataFrame(closed, "node long, ancestor long, distance long")
    trail = lambda a, b: [r["scope_id"] for r in breadcrumb_trail(s, c, a, b).orderBy("depth").collect()]
    assert trail(22, 25) == [0, 1, 2, 4, 5]  # wide wrappers only where something narrower lies below; 7 is none
    assert trail(41, 42) == [0, 1, 2, 6] and trail(55, 58) == [0, 1, 3] and trail(12, 60) == [0, 1, 3]
    assert trail(90, 95) == [0] and trail(1, 200) == [0]


def test_markup_has_an_action_of_its_own():
    f = {"path": "src/a.tsx::C", "category": "tsx"}
    assert report.action(f) == report.TSX_ACTION and report.action(f | {"path": "src/a.ts"}) == report.ACTIONS["tsx"]
    assert report.action(f | {"category": "size"}) == report.ACTIONS["size"]


def test_tree_and_graph_are_written_by_the_tasks(engine, spark, tmp_path, monkeypatch):
    """Whole files equal what nesting on the driver gives, and no row is collected but one per partition."""
    want, graph = report.tree_json(engine), engine.dependencies()
    edges = sorted(repr(sorted(report.plain(r).items(), key=str)) for r in graph[1].collect())
    monkeypatch.setattr(report, "tree_json", None)
    made = report.write_report(engine, str(tmp_path / "out"), include_tree=True, include_dependencies=True)
    assert json.loads(open(made["tree.json"]).read()) == want
    got = json.loads(open(made["dependencies.json"]).read())
    assert [n["id"] for n in got["nodes"]] == sorted(r["id"] for r in graph[0].collect())
    assert sorted(repr(sorted(e.items(), key=str)) for e in got["edges"]) == edges
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    size = {a["path"]: a["bytes"] for a in manifest["artifacts"]}
    assert size["tree.json"] == len(open(made["tree.json"], "rb").read()) and size["dependencies.json"] == len(open(made["dependencies.json"], "rb").read())
    assert cli.main(["scan", engine.root, "--out", str(tmp_path / "t.json")], spark) == 0
    assert json.loads((tmp_path / "t.json").read_text()) == want


def test_a_large_folder_is_written_in_parts(spark, tmp_path):
    from scopelake import sinks

    rows = [("d", None, "folder", 1)] + [(f"d/f{i:04}", "d", "file", 2) for i in range(1500)] + [(f"d/f{i:04}::{n}", f"d/f{i:04}", "function", 3) for i in range(0, 1500, 7) for n in range(3)]
    rows += [(f"d/f{i:04}::{n}::(body)", f"d/f{i:04}::{n}", "function_body", 4) for i in range(0, 1500, 7) for n in (0, 2)]
    nodes = spark.createDataFrame(rows, "node_id string, parent string, node_type string, depth int").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_tree(nodes, str(tmp_path / "tree"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sinks.parts(str(tmp_path / "tree"))) >= 5
    got = json.loads(b"".join(sinks.blocks([str(tmp_path / "tree")])))
    listed = nodes.select("*", *sinks.tree_place()).orderBy("_path", "_number", "_body").drop("_path", "_number", "_body", "depth").collect()
    assert got == {"tree": report.nested([report.plain(r) for r in listed])}
    sinks.write_tree(nodes.where("1 = 0"), str(tmp_path / "none"))
    assert json.loads(b"".join(sinks.blocks([str(tmp_path / "none")]))) == {"tree": []}


def test_the_graph_as_it_is_drawn(engine):
    shown = lambda e: {(r["source"], r["target"], r["kind"]) for r in e.collect()}
    nodes, edges = engine.graph()
    assert ("src/utils/b.ts::b", "src/a.ts", "export") in shown(edges) and ("src/a.ts", "src/utils/b.ts", "import") not in shown(edges)
    nodes, edges = engine.graph(externals=False, exports=False)
    assert {r["type"] for r in nodes.collect()} == {"file"}
    assert shown(edges) == {("src/a.ts", "src/utils/b.ts", "import"), ("src/a.ts", "src/utils/c.tsx", "import"), ("src/utils/c.tsx", "src/utils/b.ts", "import")}
    assert {r["target_label"] for r in edges.collect()} == {"b.ts", "c.tsx"}
    _, edges = engine.graph(externals=False, exports=False, collapse=1)
    assert {(s, t) for s, t, k in shown(edges) if k == "badge"} == {("src/a.ts", "src/utils/b.ts"), ("src/utils/c.tsx", "src/utils/b.ts")}
    nodes, _ = engine.graph(externals=False, exports=False, imported_only=True, root="src/a.ts")
    assert {r["id"] for r in nodes.collect()} == {"src/a.ts", "src/utils/b.ts", "src/utils/c.tsx"}
    assert {r["path"]: r["fan_in"] for r in engine.fan_in().collect()} == {"src": 2, "src/utils": 2, "src/utils/b.ts": 2, "src/utils/c.tsx": 1}
    assert [(r["parent"], r["exports"]) for r in engine.exports("C").collect()] == [("src/utils/c.tsx", ["C"])]
    assert engine.unread_modules().count() == 0


def test_explorer_and_treemap(engine):
    top = engine.children().collect()
    assert [r["name"] for r in top] == ["src", ".gitignore", "README.md"] and (top[0]["folders"], top[0]["files"]) == (1, 2)
    t = {r["node_id"]: r for r in engine.treemap().collect()}
    assert t["src"]["place"] == 1 and t["README.md"]["place"] > 1 and not any(r["node_type"] == "function_body" and len([x for x in t.values() if x["parent"] == r["parent"]]) > 1 for r in t.values())
    files = {r["path"]: r["loc"] for r in engine.nodes().where("node_type = 'file'").collect()}
    assert {r["path"]: r["loc"] for r in engine.leaf_sums().collect()}["src"] == sum(v for k, v in files.items() if k.startswith("src/"))
    kept = {(r["path"], r["node_type"]) for r in engine.filtered([".TS"], excluded=["src/utils"]).collect()}
    assert kept == {("src/a.ts", "file"), ("src", "folder")}
    assert {r["suffix"]: r["n"] for r in engine.suffixes().collect()} == {".ts": 2, ".tsx": 1, ".py": 1, ".md": 1, "": 1}
    assert engine.breadcrumbs("src/a.ts::a") == "src > a.ts > a" and engine.breadcrumbs("none") == ""


def test_one_file(spark, tmp_path):
    text = "const top = 1;\nfunction outer(p) {\n  const own = p;\n  function inner() {\n    return own + top;\n  }\n  return inner();\n}\nlet x = x + 1;\n"
    (tmp_path / "f.ts").write_text(text)
    (tmp_path / "n.ipynb").write_text('{"cells": [{"cell_type": "code", "source": ["a\\n", "\\n", "b"]}]}')
    (tmp_path / "bad.ipynb").write_text("{")
    e = Engine(spark, str(tmp_path))
    assert [r["label"] for r in e.focused_scope("f.ts", (5, 5)).collect()] == ["inner"]
    assert [r["label"] for r in e.scope_at("f.ts", (4, 6)).collect()] == ["inner"]
    assert [r["label"] for r in e.trail("f.ts", (5, 5)).collect()][1:] == ["outer", "inner"]
    shown, tokens = e.display("f.ts", (4, 6))
    assert shown.first()["shown"] == "  function inner() {\n    return own + top;\n  }" and shown.first()["first"] == 4
    line = "    return own + top;"
    assert {(r["name"], line[r["start_col"] : r["end_col"]]) for r in tokens.collect() if r["display_line"] == 1} == {("own", "own"), ("top", "top")}
    assert {r["name"] for r in e.pills("f.ts").collect()} == {"top", "own", "p", "x"}
    assert {r["line"] for r in e.line_clusters("f.ts").collect()} >= {3, 9}
    assert e.content("n.ipynb").first()["content"] == "a\nb"
    n = {r["path"]: r for r in e.nodes().where("node_type IN ('file', 'function')").collect()}
    assert n["n.ipynb"]["loc"] == 2 and (n["n.ipynb::[code] cell 1"]["start_line"], n["n.ipynb::[code] cell 1"]["end_line"]) == (1, 2)
    assert [r["path"] for r in e.failed().collect()] == ["bad.ipynb"]


def test_files_that_take_too_long_are_errors(spark):
    from scopelake.sources import flow as f
    from scopelake.sources import modules

    d = spark.createDataFrame([("slow.ts", "function f(a) { if (a) { return [a, { b: a }]; } }\n" * 30_000), ("a.ts", "const x = 1;")], "path string, content string")
    assert [r["path"] for r in f.failed(f.scan(d, "focus", 0.2)).collect()] == ["slow.ts"]
    failed = modules.failed(modules.scan_modules(d, 0.2)).collect()
    assert [(r["path"], r["error"][:12]) for r in failed] == [("slow.ts", "TimeoutError")]
