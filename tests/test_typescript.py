from scopelake.sources.analyzers.flow_scan import flow_rows
from scopelake.sources.analyzers.ts_scan import imports_exports, scan_typescript


def names(scopes):
    return [s.name for s in scopes]


def find(scopes, name):
    for s in scopes:
        for x in s.walk():
            if x.name == name:
                return x
    return None


def test_complexity_goes_to_the_innermost_scope():
    r = scan_typescript(
        "function a(x: number): number {\n  if (x > 0 && x < 9) { return x ?? 1; }\n  const g = () => { for (const y of z) { y ? 1 : 2; } };\n  return 0;\n}\n", "a.ts"
    )
    a = r.scopes[0]
    assert (a.name, a.complexity, a.parameter_count, a.start_line, a.end_line) == ("a", 4, 1, 1, 5)
    assert (a.children[0].name, a.children[0].complexity) == ("g", 3)
    assert a.max_nesting_depth == 1


def test_else_if_and_catch_nest():
    r = scan_typescript("function f() { try { a(); } catch (e) { if (x) {} else if (y) {} } }", "a.ts")
    assert r.scopes[0].complexity == 4  # catch, two ifs
    assert r.max_nesting_depth == 4


def test_import_blocks_span_blank_lines_and_the_largest_wins():
    r = scan_typescript("import a from 'a';\nlet z;\nimport b from 'b';\n\nimport { c } from 'c';\nimport 'd';\n", "a.ts")
    i = r.scopes[0]
    assert (i.name, i.complexity, i.nloc, i.start_line, i.end_line) == ("(imports)", 0, 4, 3, 6)
    assert r.ts_import_coupling_count == 4


def test_names_of_callbacks_and_objects():
    r = scan_typescript(
        "function main() {\n[1].sort((a, b) => a - b);\nxs.map(function (i) { return i; });\nconst mine = () => {};\nconst o = { m: () => {} };\na.b.c(() => {});\nconst v = (() => 1)();\nnew Thing(() => 2);\ny = () => 3;\n}",
        "a.ts",
    )
    assert names(r.scopes[0].children) == ["sort(ƒ)", "map(ƒ)", "mine", "o (object)", "c(ƒ)", "IIFE(ƒ)", "Thing(ƒ)", "y"]
    assert names(find(r.scopes, "o (object)").children) == ["m"]


def test_tsx_counts():
    r = scan_typescript(
        'import React from "react";\nconst C = (p: any) => {\n  useEffect(() => {}, []);\n  return (\n    <div className="box" onClick={() => go(1)}>\n      {n > 1 ? <b>Hi</b> : <b>Hi</b>}\n      {n && <i key="1"/>}\n      {/* @ts-ignore */}\n    </div>\n  );\n};\n',
        "a.tsx",
    )
    assert (r.tsx_nesting_depth, r.tsx_render_branching_count, r.tsx_react_use_effect_count) == (2, 2, 1)
    assert (r.tsx_anonymous_handler_count, r.tsx_prop_count, r.ts_any_usage_count, r.ts_ignore_count) == (1, 3, 1, 1)
    assert (r.tsx_duplicated_string_count, r.tsx_hardcoded_string_volume) == (1, 3 + 2 + 2 + 1)


def test_one_virtual_root_adopts_element_scopes():
    r = scan_typescript("function A() {\n  return (\n    <div>\n      <b onClick={() => x()} />\n      <L>{(i) => <p>{i}</p>}</L>\n    </div>\n  );\n}", "a.tsx")
    root = r.scopes[0].children[0]
    assert (root.name, root.origin_type, root.start_line, root.end_line, root.complexity) == ("<div>", "jsx_virtual_root", 3, 6, 0)
    assert names(root.children) == ["<b />", "<L>"]
    assert names(find(r.scopes, "<L>").children) == ["<L>(ƒ)"]


def test_attribute_object_belongs_to_its_element():
    r = scan_typescript("const A = () => <d onClick={() => 1}><T class={f(a, { w: () => 2 })} /></d>;", "a.tsx")
    assert names(find(r.scopes, "<T />").children) == ["class (obj)"]


def test_broken_code_leaves_the_rest():
    r = scan_typescript("const a = ;;; )\nfunction ok() { return 1 }\n@@@\nclass K { m() {} }", "a.ts")
    assert {"ok", "K (class)"} <= set(names(r.scopes))


def test_types_generics_and_regexes_are_read():
    r = scan_typescript(
        "type A<T> = T extends string ? { a: any } : (x: T) => void;\ninterface I { f(): void }\nfunction g<T,>(this: X, x?: T, ...r: any[]): x is T { return /[/]\"/.test(`${x as any}`) }\nconst h = async <T>(a: Map<string, Array<T>>) => a.get<T>('k')!;\nabstract class C<T> extends B<T> implements I { private x = 1; static { } get y() { return 1 } async *z() {} [k: string]: any }\n",
        "a.ts",
    )
    assert names(r.scopes) == ["A (type)", "I (interface)", "g", "h", "C (class)"]
    assert r.ts_type_interface_count == 2 and r.classes_count == 1
    assert r.ts_any_usage_count == 4


def test_imports_and_exports():
    i, e = imports_exports(
        "import type { T } from './t';\nimport d, { a as b, c } from './x';\nimport * as n from 'n';\nimport 's';\nexport { q as r } from './q';\nexport * from './all';\nexport { u, v as w };\nexport default function () {}\nexport const k = 1, l = 2;\nexport class M {}\nexport interface N {}\n",
        "a.ts",
    )
    assert [(x["source"], x["symbols"]) for x in i] == [("./x", ["a", "c", "default"]), ("n", []), ("s", []), ("./q", ["q"]), ("./all", [])]
    assert [x["name"] for x in e] == ["r", "u", "w", "default", "k", "l", "M"]


def test_flow_rows_follow_the_two_views():
    text = "import { j } from 'p';\nconst top = 1;\nfunction outer(p) {\n  const { a, b: c = top } = p;\n  return a + j(c);\n}\n"
    scopes, defs, usages = flow_rows(text, "a.ts", "focus")
    assert [(d["name"], d["kind"]) for d in defs] == [("j", "import"), ("top", "local"), ("outer", "module"), ("p", "param"), ("a", "local"), ("c", "local")]
    assert [u["name"] for u in usages] == ["p", "a", "j", "c"]
    scopes, defs, _ = flow_rows(text, "a.ts", "flow")
    assert [s["kind"] for s in scopes] == ["global", "function"]
    assert "j" not in [d["name"] for d in defs]
