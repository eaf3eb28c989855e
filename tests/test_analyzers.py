from scopelake.sources.analyze import analyze_text, with_body_loc
from scopelake.sources.analyzers.css_scan import scan_css
from scopelake.sources.analyzers.generic_scan import scan_generic
from scopelake.sources.analyzers.md_scan import scan_markdown
from scopelake.sources.analyzers.notebook_scan import scan_notebook, virtual_text
from scopelake.sources.analyzers.py_scan import scan_python
from scopelake.sources.trees import ignore_patterns, pattern_regex, strip_comments, translated


def test_python_scopes_and_complexity():
    r = scan_python(
        "import os\nfrom a import b\n\nclass K:\n    def m(self, *a, k=1):\n        if a and k or b:  # TODO x\n            pass\n        elif k:\n            pass\n        with x:\n            try:\n                pass\n            except E:\n                pass\n\nf = lambda q: q\n"
    )
    assert [s.name for s in r.scopes] == ["(imports)", "(class) K", "(lambda)"]
    m = r.scopes[1].children[0]
    assert (m.complexity, m.parameter_count, m.max_nesting_depth, m.todo_count) == (1 + 1 + 2 + 1 + 1, 3, 2, 1)
    assert (r.python_import_count, r.classes_count, r.todo_count, r.comment_lines) == (2, 1, 1, 1)
    assert r.function_count == 3 and r.complexity == (0 + 1 + 1) / 3


def test_css_and_scss():
    r = scan_css("/* TODO */\n.a, .b:hover {\n  color: red;\n}\n@media (x) {\n  .c { d: e }\n}\n", "a.css")
    assert [s.name for s in r.scopes] == [".a, .b:hover", "@media (x)"]
    assert r.scopes[1].children[0].name == ".c" and r.todo_count == 1
    r = scan_css("@mixin m($a) {\n x: $a;\n}\n.s { // c\n  @include m(1);\n  @include k {\n    y: z;\n  }\n}\n", "a.scss")
    assert [s.name for s in r.scopes] == ["@mixin m($a)", ".s"]
    assert [(s.name, s.nloc) for s in r.scopes[1].children] == [("@include k", 3)]


def test_markdown():
    r = scan_markdown("intro\n\n# A\n\n> said\n\n## B\n\n![x](data:image/png;base64,AA)\n\n```js\n# no heading\n```\n\nC\n===\n\n    code\n")
    assert [s.name for s in r.scopes] == ["# A", "C"]
    a = r.scopes[0]
    assert [c.name for c in a.children] == ["> said", "## B"]
    assert [c.name for c in a.children[1].children] == ["``` js", "data-url image/png;base64"]
    assert (a.start_line, a.end_line, r.md_data_url_count) == (3, 14, 1)
    assert [c.name for c in r.scopes[1].children] == ["```"]


def test_notebook_lines_are_virtual():
    text = '{"cells": [{"cell_type": "code", "source": "a\\n\\nb"}, {"cell_type": "raw", "source": []}, {"cell_type": "markdown", "source": ["x\\n", "y"]}]}'
    r = scan_notebook(text)
    assert [(s.name, s.start_line, s.end_line) for s in r.scopes] == [("[code] cell 1", 1, 2), ("[markdown] cell 3", 3, 4)]
    assert r.loc == 4 and virtual_text(text) == "a\nb\nx\ny"


def test_folder_names_of_the_root_match_at_any_depth():
    import re

    def hit(line, folder, path):
        ((negated, regex),) = ignore_patterns([(folder, line)])
        return not negated and bool(re.search(regex, path))

    assert hit("de/", "", "a/de/f") and hit("/de/", "", "de/f") and not hit("de/", "", "a/de") and not hit("a/de/", "", "b/a/de/f")
    assert hit("de/", "d", "d/de/f") and not hit("de/", "d", "d/a/de/f")


def test_generic_functions_of_other_languages():
    r = scan_generic("func (s *S) F(a int, b string) (int, error) {\n  for {\n    if a > 1 { a-- }\n  }\n}\nfunc G[T any](x T) []string {\n}\nfunc H() {}\n")
    assert [(s.name, s.complexity, s.start_line, s.end_line, s.parameter_count) for s in r.scopes] == [("F", 3, 1, 5, 2), ("G", 1, 6, 7, 1), ("H", 1, 8, 8, 0)]
    r = scan_generic("const g = (x, y) => {\n  return x ? y : 0;\n};\nlet h = async z => {\n};\nfunction k(a) {\n  if (a) { const m = () => { while (a) {} } }\n}\n")
    assert [(s.name, s.complexity, s.start_line, s.end_line, s.parameter_count) for s in r.scopes] == [("g", 2, 1, 3, 2), ("h", 1, 4, 5, 1), ("k", 2, 6, 8, 1), ("m", 2, 7, 7, 0)]


def test_generic_nested_functions_take_linear_time():
    import time

    n, start = 6000, time.perf_counter()
    r = scan_generic("".join(f"function f{i}(a) {{ if (a) {{\n" for i in range(n)) + "}}" * n)
    assert len(r.scopes) == n and all(s.complexity == 2 for s in r.scopes) and time.perf_counter() - start < 5


def test_generic():
    r = scan_generic("int f(int a) {\n  if (a && 1) return 2; // TODO\n}\n")
    assert [(s.name, s.complexity, s.parameter_count) for s in r.scopes] == [("f", 3, 1)]
    assert r.todo_count == 1


def test_body_lines_are_those_no_child_covers(spark):
    rows = [("f", 0, None, 1, 10), ("f", 1, 0, 2, 4), ("f", 2, 0, 4, 6), ("f", 3, 0, 9, 12), ("g", 0, None, 1, 5)]
    s = with_body_loc(spark.createDataFrame(rows, "path string, scope_id long, parent_scope_id long, start_line long, end_line long"))
    assert {(r["path"], r["scope_id"]): r["body_loc"] for r in s.collect()} == {("f", 0): 3, ("f", 1): 0, ("f", 2): 0, ("f", 3): 0, ("g", 0): 0}  # 1, 7, 8


def test_one_file_never_fails_the_job():
    assert analyze_text("a.py", "def (")["error"].startswith("SyntaxError")
    assert analyze_text("a.ipynb", "{")["error"] is not None
    assert analyze_text("a.ts", "")["function_count"] == 0


def test_ignore_patterns():
    assert translated("/x", "") == "**/x" and translated("a/b", "d") == "d/a/b" and translated("!y", "d") == "!d/**/y" and translated("# c", "") is None
    import re

    hit = lambda p, path: bool(re.search(pattern_regex(p), path))
    assert hit("**/*.log", "a/b.log") and hit("**/*.log", "b.log") and not hit("**/*.log", "b.logs")
    assert hit("build/", "build/x") and not hit("build/", "build") and not hit("build/", "a/build/x")
    assert hit("**/tmp", "a/tmp/x/y") and hit("a/**/b", "a/b") and hit("a/**/b", "a/c/d/b") and hit("d/**", "d/e") and hit("x?[ab]", "xyb")
    rules = ignore_patterns([("", "*.log\n!keep.log\n")])
    assert [n for n, _ in rules] == [False, True]


def test_comments_in_json():
    assert strip_comments('{"a": "//no", /* c */ "b": 1 // d\n}') == '{"a": "//no",  "b": 1 \n}'


def test_files_of_one_split_are_analyzed_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from scopelake.plans.queries import py_scopes

    spark.range(400).select(F.col("id").alias("p_partkey"), (F.col("id") % 9).cast("int").alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = py_scopes(spark, str(tmp_path)).where("name <> '(imports)'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 3 and sum(r["count"] for r in tasks) == 400


def test_text_without_a_comment_sign_is_not_tokenized(monkeypatch):
    from scopelake.sources.analyzers import py_scan

    calls, tokens = [], py_scan.tokenize.generate_tokens
    monkeypatch.setattr(py_scan.tokenize, "generate_tokens", lambda r: (calls.append(1), tokens(r))[1])
    assert py_scan.scan_python("def f():\n    return 1\n").comment_lines == 0 and not calls
    assert py_scan.scan_python("def f():  # TODO\n    return 1\n").todo_count == 1 and calls
