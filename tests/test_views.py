import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scopelake.operators import deps, explorer, flow, tree
from scopelake.sources.analyze import with_body_loc
from scopelake.sources.analyzers.ts_scan import scan_typescript


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_bodies_are_hidden_unless_alone(spark):
    n = spark.createDataFrame([("p", "(body)", "function_body"), ("p", "f", "function"), ("q", "(body)", "function_body")], "parent string, name string, node_type string")
    assert rows(tree.hide_bodies(n), "parent", "name") == [("p", "f"), ("q", "(body)")]


def test_leaf_sums_and_remainders(spark):
    n = spark.createDataFrame([("a", None, 100), ("a/b", "a", 50), ("a/b/c", "a/b", 3), ("a/d", "a", 4)], "path string, parent string, loc long")
    assert rows(tree.leaf_sums(n), "path", "loc") == [("a", 7), ("a/b", 3)]
    files = spark.createDataFrame([(1, 10), (2, 3), (3, 5)], "file_id int, loc long")
    scopes = spark.createDataFrame([(1, None, 4), (1, 0, 3), (2, None, 9)], "file_id int, parent_scope_id int, nloc long")
    assert rows(tree.body_remainder(files, scopes), "file_id", "body_loc") == [(1, 6), (2, 0), (3, 5)]


def test_display_tokens(spark):
    t = spark.createDataFrame([(3, 4, 8), (3, 10, 12), (2, 0, 2)], "line int, start_col int, end_col int")
    assert [tuple(r) for r in explorer.display_tokens(t, 3, 6).collect()] == [(3, 4, 6, 0), (3, 0, 2, 0)]


def scopes(spark):
    s = spark.createDataFrame(
        [("f", "0", None, 0, 1, 50, 0, "global"), ("f", "1", "0", 1, 2, 20, 1, "a"), ("f", "2", "1", 2, 5, 10, 2, "b"), ("f", "3", "0", 1, 5, 10, 3, "c")],
        "path string, scope_id string, parent_id string, depth int, start_line int, end_line int, preorder int, label string",
    )
    c = spark.createDataFrame([("0", "0", 0), ("1", "1", 0), ("2", "2", 0), ("3", "3", 0), ("1", "0", 1), ("2", "1", 1), ("2", "0", 2), ("3", "0", 1)], "node string, ancestor string, distance int")
    return s, c


def test_focus_descends_to_the_first_that_fits(spark):
    s, c = scopes(spark)
    assert rows(explorer.focused_scope(s, c, 6, 7), "scope_id") == [("2",)]
    assert rows(explorer.focused_scope(s, c, 3, 12), "scope_id") == [("1",)]
    assert rows(explorer.focused_scope(s, c, 30, 31), "scope_id") == [("0",)]
    assert rows(explorer.by_range(s, 5, 10), "scope_id") == [("2",)]


def test_pills(spark):
    s, c = scopes(spark)
    declared = spark.createDataFrame([("0", "a"), ("0", "x"), ("0", "y"), ("1", "z")], "scope_id string, name string")
    captured = spark.createDataFrame([("2", "x")], "scope_id string, name string")
    shown = explorer.declared_pills(declared, s, c, spark.createDataFrame([("0",)], "scope_id string"), captured)
    assert rows(shown, "scope_id", "name") == [("0", "x"), ("1", "z")]


def test_first_consumers_and_names(spark):
    x = spark.createDataFrame([("r", "s", 2, "late"), ("r", "s", 1, "first"), ("r", "a", 3, "only")], "root string, symbol string, preorder int, consumer string")
    assert [r["consumer"] for r in explorer.first_consumers(x).collect()] == ["only", "first"]
    f = spark.createDataFrame([("n", "p1", 1, 1), ("n", "p2", 2, 2)], "name string, path string, loc long, preorder int")
    assert rows(explorer.by_name(f), "name", "path") == [("n", "p2")]


def test_counts_go_to_open_scopes_but_branches_to_their_own(spark):
    _, c = scopes(spark)
    e = spark.createDataFrame([("2", "branch", 1), ("2", "comment", 2), ("1", "nesting", 3), ("2", "nesting", 1)], "scope string, kind string, value int")
    assert rows(flow.scope_counts(e, c), "scope", "comment", "nesting", "branches") == [("0", 2, 3, None), ("1", 2, 3, None), ("2", 2, 1, 1)]


def test_hydrated_edges_and_codes(spark):
    n = spark.createDataFrame([("a", "A label"), ("b", "B")], "id string, label string")
    e = spark.createDataFrame([("a", "b"), ("a", "gone")], "source string, target string")
    assert rows(deps.hydrate(e, n), "source_label", "target_label") == [("A label", "B"), ("A label", None)]
    d = spark.createDataFrame([("userService",)], "label string")
    assert d.select(deps.codes(F.col("label")).alias("c")).first()["c"][0] == "US"


def test_body_and_children_cover_the_scope(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for case in range(60):
        children = [(a, a + rng.randrange(0, 11)) for a in (rng.randrange(1, 41) for _ in range(rng.randrange(1, 13)))]
        rows += [(f"f{case}", 0, None, 1, 45)] + [(f"f{case}", i, 0, a, b) for i, (a, b) in enumerate(children, 1)]
        want[f"f{case}"] = 45 - len({line for a, b in children for line in range(a, min(b, 45) + 1)})
    s = with_body_loc(spark.createDataFrame(rows, "path string, scope_id long, parent_scope_id long, start_line long, end_line long"))
    assert {r["path"]: r["body_loc"] for r in s.where("scope_id = 0").collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab(){}[]<>/=`'\"\\;:,.?!&|*+-\n ${}01ifnrwxd@#", max_size=60))
def test_any_text_is_scanned_without_failing(text):
    for path in ("a.ts", "a.tsx"):
        r = scan_typescript("function keep() {}\n" + text, path)
        assert r.loc >= 1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_read_by_every_analyzer(text):
    from scopelake.sources.analyze import analyze_text

    for path in ("a.css", "a.scss", "a.md", "a.c", "a.tsx"):
        assert analyze_text(path, text)["error"] is None


def nested(spark):
    """A file whose first child holds lines 6 and 7 and whose second does so more narrowly, and one whose own scope does not."""
    rows = [("g", "t", None, 1, 40, 0, 0), ("g", "t1", "t", 2, 20, 1, 1), ("g", "t11", "t1", 3, 5, 2, 2), ("g", "t2", "t", 5, 12, 1, 3), ("g", "t21", "t2", 6, 8, 2, 4), ("h", "u", None, 1, 5, 0, 0)]
    s = spark.createDataFrame(rows, "path string, scope_id string, parent_id string, start_line long, end_line long, depth int, preorder int")
    up = [(r[1], r[1], 0) for r in rows] + [(r[1], r[2], 1) for r in rows if r[2]] + [("t11", "t", 2), ("t21", "t", 2)]
    return s, spark.createDataFrame(up, "node string, ancestor string, distance int")


def one_shuffle(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") == 1 and "Join" not in plan and "Window" not in plan


def test_the_trail_takes_one_shuffle_of_few_scopes(spark):
    s, c = nested(spark)
    assert one_shuffle(explorer.breadcrumb_trail(s, c, 6, 7))
    assert sorted((r["path"], r["scope_id"], r["depth"]) for r in explorer.breadcrumb_trail(s, c, 6, 7).collect()) == [("g", "t", 0), ("g", "t2", 1), ("g", "t21", 2), ("h", "u", 0)]


def test_the_focused_scope_takes_one_shuffle_of_few_scopes(spark):
    s, c = nested(spark)
    assert one_shuffle(explorer.focused_scope(s, c, 6, 7))
    assert [tuple(r) for r in explorer.focused_scope(s, c, 6, 7).select("path", "scope_id").collect()] == [("g", "t1")]
