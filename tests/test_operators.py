from pyspark.sql import functions as F

from scopelake.functions import text as T
from scopelake.operators import deps, flow, lines, rank, tree


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect())) if cols else sorted(map(tuple, df.collect()))


def test_score_divides_by_positive_weights_only(spark):
    n = spark.createDataFrame([("a", 10, 0), ("b", 5, 4), ("c", 0, 0)], "p string, x long, y long")
    s = rank.with_score(n, {"x": 2.0, "y": 1.0})
    assert rows(s, "p", "raw_score") == [("a", 1.0), ("b", (0.5 * 2 + 1) / 3)]


def test_ranks_are_a_permutation(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("score"))
    r = rank.all_ranked(df, "id").toPandas().sort_values("rank")
    assert list(r["rank"]) == list(range(1, 1001))
    assert list(r["score"]) == sorted(r["score"], reverse=True)


def test_findings_take_the_first_of_path_and_category(spark):
    r = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "x", 0.8, 2), ("a", "y", 0.5, 3), ("b", "x", 0.1, 4)], "path string, category string, score double, rank int")
    assert rows(rank.findings(r, 2), "id", "path", "category", "priority") == [("finding-001", "a", "x", "high"), ("finding-002", "a", "y", "medium")]


def test_rollup_root_is_the_sum_of_files(spark):
    f = spark.createDataFrame([("r/a/1", 1, 2.0), ("r/a/2", 2, 5.0), ("r/b/c/3", 4, 1.0)], "path string, loc long, complexity double")
    assert rows(tree.rollup(f, ["loc"], ["complexity"]), "path", "loc", "complexity") == [("r", 7, 5.0), ("r/a", 3, 5.0), ("r/b", 4, 1.0), ("r/b/c", 4, 1.0)]


def test_closures_agree(spark):
    e = spark.createDataFrame([(str(i), str(i // 2) if i else None) for i in range(40)], "node string, parent string").where("node <> parent OR parent IS NULL")
    assert rows(tree.closure(e), "node", "ancestor", "distance") == rows(tree.fixed_closure(e, 7), "node", "ancestor", "distance")


def test_interval_union(spark):
    s = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 9, 9), ("k", 3, 4), ("e", 5, 4)], "key string, start_line long, end_line long")
    assert rows(tree.interval_union(s)) == [("e", 0), ("k", 6)]


def test_resolution_hoisted_and_ordered(spark):
    closed = spark.createDataFrame([("g", "g", 0), ("f", "f", 0), ("f", "g", 1)], "node string, ancestor string, distance int")
    defs = spark.createDataFrame([("g", "x", "d1", 1), ("f", "x", "d2", 5)], "scope string, name string, def_id string, preorder int")
    u = spark.createDataFrame([("u1", "f", "x", 3), ("u2", "f", "x", 9), ("u3", "f", "y", 9)], "usage_id string, scope string, name string, preorder int")
    assert rows(flow.resolve_hoisted(u, closed, defs.drop("preorder")), "usage_id", "def_id") == [("u1", "d2"), ("u2", "d2"), ("u3", None)]
    assert rows(flow.resolve_ordered(u, closed, defs), "usage_id", "def_id") == [("u1", "d1"), ("u2", "d2"), ("u3", None)]


def test_candidates_in_order(spark):
    paths = ["a/docs.ts", "a/docs.service.ts", "b/index.tsx", "s/index.tsx"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    imports = spark.createDataFrame([("1", "a/docs.service"), ("2", "b"), ("3", "s/index.css"), ("4", "none")], "import_id string, t string")
    found = deps.resolve(imports, files, deps.candidates(F.col("t")))
    assert rows(found, "import_id", "resolved") == [("1", "a/docs.ts"), ("2", "b/index.tsx"), ("3", None), ("4", None)]


def test_aliases(spark):
    s = spark.createDataFrame([("@x/a/b",), ("@x",), ("y",)], "specifier string")
    a = spark.createDataFrame([(0, "@x/*", ["src/*", "lib"]), (1, "@x", ["m.ts"])], "ord int, pattern string, targets array<string>")
    assert rows(deps.expand_aliases(s, a), "specifier", "target") == [("@x", "m.ts"), ("@x/a/b", "lib/a/b"), ("@x/a/b", "src/a/b")]


def test_symbol_edges_and_fallback(spark):
    exports = spark.createDataFrame([("f", "a", "f::a"), ("f", "b", "f::b")], "file string, name string, export_id string")
    imports = spark.createDataFrame([("i", "f", ["a", "zz"]), ("j", "f", []), ("k", "f", ["zz"])], "importer string, resolved string, symbols array<string>")
    assert rows(deps.symbol_edges(imports, exports), "source", "target") == [("f::a", "i"), ("f::a", "j"), ("f::b", "j")]


def test_codes_are_unique():
    assert deps.assign_codes([("a", ["AB"]), ("b", ["AB", "AC"]), ("c", ["AB"])]) == {"a": "AB", "b": "AC", "c": "C1"}


def test_text_functions(spark):
    d = spark.createDataFrame([("x",)], "t string")
    one = lambda c: d.select(c.alias("r")).first()["r"]
    assert one(T.collapsed_path(F.lit("a/./b/../c//d"))) == "a/c/d"
    assert one(T.label_of_path(F.lit("p/index.ts"))) == "p/index.ts" and one(T.label_of_path(F.lit("p/a.ts"))) == "a.ts"
    assert one(T.percent_g(F.lit(2.0))) == "2" and one(T.percent_g(F.lit(2.5))) == "2.5"
    assert one(T.mime_label(F.lit("data:image/png;base64,AA"))) == "image/png;base64"
    assert one(T.scope_header(F.lit("\n\n .a   b { x"))) == ".a b"
    assert one(T.suffix(F.lit("a/B.TS"))) == ".ts" and one(T.suffix(F.lit("abc"))) is None
    assert one(T.language(F.lit("x.scss"))) == "scss"
    assert T.path_filter("\\src\\a") == "src/a/" and T.path_filter("/a/b.ts") == "a/b.ts" and T.path_filter(".agents/") == ".agents/"


def test_display_slice_and_indent(spark):
    d = spark.createDataFrame([(1, "    a\n      b\n\n    c")], "k int, text string")
    assert rows(lines.common_indent(d, "k")) == [(1, 4, 2)]
    assert rows(lines.display_slice(d, "k", F.lit(2), F.lit(2))) == [(1, 2, 2, "      b")]
    assert rows(lines.display_slice(d, "k", F.lit(3), F.lit(1)), "first", "last") == [(1, 4)]


def test_graph_filters(spark):
    n = spark.createDataFrame([("a", "file", None), ("b", "file", None), ("b::x", "export", "b"), ("r", "external", None), ("c", "file", None)], "id string, type string, parent string")
    e = spark.createDataFrame([("a", "b"), ("b::x", "a"), ("a", "r")], "source string, target string")
    assert rows(deps.without_externals(n, e)[1], "source", "target") == [("a", "b"), ("b::x", "a")]
    assert rows(deps.without_exports(n, e)[1], "source", "target") == [("a", "b"), ("a", "r")]
    assert rows(deps.with_exports(n, e)[1], "source", "target") == [("a", "r"), ("b::x", "a")]
    assert rows(deps.only_imported(n, e, "c")[0], "id") == [("a",), ("b",), ("b::x",), ("c",), ("r",)]
