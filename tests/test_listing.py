"""Pruned listings as a data source; ignore patterns as a table."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from scopelake.sources import ignore, trees
from scopelake.sources.tree_source import TreeReader, scan


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    paths = ["a.ts", ".env", "node_modules/x/y.ts", "src/build/z.ts", ".hidden/q.ts", "other/o.ts"]
    paths += [f"src/p{i}/q{k}/f{n}.ts" for i in range(6) for k in range(3) for n in range(2)]
    for p in paths:
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_text(p)
    return top


def walked(reader):
    return [sorted(p for b in reader.read(part) for p in b.column("path").to_pylist()) for part in reader.partitions()]


def listed(monkeypatch):
    seen, entries = [], trees._entries
    monkeypatch.setattr(trees, "_entries", lambda fs, folder: (seen.append(folder), entries(fs, folder))[1])
    return seen


def test_one_huge_folder_is_many_tasks(root):
    parts = walked(TreeReader({"root": str(root), "tasks": "12"}))
    assert len(parts) == 12 and sum(len([p for p in x if p.startswith("src/")]) > 0 for x in parts) >= 6
    assert sorted(p for x in parts for p in x) == sorted(["a.ts", ".env", ".hidden/q.ts", "other/o.ts"] + [f"src/p{i}/q{k}/f{n}.ts" for i in range(6) for k in range(3) for n in range(2)])
    assert len(walked(TreeReader({"root": str(root), "tasks": "1"}))) == 1


@pytest.mark.parametrize("tasks", ["1", "5", "1000"])
def test_pruned_folders_are_never_listed(root, monkeypatch, tasks):
    seen = listed(monkeypatch)
    walked(TreeReader({"root": str(root), "tasks": tasks, "dot_dirs": "false"}))
    assert seen and not [f for f in seen if any(x in f.split("/") for x in ("node_modules", "build", ".hidden"))]


@pytest.mark.parametrize("pushed,most", [(EqualTo(("path",), "src/p1/q2/f0.ts"), 4), (StringStartsWith(("path",), "src/p1/"), 6), (In(("path",), ("a.ts", "other/o.ts")), 2)])
def test_filters_prune_folders(root, monkeypatch, pushed, most):
    seen = listed(monkeypatch)
    reader = TreeReader({"root": str(root), "tasks": "1"})
    assert list(reader.pushFilters([pushed])) == [pushed]
    (found,) = walked(reader)
    assert len(seen) <= most and found


def test_scan(spark, root):
    df = scan(spark, str(root), tasks=7)
    assert df.rdd.getNumPartitions() == 7
    assert df.count() == 40 and df.where("path = 'src/p1/q2/f0.ts'").count() == 1
    assert df.where(F.col("path").startswith("src/p3/")).count() == 6
    assert {r["file_size"] for r in df.where("path = 'other/o.ts'").collect()} == {10}


FILES = [
    ("", "*.log\n# no\n\n/build\nsrc/gen\nkeep?.t*\n!important.log\ntmp/\nname with space \n\\!odd\n"),
    ("src", "!*.log\ngen/\n/only\ndeep/**/x.ts\nsub/k*.ts\nimp*t.log\n*.min.js\n[ab].ts\n**/z\n"),
    ("src/sub", "a.ts\n!b.ts\n*~\n"),
    ("we[i]rd", "a.ts\n*.log\n"),
]


def test_patterns_as_a_table_equal_one_by_one(spark):
    rng = random.Random(4)
    names = ["a.ts", "b.ts", "c.log", "important.log", "build", "gen", "tmp", "only", "deep", "x.ts", "z", "m.min.js", "n~", "keep1.ts", "keep2", "name with space", "!odd", ".log", "we[i]rd", "weird"]
    paths = {"/".join(rng.choice(["src", "sub", "we[i]rd", "weird", *names]) for _ in range(rng.randrange(0, 4))) for _ in range(600)}
    paths = sorted({f"{p}/{rng.choice(names)}".lstrip("/") for p in paths} | {f"src/{rng.choice(['sub/', ''])}{n}" for n in names} | set(names))
    p = spark.createDataFrame([(x,) for x in paths], "path string")
    files = spark.createDataFrame([(f"{f}/.gitignore".lstrip("/"), c) for f, c in FILES], "path string, content string")
    want = p.where(trees.git_ignored(F.col("path"), trees.ignore_patterns(FILES)))
    got = ignore.ignored(p, ignore.ignore_lines(files))
    assert sorted(r["path"] for r in got.collect()) == sorted(r["path"] for r in want.collect())
    kinds = {r["kind"] for r in ignore.patterns(ignore.ignore_lines(files)).collect()}
    assert kinds == {"path", "name", "suffix", "head", "glob"}


def test_the_plan_does_not_grow_with_the_patterns(spark):
    p = spark.createDataFrame([("a/b.ts",)], "path string")

    def size(n):
        lines = spark.range(n).select(F.lit("").alias("folder"), F.col("id").alias("n"), F.concat(F.lit("name"), "id").alias("line"))
        return len(ignore.ignored(p, lines)._jdf.queryExecution().optimizedPlan().toString())

    assert abs(size(10_000) - size(10)) < 200


def test_repeated_lines_meet_a_path_once(spark):
    lines = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "").otherwise("src").alias("folder"), F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "*.ts").when(F.col("id") % 3 == 1, "src/a.ts").otherwise("k?.ts").alias("line"))
    table = ignore.patterns(lines)
    assert ignore.distinct_patterns(table).count() == 6  # a name's glob, a path and a suffix for each of both folders
    got = ignore.deciding(spark.createDataFrame([("src/a.ts",), ("a.ts",), ("k1.ts",), ("src/k1.ts",), ("b.md",)], "path string"), table)
    assert sorted(map(tuple, got.collect())) == [("a.ts", "", 4998, False), ("k1.ts", "", 4998, False), ("src/a.ts", "src", 4995, False), ("src/k1.ts", "src", 4997, False)]
