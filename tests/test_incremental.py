"""A refreshed analysis equals one from scratch, and only changed files are analyzed again."""

import os

import pytest
from pyspark.sql import functions as F

from scopelake.engine import Engine
from scopelake.operators import incremental
from scopelake.sources.cache import Cache

FILES = {
    "a.py": "def f(x):\n    return x\n",
    "src/b.py": "def g(x):\n    if x:\n        return 1\n    return 2\n",
    "src/deep/c.py": "def h(x):\n    for y in x:\n        if y:\n            return y\n    return 0  # TODO\n",
    "src/deep/d.py": "x = 1\n",
    "src/bad.py": "broken(",
    "docs/e.md": "# T\n\ntext\n",
}


def put(root, name, text, time=None):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    if time:
        os.utime(p, (time, time))


def shown(nodes):
    return sorted(repr(r.asDict()) for r in nodes.collect())


@pytest.fixture
def tree(tmp_path):
    for n, t in FILES.items():
        put(tmp_path / "t", n, t, 1_000_000_000)
    return tmp_path / "t"


def test_refresh(spark, tree, tmp_path):
    e = Engine(spark, str(tree), str(tmp_path / "cache"))
    assert shown(e.nodes()) == shown(Engine(spark, str(tree)).nodes()) and e.refreshed == {"added": 6}
    e.refresh()
    assert e.refreshed == {"same": 6} and e.cache.version() == 1
    put(tree, "src/deep/c.py", "def h(x):\n    return x\n")  # the folder's maximum goes
    put(tree, "src/b.py", FILES["src/b.py"], 2_000_000_000)  # another time only
    put(tree, "new/n.py", "def n():\n    pass\n")
    put(tree, "src/bad.py", "y = 1\n")
    (tree / "docs/e.md").unlink()
    e.refresh()
    assert e.refreshed == {"same": 2, "touched": 1, "changed": 2, "added": 1, "removed": 1}
    assert shown(e.nodes()) == shown(Engine(spark, str(tree)).nodes())
    # only files that changed were analyzed again
    assert sorted(r["path"] for r in spark.read.parquet(f"{tmp_path}/cache/rows/version=2").collect()) == ["new/n.py", "src/bad.py", "src/deep/c.py"]
    again = Engine(spark, str(tree), str(tmp_path / "cache"))  # another session
    assert shown(again.nodes()) == shown(e.nodes()) and again.refreshed == {}
    before = shown(again.nodes())
    again.release()
    e.release()
    e.cache.compact()
    assert shown(e.nodes()) == before and sorted(p.name for p in (tmp_path / "cache/rows").iterdir()) == ["version=3"]
    (tree / "a.py").unlink()
    e.refresh()
    assert shown(e.nodes()) == shown(Engine(spark, str(tree)).nodes())


def test_a_refresh_that_failed_does_not_count(spark, tree, tmp_path, monkeypatch):
    c = Cache(spark, str(tree), str(tmp_path / "cache"))
    c.refresh()
    put(tree, "src/deep/d.py", "x = 2\ny = 3\n")
    write = Cache._write

    def failing(self, df, kind, version):
        if kind == "folders":
            raise OSError("gone")
        return write(self, df, kind, version)

    monkeypatch.setattr(Cache, "_write", failing)
    with pytest.raises(OSError):
        c.refresh()
    monkeypatch.setattr(Cache, "_write", write)
    assert c.version() == 1 and {r["path"]: r["loc"] for r in c.rows().collect()}["src/deep/d.py"] == 1
    assert c.refresh()["changed"] == 1 and {r["path"]: r["loc"] for r in c.rows().collect()}["src/deep/d.py"] == 2


def test_untouched_folders_are_not_looked_into(spark):
    """Maxima of folders beside the change come from their rows, even where those are wrong."""
    rows = spark.createDataFrame([("a/x/1", 1, 5, 1), ("a/y/2", 2, 9, 1), ("b/3", 3, 7, 1)], "path string, loc long, top long, file_count long")
    sums, maxima = ["loc", "file_count"], ["top"]
    marked = incremental.folder_table(rows, sums, maxima).withColumn("own_top", F.when(F.col("path") == "a/y", 100).otherwise(F.col("own_top")))
    gone, fresh = rows.where("path = 'a/x/1'"), rows.where("path = 'a/x/1'").withColumns({"loc": F.lit(10).cast("long"), "top": F.lit(6).cast("long")})
    now = rows.where("path <> 'a/x/1'").unionByName(fresh)
    got = {r["path"]: (r["loc"], r["top"]) for r in incremental.refreshed_folders(marked, gone, fresh, now, sums, maxima).collect()}
    assert got == {"": (15, 100), "a": (12, 100), "a/x": (10, 6), "a/y": (2, 9), "b": (3, 7)}
