"""Sections, notebooks, late rows and sketches on awkward rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scopelake.operators import deps, lines, markdown, notebooks
from scopelake.sources.analyzers.md_scan import scan_markdown
from scopelake.sources.analyzers.notebook_scan import scan_notebook
from scopelake.sources.analyzers.notebook_scan import virtual_text as text_by_hand
from scopelake.streaming import events


def sections_of(spark, text):
    d = spark.createDataFrame([(1, text)], "k long, text string")
    n = d.select("k", F.size(F.split("text", "\n")).alias("n_lines"))
    found = markdown.sections(markdown.headings(lines.exploded(d, "k"), "k"), n, "k")
    return sorted((r["line_no"], r["end_line"], r["title"], r["parent"]) for r in found.collect())


def by_hand(text):
    out = []

    def walk(s, above):
        if s.origin_type == "markdown_section":
            out.append((s.start_line, s.end_line, s.name, above))
            for c in s.children:
                walk(c, s.start_line)

    for s in scan_markdown(text).scopes:
        walk(s, None)
    return sorted(out)


@pytest.mark.parametrize(
    "text",
    [
        "# A\n\ntext\n## B\n```py\n# no\n~~~\n```\n### C ###\n# D\n#\tE\n####### none\n#none",
        "Title\n=====\n\nmore\n----\n~~~\n# in\n``` \n~~~~\n## Out\n````\n# in\n```\n# still\n````\n# last",
        "```\n# never closed\n# still in",
        "no heading",
        "   ## three spaces\n    # code\n> quote\n===\n\n===\n# x\n---\n",
        "",
    ],
)
def test_sections(spark, text):
    assert sections_of(spark, text + "\nend") == by_hand(text + "\nend")


def test_sections_of_random_levels(spark):
    rng = random.Random(1)
    text = "\n".join(rng.choice(["#" * rng.randrange(1, 7) + f" h{i}", "text", "", "```"]) for i in range(300)) + "\nend"
    assert sections_of(spark, text) == by_hand(text)


NOTEBOOKS = [
    {"cells": [{"cell_type": "code", "source": ["a = 1\n", "\n", "b = 2"]}, {"cell_type": "markdown", "source": "[1, 2]\ntext\r\nmore end"}, {"cell_type": "raw", "source": ""}, {"cell_type": "code"}, {"cell_type": "code", "source": []}]},
    {"cells": [{"cell_type": "code", "source": '["x"]', "outputs": ["never\nread"]}, {"cell_type": "code", "source": [" \n", "\tz\n"]}]},
    {"cells": []}, {},
]


def test_notebooks(spark):
    rows = [(i, json.dumps(n)) for i, n in enumerate(NOTEBOOKS)] + [(9, "no json"), (10, None)]
    d = spark.createDataFrame(rows, "k long, text string")
    got = sorted((r["k"], r["name"], r["start_line"], r["end_line"]) for r in notebooks.notebook_cells(d, "k").collect())
    assert got == sorted((i, s.name, s.start_line, s.end_line) for i, n in enumerate(NOTEBOOKS) for s in scan_notebook(json.dumps(n)).scopes)
    texts = {r["k"]: r["t"] for r in d.select("k", notebooks.virtual_text(F.col("text")).alias("t")).collect()}
    assert [texts[i] for i in range(4)] == [text_by_hand(json.dumps(n)) for n in NOTEBOOKS] and texts[9] is texts[10] is None
    assert "Python" not in notebooks.notebook_cells(d, "k")._jdf.queryExecution().executedPlan().toString()
    unnamed = spark.createDataFrame([(1, '{"cells": [{"source": "x"}]}')], "k long, text string")
    assert notebooks.notebook_cells(unnamed, "k").first()["name"] == "[cell] cell 1"


def test_late_rows_are_dropped_and_a_restart_writes_each_window_once(spark, tmp_path):
    e = lambda *rows: spark.createDataFrame([(f"2024-01-01 {t}", k, 1.0) for t, k in rows], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    put = lambda df: df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: events.closed_windows(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c")
    rows = [("01:10:00", "a"), ("01:20:00", "a"), ("06:30:00", "b")]
    put(e(*rows))
    run()
    shown = lambda: sorted((str(r["start"])[11:16], r["event_type"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert shown() == [("01:00", "a", 2)]
    assert run()["rows"] == 0 and shown() == [("01:00", "a", 2)]  # nothing is new
    more = [("01:30:00", "a"), ("05:00:00", "a"), ("03:30:00", "a")]  # the watermark is 04:30: the first and the last are late
    put(e(*more))
    run()
    every = spark.read.parquet(f"{tmp_path}/in")
    put(events.closing_event(every))
    run()
    assert shown() == [("01:00", "a", 2), ("05:00", "a", 1), ("06:00", "b", 1)]
    late = events.late_rows(e(*rows, *more), spark.read.parquet(f"{tmp_path}/out")).first()
    assert (late["read"], late["kept"], late["dropped"]) == (6, 4, 2)


def test_sketches_merge(spark):
    edges = spark.range(200_000).select(F.concat(F.lit("t"), F.col("id") % 7).alias("target"), F.concat(F.lit("s"), F.floor(F.col("id") / 3) % 20_000).alias("source"))
    s = deps.fan_in_sketches(edges).withColumn("path", F.concat_ws("/", F.lit("top"), F.col("target")))
    got = {r["path"]: r["fan_in"] for r in deps.merged_fan_in(s, "path").collect()}
    exact = {r["target"]: r["n"] for r in edges.groupBy("target").agg(F.count_distinct("source").alias("n")).collect()}
    assert all(abs(got[f"top/{t}"] - n) <= deps.SKETCH_ERROR * n for t, n in exact.items())
    assert abs(got["top"] - 20_000) <= deps.SKETCH_ERROR * 20_000
