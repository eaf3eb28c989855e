"""Operators over the lines of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelake.functions.text import INK, has_ink


def exploded(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 1), line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "line")).select(key, (F.col("_n") + 1).alias("line_no"), "line")


def line_metrics(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per text: lines, those with ink, the longest, and those that open with a comment sign; no shuffle."""
    ls = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return docs.withColumn("_l", ls).select(
        *[c for c in docs.columns if c != text],
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", has_ink)).cast("long").alias("loc"),
        F.array_max(F.transform("_l", lambda x: F.length(x))).cast("long").alias("longest_line"),
        F.size(F.filter("_l", lambda x: x.rlike("^[ \t]*(#|//)"))).cast("long").alias("comment_lines"),
    )


def duplicate_strings(strings: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_duplicated: distinct strings that a key holds more than once."""
    return strings.groupBy(key, text).count().groupBy(key).agg(F.count_if(F.col("count") > 1).alias("n_duplicated"))


def runs_of(lines: DataFrame, key: str, holds: Column) -> DataFrame:
    """key, start_line, end_line, n: runs of lines that hold, blank lines between them not counting against.

    lines: key, line_no, line.  A run ends at the first inked line that does not hold.
    """
    inked = lines.where(F.col("line").rlike(INK)).withColumn("_ok", holds)
    w = Window.partitionBy(key).orderBy("line_no")
    breaks = F.sum((~F.col("_ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = inked.withColumn("_run", breaks).where("_ok")
    return kept.groupBy(key, "_run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n")).drop("_run")


def largest_run(runs: DataFrame, key: str) -> DataFrame:
    """Of each key the run with the most lines, the first of them on ties."""
    first = Window.partitionBy(key).orderBy(F.desc("n"), "start_line")
    return runs.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def common_indent(docs: DataFrame, key: str, text: str = "text", keep: int = 2) -> DataFrame:
    """key, indent (least leading white space of inked lines), cut (what to take off, leaving keep)."""
    inked = F.filter(F.split(text, "\n"), has_ink)
    least = F.array_min(F.transform(inked, lambda x: F.length(F.regexp_extract(x, "^([ \t]*)", 1))))
    d = docs.select(key, F.coalesce(least, F.lit(0)).cast("long").alias("indent"))
    return d.withColumn("cut", F.greatest(F.lit(0), F.col("indent") - keep).cast("long"))


def display_slice(docs: DataFrame, key: str, start: Column, end: Column, offset: int = 0, text: str = "text") -> DataFrame:
    """key, first, last, shown: lines start - offset to end + offset, clamped; the whole text if inverted."""
    d = docs.withColumn("_l", F.split(text, "\n")).withColumns({"_n": F.size("_l"), "_a": start - offset, "_b": end + offset})
    ok = (F.col("_a") <= F.col("_b")) & (start <= end)
    d = d.withColumn("first", F.when(ok, F.least(F.greatest(F.col("_a"), F.lit(1)), F.col("_n"))).otherwise(1))
    d = d.withColumn("last", F.when(ok, F.least(F.greatest(F.col("_b"), F.lit(1)), F.col("_n"))).otherwise(F.col("_n")))
    shown = F.array_join(F.slice("_l", F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int")), "\n")
    return d.select(key, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), shown.alias("shown"))


def virtual_lines(cells: DataFrame, notebook: str, index: str, n: str) -> DataFrame:
    """cells with start_line and end_line, laid end to end by their counts."""
    w = Window.partitionBy(notebook).orderBy(index)
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("start_line", (before + 1).cast("long")).withColumn("end_line", (before + F.col(n)).cast("long"))
