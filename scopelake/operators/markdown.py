"""Sections of Markdown texts from their lines: fences, headings, and what each heading holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What opens and closes a fence, a heading by signs, a heading by a line below it.
FENCE, ATX, UNDERLINE = r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$", r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", r"^ {0,3}(=+|-+)[ \t]*$"
LEVELS = range(1, 7)


def fences(lines: DataFrame, key: str) -> DataFrame:
    """key, start_line, end_line of fenced blocks; end_line is null for one that never closes.

    lines: key, line_no, line.  Only lines that look like fences are brought together per
    text; a block closes with the sign it was opened with, at least as often and alone.
    """
    mark = F.regexp_extract("line", FENCE, 1)
    seen = lines.where(F.col("line").rlike(FENCE)).select(key, F.struct("line_no", mark.alias("mark"), (F.regexp_extract("line", FENCE, 2) == "").alias("bare")).alias("f"))
    marks = seen.groupBy(key).agg(F.sort_array(F.collect_list("f")).alias("f"))
    closed = "aggregate(f, named_struct('at', cast(null as long), 'mark', '', 'made', cast(array() as array<struct<start_line:long,end_line:long>>)), "
    # an open block (at) waits for its closing line; any other fence line inside is text
    step = (
        "(s, x) -> case when s.at is null then named_struct('at', cast(x.line_no as long), 'mark', x.mark, 'made', s.made) "
        "when x.bare and left(x.mark, 1) = left(s.mark, 1) and length(x.mark) >= length(s.mark) then named_struct('at', cast(null as long), 'mark', '', 'made', array_append(s.made, named_struct('start_line', s.at, 'end_line', cast(x.line_no as long)))) "
        "else s end, "
    )
    last = "s -> case when s.at is null then s.made else array_append(s.made, named_struct('start_line', s.at, 'end_line', cast(null as long))) end)"
    return marks.select(key, F.explode(F.expr(closed + step + last)).alias("b")).select(key, "b.*")


def outside_fences(lines: DataFrame, key: str) -> DataFrame:
    """lines that no fenced block holds, its own fences included."""
    f = fences(lines, key)
    steps = f.select(key, F.col("start_line").alias("line_no"), F.lit(1).alias("_s")).unionByName(f.where("end_line IS NOT NULL").select(key, (F.col("end_line") + 1).alias("line_no"), F.lit(-1).alias("_s")))
    steps = steps.groupBy(key, "line_no").agg(F.sum("_s").alias("_s"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.sum("_s").over(w), F.lit(0))
    return lines.join(steps, [key, "line_no"], "left").withColumn("_in", inside).where("_in = 0").drop("_in", "_s")


def headings(lines: DataFrame, key: str) -> DataFrame:
    """key, line_no, level, title of headings outside fences: by signs, or by a line below a line of text."""
    w = Window.partitionBy(key).orderBy("line_no")
    text = F.lag("line").over(w)
    near = F.lag("line_no").over(w) == F.col("line_no") - 1
    plain = text.rlike(r"\S") & ~text.rlike(ATX) & ~text.rlike(r"^ {0,3}>|^(?: {4}|\t)") & ~text.rlike(UNDERLINE)
    h = outside_fences(lines, key).withColumns({"_text": text, "_plain": F.coalesce(near & plain, F.lit(False))})
    atx, below = F.col("line").rlike(ATX), F.col("line").rlike(UNDERLINE) & F.col("_plain")
    level = F.when(atx, F.length(F.regexp_extract("line", ATX, 1))).otherwise(F.when(F.col("line").contains("="), 1).otherwise(2))
    title = F.when(atx, F.trim(F.concat_ws(" ", F.regexp_extract("line", ATX, 1), F.regexp_extract("line", ATX, 2)))).otherwise(F.trim("_text"))
    at = F.when(atx, F.col("line_no")).otherwise(F.col("line_no") - 1)
    return h.where(atx | below).select(key, at.alias("line_no"), level.alias("level"), title.alias("title"))


def sections(found: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """key, line_no, level, title, end_line, parent of headings; lengths: key, n_lines.

    A section ends before the next heading of its level or a higher one; its parent is the
    last heading of a higher level.  One running last per level, forwards and backwards.
    """
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k, w: F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(w)
    parent = F.greatest(*[F.when(F.col("level") > k, last(k, before)) for k in LEVELS])
    following = F.least(*[F.when(F.col("level") >= k, last(k, after)) for k in LEVELS])
    s = found.withColumns({"parent": parent, "_next": following}).join(lengths, key)
    return s.select(key, "line_no", "level", "title", F.greatest(F.col("line_no"), F.coalesce(F.col("_next") - 1, F.col("n_lines"))).alias("end_line"), "parent")
