"""Sweeps: what was last or smallest at a place, by sorted streams and blocks instead of joins on ranges.

No step makes a row for every pair of a point and what lies before or around it, and no
key is one task: streams are cut into buckets of their order, with what each bucket ends
with carried on to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopelake.functions.storage import written
from scopelake.operators.rank import all_ranked

#: About how many points a bucket takes.
BUCKET_ROWS = 100_000
#: Blocks up to whose number they are broadcast (some 4 MB): those of the upper levels.
FEW_BLOCKS = 1 << 16


def asof(points: DataFrame, events: DataFrame, keys: list[str], order: str, value: str, width: int, strict: bool = False) -> DataFrame:
    """points with ``found``, the value of the last event of their keys at or before them (strict: before them).

    ``width`` is the span of a bucket in units of ``order``; keys are not null.  Of equal
    orders the greatest value is the last.  Each bucket is one sorted stream with a running
    last value; buckets of a key exchange one row each.
    """
    at_once = 1 if strict else 0
    none = F.lit(None).cast(events.schema[value].dataType)
    e = events.select(*keys, order, F.lit(at_once).alias("_side"), F.col(value).alias("_v"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_p"))
    p = points.select(*keys, order, F.lit(1 - at_once).alias("_side"), none.alias("_v"), F.struct("*").alias("_p"))
    both = e.unionByName(p).withColumn("_b", F.floor(F.col(order) / width))
    w = Window.partitionBy(*keys, "_b").orderBy(order, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(order, "_v"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry")).where("_carry IS NOT NULL")
    run = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_p IS NOT NULL")
    return run.join(carried, [*keys, "_b"], "left").select("_p.*", F.coalesce("_v", "_carry").alias("found"))


def bucket_width(points: DataFrame, order: str) -> int:
    """A width that gives evenly spread points about BUCKET_ROWS a bucket."""
    low, high, n = points.agg(F.min(order), F.max(order), F.count("*")).first()
    return max(1, int((high - low) * BUCKET_ROWS / n)) if n and high is not None else 1


def blocks(low: str, high: str, levels: int):
    """(level, block) of the binary blocks that together are [low, high): at most two a level."""

    def of(k):
        two = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, last = F.ceil(F.col(low) / two), F.floor(F.col(high) / two)
        at = lambda block, holds: F.when((first < last) & holds, F.struct(k.alias("level"), block.alias("block")))
        return F.array(at(first, first % 2 == 1), at(last - 1, last % 2 == 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)))


def smallest_enclosing(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """points with the innermost span (start, end, span_id) of the same key that holds them; others go.

    Innermost: the latest start, then the earliest end, then the larger id.  The places where
    the answer can change - starts, and those after ends - are numbered by a range sort.  A
    span covers a run of these numbers, cut into binary blocks; a block keeps its best span
    only, and each place takes the best of the blocks above it.  Points then look up the
    last place before them.  Rows are linear in points plus spans times the levels, however
    many spans hold a point.
    """
    s = spans.select(F.col(key).alias("_k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "span_id").where("start <= end AND _k IS NOT NULL")
    ends = s.select("_k", F.col("start").alias("_x")).union(s.select("_k", (F.col("end") + 1).alias("_x"))).distinct()
    places = all_ranked(ends, "_x", by="_k")
    n = places.count()
    numbered = s.join(places.withColumnsRenamed({"_x": "start", "rank": "_low"}), ["_k", "start"]).withColumn("_x", F.col("end") + 1)
    numbered = numbered.join(places.withColumnRenamed("rank", "_high"), ["_k", "_x"])
    size = F.struct("start", (-F.col("end")).alias("e"), "span_id")
    best = numbered.select(F.explode(blocks("_low", "_high", max(1, n).bit_length())).alias("b"), size.alias("s"))
    best = best.groupBy("b.level", "b.block").agg(F.max("s").alias("s"))
    levels = range(max(1, n).bit_length() + 1)
    upper = next(k for k in levels if n >> k <= FEW_BLOCKS // 2)  # the blocks of all levels from there on are at most FEW_BLOCKS
    if upper:
        best = written(best, "blocks")
    over = places.select("rank", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    over = over.withColumn("block", F.expr("shiftright(rank, level)"))
    found = over.where(F.col("level") >= upper).join(F.broadcast(best.where(F.col("level") >= upper)), ["level", "block"])
    if upper:
        found = found.unionByName(over.where(F.col("level") < upper).join(best.where(F.col("level") < upper), ["level", "block"]))
    cover = places.join(found.groupBy("rank").agg(F.max("s").alias("s")), "rank", "left")
    # a place that no span covers ends what was before it
    events = cover.select(F.col("_k").alias(key), F.col("_x").alias(at), F.struct(F.col("s").isNotNull().alias("held"), "s").alias("s"))
    held = asof(points.where(F.col(key).isNotNull() & F.col(at).isNotNull()), events, [key], at, "s", bucket_width(points, at))
    return held.where("found.held").select(*points.columns, F.col("found.s.span_id").alias("span_id"))
