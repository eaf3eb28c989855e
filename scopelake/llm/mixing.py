"""Mixing sources to target weights by fitting each source's budget as a bounded subset sum.

1. Documents are counted by exact size (words) within each source.
2. The budget - a share of all sizes - is dealt to the sources by weight; a target stops
   at ``most`` times its source's size and the excess is dealt again by weight among the
   others, until none is above.
3. Each source takes whole passes first.  What remains is fitted on its histogram of
   sizes: a proportional part of every size, then a bounded-knapsack dynamic programme
   (reachable sums as the bits of one integer) over the unused documents closes the gap;
   a gap too wide for its bits is first closed in coarser units.
   A histogram has one row per distinct size, whatever the number of documents.
4. Documents are picked per (source, size) in the order of a seeded hash.  The hash is
   cut into ranges with counts of their own, so a size that a third of all documents
   share is picked without bringing them together: whole ranges are taken by their
   count, and only inside the one range that is cut are documents ranked.

Sources are numbered by a range sort and their targets found by aggregates, so neither
their number nor their names are bounded by the driver.

Defined results: null and blank texts have size 0; a source of size 0 has target 0 and
takes nothing.  A null source is a source of its own, the last.  Repeated rows are
documents of their own; rows of one size whose hashes tie (one doc_id) are equal to the
mix, and any of them is taken.  Texts of any length count whole.  Extra columns are
ignored (mixed_documents: kept as they are); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelake.llm.common import located, mark, write_marks, written

WEIGHTS, SHARE, MOST, SEED = (1.0, 2.0, 3.0), 1.0, 3, 17
#: Ranges of the seeded hash.
RANGES = 1024
#: An eighth of the most sums (bits) of the dynamic programme.
PROGRAMME_BITS = 1 << 17


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """source, doc_id, size (words of every whole text) and the columns keep."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), "doc_id", n.alias("size"), *keep)


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """per_source (source, n) as source, source_size, target; weights repeat over the sources by code point, null last."""
    order = F.col("source").asc_nulls_last()
    placed = per_source.repartitionByRange(order).sortWithinPartitions(order)
    placed = written(placed.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    first, seen = [], 0
    for r in placed.groupBy("_p").count().orderBy("_p").collect():  # a row per partition
        first.append((r["_p"], seen))
        seen += r["count"]
    if not seen:
        return placed.select("source", F.col("n").alias("source_size"), F.lit(0.0).alias("target"))
    offsets = F.broadcast(placed.sparkSession.createDataFrame(first, "_p int, _first long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_first") + F.col("_i")) % len(weights) + 1).cast("int"))
    w = placed.join(offsets, "_p").select("source", "n", weight.alias("w"))
    budget, total, capped = share * placed.agg(F.sum("n")).first()[0], w.agg(F.sum("w")).first()[0], 0
    left = budget

    def dealt() -> Column:
        return F.lit(float(left)) * F.col("w") / F.lit(float(total))

    while total:  # each round deals the excess again; rounds end when no further source is above
        over = dealt() > most * F.col("n")
        r = w.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("n"))).alias("size"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        if r["n"] == capped:
            break
        capped, left, total = r["n"], budget - most * (r["size"] or 0), r["w"] or 0.0
    target = F.least(dealt(), (most * F.col("n")).cast("double")) if total else (most * F.col("n")).cast("double")
    return w.select("source", F.col("n").alias("source_size"), target.alias("target"))


def subset_sum(lengths: list[int], counts: list[int], goal: int) -> list[int]:
    """How many of each length to take for the largest reachable sum <= goal (bounded knapsack).

    Each length is taken in lots of 1, 2, 4 ... of its count.  by[s] is the lot with which
    the sum s was first reached; s without that lot was reached before it, so the choice is
    read back from sum to sum, in 4 bytes a sum whatever the number of lots.
    """
    mask = (1 << (goal + 1)) - 1
    by = np.full(goal + 1, -1, np.int32)
    lots: list[tuple[int, int]] = []
    reach = 1
    for j, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count = min(count, goal // length)
        lot = 1
        while count > 0 and not reach >> goal & 1:
            k = min(lot, count)
            more = reach << (k * length) & mask & ~reach
            if more:
                bits = np.frombuffer(more.to_bytes(goal // 8 + 1, "little"), np.uint8)
                by[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(lots)
                reach |= more
            lots.append((j, k))
            count, lot = count - k, 2 * lot
    taken, at = [0] * len(lengths), reach.bit_length() - 1
    while at:
        j, k = lots[by[at]]
        taken[j] += k
        at -= k * lengths[j]
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, goal: int, bits: int = PROGRAMME_BITS) -> np.ndarray:
    """How many documents of each size (> 0) to take so that their sizes sum to goal or just below."""
    order = np.argsort(lengths)
    length, count = [int(x) for x in lengths[order]], [int(x) for x in counts[order]]
    total = sum(n * c for n, c in zip(length, count, strict=True))
    if goal >= total:
        return counts.copy()
    # an even share of the documents in order of size, short of the goal by a few of the largest
    aim, seen, had, take = goal - min(goal, bits, 4 * length[-1]), 0, 0, []
    for c in count:
        seen += c
        now = seen * aim // total
        take.append(now - had)
        had = now
    gap = goal - sum(n * t for n, t in zip(length, take, strict=True))
    for i in range(len(take) - 1, -1, -1):  # only where single documents are huge
        if gap < 0:
            less = min(take[i], -(gap // length[i]))
            take[i], gap = take[i] - less, gap + less * length[i]
    while gap > 0:
        # the programme in units that keep it within its bits, sizes rounded up; in units of one it is the last
        unit = -(-gap // (8 * bits))
        unused = [c - t for c, t in zip(count, take, strict=True)]
        more = subset_sum([-(-n // unit) for n in length], unused, gap // unit)
        if unit > 1 and not any(more):  # only rounding may keep the last one out
            best = max((i for i, n in enumerate(length) if unused[i] and n <= gap), default=None)
            more = [int(i == best) for i in range(len(length))]
        gap -= sum(n * m for n, m in zip(length, more, strict=True))
        take = [t + m for t, m in zip(take, more, strict=True)]
        if unit == 1 or not any(more):
            break
    out = np.zeros(len(lengths), np.int64)
    out[order] = take
    return out


def mix_sizes(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """sized (a written table: source, doc_id, size and more) with source_size, target, copies."""
    lot = F.pmod(F.shiftright(F.xxhash64(F.lit(seed), "doc_id"), 20), F.lit(RANGES)).cast("int")
    # partial aggregation leaves one row per task, source, size and range
    dealt = sized.withColumns({"h": F.xxhash64(F.lit(seed), "doc_id"), "lot": lot})
    cells = written(dealt.groupBy("source", "size", "lot").count(), "size-counts")
    histogram = written(cells.groupBy("source", "size").agg(F.sum("count").alias("count")), "histogram")
    by_source = written(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).cast("long").alias("n")), weights, share, most), "targets")

    def one(part: pa.Table) -> pa.Table:
        size, goal = part.column("source_size")[0].as_py(), round(part.column("target")[0].as_py())
        length, count = part.column("size").to_numpy(), part.column("count").to_numpy()
        passes, rest = divmod(goal, size) if size else (0, 0)
        if passes >= most:
            passes, rest = most, 0
        take = np.zeros(len(length), np.int64)
        some = length > 0
        if rest and some.any():
            take[some] = fit(length[some], count[some], rest)
        return part.drop_columns("count").append_column("passes", pa.array(np.full(len(length), passes))).append_column("take", pa.array(take))

    goals = histogram.join(by_source, histogram.source.eqNullSafe(by_source.source)).select(histogram.source, "source_size", "target", "size", "count")
    chosen = written(
        goals.groupBy("source").applyInArrow(one, "source string, source_size long, target double, size long, passes long, take long"), "chosen"
    )
    # of each range: all, none, or so many of its first
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source", "size").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lots = cells.withColumn("before", before).withColumnRenamed("source", "s").withColumnRenamed("size", "z")
    lots = lots.join(chosen, lots.s.eqNullSafe(chosen.source) & (F.col("z") == F.col("size"))).select(
        "s", "z", "lot", "source_size", "target", "passes", F.greatest(F.lit(0), F.least(F.col("count"), F.col("take") - F.col("before"))).alias("k"), "count"
    )
    key = dealt.source.eqNullSafe(F.col("s")) & (dealt["size"] == F.col("z")) & (dealt["lot"] == lots["lot"])
    joined = dealt.join(lots, key).drop(lots["lot"])
    sure = (F.col("k") == 0) | (F.col("k") == F.col("count"))
    columns = [*sized.columns, "source_size", "target"]
    whole = joined.where(sure).select(*columns, (F.col("passes") + (F.col("k") > 0).cast("long")).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "lot").orderBy("h", "doc_id"))
    split = joined.where(~sure).withColumn("r", rank).select(*columns, (F.col("passes") + (F.col("r") <= F.col("k")).cast("long")).alias("copies"))
    return whole.unionByName(split)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    return mix_sizes(written(sizes(docs), "sizes"), weights, share, most, seed)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; rows are found by their place, so no text shuffles."""
    placed = located(docs)
    mixed = mix_sizes(written(sizes(placed, "__file", "__row"), "sizes"), weights, share, most, seed)
    taken = mixed.where("copies > 0").select("__file", "__row", F.col("copies").cast("long").alias("copies"))
    out = mark(placed, write_marks(taken, "mix-marks"), "__copies").where("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
