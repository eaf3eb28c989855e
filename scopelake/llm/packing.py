"""Best-fit-decreasing packing of tokenized documents into sequences of fixed capacity.

Only lengths decide a packing, and there are at most ``capacity`` different ones, so the
whole corpus is packed at once from its histogram of lengths: pieces go longest first,
each to the open bin with the least room that still holds it, found by a segment tree
over remaining capacities in logarithmic time.  Bins with the same room are one class,
and equal pieces that meet equal bins are placed together, so the work and the plan are
bounded by the capacity, not by the corpus.  The plan says, for ranks from-to among the
pieces of one length, which bins and which offsets they get.

Pieces get their rank within their length from counts per (length, bucket), with the
bucket a hash of (doc_id, piece): a length that a third of all pieces share is ranked in
``buckets`` separate groups, as many as the number of pieces asks for.  No step collects pieces.

Defined results: a null or empty text is one piece, the end id alone.  Texts of any
length are cut into pieces whole.  Pieces of one length are in the order of a hash, ties
in any order.  Repeated rows are packed once each.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scopelake.llm.common import arrow_rows, trimmed, written
from scopelake.llm.tokens import END_BYTES, bounded_slices, default_tokenizer_path, encoder

CAPACITY = 2048
#: Groups into which the pieces of one length are dealt for ranking: so many at least, and one for so many pieces.
BUCKETS, BUCKET_ROWS = 256, 100_000


class RoomTree:
    """Segment tree over remaining capacities 0..capacity: the least room >= need that some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.bins = [0] * (2 * self.leaves)

    def add(self, room: int, count: int) -> None:
        at = self.leaves + room
        while at:
            self.bins[at] += count
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Up from leaf ``need`` while nothing open lies to the right, then down to the leftmost open leaf."""
        at = self.leaves + need
        if not self.bins[at]:
            while at > 1 and (at % 2 or not self.bins[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.bins[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, pieces per bin, offset) for a histogram of lengths.

    Equals best-fit decreasing one piece at a time: while a bin just used still holds the
    piece it is the tightest, so it takes as many as fit before the next bin is touched.
    """
    tree = RoomTree(capacity)
    classes: dict[int, list[tuple[int, int]]] = {}  # room -> [(first bin, bins)]
    out, bins = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            classes.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = classes[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # one bin takes the last few
                out.append((length, rank, left, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                full, left = full + 1, 0
            keep(room, first + full, n - full)
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, on demand): documents cut only where longer than capacity."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for b in batches:
            doc, text = b.column("doc_id"), b.column("text")
            for lo, hi in bounded_slices(text):
                rows: list[list] = [[] for _ in columns]
                for d, raw in zip(doc[lo:hi].to_pylist(), coder.encode(text[lo:hi].to_pylist()), strict=True):
                    raw += END_BYTES
                    n = len(raw) // 4
                    at = 0
                    end = n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        part = raw[4 * at : 4 * end]
                        for row, x in zip(rows, (d, piece, at, end - at, zlib.crc32(part), part), strict=False):
                            row.append(x)
                        at, end = end, end + capacity
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names=columns)

    kinds = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in columns)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(cut), kinds)


def pack(cut: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """cut (a written table with doc_id, piece, length, ...) with sequence_id and offset added."""
    spark = cut.sparkSession
    buckets = buckets or max(BUCKETS, -(-cut.count() // BUCKET_ROWS))  # counted in the files' footers
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = written(dealt.groupBy("length", "_b").count(), "length-counts")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "_b", F.coalesce(before, F.lit(0)).cast("long").alias("_first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # <= capacity rows
    steps = spark.createDataFrame(plan(histogram, capacity), "length long, _rank long, _n long, _bin long, _each long, _at long")
    local = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("_local", local).join(first, ["length", "_b"])  # dealt is already partitioned so for its ranks
    ranked = ranked.withColumn("_r", F.col("_first") + F.col("_local"))
    inside = (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n"))
    # two steps a length on average, whatever the corpus: some thousand rows of 48 bytes
    placed = ranked.join(F.broadcast(steps.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & inside)
    nth = F.col("_r") - F.col("_rank")
    return placed.select(
        *cut.columns,
        (F.col("_bin") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + nth % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset."""
    with arrow_rows(docs.sparkSession):
        cut = written(pieces(docs, tokenizer_path or default_tokenizer_path(), capacity, keep_ids), "pieces")
    return pack(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces that carry ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids")
    )
