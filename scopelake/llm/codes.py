"""Vector code compression: every part of a vector becomes the number of its codebook's nearest entry.

Vectors are cut into ``parts`` equal consecutive parts, each with a codebook of its own.
Codebooks start as the parts of the vectors of the smallest ids.  In each round the
codebooks go to the tasks as kd-trees (at most ``entries`` leaves each, so their size
depends on the width of a vector only); every part is assigned by branch and bound, and
sums and counts per entry are added in the tasks, then by a shuffle of a row per entry
and component, and become the new entries.  Rows never shuffle.

Search.  A node knows the box around its entries.  It is visited where the box is no
farther than the best distance so far - equally far too, since it may hold an entry of
the same distance and a lower index - nearer child first.  All parts of a batch descend
together as index sets.

Numbers.  Components are whole and exact at any size: 64-bit integers where no sum of
squares can pass 2**63, integers of any size for the rows beyond.  Sums travel as pieces
of 30 bits, as many as the largest component and the number of rows can need.

Defined results: a vector that is null, empty, holds null or non-finite components, or
whose length differs from the most frequent one takes no part.  A length that ``parts``
does not divide is filled up with zeros.  With fewer vectors than entries a codebook has
one entry per vector.  A null vec_id comes last among the smallest; equal ids are in the
order of their vectors.  Repeated rows are coded once each.  An error beyond a long counts
as the greatest long.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelake.llm.common import written
from scopelake.llm.vectors import MOST, integers, matrix, whole

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a leaf of a tree; rows that descend together.
LEAF, ROWS = 8, 8192
#: Bits of a piece of a sum.
BITS = 30
#: Labels whose sums are broadcast (at most 8 MB with long labels of 64 bytes); beyond, they are joined with salts.
FEW_LABELS, SALTS = 100_000, 64


class Tree:
    """A kd-tree over the entries of one codebook, split at the middle of the widest dimension."""

    def __init__(self, entries: list[list[int]], at: list[int] | None = None):
        self.at = list(range(len(entries))) if at is None else at
        own = [entries[i] for i in self.at]
        self.low, self.high = [min(c) for c in zip(*own, strict=True)], [max(c) for c in zip(*own, strict=True)]
        self.largest = max(max(map(abs, self.low)), max(map(abs, self.high)))
        self.children: tuple[Tree, Tree] | None = None
        wide = [h - l for l, h in zip(self.low, self.high, strict=True)]
        if len(own) > LEAF and max(wide):
            self.axis = wide.index(max(wide))
            order = sorted(self.at, key=lambda i: (entries[i][self.axis], i))
            middle = len(order) // 2
            self.split = entries[order[middle]][self.axis]
            self.children = Tree(entries, sorted(order[:middle])), Tree(entries, sorted(order[middle:]))
        else:
            self.own = own  # in order of index

    def typed(self, kind) -> "Tree":
        """The tree with its numbers as arrays of a kind, once per worker and kind."""
        held = self.__dict__.setdefault("_typed", {})
        if kind not in held:
            t = held[kind] = object.__new__(Tree)
            t.low, t.high, t.at, t.children = np.array(self.low, kind), np.array(self.high, kind), np.array(self.at), None
            if self.children:
                t.axis, t.split, t.children = self.axis, self.split, tuple(c.typed(kind) for c in self.children)
            else:
                t.own = np.array(self.own, kind)
        return held[kind]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of q, ties to the lower index."""
        kind = q.dtype.type if q.dtype != object else object
        best = np.full(len(q), MOST if kind is not object else math.inf, kind)
        where = np.full(len(q), -1)
        _visit(self.typed(kind), q, np.arange(len(q)), best, where)
        return where, best


def _visit(node: Tree, q: np.ndarray, rows: np.ndarray, best: np.ndarray, where: np.ndarray) -> None:
    own = q[rows]
    away = np.maximum(np.maximum(node.low - own, own - node.high), 0)
    near = np.flatnonzero((away * away).sum(1) <= best[rows])  # also where equal
    if not len(near):
        return
    rows, own = rows[near], own[near]
    if node.children:
        left = own[:, node.axis] < node.split
        first, second = node.children
        for some, nearer, farther in ((rows[left], first, second), (rows[~left], second, first)):
            if len(some):
                _visit(nearer, q, some, best, where)
                _visit(farther, q, some, best, where)
        return
    gaps = own[:, None, :] - node.own[None]
    d = (gaps * gaps).sum(2)
    at = d.argmin(1)  # the first of the least
    d, index = d[np.arange(len(d)), at], node.at[at]
    better = np.flatnonzero((d < best[rows]) | ((d == best[rows]) & (index < where[rows])))
    best[rows[better]], where[rows[better]] = d[better], index[better]


def _halves(v: np.ndarray, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components as integers): those whose distances, sums over all parts included, fit 64 bits, and the others."""
    if not len(v):
        return
    most = np.abs(v).max(1)
    least = max(t.largest for t in trees)
    fits = most < 2.0**50
    room = math.isqrt((1 << 62) // v.shape[1]) // 2  # (2 m)**2 * width < 2**62
    fits &= (most < room) & (least < room)
    for some, kind in ((np.flatnonzero(fits), np.int64), (np.flatnonzero(~fits), object)):
        if len(some):
            yield some, v[some].astype(np.int64) if kind is np.int64 else integers(v[some])


def assigned(v: np.ndarray, trees: list[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their components, entry of each part, error) of a matrix of whole doubles, in one or two lots."""
    for rows, x in _halves(v, trees):
        codes, error = np.empty((len(rows), len(trees)), np.int64), np.zeros(len(rows), x.dtype)
        width = x.shape[1] // len(trees)
        for part, tree in enumerate(trees):
            codes[:, part], d = tree.nearest(x[:, part * width : (part + 1) * width])
            error = error + d
        yield rows, x, codes, error


def _filled(v: np.ndarray, parts: int) -> np.ndarray:
    over = -v.shape[1] % parts
    return np.pad(v, ((0, 0), (0, over))) if over else v


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, b.num_rows, ROWS):
        yield b.slice(lo, ROWS)


def first_codebooks(x: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    """Per part the entries from the vectors of the smallest ids."""
    rows = x.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not rows:
        return []
    v = _filled(np.array([r["v"] for r in rows]), parts)
    return [[[int(c) for c in row] for row in part] for part in np.split(v, parts, axis=1)]


def one_round(x: DataFrame, books: list[list[list[int]]], rows: int, largest: float) -> list[list[list[int]]]:
    """The codebooks after all parts are assigned and every used entry is replaced by floor(sum / count) of its parts."""
    parts, entries, width = len(books), len(books[0]), len(books[0][0])
    pieces = -(-(int(largest) * rows).bit_length() // BITS) + 1
    shared = x.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for whole_batch in batches:
            for b in _slices(whole_batch):
                for _, v, codes, _ in assigned(_filled(matrix(b.column("v")), parts), trees):
                    for part in range(parts):
                        added = np.zeros((entries, width), v.dtype)
                        np.add.at(added, codes[:, part], v[:, part * width : (part + 1) * width])
                        counts[part] += np.bincount(codes[:, part], minlength=entries)
                        sums[part] += added
        used = np.flatnonzero(counts.reshape(-1))
        own = sums.reshape(-1, width)[used]
        columns = [(used, np.full(len(used), -1), counts.reshape(-1)[used])]
        for c in range(width):
            for k in range(pieces):
                piece = [int(s) >> BITS * k if k == pieces - 1 else int(s) >> BITS * k & (1 << BITS) - 1 for s in own[:, c]]
                columns.append((used, np.full(len(used), c * pieces + k), np.array(piece, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], names=["entry", "slot", "n"])

    added = x.select("v").mapInArrow(run, "entry long, slot long, n long").groupBy("entry", "slot").agg(F.sum("n").alias("n"))
    total: dict[tuple[int, int], int] = {(r["entry"], r["slot"]): r["n"] for r in added.collect()}  # the codebooks' size, whatever the rows
    shared.destroy()
    out = [[list(entry) for entry in book] for book in books]
    for (at, slot), n in total.items():
        if slot < 0:
            out[at // entries][at % entries] = [sum(total[at, c * pieces + k] << BITS * k for k in range(pieces)) // n for c in range(width)]
    return out


def books_digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def fit(x: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The codebooks (part, entry, component) of whole vectors x; none for an empty table."""
    books = first_codebooks(x, parts, entries)
    if books and rounds:
        stats = x.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
        for _ in range(rounds):
            books = one_round(x, books, stats["n"], stats["m"])
    return books


def encode(x: DataFrame, books: list[list[list[int]]], *keep: str) -> DataFrame:
    """vec_id, the columns kept, code (two hex digits a part) and error of every vector of x."""
    shared, parts = x.sparkSession.sparkContext.broadcast([Tree(b) for b in books]), len(books)
    digits = np.array([f"{i:02x}" for i in range(len(books[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole_batch in batches:
            for b in _slices(whole_batch):
                code, error = np.empty(b.num_rows, object), np.zeros(b.num_rows, np.int64)
                for rows, _, codes, e in assigned(_filled(matrix(b.column("v")), parts), trees):
                    code[rows] = ["".join(row) for row in digits[codes].tolist()]
                    error[rows] = e if e.dtype != object else np.array([min(int(d), MOST) for d in e], np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", *keep)), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", *keep, "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return x.select("vec_id", *keep, "v").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("vec_id", *keep)) + ", code string, error long")


def decoded(coded: DataFrame, books: list[list[list[int]]], width: int | None = None) -> DataFrame:
    """coded with v, the whole vector that the code stands for; width drops zeros that filled it up."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(c)) for c in entry]) for entry in book]) for book in books])
    part = lambda i: F.element_at(F.element_at(entries, i + 1), F.conv(F.substring("code", 2 * i + 1, 2), 16, 10).cast("int") + 1)
    v = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), part))
    return coded.withColumn("v", F.slice(v, 1, width) if width else v)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded (a written table) with label_error, the error summed over the rows of equal labels, nulls together."""
    most = F.lit(MOST).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("long")
    sums = coded.groupBy(F.col(label).alias("_label")).agg(total.alias("label_error"))
    if coded.select(label).distinct().limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(sums, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_s"))).drop("_label", "_salt", "_s")


def compress(vectors: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of the vectors (vec_id, embedding, label) that take part."""
    x = written(whole(vectors.withColumn("label", F.col(label)), scale, "label"), "vectors")
    books = fit(x, parts, entries, rounds)
    if not books:
        return x.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written(encode(x, books, "label"), "codes")
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(books_digest(books)))
