"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features of a text are the n-grams (orders 1 and 2) of its words, and of their shapes -
letters, digits and marks in runs, with a sign on a word equal to the one before - each
hashed into ``2 ** bits`` cells with the relative frequency as value.  A score is the
sigmoid of a sparse dot product with the weights, so it needs neither a dictionary nor
any other column of the document.

Training reads a bounded sample: at most ``per_class`` labelled documents of each class
outside the held-out fold, the first by a hash of their doc_id.  Their ids (a bounded
number) are broadcast to one scan of the documents, which turns whole texts into vectors
where they lie; the vectors are then learned from in one task, in the order of that
hash, ``epochs`` times, up to ``most_cells`` entries (12 bytes each).  Each update follows
the regularised leader: per-coordinate steps and an L1 term that leaves rare cells at zero.
The weights (4 bytes a cell) are the only thing that goes to the driver and back out.

Defined results: a null, empty or blank text has no features and gets the score of the
bias.  A doc_id labelled more than once counts as its highest label, one with several
rows is one example; null labels do not count.  Without labels of both classes every
score is the share of label 1 (0.5 without labels).  Texts of any length are scored whole.
Equal scores and repeated rows stay as they are; extra columns are ignored
(keep_predicted: kept); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from scopelake.llm.common import arrow_rows, located, mark, trimmed, write_marks

PER_CLASS, BITS, EPOCHS = 3000, 18, 3
#: Bound of the sample in memory: entries of all its vectors.
MOST_CELLS = 20_000_000
#: FTRL-proximal: step, its offset, L1, L2.
ALPHA, BETA, L1, L2 = 2.0, 0.05, 0.002, 0.01
FOLDS, HELD_OUT = 3, 1

_MEMO: dict[bytes, tuple[int, int]] = {}
_MEMO_ENTRIES = 60_000
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[^\W\d_A]+"), re.compile(r"\d+")


def _hashes(word: bytes) -> tuple[int, int]:
    """(hash of the word in lower case, hash of its shape)."""
    text = word.decode("utf-8", "replace")
    shape = _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", text)))
    found = crc32(text.lower().encode()), crc32(shape.encode())
    if len(_MEMO) < _MEMO_ENTRIES:
        _MEMO[word] = found
    return found


def cells(text: str | None, bits: int = BITS) -> np.ndarray:
    """Cell of every n-gram of the text, repeats included; 4 of them for a word on average."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    get = _MEMO.get
    pairs = np.array([get(w) or _hashes(w) for w in words], np.uint64)
    word, shape = pairs[:, 0], pairs[:, 1].copy()
    same = np.concatenate(([False], word[1:] == word[:-1]))
    shape[same] ^= np.uint64(0x5BD1E995)

    def two(x: np.ndarray) -> np.ndarray:
        return x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]

    grams = [word, two(word) ^ np.uint64(1 << 40), shape ^ np.uint64(1 << 41), two(shape) ^ np.uint64(1 << 42)]
    h = np.concatenate(grams) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def vector(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(cells, values) of a text, each cell once."""
    c = cells(text, bits)
    if not len(c):
        return c, np.zeros(0)
    cell, count = np.unique(c, return_counts=True)
    return cell, 4 * count / len(c)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) after the given passes over the examples in their order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = min(max(np.mean([y for _, _, y in examples]), 1e-3), 1 - 1e-3)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0

    def weights(zc: np.ndarray, nc: np.ndarray) -> np.ndarray:
        w = (np.sign(zc) * L1 - zc) / ((BETA + np.sqrt(nc)) / ALPHA + L2)
        return np.where(np.abs(zc) <= L1, 0.0, w)

    for _ in range(epochs):
        for cell, value, y in examples:
            zc, nc = z[cell], n[cell]
            w = weights(zc, nc)
            g = 1 / (1 + np.exp(-np.clip(bias + w @ value, -35, 35))) - y
            gc = g * value
            n_new = nc + gc * gc
            z[cell] = zc + gc - (np.sqrt(n_new) - np.sqrt(nc)) / ALPHA * w
            n[cell] = n_new
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    return weights(z, n).astype(np.float32), float(bias)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = EPOCHS, most_cells: int = MOST_CELLS) -> tuple[np.ndarray, float]:
    """(weights, bias) from a bounded sample of the labels outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    first = [known.where(c).orderBy("h", "doc_id").limit(per_class) for c in ("y > 0", "y <= 0")]
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(first[0].union(first[1])), "doc_id")  # 2 * per_class ids at most
    none = np.zeros(1 << bits, np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, y, text in zip(*(b.column(c) for c in ("h", "y", "text")), strict=True):
                cell, value = vector(text.as_py(), bits)
                yield pa.RecordBatch.from_pydict({"h": pa.array([h.as_py()]), "y": pa.array([y.as_py()], pa.int32()), "cells": [cell.astype("<i4").tobytes()], "held": [value.tobytes()]})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for b in batches:
            for y, cell, value in zip(*(b.column(c).to_pylist() for c in ("y", "cells", "held")), strict=True):
                held += len(cell) // 4
                if held <= most_cells:
                    seen.append((np.frombuffer(cell, "<i4"), np.frombuffer(value), int(y > 0)))
        if {y for _, _, y in seen} == {0, 1}:
            w, bias = ftrl(seen, bits, epochs)
        else:
            share = min(max(np.mean([y for _, _, y in seen]), 1e-6), 1 - 1e-6) if seen else 0.5
            w, bias = none, float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()], "b": [bias]})

    made = sample.select("h", "y", "text").mapInArrow(vectors, "h long, y int, cells binary, held binary")
    single = made.groupBy("h").agg(F.min(F.struct("y", "cells", "held")).alias("x"))  # a doc_id's rows leave their tasks as one
    # one task: the order of the examples is part of the method, and their number is bounded
    with arrow_rows(docs.sparkSession, 500):
        rows = single.repartition(1).sortWithinPartitions("h").select("x.*").mapInArrow(trimmed(learn), "w binary, b double").collect()
    return (np.frombuffer(rows[0]["w"], np.float32), rows[0]["b"]) if rows else (none, 0.0)


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns keep of docs (doc_id by default) with score and predicted, under names that keep does not have."""
    bits = int(len(weights)).bit_length() - 1
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 * 2 ** bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for b in batches:
            texts = b.column(keep.index("text") if "text" in keep else b.num_columns - 1).to_pylist()
            dots = np.empty(len(texts))
            for i, t in enumerate(texts):
                c = cells(t, bits)
                dots[i] = 4 * w[c].sum() / len(c) if len(c) else 0.0
            s = 1 / (1 + np.exp(-np.clip(bias + dots, -35, 35)))
            columns = [*b.columns[: len(keep)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], DoubleType()).add(names[1], IntegerType())
    text = [] if "text" in keep else [F.col("text").cast("string").alias("_scored")]
    return docs.select(*keep, *text).mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    w, bias = train(docs, labels, per_class, bits, epochs)
    return score(docs, w, bias).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


def keep_predicted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of docs that are predicted to have label 1, as they are; only their places leave the scoring tasks."""
    w, bias = train(docs, labels, per_class, bits, epochs)
    placed = located(docs)
    good = score(placed, w, bias, keep=["__file", "__row"]).where("predicted = 1").select("__file", "__row", F.lit(1).cast("long").alias("kept"))
    with arrow_rows(docs.sparkSession):
        folder = write_marks(good, "classified")
    return mark(placed, folder, "__kept").where("__kept = 1").select(*docs.columns)
