"""Exact top-k by inner product over a pivot-distance index.

Index.  Pivots, about the root of the number of vectors, are chosen from a bounded sample
(farthest first).  Every vector is keyed by its nearest pivot and its distance to it, and
the annuli of each pivot are written in order of distance (``lists``): at most
``annulus_rows`` vectors each, so that equal vectors in any number fill several and no
pivot is one task.

Search.  Queries are keyed alike and sorted, so that a block of ``query_rows`` holds
neighbours.  A task takes a block through the pivots, nearest first, and through the
annuli of each from the ring of its queries outwards.  For x at a distance r from pivot p

    q.x = q.p + q.(x - p) <= q.p + |q| r
    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2   with   |q - x| >= | |q - p| - r |

so a pivot, or an annulus with its inner and outer radius and greatest norm, is passed
over for every query whose k-th score so far is above both bounds, and read only where it
is left open for some query of the block.  Scores tighten before each next annulus.  Each
query's k best are whole when its task ends: nothing is joined or sorted afterwards.

The triangle inequality can close only what lies far off.  Where distances are nearly
equal, as for independent vectors of many dimensions, every annulus stays open and the
search reads all of them, in blocks; ``scored`` tells how many vectors each query met.

Components become floor(scale * x), x as double.  Scores are exact for vectors of any
length: held as 32-bit floats where all squared norms are below 2**24, else as doubles,
and multiplied in integers where doubles could round (see ``vectors``, which also says
what counts beyond a long).
Defined results: a vector that is null, empty, holds null or non-finite components, or
whose length differs from the most frequent one takes no part; so does a row with a null
id.  Repeated ids are candidates of their own, except of their own id, and queries of
their own.  Ties go to smaller ids.  Extra columns are ignored; with no queries or no
candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelake.llm import lists
from scopelake.llm.common import written
from scopelake.llm.vectors import NONE, SLACK, Best, is_open, matrix, products, sampled, whole

K, SCALE = 20, 64
#: Bound of the number of pivots.
PIVOTS = 1024
#: Rows of an annulus, queries of a block.
ANNULUS_ROWS, QUERY_ROWS = 1024, 512


def choose_pivots(x: DataFrame, width: int, pivots: int) -> np.ndarray:
    """Pivots, farthest first from a bounded sample (the first by a hash of the vector)."""
    held = sampled(x, width)
    if not len(held):
        return np.zeros((1, width))
    chosen, far = [0], ((held - held[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(held)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((held - held[chosen[-1]]) ** 2).sum(1))
    return held[chosen]


def _reach(qp: np.ndarray, q2: np.ndarray, qd: np.ndarray, p2: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The greatest inner product that each query (rows) can have within each annulus (columns), with the slack of its norms."""
    inner, outer, top = known["inner"], known["outer"], known["top"]
    away = np.maximum(0, np.maximum(qd - outer, inner - qd))
    bound = np.minimum(qp + np.sqrt(q2)[:, None] * outer, (q2[:, None] + top - away**2) / 2)
    return bound + SLACK * np.maximum(np.maximum(q2[:, None], top), p2)


def search_block(ids: np.ndarray, q: np.ndarray, index: lists.Lists, k: int, read: lists.Reader) -> tuple[Best, np.ndarray]:
    """(k best, vectors met) of each query of a block."""
    best, met, known = Best(len(q), k), np.zeros(len(q), np.int64), index.known
    pivots = index.centres[known["centre"]]
    typed = q.astype(index.kind)
    with np.errstate(all="ignore"):
        q2, p2 = (q**2).sum(1), (pivots**2).sum(1)
        qp = q @ pivots.T
        qd = np.sqrt(np.maximum(0, q2[:, None] + p2 - 2 * qp))
        reach = _reach(qp, q2, qd, p2, known)
        for at in np.argsort(qd.min(0), kind="stable"):
            some = np.flatnonzero(is_open(reach[:, at], best.floor))
            if not len(some):
                continue
            rings = read.list_of(int(known["file"][at]))
            inside = _reach(qp[some, at, None], q2[some], qd[some, at, None], p2[at], rings)
            own = np.median(qd[some, at])
            for a in np.argsort(np.abs((rings["inner"] + rings["outer"]) / 2 - own), kind="stable"):
                left = some[is_open(inside[:, a], best.floor[some])]
                if not len(left):
                    continue
                (c_ids,), c = read.ring(rings[a])
                scores = products(typed[left], c, q2[left], np.square(c, dtype=np.float64).sum(1))
                scores[ids[left, None] == c_ids[None]] = NONE
                best.add(left, c_ids, scores)
                met[left] += len(c_ids)
    return best, met


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, pivots: int | None = None, annulus_rows: int = ANNULUS_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score, scored for the rows of vectors (vec_id, embedding) that is_query (on vec_id) holds for."""
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score long, scored long"
    x = written(whole(vectors, scale).where("vec_id IS NOT NULL"), "vectors")
    stats = x.agg(F.count("*").alias("n"), F.max("norm2").alias("m"), F.max(F.size("v")).alias("w"), F.count_if(is_query).alias("q")).first()
    if not stats["n"] or not stats["q"]:
        return spark.createDataFrame([], shape)
    n, width = stats["n"], stats["w"]
    p = choose_pivots(x, width, pivots or min(PIVOTS, int(np.ceil(np.sqrt(n)))))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = lists.write_lists(lists.keyed(x, p), p, annulus_rows, max(1, min(most, -(-n // annulus_rows))), "<f4" if stats["m"] < 2.0**24 else "<f8")
    held = spark.sparkContext.broadcast(index)  # a row per pivot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value

        def found(ids: np.ndarray, q: np.ndarray, read: lists.Reader) -> pa.RecordBatch:
            best, met = search_block(ids, q, index, k, read)
            columns = [ids[best.rows], best.ranks().astype(np.int32), best.ids, best.scores, met[best.rows]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "rank", "vec_id", "score", "scored"])

        with index.reader() as read:
            for ids, q in blocks(batches, query_rows):
                yield found(ids, q, read)

    asked = lists.keyed(x.where(is_query), p)
    tasks = max(-(-stats["q"] // query_rows), min(most, -(-stats["q"] // 64)))
    return lists.in_order(asked, tasks).select("vec_id", "v").mapInArrow(run, shape)


def blocks(batches: Iterator[pa.RecordBatch], rows: int, *more: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows of a task as (ids, vectors, and ``more`` long columns) of about so many rows."""
    waiting: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            waiting.append((part.column("vec_id").to_numpy(), matrix(part.column("v")), *(part.column(c).to_numpy() for c in more)))
            if sum(len(w[0]) for w in waiting) >= rows:
                yield tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
                waiting = []
    if waiting:
        yield tuple(np.concatenate(c) for c in zip(*waiting, strict=True))
