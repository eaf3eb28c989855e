"""Hard-negative mining over k-means inverted lists.

Centroids, about the root of the number of vectors, come from Lloyd rounds on a bounded
sample (``vectors.SAMPLE``); every vector is then listed under its nearest one (``lists``),
and the radius of each list is stored.  For a list with centroid c and radius r

    q.c - |q| r  <=  q.x  <=  q.c + |q| r        (Cauchy-Schwarz)

A task takes a block of anchors through the lists twice.  First for positives: the best
rows of the anchor's label.  Then for negatives: for each positive the best rows of other
labels whose scores lie in its window.  Lists are visited by falling upper bound; those
whose bounds miss every open window are skipped, and the walk ends once what is left has
bounds strictly below the k-th score of every search (an equal score may belong to a
smaller id).  Rings of a list carry radii of their own and are skipped alike.  Results
are exact and whole when the task ends.

How much is skipped depends on the data: where directions are independent, radii are
near the vectors' own length, every list stays open, and each block reads all lists.

Components become floor(scale * x), x as double; scores are exact (``vectors``), and one
beyond a long counts as the nearest long, in windows too.
Defined results: rows with a null id, a null label, or a vector that is null, empty, holds
null or non-finite components or has another length than the most frequent one take no part.
Rows of the anchor's own id are neither its positives nor its negatives; repeated ids are
rows of their own otherwise, and anchors of their own.  A positive below zero has an empty
window.  Without positives, or negatives in the window, there are no rows.  Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelake.llm import lists
from scopelake.llm.common import written
from scopelake.llm.topk import blocks
from scopelake.llm.vectors import NONE, SLACK, Best, is_open, products, sampled, whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score is at least 4/5 of the positive's, and at most the positive's.
LEAST = 4, 5
#: Bound of the number of centroids, and Lloyd rounds on the sample.
CENTROIDS, ROUNDS = 1024, 10
RING_ROWS, ANCHOR_ROWS = 1024, 256


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of the sample, from its first distinct vectors; a centroid without vectors stays."""
    _, first = np.unique(sample, axis=0, return_index=True)
    c = sample[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        own = ((c**2).sum(1)[None] - 2 * (sample @ c.T)).argmin(1)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def walk(q: np.ndarray, q2: np.ndarray, index: lists.Lists, read: lists.Reader, wanted: Callable, take: Callable) -> int:
    """Visit lists by falling upper bound; gives how many vectors were met.

    wanted(upper, lower) says of every anchor whether scores within the bounds can count;
    take(rows, longs, scores) gets the scores of a ring for the anchors that want it.
    """
    known = index.known
    centre = index.centres[known["centre"]]
    reach, c2, typed, met = np.sqrt(q2), (centre**2).sum(1), q.astype(index.kind), 0
    qc = q @ centre.T

    def bounds(at: int, outer: float, top: float) -> tuple[np.ndarray, np.ndarray]:
        slack = SLACK * np.maximum(q2, max(top, c2[at]))
        return qc[:, at] + reach * outer + slack, qc[:, at] - reach * outer - slack

    upper = np.nan_to_num(np.stack([bounds(at, known["outer"][at], known["top"][at])[0] for at in range(len(known))], axis=1), nan=np.inf)
    order = np.argsort(-upper.max(0), kind="stable")
    left = np.maximum.accumulate(upper[:, order][:, ::-1], axis=1)[:, ::-1]  # the best bound of what is yet to come
    for n, at in enumerate(order):
        if not wanted(left[:, n], np.full(len(q), -np.inf)).any():
            break
        if not wanted(*bounds(at, known["outer"][at], known["top"][at])).any():
            continue
        for ring in read.list_of(int(known["file"][at])):
            rows = np.flatnonzero(wanted(*bounds(at, ring["outer"], ring["top"])))
            if len(rows):
                longs, c = read.ring(ring)
                take(rows, longs, products(typed[rows], c, q2[rows], np.square(c, dtype=np.float64).sum(1)))
                met += len(c)
    return met


def mine_block(ids: np.ndarray, q: np.ndarray, labels: np.ndarray, index: lists.Lists, read: lists.Reader, positives: int, negatives: int) -> list[np.ndarray]:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of a block of anchors."""
    with np.errstate(all="ignore"):
        q2 = (q**2).sum(1)
        near = Best(len(q), positives)

        def take_positives(rows: np.ndarray, longs: np.ndarray, scores: np.ndarray) -> None:
            scores[(labels[rows, None] != longs[1][None]) | (ids[rows, None] == longs[0][None])] = NONE
            near.add(rows, longs[0], scores)

        walk(q, q2, index, read, lambda upper, lower: is_open(upper, near.floor), take_positives)
        # a search for each anchor and positive; the least score is rounded up
        least = np.array([-(-LEAST[0] * int(s) // LEAST[1]) for s in near.scores], np.int64)
        held = np.flatnonzero(least <= near.scores)
        anchor, most, least = near.rows[held], near.scores[held], least[held]
        hard = Best(len(held), negatives)

        def in_window(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
            some = is_open(upper[anchor], np.maximum(hard.floor, least)) & ~(lower[anchor] > most)
            return np.bincount(anchor[some], minlength=len(q)) > 0

        def take_negatives(rows: np.ndarray, longs: np.ndarray, scores: np.ndarray) -> None:
            scores[(labels[rows, None] == longs[1][None]) | (ids[rows, None] == longs[0][None])] = NONE
            at = np.full(len(q), -1)
            at[rows] = np.arange(len(rows))
            searches = np.flatnonzero(at[anchor] >= 0)
            own = scores[at[anchor[searches]]]
            own[(own > most[searches, None]) | (own < least[searches, None])] = NONE
            hard.add(searches, longs[0], own)

        if len(held):
            walk(q, q2, index, read, in_window, take_negatives)
    pair = held[hard.rows]
    return [ids[near.rows[pair]], near.ids[pair], hard.ranks().astype(np.int32), hard.ids, near.scores[pair], hard.scores]


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, lists_wanted: int | None = None, ring_rows: int = RING_ROWS, anchor_rows: int = ANCHOR_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of vectors
    (vec_id, embedding, label) that is_anchor (on vec_id) holds for."""
    spark = vectors.sparkSession
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    named = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).where("vec_id IS NOT NULL AND label IS NOT NULL")
    x = written(whole(named, scale, "label"), "vectors")
    stats = x.agg(F.count("*").alias("n"), F.max("norm2").alias("m"), F.max(F.size("v")).alias("w"), F.count_if(is_anchor).alias("q")).first()
    if not stats["n"] or not stats["q"]:
        return spark.createDataFrame([], shape)
    n, width = stats["n"], stats["w"]
    sample = sampled(x, width)
    c = centroids(sample, lists_wanted or min(CENTROIDS, int(np.ceil(np.sqrt(n))))) if len(sample) else np.zeros((1, width))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = lists.write_lists(lists.keyed(x, c), c, ring_rows, max(1, min(most, -(-n // ring_rows))), "<f4" if stats["m"] < 2.0**24 else "<f8", "label")
    held = spark.sparkContext.broadcast(index)  # a row per centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        with index.reader() as read:
            for ids, q, labels in blocks(batches, anchor_rows, "label"):
                found = mine_block(ids, q, labels, index, read, positives, negatives)
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    anchors = lists.keyed(x.where(is_anchor), c)
    tasks = max(-(-stats["q"] // anchor_rows), min(most, -(-stats["q"] // 32)))
    return lists.in_order(anchors, tasks).select("vec_id", "v", "label").mapInArrow(run, shape)
