"""What the operators on vectors share: whole components, exact scores, the best of a search.

Vectors become whole numbers held as doubles, which are exact at any size: a double of
2**53 or more is whole itself.  Scores are exact too: in floating point as long as
|q| |c| < 2**53, in 64-bit integers up to 2**63, in integers of any size beyond.  A score
that no long can hold counts as the nearest long (of -2**63 + 1 and 2**63 - 1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for "no score"; no score is as low.
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max
#: Bounds of the sample that centres are chosen from (rows, bytes).
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Slack of floating-point bounds, as a part of the squared norms that meet; it only ever keeps more.
SLACK = 1e-6


def whole(vectors: DataFrame, scale: int, *keep: str) -> DataFrame:
    """vec_id, the columns kept, v (array of whole doubles, floor(scale * x)) and norm2 of the vectors that take part.

    A vector that is null, empty, holds null or non-finite components (also after scaling),
    or has another length than the most frequent one (the least of equally frequent) takes no part.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.transform(F.col("embedding").cast("array<double>"), lambda c: F.lit(float(scale)) * c).alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = x.where(F.col("e").isNotNull() & (F.size("e") > 0)).where(F.coalesce(finite, F.lit(False)))
    common = x.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    x = x.where(F.size("e") == (common[0]["n"] if common else 0))
    # floor() gives a long: what is too large for one is whole already
    x = x.withColumn("v", F.transform("e", lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)))
    return x.select("vec_id", *keep, "v", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c).alias("norm2"))


def sampled(x: DataFrame, width: int, sample: int = SAMPLE) -> np.ndarray:
    """At most ``sample`` vectors, those of the least hashes: ids first, so that no task sends vectors that are not chosen."""
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * width)))
    keyed = x.where(F.col("norm2") < F.lit(float("inf"))).withColumn("h", F.xxhash64("v"))
    chosen = keyed.select("h", "vec_id").orderBy("h", "vec_id").limit(sample).distinct()
    rows = keyed.join(F.broadcast(chosen), ["h", "vec_id"]).orderBy("h", "vec_id").select("v").limit(sample).collect()
    return np.array([r["v"] for r in rows]).reshape(-1, width)


def matrix(column) -> np.ndarray:
    """An Arrow column of vectors of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any size."""
    return np.frompyfunc(int, 1, 1)(x)


def _wide(q: np.ndarray, c: np.ndarray, bound2: float) -> np.ndarray:
    """Exact products of vectors whose squared norms multiply to bound2 at most."""
    if bound2 < 2.0**124:
        return q.astype(np.int64) @ c.astype(np.int64).T
    exact = integers(q) @ integers(c).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def products(q: np.ndarray, c: np.ndarray, q2: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of q and c as longs; q2, c2 are their squared norms.

    Only pairs with a long vector are taken out of floating point.
    """
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    with np.errstate(all="ignore"):
        fast = q @ c.T
        most_q, most_c = float(q2.max()), float(c2.max())
        if most_q * most_c < 2.0**105:
            return fast.astype(np.int64)
        long_q, long_c = ~(q2 * most_c < 2.0**105), ~(c2 * most_q < 2.0**105)
        out = np.where(long_q[:, None] | long_c[None], 0.0, fast).astype(np.int64)
        q, c = q.astype(np.float64), c.astype(np.float64)
        if long_c.any():
            out[:, long_c] = _wide(q, c[long_c], most_q * most_c)
        if long_q.any() and not long_c.all():
            out[np.ix_(long_q, ~long_c)] = _wide(q[long_q], c[~long_c], most_q * float(c2[~long_c].max()))
    return out


def is_open(reach: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Whether a score of at most reach can still count beside a k-th score; bounds that are no number are open."""
    held = np.clip(np.nan_to_num(reach, nan=np.inf, posinf=np.inf, neginf=-np.inf), -(2.0**63), 2.0**63)
    return (held >= floor) | (floor == NONE)


class Best:
    """The k best (score, smaller id first) of each of a number of searches, and the k-th score where there are k."""

    def __init__(self, searches: int, k: int):
        self.k, self.floor = k, np.full(searches, NONE)
        self.rows, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores (searches ``rows`` by ids); NONE takes no part."""
        least = self.floor[rows]
        if len(ids) > self.k:  # more than k remain only where scores tie with the k-th: the first by id do
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        row, at = np.nonzero((scores >= least[:, None]) & (scores > NONE))
        if not len(row):
            return
        every = np.concatenate((self.rows, rows[row])), np.concatenate((self.ids, ids[at])), np.concatenate((self.scores, scores[row, at]))
        order = np.lexsort((every[1], -every[2], every[0]))
        r, i, s = (x[order] for x in every)
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        keep = nth < self.k
        self.rows, self.ids, self.scores = r[keep], i[keep], s[keep]
        full = nth == self.k - 1
        self.floor[r[full]] = s[full]

    def ranks(self) -> np.ndarray:
        return np.arange(len(self.rows)) - np.searchsorted(self.rows, self.rows) + 1
