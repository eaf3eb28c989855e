"""Vector operators and online packing against brute force: long vectors, ties, repeats, nulls, blanks, many tasks."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scopelake.llm import codes, negatives, online, packing, tokens, topk, vectors
from tests.llm.test_contracts import docs, empty, local  # noqa: F401

MOST = 2**63 - 1


def clipped(x):
    return max(-MOST, min(MOST, x))


def whole(v, scale):
    return [math.floor(scale * x) for x in v]


def dot(a, b):
    return clipped(sum(x * y for x, y in zip(a, b, strict=True)))


def usable(rows, width):
    ok = lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    return [r for r in rows if ok(r[1])]


#: Finite floats of every length among ordinary ones.
LONG = [[2e6] + [0.1] * 7, [-2e6, 1.0] + [0.0] * 6, [3e38] * 8, [-3e38] + [1e30] * 7, [1e15, -1e15] * 4, [1e15, -1e15, 3.0, 0.0] * 2, [2.0**40] * 8, [0.0] * 8]
LONG = [[float(np.float32(x)) for x in v] for v in LONG]


def small_rows(n, seed, width=8, labels=4):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, width)], int(rng.integers(labels))) for i in range(n)]
    rows += [(n + i, rows[20][1], 1) for i in range(n // 2)]  # one very common vector
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.1] * (width - 1), 1), (5003, [None] * width, 1), (5004, [math.nan] * width, 1), (5005, [math.inf] * width, 1), (5006, rows[3][1], None)]
    return rows


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return df.withColumns({c: F.lit(c) for c in ("v", "norm2", "code", "error", "centre", "dist", "n", "h", "e")})


# exact top-k


def test_long_vectors_among_short_ones(spark):
    rows = small_rows(60, 1) + [(100 * (i + 1), v, 0) for i, v in enumerate(LONG)]
    ok = [(i, whole(v, 64)) for i, v, _ in usable(rows, 8)]
    want = {}
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-dot(a, b), i) for i, b in ok if i != q)[:20]
            want[q] = [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    got = defaultdict(list)
    for r in topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, annulus_rows=16, query_rows=4).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == want


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 1, (40, 6)) * 10.0 ** rng.integers(0, 30, (40, 1)))
    got = vectors.products(x, x[::-1], (x**2).sum(1), (x[::-1] ** 2).sum(1))
    for i in range(40):
        for j in range(40):
            assert got[i, j] == dot([int(a) for a in x[i]], [int(a) for a in x[39 - j]])


def test_an_attempt_writes_under_its_own_name(spark, tmp_path):
    """Both attempts of a task may end: what the rows name is whole."""
    from scopelake.llm import lists

    x = vectors.whole(frame(spark, small_rows(40, 3)), 64)
    centres = vectors.sampled(x, 8)[:3]
    found = [lists.write_lists(lists.keyed(x, centres), centres, 16, 2, "<f8") for _ in range(2)]
    for index in found:
        with index.reader() as read:
            ids = [i for f in index.known["file"] for r in read.list_of(int(f)) for i in read.ring(r)[0][0].tolist()]
        assert Counter(ids) == Counter(r["vec_id"] for r in x.collect())


# hard negatives


def mined(rows, width, positives=5, count=5):
    ok = [(i, whole(v, 256), label) for i, v, label in usable(rows, width) if i is not None and label is not None]
    out = []
    for a, q, label in ok:
        if a % 100:
            continue
        same = sorted((-dot(q, v), i) for i, v, x in ok if x == label and i != a)[:positives]
        other = sorted((-dot(q, v), i) for i, v, x in ok if x != label and i != a)
        for ps, p in same:
            hard = [(i, -s) for s, i in other if 80 * -ps <= 100 * -s <= 100 * -ps][:count]
            out += [(a, p, n, i, -ps, s) for n, (i, s) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("long", [False, True])
def test_hard_negatives(spark, long):
    rows = small_rows(330, 4) + [(None, [0.25] * 8, 1)] + ([(6000 + 50 * i, v, i % 2) for i, v in enumerate(LONG)] if long else [])
    rows += [(700, rows[7][1], 2), (701, rows[7][1], 3)]  # ties
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, lists_wanted=7, ring_rows=20, anchor_rows=3).collect())
    assert got == mined(rows, 8) and len(got) > 20
    assert negatives.mine(df.where("1 = 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df, F.col("vec_id") < 0).count() == 0


def test_lists_outside_the_window_are_skipped(spark):
    """Far clusters are met by no anchor's walk."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 1, (40, 16))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    rows = [(i, [float(x) for x in middles[i % 40] + rng.normal(0, 0.02, 16)], i // 40 % 3) for i in range(4000)]
    df = frame(spark, rows, "double")
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, ring_rows=50).collect())
    assert got == mined(rows, 16)
    x = [(i, np.array(whole(v, 256), float), label) for i, v, label in rows]
    from scopelake.llm import lists

    held = vectors.whole(df, 256, "label").withColumn("label", F.col("label").cast("long"))
    c = negatives.centroids(vectors.sampled(held, 16), 64)
    index = lists.write_lists(lists.keyed(held, c), c, 50, 4, "<f4", "label")
    q = np.array([x[0][1]])
    best, met = vectors.Best(1, 5), []

    def take(some, longs, scores):
        best.add(some, longs[0], scores)
        met.extend(longs[0].tolist())

    with index.reader() as read:
        negatives.walk(q, (q**2).sum(1), index, read, lambda upper, lower: vectors.is_open(upper, best.floor), take)
    assert len(met) < 0.25 * len(rows)


# vector codes


def compressed(rows, width, scale=256, parts=16, entries=64, rounds=2):
    ok = [(i, whole(v, scale) + [0] * (-width % parts), label) for i, v, label in usable(rows, width)]
    each = len(ok[0][1]) // parts
    cut = lambda v: [tuple(v[p * each : (p + 1) * each]) for p in range(parts)]
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in ok:
                held[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            new.append([tuple(sum(c) // len(held[n]) for c in zip(*held[n], strict=True)) if n in held else e for n, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in ok:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{n:02x}" for _, n in found), min(MOST, sum(d for d, _ in found)), label))
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((repr((i, c, e, min(MOST, total[label]), digest)) for i, c, e, label in out))


@pytest.mark.parametrize("width,long", [(32, False), (8, True), (20, False)])
def test_vector_codes(spark, width, long):
    rows = small_rows(150, 6, width) + [(None, [0.25] * width, 1), (5, [0.125] * width, 2), (5, [0.0] * width, 2)] + ([(3000 + i, v, 3) for i, v in enumerate(LONG)] + [(-1, LONG[2], 3)] if long else [])
    df = frame(spark, rows)
    got = sorted(repr(tuple(r)) for r in codes.compress(df).drop("label").collect())
    assert got == compressed(rows, width)
    assert codes.compress(df.where("1 = 0")).count() == 0


def test_few_vectors_and_equal_entries(spark):
    rows = [(i, [float(i // 3)] * 16, i) for i in range(9)]
    got = sorted(repr(tuple(r)) for r in codes.compress(frame(spark, rows)).drop("label").collect())
    assert got == compressed(rows, 16)


def test_the_tree_finds_the_first_of_equal_entries():
    rng = np.random.default_rng(7)
    entries = [[int(x) for x in row] for row in rng.integers(-3, 4, (64, 3))]
    q = rng.integers(-5, 6, (500, 3))
    at, d = codes.Tree(entries).nearest(q)
    for row, i, got in zip(q.tolist(), at.tolist(), d.tolist(), strict=True):
        assert (got, i) == min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), n) for n, e in enumerate(entries))


def test_label_sums_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW_LABELS", 2)
    rows = small_rows(80, 8, 16)
    got = sorted(repr(tuple(r)) for r in codes.compress(frame(spark, rows)).drop("label").collect())
    assert got == compressed(rows, 16)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    df = frame(spark, small_rows(100, 9, 16))
    x = vectors.whole(df, 256, "label")
    books = codes.fit(x, parts=4, entries=8)
    back = codes.decoded(codes.encode(x, books).withColumnRenamed("v", "_"), books).join(x.select("vec_id", F.col("v").alias("own")), "vec_id")
    for r in back.collect():
        assert sum((a - b) ** 2 for a, b in zip(r["v"], r["own"], strict=True)) == r["error"]


# online packing

WORD = tokens.default_tokenizer_path("word_bpe_49k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    return [[*x.ids, 2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_the_spaceless_encoder_equals_the_library(docs, spark, sf):  # noqa: F811
    bits = ["İ", "İ,", "x́", "'s", "it's,", "<|endoftext|>", "a<|startoftext|>b", "<|endo", " ", "  ", "\n", "\x0b", "\x85", "\xa0", " ", "é,", "ΑΣ", "漢字", "한글", "́", "12.", "×,", "÷.", "ﬁ", "ẞ,", "ı,", "...", "World,", "\x1c", "🙂", "Å", "\x00", "a.,", "z.. ", "İx,"]
    rng = np.random.default_rng(10)
    texts = [t for _, t in local(docs)] + ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(2000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ["x" * 5000, "漢" * 3000]
    coder = tokens.encoder(WORD)
    assert isinstance(coder, tokens.SpacelessEncoder)
    got = [raw for at in range(0, len(texts), 100) for raw in coder.encode(texts[at : at + 100])]
    assert [np.frombuffer(r, "<u4").tolist() for r in got] == [i[:-1] for i in ids_of(texts)]
    assert all(len(w) <= coder.LONGEST for w in coder.memo)


def checked(rows, documents, capacity):
    """Every id of every document lies in one piece; sequences are gapless; gives (padding, sequences)."""
    held, spent = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        spent[r["sequence_id"]].append((r["offset"], r["length"]))
        held[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    want = defaultdict(list)
    for (d, _), ids in zip(documents, ids_of([t for _, t in documents]), strict=True):
        want[d, len(ids)].append(ids)
    assert held.keys() == want.keys()
    for k, ids in want.items():
        every = sorted(ids)
        if len(every) == 1:
            assert [x for _, p in sorted(held[k]) for x in p] == every[0]
        else:  # repeated rows: counts of every id
            assert Counter(x for _, p in held[k] for x in p) == Counter(x for e in every for x in e)
    padding = 0
    for parts in spent.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding, len(spent)


@pytest.mark.parametrize("tasks,fan_in", [(1, 64), (7, 2)])
def test_online_packing(docs, empty, tasks, fan_in):  # noqa: F811
    rows = online.pack_online(docs.repartition(tasks), capacity=256, windows=4, keep_ids=True, fan_in=fan_in).collect()
    padding, n = checked(rows, local(docs), 256)
    total = sum(r["length"] for r in rows)
    assert padding == 0 and n <= total // 256 + 8
    assert online.pack_online(empty).count() == 0
    packed = online.pack_online(docs, capacity=256, keep_ids=True)
    assert {len(r["ids"]) // 4 for r in packing.sequences(packed).collect()} <= set(range(1, 257))


def test_padding_may_be_allowed_to_save_cuts(docs):  # noqa: F811
    cut = online.pack_online(docs, capacity=256, windows=4, keep_ids=True).collect()
    padded = online.pack_online(docs, capacity=256, windows=4, pad_most=60, keep_ids=True).collect()
    assert checked(padded, local(docs), 256)[0] <= 60 * len({r["sequence_id"] for r in padded})
    assert len(padded) <= len(cut)


@pytest.mark.parametrize("seed", range(5))
def test_windows_place_best_fit_and_emit_the_fullest(seed):
    """Against the rule one document at a time, over a plain list of open windows."""
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(1, 90, 300)]
    w = online.Windows(50, 3)
    rooms, emitted = [], []
    for d, n in enumerate(sizes):
        w.add(d, 0, b"\1\0\0\0" * n, n)
        while n >= 50:
            emitted.append(50)
            n -= 50
        while n:
            fits = [r for r in rooms if r >= n]
            if fits:
                at = rooms.index(min(fits))
                rooms[at] -= n
                n = 0
            elif len(rooms) < 3:
                rooms.append(50 - n)
                n = 0
            else:
                at = rooms.index(min(rooms))
                n -= rooms[at]
                rooms[at] = 0
            if 0 in rooms:
                rooms.remove(0)
                emitted.append(50)
        assert sorted(r for r, _ in w.rooms) == sorted(rooms)
    assert len(w.taken()) == len(emitted)
    joined = online.joined(w.left(), 50)
    ends = [sum(len(p[2]) // 4 for p, _ in x) for x in joined]
    assert sum(ends) == sum(50 - r for r in rooms) and all(e == 50 or e & (e - 1) == 0 for e in ends)
