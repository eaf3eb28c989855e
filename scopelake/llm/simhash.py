"""SimHash near-duplicate detection by pigeonhole blocks.

1. Every document gets a 64-bit fingerprint of its word shingles (Arrow batches, numpy).
2. Documents with equal fingerprints are one node, which the fingerprint itself names.
3. A fingerprint is cut into ``blocks`` parts.  Two fingerprints that differ in at most
   ``distance`` bits agree on at least ``blocks - distance`` whole parts, so every choice
   of that many parts is a join key and any close pair meets under at least one.
4. Fingerprints that share a key stream through a task sorted by it.  Within a key, links
   are found by a search that drops every fingerprint from the open set once it is
   reached: only a spanning forest leaves the task, never all pairs, and a dense group
   is absorbed in a few passes.  Connectivity is exactly that of all verified pairs.
5. Components come from the links: in one task up to a counted bound, beyond it from
   rounds of large-star / small-star, each written to the shared folder.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is
linked like any other.  Repeated rows have equal results.  Rows with a null doc_id are
fingerprinted and linked; the component_id of a group without any doc_id is null.  Very
long texts are hashed whole, in steps.  Extra columns are ignored (keep_one: kept as they
are); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelake.llm.common import arrow_rows, located, mark, marks_at, trimmed, write_marks, written

SHINGLE_WORDS, SEED, DISTANCE, BLOCKS = 4, 42, 4, 7
#: Hashes whose bits are counted at a time.
_STEP = 1 << 18


def _shingles(text: str | None, shingle_words: int) -> tuple[bytes, list[int], list[int]]:
    """(lower-cased words joined by spaces, starts, ends of the shingles in it); fewer words are one shingle, none have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, n = b" ".join(words), len(words)
    if n <= shingle_words:
        return joined, [0] * bool(n), [len(joined)] * bool(n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: n - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist()


def fingerprint_bytes(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    joined, s, e = _shingles(text, shingle_words)
    total = len(s)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _STEP):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(s[at : at + _STEP], e[at : at + _STEP], strict=True)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint_bytes(t.as_py(), shingle_words, seed) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(one), "doc_id long, fp long")


def _forest(fps: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (first of each tree, other) of the graph of close pairs; fps: rows of 64-bit words."""
    heads, tails = [], []
    while len(ids) > 1:
        root, frontier = ids[0], [fps[0]]
        fps, ids = fps[1:], ids[1:]
        while frontier and len(ids):
            close = np.bitwise_count(fps ^ frontier.pop()).sum(axis=1) <= distance
            if close.any():
                heads.append(np.full(int(close.sum()), root))
                tails.append(ids[close])
                frontier += list(fps[close])
                fps, ids = fps[~close], ids[~close]
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (ids[:0], ids[:0])


def _links(keyed: DataFrame, distance: int) -> DataFrame:
    """keyed (k, id, fp as long or binary) sorted by k within its partitions -> links a, b between ids."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of the key that may go on

        def links(k: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
            shared = np.flatnonzero(np.diff(edges) > 1)
            found = [_forest(fps[x:y], ids[x:y], distance) for x, y in zip(edges[shared].tolist(), edges[shared + 1].tolist(), strict=True)]
            found = [f for f in found if len(f[0])]
            if found:
                a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, ids = batch.column("k").to_numpy(), batch.column("id").to_numpy()
            fp = batch.column("fp")
            wide = np.frombuffer(b"".join(fp.to_pylist()), np.uint64) if pa.types.is_binary(fp.type) else fp.to_numpy().view(np.uint64)
            held.append((k.copy(), ids.copy(), wide.reshape(len(k), -1).copy()))
            if held[0][0][0] == k[-1]:
                continue
            k, ids, fps = (np.concatenate(c) for c in zip(*held, strict=True))
            last = len(k) - int(np.argmax(k[::-1] != k[-1]))
            yield from links(k[:last], ids[:last], fps[:last])
            held = [(k[last:], ids[last:], fps[last:])]
        if held:
            yield from links(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return keyed.mapInArrow(trimmed(stream), "a long, b long")


def _named(prints: DataFrame, named: DataFrame) -> DataFrame:
    """prints with the component_id of their fingerprint; named: fp, component_id.

    Copies share a fingerprint: the many rows of one are dealt out over salts.
    """
    salts = 16
    many = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    return salted.join(many, ["fp", "salt"]).drop("salt")


def _members(roots: DataFrame) -> DataFrame:
    """node, root of every node of a component of two and more, the root itself included."""
    return roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def close_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links a, b (distinct, between ids) that connect the distinct fingerprints (id, fp) as all close pairs do."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]
    # the number of the choice goes into the hash of the key; a chance collision only adds a pair to verify
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    keyed = fps.select("id", "fp", F.explode(keys).alias("k")).repartition("k").sortWithinPartitions("k")
    return _links(keyed, distance).distinct()


#: Links (16 bytes each) that one task may join by itself.
ONE_TASK_LINKS = 1_000_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the links of one task, by union-find with the smaller node as root."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(c) for c in zip(*held, strict=True))
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(place[: len(u)].tolist(), place[len(u) :].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # roots are smaller than what they hold
        root[x] = root[root[x]]
    linked = np.flatnonzero(np.array(root) != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[np.array(root)[linked]])], names=["node", "root"])


def components(links: DataFrame, most_rounds: int = 60, one_task_links: int = ONE_TASK_LINKS) -> DataFrame:
    """node, root: the smallest node of each component (signed order) for every node that is not it.

    Up to one_task_links links, counted first, are joined in one task (not the driver);
    beyond it rounds of large-star / small-star do it without any bound.
    """
    both = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    if both.count() <= one_task_links:
        return both.repartition(1).mapInArrow(_united, "node long, root long")
    seen = None
    for _ in range(most_rounds):
        # large star: every larger neighbour is linked to the smallest neighbour
        sym = both.select("u", "v").union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        own = m.where("m <> u").select("u", F.col("m").alias("v"))
        large = large.union(own).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(m2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        state = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first()
        both = new
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return both.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED, distance: int = DISTANCE, blocks: int = BLOCKS
) -> DataFrame:
    """doc_id, fp, component_id, one row per input row; component_id is the smallest doc_id reachable."""
    with arrow_rows(docs.sparkSession):
        prints = written(fingerprints(docs, shingle_words, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")  # the fingerprint is the node
    roots = written(components(close_links(nodes.select(F.col("fp").alias("id"), "fp"), distance, blocks)), "roots")
    linked = _members(roots).join(nodes, F.col("node") == F.col("fp")).select("root", "node", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    found = _members(roots).join(names, "root").select("node", "root", "name")
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.when(F.col("root").isNotNull(), F.col("name")).otherwise(F.col("least")).alias("component_id"))
    return _named(prints, named).select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, shingle_words: int, seed: int) -> np.ndarray:
    """The 64-bit hashes of the distinct shingles, sorted; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    joined, s, e = _shingles(text, shingle_words)
    return np.unique(np.fromiter((xxh64_intdigest(joined[x:y], seed) for x, y in zip(s, e, strict=True)), np.uint64, len(s)))


def wide_fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """A fingerprint of 64 * words bits of a set of shingles; each hash is mixed anew for every 64."""
    odd = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        m = hashes[at : at + 4096, None] + odd
        m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((m ^ (m >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _alike(ids: np.ndarray, sets: list[np.ndarray], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (first of each tree, other) of the graph of sets whose Jaccard similarity is at least ``similarity``.

    Exact for every pair.  A set that is reached leaves the open ones; a tree starts at the
    set whose shingles are the most common, so a dense group is absorbed in a few passes.
    """
    heads, tails = [], []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids, sizes, flat = ids[sizes > 0], sizes[sizes > 0], np.concatenate(sets)
    names, flat = np.unique(flat, return_inverse=True)
    marked = np.zeros(len(names), bool)
    common = np.bincount(flat, minlength=len(names))
    while len(ids) > 1:
        starts = np.cumsum(sizes) - sizes
        first = int(np.argmax(np.add.reduceat(common[flat], starts) / sizes))
        root, frontier = ids[first], [flat[starts[first] : starts[first] + sizes[first]]]
        stay = np.arange(len(ids)) != first
        while True:
            flat, ids, sizes = flat[np.repeat(stay, sizes)], ids[stay], sizes[stay]
            if not frontier or not len(ids):
                break
            own = frontier.pop()
            marked[own] = True
            starts = np.cumsum(sizes) - sizes
            both = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            marked[own] = False
            close = similarity.denominator * both >= similarity.numerator * (len(own) + sizes - both)
            if close.any():
                heads.append(np.full(int(close.sum()), root))
                tails.append(ids[close])
                frontier += [flat[starts[i] : starts[i] + sizes[i]] for i in np.flatnonzero(close)]
            stay = ~close
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (ids[:0], ids[:0])


#: Most bytes of shingle sets of one component that a task holds once; a larger component is cut into parts of this size.
PART_BYTES = 16 << 20


def _meetings(own: int, parts: int) -> list[tuple[int, int]]:
    """(i, j) of the tasks that get a node of a component of so many parts: those that compare its part with another."""
    if parts <= 1:
        return [(0, 0)]
    i = (own * 0x9E3779B97F4A7C15 >> 20) % parts
    return [(min(i, j), max(i, j)) for j in range(parts) if j != i]


def _verified(placed: DataFrame, nodes: DataFrame, loose: DataFrame, shingle_words: int, seed: int, similarity: float, part_bytes: int) -> DataFrame:
    """Links a, b that connect the nodes of each loose component (node, root) as all its pairs at ``similarity`` or more do.

    Only texts of components of two and more are hashed again.  A component is one task's
    up to ``part_bytes``; a larger one is cut into parts, and a task compares two of them:
    every pair of sets meets, and each task gives a spanning forest of its own.
    """
    least = Fraction(str(similarity))
    members = _members(loose).join(nodes, F.col("node") == F.col("id")).select("__file", "__row", "id", F.col("root").alias("c"), "n")
    members = written(members, "members")
    large = members.groupBy("c").agg(F.ceil(8 * F.sum("n") / part_bytes).alias("parts")).where("parts > 1")
    folder = write_marks(members.join(large, "c", "left").select("__file", "__row", "id", "c", F.coalesce("parts", F.lit(1)).cast("long").alias("parts")), "member-marks")
    shape = "c long, i long, j long, id long, held binary"
    names, kinds = ["c", "i", "j", "id", "held"], [pa.int64()] * 4 + [pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            at, (ids, cs, parts) = marks_at(folder, 3, b.column("__file").to_numpy(), b.column("__row").to_numpy(), seen)
            text = b.column("text")
            rows, size = [], 0
            for k, own, c, n in zip(at.tolist(), ids.tolist(), cs.tolist(), parts.tolist(), strict=True):
                held = shingle_hashes(text[k].as_py(), shingle_words, seed).tobytes()
                for i, j in _meetings(own, n):
                    rows.append((c, i, j, own, held))
                    size += len(held) + 32
                    if size > 8 << 20:
                        yield pack(rows)
                        rows, size = [], 0
            if rows:
                yield pack(rows)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in names), strict=True))
        for _, of in groupby(rows, key=lambda r: r[:3]):
            group = [(r[3], np.frombuffer(r[4], np.uint64)) for r in of]
            a, b = _alike(np.array([i for i, _ in group], np.int64), [h for _, h in group], least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    with arrow_rows(placed.sparkSession, 500):
        hashed = placed.select("__file", "__row", "text").mapInArrow(trimmed(sets), shape)
        return written(hashed.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInArrow(links, "a long, b long"), "verified")


def _groups(
    placed: DataFrame, shingle_words: int = 5, similarity: float = 0.8, seed: int = SEED, words: int = 16, block_bits: int = 18, verify_words: int = 4, part_bytes: int = PART_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(prints: doc_id, fp of every row; nodes: fp, root, first = (no id, doc_id, __file, __row) of the first row that has it).

    Candidates come from fingerprints.  A Jaccard similarity of 0.8 is a cosine of 0.89 and
    leaves 15 % of SimHash bits different, 10 of 64: no block of a 64-bit fingerprint is
    then sure to agree.  So the fingerprint of the distinct shingles is ``64 * words`` bits,
    cut into blocks of ``block_bits``; a pair at 0.85 shares one of the 56 blocks with a
    chance of 0.99, one at 0.8 with 0.95.  What shares a block and lies within the expected
    Hamming distance at ``similarity`` and 3 standard deviations, over ``64 * verify_words``
    bits, is a candidate.  Every link is then verified on the shingle sets of the whole
    texts (as 64-bit hashes), for all pairs of a component of candidates: no link is below
    ``similarity``.  Equal shingle sets are one node, whatever the number of their rows.
    Rows are known by their place in the files, so no text is ever shuffled.
    """
    cosine = 2 * similarity / (1 + similarity)
    part, bits = float(np.arccos(cosine) / np.pi), 64 * verify_words
    distance = int(bits * part + 3 * np.sqrt(bits * part * (1 - part)))
    blocks, wide = 64 * words // block_bits, 8 * words

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sets = [shingle_hashes(t.as_py(), shingle_words, seed) for t in b.column("text")]
            fp = [wide_fingerprint(h, words) + xxh3_128_digest(h.tobytes()) for h in sets]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("__file", "__row", "doc_id")), pa.array(fp, pa.binary()), pa.array(n)], names=["__file", "__row", "doc_id", "fp", "n"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                c = b.slice(lo, 1000)
                ids = c.column("id").to_numpy()
                raw = np.frombuffer(b"".join(c.column("fp").to_pylist()), np.uint8).reshape(len(ids), -1)[:, :wide]
                cut = np.unpackbits(raw, axis=1, bitorder="little")[:, : blocks * block_bits].reshape(len(ids), blocks, block_bits)
                key = (cut.astype(np.int64) << np.arange(block_bits)).sum(axis=2) + (np.arange(blocks) << block_bits)
                held = np.repeat(raw[:, : 8 * verify_words], blocks, axis=0)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * verify_words), len(held), [None, pa.py_buffer(held.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(ids, blocks)), flat.cast(pa.binary())], names=["k", "id", "fp"])

    placed = placed.select("__file", "__row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with arrow_rows(placed.sparkSession):
        found = written(placed.mapInArrow(trimmed(prints), "__file long, __row long, doc_id long, fp binary, n long"), "wide-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__file", "__row")).alias("first")
    nodes = written(found.groupBy("fp").agg(first, F.first("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("id", "fp").mapInArrow(keys, "k long, id long, fp binary").repartition("k").sortWithinPartitions("k")
    loose = written(components(_links(keyed, distance).distinct()), "loose")
    places = nodes.select("id", "n", F.col("first.__file").alias("__file"), F.col("first.__row").alias("__row"))
    roots = components(_verified(placed, places, loose, shingle_words, seed, similarity, part_bytes))
    rooted = nodes.join(roots, nodes.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("root"), "first")
    return found.select("doc_id", "fp"), rooted


def similar_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, component_id of every row: texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    component_id is the smallest doc_id reachable, null where there is none.  Arguments and
    method are those of _groups().
    """
    prints, rooted = _groups(located(docs), **how)
    rooted = written(rooted.select("fp", "root", F.col("first.doc_id").alias("least")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return _named(prints, named).select("doc_id", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (repeated rows: one of them).

    Rows without a doc_id are known by their text here: they go where a row with one is
    alike, and otherwise one row of each group of them stays.
    """
    placed = located(docs)
    _, rooted = _groups(placed, **how)
    stays = rooted.groupBy("root").agg(F.min("first").alias("x")).select("x.__file", "x.__row", F.lit(1).cast("long").alias("kept"))
    return mark(placed, write_marks(stays, "kept-marks"), "__kept").where("__kept = 1").select(*docs.columns)
