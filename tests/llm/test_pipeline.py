"""The whole pipeline against each step done by hand on the rows before it."""

import struct
import zlib
from collections import Counter, defaultdict

from scopelake.llm import classifier, mixing
from tests.llm.test_contracts import components_by_jaccard, reference
from tests.llm.test_more import linked_by_pairs


def masked(text, mask="<SECRET>"):
    """Every span that the pairwise linker reports, touching ones as one."""
    out, at = [], 0
    runs = []
    for start, end in sorted((s, e) for s, _, e in linked_by_pairs(text or "")):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(end, runs[-1][1])
        else:
            runs.append([start, end])
    for start, end in runs:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]]) if runs else text


def pieces(ids, capacity=2048):
    at, end = 0, len(ids) % capacity or capacity
    for n in range(-(-len(ids) // capacity)):
        part = ids[at:end]
        yield n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        at, end = end, end + capacity


def test_the_pipeline_equals_its_steps_by_hand(spark, sf):
    import corpus_pipeline

    sf = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    good = {r["doc_id"] for r in classifier.classify(docs, labels).collect() if r["predicted"] == 1}
    alike = components_by_jaccard([(d, rows[d]["text"]) for d in sorted(good)])
    single = sorted({c for c in alike.values()})
    clean = [{**rows[d], "text": masked(rows[d]["text"])} for d in single]
    for r in clean:
        r["n_chars"] = len(r["text"] or "") if r["text"] != rows[r["doc_id"]]["text"] else r["n_chars"]
    assert any(r["text"] != rows[r["doc_id"]]["text"] for r in clean) and len(clean) < len(good) < len(rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(clean, docs.schema)).collect()}
    ids = [x.tolist() for x in reference([r["text"] for r in clean])]
    want = Counter()
    for r, x in zip(clean, ids, strict=True):
        for p in pieces(x):
            want[(r["doc_id"], *p)] += copies[r["doc_id"]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(held) <= 1.1 * total / 2048 + 1
