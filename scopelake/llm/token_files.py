"""Token-id files: each document compressed alone against a shared zstandard dictionary.

A set of files in the shared folder, in ascending order of doc_id (null last):

    <folder>/dictionary                 zstandard dictionary, trained on a bounded sample
    <folder>/shard-00000-<attempt>.tok  head, frames, index, foot

    head   8 bytes magic, 32 bytes SHA-256 of the dictionary
    frame  one zstandard frame per document: its ids as little-endian unsigned 16- or
           32-bit numbers (width in the index)
    index  per document: doc_id, null flag, frame offset, frame bytes, ids, width
    foot   documents, ids, index offset, magic

Any document is read by its index entry alone.  A shard is written under a name of its
own attempt and renamed when it is whole, so a lost executor leaves no half file and a
second attempt writes the same bytes.

Defined results: a null or empty text holds the end id alone.  Texts of any length are
encoded whole.  Rows of one doc_id are written once each, next to each other, in the order
of reading.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelake.llm.common import arrow_rows, file_system, shared_folder, trimmed
from scopelake.llm.tokens import END_BYTES, bounded_slices, default_tokenizer_path, encoder

MAGIC = b"TOKZSTD1"
FOOT = "<QQQ8s"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n", "<u8"), ("width", "u1")])
#: Bounds of the sample that trains the dictionary: documents, and bytes of ids from each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16_384, 65_536
LEVEL = 1


def _narrow(ids: bytes) -> tuple[bytes, int]:
    x = np.frombuffer(ids, "<u4")
    return (x.astype("<u2").tobytes(), 2) if not len(x) or int(x.max()) < 1 << 16 else (ids, 4)


def train_dictionary(docs: DataFrame, tokenizer_path: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from SAMPLE_DOCS documents, the first by a hash of their doc_id; empty if they are too few."""
    import zstandard

    # ids first, so that no task sends texts that are not chosen
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    sample = docs.select("doc_id", F.left(F.col("text"), F.lit(4 * SAMPLE_BYTES)).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = sample.orderBy("doc_id", "text").limit(SAMPLE_DOCS).collect()
    raw = encoder(tokenizer_path).encode([r["text"] for r in rows])
    samples = [_narrow(x + END_BYTES)[0][:SAMPLE_BYTES] for x in raw]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _codec(dictionary: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held), zstandard.ZstdDecompressor(dict_data=held)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None) -> list[dict]:
    """Write the files; gives the manifest, one entry per shard: shard, path, docs, ids, first id's place."""
    path = tokenizer_path or default_tokenizer_path()
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    fs, top = file_system(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/dictionary") as f:
        f.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, top = file_system(folder)
        name = f"shard-{shard:05d}-{uuid.uuid4().hex}.tok"  # the attempt's own
        own = f"{top}/.{name}"
        coder, (squeeze, _) = encoder(path), _codec(dictionary)
        index: list[np.ndarray] = []
        at, total = len(MAGIC) + len(digest), 0
        with fs.open_output_stream(own) as f:
            f.write(MAGIC + digest)
            for b in batches:
                doc, text = b.column("doc_id"), b.column("text")
                for lo, hi in bounded_slices(text):
                    frames, entries = [], []
                    for d, raw in zip(doc[lo:hi].to_pylist(), coder.encode(text[lo:hi].to_pylist()), strict=True):
                        ids, width = _narrow(raw + END_BYTES)
                        frame = squeeze.compress(ids)
                        frames.append(frame)
                        entries.append((0 if d is None else d, d is None, at, len(frame), len(ids) // width, width))
                        at, total = at + len(frame), total + len(ids) // width
                    f.write(b"".join(frames))
                    index.append(np.array(entries, INDEX))
            held = sum(map(len, index))
            for entries in index:
                f.write(entries.tobytes())
            f.write(struct.pack(FOOT, held, total, at, MAGIC))
        if index:
            fs.move(own, f"{top}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [held], "ids": [total], "name": [name]}, schema=pa.schema([("shard", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("name", pa.string())]))
        else:
            fs.delete_file(own)

    # rows of one doc_id, or without one, are dealt by their place in the reading, so that many of them are many shards
    skinny = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__at"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("doc_id").asc_nulls_last(), "__at")
    ordered = skinny.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest, first = [], 0
    with arrow_rows(docs.sparkSession):
        shards = ordered.mapInArrow(trimmed(write), "shard long, docs long, ids long, name string").collect()  # one row per shard
    for r in sorted(shards):
        manifest.append({"shard": r["shard"], "path": f"{folder}/{r['name']}", "docs": r["docs"], "ids": r["ids"], "first": first})
        first += r["ids"]
    return manifest


def _index(fs, path: str):
    """(open file, dictionary hash, index) of a shard."""
    f = fs.open_input_file(path)
    size = f.size()
    docs, _, at, magic = struct.unpack(FOOT, f.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
    head = f.read_at(len(MAGIC) + 32, 0)
    if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
        raise ValueError(f"{path} is no whole token file")
    return f, head[len(MAGIC) :], np.frombuffer(f.read_at(docs * INDEX.itemsize, at), INDEX)


def _dictionary(fs, top: str, digest: bytes) -> bytes:
    with fs.open_input_stream(f"{top}/dictionary") as f:
        held = f.read()
    if hashlib.sha256(held).digest() != digest:
        raise ValueError("the dictionary is not the one these files were written with")
    return held


def read_document(shard_path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document of a shard, by its index entry; None if it isn't there."""
    fs, path = file_system(shard_path)
    f, digest, index = _index(fs, path)
    with f:
        found = np.flatnonzero((index["doc_id"] == doc_id) & (index["null"] == 0))
        if not len(found):
            return None
        e = index[found[0]]
        _, expand = _codec(_dictionary(fs, path.rpartition("/")[0], digest))
        raw = expand.decompress(f.read_at(int(e["size"]), int(e["offset"])))
        return np.frombuffer(raw, f"<u{e['width']}").astype(np.uint32)


def read_token_files(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32 (and ids as little-endian uint32)."""
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                fs, at = file_system(path)
                f, digest, index = _index(fs, at)
                _, expand = _codec(_dictionary(fs, at.rpartition("/")[0], digest))
                with f:
                    for lo in range(0, len(index), 500):
                        part = index[lo : lo + 500]
                        base = int(part["offset"][0])
                        block = f.read_at(int(part["offset"][-1]) + int(part["size"][-1]) - base, base)
                        rows: list[list] = [[] for _ in columns]
                        for e in part:
                            o = int(e["offset"]) - base
                            raw = expand.decompress(block[o : o + int(e["size"])])
                            ids = raw if e["width"] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                            n = len(ids) // 4
                            for row, x in zip(rows, (None if e["null"] else int(e["doc_id"]), first, n, zlib.crc32(ids), ids), strict=False):
                                row.append(x)
                            first += n
                        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names=columns)

    shape = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in columns)
    if not manifest:
        return spark.createDataFrame([], shape)
    rows = spark.createDataFrame([(m["path"], m["first"]) for m in manifest], "path string, first long")
    return rows.repartition(len(manifest), "path").mapInArrow(read, shape)


def encode_to_files(docs: DataFrame, tokenizer_path: str | None = None, folder: str | None = None) -> tuple[list[dict], DataFrame]:
    """(manifest, what the written files hold)."""
    manifest = write_token_files(docs, folder or shared_folder(docs.sparkSession, "token-files"), tokenizer_path)
    return manifest, read_token_files(docs.sparkSession, manifest)
