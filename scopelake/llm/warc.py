"""WARC archives: write with deduplication and segments, read back by segment reassembly.

Writing.  Payloads are compared by SHA-256 and never shuffle: smallest page_id per digest
from a partial aggregation, digests that occur twice joined back to the places of their
rows (dealt out over as many salts as the digest's rows need), and the originals of
revisits read by place where the page is written.  A page
becomes a ``response`` record (HTTP head, chunked transfer framing) or a ``revisit``
(head with the payload's length and digest, no payload).  A block longer than
``segment_bytes`` is cut: segment 1 stays a response, the rest are ``continuation``
records with origin identifier and number, the last with the total length.  Each record
is a gzip member of its own; a file is renamed when it is whole, to a name of the attempt's
own that its rows return.

Reading.  Files are parsed member by member, so memory is bounded by one segment.
Continuations are grouped by origin identifier, ordered by segment number, checked
against the total length and freed of the chunked framing.  Every payload's digest is
computed anew and compared with the record's.

Record identifiers hold the page, the digest, the writing task and a running number, so
no two records share one.  A revisit refers to its original by page and digest alone, the
beginning of the original's identifier.

Defined results: a null html is the empty payload.  Pages with the smallest page_id of
their payload are responses, also when the row is repeated.  A null page_id never is
the original of a page that has an id; if all copies lack one they are all responses.
Payloads of any length are written whole, in segments.  Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelake.llm.common import file_system, located, mark, shared_folder, write_marks, written

LEAST_REVISIT = 100
SEGMENT_BYTES, CHUNK_BYTES, ROLL_BYTES = 32_768, 8_192, 256 << 20
#: Rows of one digest that meet in a task.
SALT_ROWS = 100_000
#: Digests with more rows than that, up to which they are broadcast (10 MB).
FEW_HOT = 100_000
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += (b"%x\r\n" % len(part), part, CRLF)
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """What the framing holds; chunk extensions are skipped, a broken frame is an error."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        parts.append(body[at : at + size])
        if len(parts[-1]) != size or body[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        at += size + 2


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_records(record_id: str, page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    common += [] if page_id is None else [("X-Page-ID", str(page_id))]
    if refers_to is not None:
        fields = [*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", "application/http; msgtype=response")]
        yield record("revisit", fields, HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    common.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        yield record("response", common, block)
        return
    last = -(-len(block) // segment_bytes)
    for n in range(1, last + 1):
        part = block[(n - 1) * segment_bytes : n * segment_bytes]
        if n == 1:
            yield record("response", [*common, ("WARC-Segment-Number", "1")], part)
            continue
        fields = [("WARC-Record-ID", f"<{record_id}/{n}>"), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n))]
        fields += [("WARC-Segment-Total-Length", str(len(block)))] if n == last else []
        yield record("continuation", fields, part)


def read_records(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an open file of gzip members."""
    rest = b""
    while True:
        expand, parts = zlib.decompressobj(31), []
        while not expand.eof:
            rest = rest or stream.read(step)
            if not rest:
                if parts:
                    raise ValueError("the file ends inside a record")
                return
            parts.append(expand.decompress(rest))
            rest = expand.unused_data if expand.eof else b""
        raw = b"".join(parts)
        end = raw.index(b"\r\n\r\n")
        lines = raw[:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        block = raw[end + 4 : end + 4 + size]
        if not lines[0].startswith("WARC/") or len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError("broken record")
        yield fields, block


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload, digest, original (null for responses).

    What is grouped and joined are digests with the places of their rows; the marks of
    revisits are then read by place, so that no payload shuffles.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = located(pages).select("__file", "__row", F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digests = written(p.where(F.octet_length("payload") >= least).select("__file", "__row", "page_id", F.sha2("payload", 256).alias("digest")), "digests")
    seen = digests.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    # a salt for every SALT_ROWS rows of a digest: its rows meet in tasks of about so many, however many there are
    seen = written(seen.where("n > 1 AND original IS NOT NULL").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS)), "originals")
    some, hot = seen.agg(F.count("*"), F.count_if(F.col("salts") > 1)).first()
    if not some:
        return p.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.lit(None).cast("long").alias("original"))
    salted = digests.withColumn("_n", F.lit(1))
    if hot:
        many = seen.where("salts > 1").select(F.col("d").alias("_d"), F.col("salts").alias("_n"))
        salted = digests.join(F.broadcast(many) if hot <= FEW_HOT else many, F.col("digest") == F.col("_d"), "left")
    salted = salted.withColumn("_s", F.pmod(F.xxhash64("__file", "__row"), F.coalesce("_n", F.lit(1))))
    seen = seen.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    again = salted.join(seen, (F.col("digest") == F.col("d")) & (F.col("_s") == F.col("s"))).where("NOT original <=> page_id")
    marks = write_marks(again.select("__file", "__row", "original"), "revisits")
    return mark(p, marks, "original").select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), "original")


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT, roll_bytes: int = ROLL_BYTES) -> list[str]:
    """Write the archives; gives their paths (one or more per task that had pages)."""
    fs, top = file_system(folder)
    fs.create_dir(top, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, fs, top = TaskContext.get().partitionId(), *file_system(folder)
        out, own, size, names, made, attempt = None, "", 0, [], 0, uuid.uuid4().hex

        def close() -> None:
            out.close()
            names.append(f"part-{part:05d}-{len(names):04d}-{attempt}.warc.gz")
            fs.move(own, f"{top}/{names[-1]}")

        for b in batches:
            for page, url, payload, digest, original in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "original")), strict=True):
                # the writing task and a running number: repeated rows are records of their own, wherever they lie
                name, made = f"urn:page:{page}:{digest[:32]}:{part}:{made}", made + 1
                refers = None if original is None else f"urn:page:{original}:{digest[:32]}"
                if out is None:
                    own, size = f"{top}/.{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(own, compression=None)
                for r in page_records(name, page, (url or "").replace("\r", "").replace("\n", ""), payload, digest, refers, segment_bytes):
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = squeeze.compress(r) + squeeze.flush()
                    out.write(packed)
                    size += len(packed)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if names:
            yield pa.RecordBatch.from_pydict({"name": names})

    return [f"{folder}/{r['name']}" for r in revisits(pages, least_revisit).mapInArrow(write, "name string").collect()]  # one short name per archive


SEEN = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
SEEN_SQL = "page_id long, record_type string, refers_to long, digest string, bytes long, origin string, segment long, total long, block binary"


def _payload(block: bytes, digest: str) -> bytes:
    payload = unchunked(block[block.index(b"\r\n\r\n") + 4 :])
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return payload


def read_archives(spark: SparkSession, paths: list[str], with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload of responses) of every page."""
    shape = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    if not paths:
        return spark.createDataFrame([], shape)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEEN, strict=True)], schema=SEEN)

        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as stream:
                    for f, block in read_records(stream):
                        kind, segment = f["WARC-Type"], number(f.get("WARC-Segment-Number"))
                        own, digest = f["WARC-Record-ID"], f.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                        size, origin, kept = None, None, None
                        if segment is not None:
                            origin, kept = f.get("WARC-Segment-Origin-ID", own), block
                        elif kind == "revisit":
                            size = int(block.split(b"Content-Length: ")[1].split(CRLF)[0])
                        else:
                            payload = _payload(block, digest)
                            size, kept = len(payload), payload if with_payload else None
                        refers = f["WARC-Refers-To"].split(":")[2] if kind == "revisit" else None
                        rows.append((number(f.get("X-Page-ID")), kind, number(refers), digest, size, origin, segment, number(f.get("WARC-Segment-Total-Length")), kept))
                        held += len(kept or b"") + 200
                        if held > 4 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    def join(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["segment"])
        first, whole = rows[0], b"".join([r["block"] for r in rows])
        if [r["segment"] for r in rows] != list(range(1, len(rows) + 1)) or rows[-1]["total"] != len(whole):
            raise ValueError(f"{first['origin']}: segments are missing, or their length is not the total")
        payload = _payload(whole, first["digest"])
        out = {"page_id": pa.array([first["page_id"]], pa.int64()), "payload_bytes": pa.array([len(payload)], pa.int64()), "payload_digest": [first["digest"]], "record_type": [first["record_type"]], "refers_to": pa.array([None], pa.int64())}
        return pa.table(out | ({"payload": pa.array([payload], pa.binary())} if with_payload else {}))

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path")
    seen = written(files.mapInArrow(parse, SEEN_SQL), "warc-records")
    whole = seen.where("segment IS NULL").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", *[F.col("block").alias("payload")] * with_payload
    )
    # a group is one payload
    joined = seen.where("segment IS NOT NULL").groupBy("origin").applyInArrow(join, shape)
    return whole.unionByName(joined)


def archive(pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> tuple[list[str], DataFrame]:
    """(paths of the archives, what they hold)."""
    paths = write_archives(pages, folder or shared_folder(pages.sparkSession, "warc"), segment_bytes)
    return paths, read_archives(pages.sparkSession, paths)
