"""Bounded-space online packing: a fixed number of open windows per partition, best-fit, no second look at documents.

A task reads its documents in turn and keeps at most ``windows`` windows of ``capacity``
tokens open.  A document, less the whole windows that one longer than a window fills by
itself, goes to the open window with the least room that holds it, else to a new one.
With all windows open and none that holds it, the fullest is emitted: its room, where
more than ``pad_most``, first takes the document's beginning, and the rest is placed
anew.  So only a document that meets no window is cut, once, and with ``pad_most`` 0 no
emitted window has padding.

Leftovers, at most ``windows`` a task, are merged by the same rule: those of ``fan_in``
tasks meet in one, which leaves as many again, until one task is left.  A task of a merge
so holds fan_in * windows windows at most (16 MB of ids), whatever the corpus.  The last
one joins its windows, fullest first, into full ones, and cuts what remains into
sequences of powers of two, which need no padding either.

Memory is that of the open windows and of one slice of texts.  A lost task packs its
partition again in the same way; what it emitted is written once, as a table.

Defined results: a null or empty text is the end id alone.  A null doc_id stays null.
Repeated rows are packed once each; texts of any length whole.  Extra columns are
ignored.  An empty table gives no rows.  Sequence ids are unique but not consecutive.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelake.llm.common import arrow_rows, trimmed, written
from scopelake.llm.tokens import bounded_slices, default_tokenizer_path, encoder

CAPACITY, WINDOWS, END_ID = 4096, 16, 2
#: Tasks whose leftovers one task of a merge takes.
FAN_IN = 64
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "lot"]
SHAPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, lot long"
_KINDS = [pa.int64()] * 7 + [pa.binary(), pa.int64()]


class Windows:
    """The open windows of a task.  Pieces are (doc_id, start, ids, doc_tokens), ids four bytes each.

    ``rooms`` holds (room, number of the window) in order, so the tightest that fits is
    found by bisection.  Emitted windows are lists of (piece, offset), in ``full``.
    """

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS, pad_most: int = 0):
        self.capacity, self.windows, self.pad_most = capacity, windows, pad_most
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple[tuple, int]]] = {}
        self.full: list[list[tuple[tuple, int]]] = []
        self.made = 0

    def _put(self, at: int, piece: tuple) -> None:
        """Into the window at that place of ``rooms``; emitted where it is full then."""
        room, number = self.rooms.pop(at)
        self.held[number].append((piece, self.capacity - room))
        room -= len(piece[2]) // 4
        if room:
            insort(self.rooms, (room, number))
        else:
            self.full.append(self.held.pop(number))

    def add(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        whole = len(ids) // 4 // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.full.append([((doc_id, start + at, ids[4 * at : 4 * (at + self.capacity)], doc_tokens), 0)])
        ids, start = ids[4 * whole :], start + whole
        while ids:
            at = bisect_left(self.rooms, (len(ids) // 4, -1))
            if at < len(self.rooms):
                self._put(at, (doc_id, start, ids, doc_tokens))
                return
            if len(self.rooms) < self.windows:
                insort(self.rooms, (self.capacity, self.made))
                self.held[self.made] = []
                self.made += 1
                self._put(bisect_left(self.rooms, (self.capacity, -1)), (doc_id, start, ids, doc_tokens))
                return
            room = self.rooms[0][0]  # the fullest
            if room > self.pad_most:
                self._put(0, (doc_id, start, ids[: 4 * room], doc_tokens))
                ids, start = ids[4 * room :], start + room
            else:
                self.full.append(self.held.pop(self.rooms.pop(0)[1]))

    def taken(self) -> list[list[tuple[tuple, int]]]:
        """The windows emitted since the last call."""
        out, self.full = self.full, []
        return out

    def left(self) -> list[list[tuple[tuple, int]]]:
        """The open windows, fullest first."""
        return [self.held[number] for _, number in self.rooms]


def joined(windows: list[list[tuple[tuple, int]]], capacity: int) -> list[list[tuple[tuple, int]]]:
    """All pieces of some windows as full windows, and the rest as windows of powers of two, largest first."""
    pieces = [piece for w in windows for piece, _ in w]
    left = sum(len(p[2]) for p in pieces) // 4
    out, room = [], 0
    for doc_id, start, ids, n in pieces:
        while ids:
            if not room:
                room = capacity if left >= capacity else 1 << left.bit_length() - 1
                out.append([])
                used = 0
            part = ids[: 4 * room]
            out[-1].append(((doc_id, start, part, n), used))
            size = len(part) // 4
            ids, start, room, used, left = ids[4 * size :], start + size, room - size, used + size, left - size
    return out


class _Rows:
    """Pieces as record batches."""

    def __init__(self, level: int, task: int, keep_ids: bool):
        self.base, self.lot, self.keep_ids = level << 56 | task << 32, task, keep_ids
        self.columns: list[list] = [[] for _ in COLUMNS]
        self.sequences = 0

    def add(self, windows: list[list[tuple[tuple, int]]], final: bool) -> None:
        """final: emitted windows; else leftovers, which keep their ids."""
        for w in windows:
            number = self.base + self.sequences
            self.sequences += 1
            for (doc_id, start, ids, n), offset in w:
                row = doc_id, start, len(ids) // 4, zlib.crc32(ids), n, number if final else None, offset, ids if self.keep_ids or not final else None, self.lot
                for column, x in zip(self.columns, row, strict=True):
                    column.append(x)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.columns, _KINDS, strict=True)], names=COLUMNS)
        self.columns = [[] for _ in COLUMNS]
        return out


def pack_partitions(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, windows: int, pad_most: int, keep_ids: bool) -> DataFrame:
    """The first pass: emitted pieces, and leftovers (sequence_id null) with their ids and task (lot)."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, open_, rows = encoder(tokenizer_path), Windows(capacity, windows, pad_most), _Rows(0, TaskContext.get().partitionId(), keep_ids)
        for b in batches:
            doc, text = b.column("doc_id"), b.column("text")
            for lo, hi in bounded_slices(text):
                for d, raw in zip(doc[lo:hi].to_pylist(), coder.encode(text[lo:hi].to_pylist()), strict=True):
                    open_.add(d, 0, raw + end, len(raw) // 4 + 1)
                rows.add(open_.taken(), True)
                yield rows.batch()
        rows.add(open_.left(), False)
        yield rows.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), SHAPE)


def merge_leftovers(left: DataFrame, level: int, last: bool, capacity: int, windows: int, pad_most: int, keep_ids: bool, fan_in: int = FAN_IN) -> DataFrame:
    """The leftovers of fan_in tasks packed as if one task had met them; with last, nothing is left over."""

    def run(part: pa.Table) -> pa.Table:
        group = part.column("lot")[0].as_py() // fan_in
        open_, rows = Windows(capacity, windows, pad_most), _Rows(level, group, keep_ids)
        order = ["lot", "doc_id", "start", "length", "ids_crc32"]  # not the order of arrival
        for r in part.sort_by([(c, "ascending") for c in order]).select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            open_.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        rows.add(open_.taken(), True)
        rows.add(joined(open_.left(), capacity) if last else open_.left(), last)
        return pa.Table.from_batches([rows.batch()])

    return left.groupBy(F.floor(F.col("lot") / fan_in).alias("_g")).applyInArrow(run, SHAPE)


def pack_online(
    docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, windows: int = WINDOWS, pad_most: int = 0, keep_ids: bool = False, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (ids)."""
    path = tokenizer_path or default_tokenizer_path("word_bpe_49k.json")
    with arrow_rows(docs.sparkSession):
        made = written(pack_partitions(docs, path, end_id, capacity, windows, pad_most, keep_ids), "packed")
    out, level = made.where("sequence_id IS NOT NULL"), 0
    tasks = (made.agg(F.max("lot")).first()[0] or 0) + 1
    while True:
        level, last = level + 1, tasks <= fan_in
        made = written(merge_leftovers(made.where("sequence_id IS NULL"), level, last, capacity, windows, pad_most, keep_ids, fan_in), "merged")
        out = out.unionByName(made.where("sequence_id IS NOT NULL"))
        if last:
            return out.select(*COLUMNS[: 7 + keep_ids])
        tasks = -(-tasks // fan_in)
