"""Lists of vectors by nearest centre, in files of the shared folder.

Every vector is keyed by its nearest centre and its distance to it, range-partitioned by
(centre, distance, id) and cut into rings of at most ``rows`` vectors, written one after
another.  Equal vectors in any number fill several rings; no centre is one task.  A
centre's list of rings is a file of its own; what is broadcast is a row per centre: the
radius of its nearest and farthest vector, the greatest squared norm and the list's file.

Each attempt of a task writes under a name of its own and returns it with its rows, so
a repeated task neither meets nor replaces another's file.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scopelake.llm.common import file_system, shared_folder, written
from scopelake.llm.vectors import matrix

#: What the list of a centre says of each ring.
RING = np.dtype([("inner", "<f8"), ("outer", "<f8"), ("top", "<f8"), ("n", "<i8"), ("file", "<i8"), ("offset", "<i8")])
#: What is known of each centre that has vectors.
CENTRE = np.dtype([("centre", "<i8"), ("inner", "<f8"), ("outer", "<f8"), ("top", "<f8"), ("file", "<i8")])
#: Rings a reader remembers (48 bytes each), files it holds open.
RINGS, FILES = 1 << 18, 32


def keyed(x: DataFrame, centres: np.ndarray) -> DataFrame:
    """x (with v, norm2) and the nearest centre of each vector with the distance to it."""
    shared = x.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        p2 = (p**2).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"))
            with np.errstate(all="ignore"):
                d2 = p2[None] - 2 * (v @ p.T)
                at = d2.argmin(1)
                dist = np.sqrt(np.maximum(0, b.column("norm2").to_numpy() + d2[np.arange(len(v)), at]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(dist)], names=[*b.schema.names, "centre", "dist"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema.fields)
    return x.mapInArrow(run, f"{shape}, centre int, dist double")


def in_order(rows: DataFrame, parts: int) -> DataFrame:
    order = ["centre", "dist", "vec_id"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


class Lists:
    """The lists of one index; sent to the tasks, which read it through ``reader``."""

    def __init__(self, folder: str, centres: np.ndarray, known: np.ndarray, kind: str, width: int, longs: int):
        self.folder, self.centres, self.known, self.kind, self.width, self.longs = folder, centres, known, kind, width, longs

    def reader(self) -> "Reader":
        return Reader(self)


class Reader:
    """Reads rings within a task; a context that closes its files."""

    def __init__(self, lists: Lists):
        self.lists, (self.fs, self.top), self.files, self.rings = lists, file_system(lists.folder), {}, {}

    def __enter__(self) -> "Reader":
        return self

    def __exit__(self, *_) -> None:
        for f in self.files.values():
            f.close()
        self.files = {}

    def list_of(self, file: int) -> np.ndarray:
        """The rings in a list's file."""
        if file not in self.rings:
            if sum(map(len, self.rings.values())) > RINGS:
                self.rings.clear()
            with self.fs.open_input_file(f"{self.top}/list-{file:016x}") as f:
                self.rings[file] = np.frombuffer(f.read(), RING)
        return self.rings[file]

    def ring(self, r: np.void) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id and the other longs as rows, vectors) of a ring."""
        file, n = int(r["file"]), int(r["n"])
        if file not in self.files:
            if len(self.files) >= FILES:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.fs.open_input_file(f"{self.top}/rings-{file:016x}")
        longs, each = self.lists.longs, int(self.lists.kind[2])
        raw = self.files[file].read_at(n * (8 * longs + self.lists.width * each), int(r["offset"]))
        return np.frombuffer(raw, "<i8", longs * n).reshape(longs, n), np.frombuffer(raw, self.lists.kind, offset=8 * longs * n).reshape(n, self.lists.width)


def write_lists(rows: DataFrame, centres: np.ndarray, ring_rows: int, parts: int, kind: str, *more: str) -> Lists:
    """Lists of keyed rows (vec_id, v, norm2, centre, dist and ``more`` long columns), components in ``kind``."""
    folder, width, longs = shared_folder(rows.sparkSession, "lists"), centres.shape[1], ["vec_id", *more]
    fs, top = file_system(folder)
    fs.create_dir(top, recursive=True)
    names = ["centre", *RING.names]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, (fs, top) = secrets.randbits(62), file_system(folder)
        at, made, held = 0, [], []
        out = fs.open_output_stream(f"{top}/rings-{file:016x}", compression=None)

        def cut(last: bool) -> None:
            nonlocal at, held
            ids, *rest = zip(*held, strict=True)
            ids, (v, norm2, centre, dist) = np.concatenate(ids, axis=1), map(np.concatenate, rest)
            begin, n = 0, len(dist)
            while begin < n:
                end = begin + int(np.searchsorted(centre[begin:], centre[begin], "right"))
                if not last and end == n and end - begin < ring_rows:
                    break
                end = min(end, begin + ring_rows)
                s = slice(begin, end)
                raw = np.ascontiguousarray(ids[:, s], "<i8").tobytes() + v[s].astype(kind).tobytes()
                out.write(raw)
                made.append((int(centre[begin]), float(dist[s].min()), float(dist[s].max()), float(norm2[s].max()), end - begin, file, at))
                at, begin = at + len(raw), end
            held = [(ids[:, begin:], v[begin:], norm2[begin:], centre[begin:], dist[begin:])] if begin < n else []

        for b in batches:
            if b.num_rows:
                held.append((np.stack([b.column(c).to_numpy() for c in longs]), matrix(b.column("v")), *(b.column(c).to_numpy() for c in ("norm2", "centre", "dist"))))
            if sum(len(h[-1]) for h in held) >= 4 * ring_rows:
                cut(False)
        if held:
            cut(True)
        out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=names)
        else:
            fs.delete_file(f"{top}/rings-{file:016x}")

    def enlist(part: pa.Table) -> pa.Table:
        ring = np.empty(part.num_rows, RING)
        for c in RING.names:
            ring[c] = part.column(c).to_numpy()
        ring.sort(order=["inner", "outer", "file", "offset"])
        file, (fs, top) = secrets.randbits(62), file_system(folder)
        with fs.open_output_stream(f"{top}/list-{file:016x}", compression=None) as f:
            f.write(ring.tobytes())
        return pa.table({"centre": [part.column("centre")[0].as_py()], "inner": [ring["inner"].min()], "outer": [ring["outer"].max()], "top": [ring["top"].max()], "file": [file]})

    made = written(in_order(rows, parts).select(*longs, "v", "norm2", "centre", "dist").mapInArrow(write, "centre long, inner double, outer double, top double, n long, file long, offset long"), "rings")
    found = made.groupBy("centre").applyInArrow(enlist, "centre long, inner double, outer double, top double, file long").collect()  # a row per centre
    return Lists(folder, centres, np.array([tuple(r) for r in found], CENTRE), kind, width, len(longs))
