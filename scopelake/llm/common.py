"""What the operators of this subpackage share: the shared folder, written tables, marks of rows, words."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Fixed value: the white space between words, and the words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor and the driver can reach.

    It lies under ``spark.checkpoint.dir``.  Where the session has no such setting a
    temporary folder is made, set as the checkpoint folder and removed at the end of the
    process - in local mode only, since executors elsewhere could not reach it.  What is
    written under a named folder stays, since results are read from it lazily; within
    ``scope()`` it is deleted at the end.  Asking for the context's folder and the plan of
    a DataFrame (``located``) needs a classic session, not Spark Connect.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            top = made.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            made = tempfile.mkdtemp(prefix="llm-checkpoints-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            top = "file://" + made
            spark.sparkContext.setCheckpointDir(top)
    made = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(made)
    return made


_SCOPES: list[list[str]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end what operators wrote to the shared folder inside: read or write their results before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            fs, path = file_system(folder)
            with suppress(FileNotFoundError):
                fs.delete_dir(path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut and nothing is computed twice."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Smaller Arrow batches for the actions inside: a batch of whole texts stays at a few megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of one file whose marks are kept together.
_MARK_ROWS = 1 << 20


def _plain_scan(docs: DataFrame) -> bool:
    """Whether docs are rows of files, selected and filtered at most: each then has a place of its own."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and "_metadata" not in docs.columns


def located(docs: DataFrame) -> DataFrame:
    """docs with __file (64-bit hash of the path) and __row (its number in the file): the place of each row.

    Places name rows whatever their columns hold, and the same in every reading.  Rows
    that aren't read straight from Parquet files are written first.
    """
    if _plain_scan(docs):
        try:
            of = docs.metadataColumn("_metadata")
            return docs.withColumns({"__file": F.xxhash64(of["file_path"]), "__row": of["row_index"]})
        except Exception as e:  # files without row numbers
            if "_metadata" not in str(e) and "row_index" not in str(e):
                raise
    docs = written(docs, "located")
    of = docs.metadataColumn("_metadata")
    return docs.withColumns({"__file": F.xxhash64(of["file_path"]), "__row": of["row_index"]})


def _mark_file(folder: str, file: int, part: int) -> str:
    return f"{folder}/{file & (1 << 64) - 1:016x}-{part:x}"


def settle(fs, own: str, name: str) -> None:
    """Rename a whole file to a name that every attempt of a task gives it, with the same content.

    Where another attempt was first, a store may replace its file or refuse; both are right.
    """
    try:
        fs.move(own, name)
    except OSError:
        if not fs.get_file_info(name).is_file:
            raise
        fs.delete_file(own)


def write_marks(marks: DataFrame, name: str) -> str:
    """Write marks (__file, __row and further long columns, one row per place) for reading by place; gives the folder.

    One small file per 2**20 rows of a file of documents holds its marks in order of row.
    """
    folder, columns = shared_folder(marks.sparkSession, name), marks.columns
    fs, top = file_system(folder)
    fs.create_dir(top, recursive=True)

    def write(part: pa.Table) -> pa.Table:
        held = np.stack([part.column(c).to_numpy() for c in columns if c != "__file"])
        held = np.ascontiguousarray(held[:, np.argsort(held[0])], dtype="<i8")
        fs, top = file_system(folder)
        own, name = f"{top}/.{uuid.uuid4().hex}", _mark_file(top, part.column("__file")[0].as_py(), part.column("__part")[0].as_py())
        with fs.open_output_stream(own) as f:
            f.write(held.tobytes())
        settle(fs, own, name)
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    chunk = F.shiftright("__row", _MARK_ROWS.bit_length() - 1).alias("__part")
    marks.select("*", chunk).groupBy("__file", "__part").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def _read_marks(folder: str, columns: int, file: int, part: int) -> np.ndarray:
    fs, path = file_system(_mark_file(folder, file, part))
    try:
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), "<i8").reshape(columns + 1, -1)
    except FileNotFoundError:
        return np.zeros((columns + 1, 0), np.int64)


def marks_at(folder: str, columns: int, files: np.ndarray, rows: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """(which of the places are marked, the marks of those as columns); held keeps what the caller read last."""
    marked, found = [], []
    parts = rows // _MARK_ROWS
    edges = np.flatnonzero((files[1:] != files[:-1]) | (parts[1:] != parts[:-1])) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
        key = int(files[lo]), int(parts[lo])
        if key not in held:
            held.clear()
            held[key] = _read_marks(folder, columns, *key)
        marks = held[key]
        at = np.searchsorted(marks[0], rows[lo:hi])
        at[at == marks.shape[1]] = 0
        same = np.flatnonzero(marks[0][at] == rows[lo:hi]) if marks.shape[1] else np.zeros(0, np.int64)
        marked.append(lo + same)
        found.append(marks[1:, at[same]])
    return np.concatenate(marked), np.concatenate(found, axis=1)


def mark(docs: DataFrame, folder: str, name: str) -> DataFrame:
    """located docs with the mark (long; null: none) of each row, read by place.

    Only places go to Python; the rows themselves neither leave the JVM nor shuffle.
    """

    @arrow_udf("long")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        held: dict = {}
        for files, rows in batches:
            if not len(rows):
                yield pa.array([], pa.int64())
                continue
            at, found = marks_at(folder, 1, files.to_numpy(), rows.to_numpy(), held)
            out, none = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
            out[at], none[at] = found[0], False
            yield pa.array(out, pa.int64(), mask=none)

    return docs.withColumn(name, read.asNondeterministic()("__file", "__row"))  # evaluated once, also below a filter


def trimmed(run):
    """run, a function of Arrow batches, giving back what the allocators hold when its batches end: workers outlive tasks."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return through


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
