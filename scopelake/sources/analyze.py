"""Files to rows: one Arrow pass over (path, content) gives metrics and scopes of every file."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelake.sources.analyzers.rows import FileRow, Scope

FILE_COUNTS = [n for n in FileRow.__dataclass_fields__ if n != "scopes"]
SCOPE_FIELDS = ["name", "origin_type", "complexity", "nloc", "start_line", "end_line", "parameter_count", "max_nesting_depth", "comment_lines", "todo_count", "ts_type_interface_count", "md_data_url_count"]
_DOUBLES = {"complexity", "comment_density", "average_function_length"}
_kind = lambda n: "double" if n in _DOUBLES else "string" if n in ("name", "origin_type") else "long"
SCOPE_SQL = "array<struct<scope_id:long,parent_scope_id:long,depth:int,name_path:string," + ",".join(f"{n}:{_kind(n)}" for n in SCOPE_FIELDS) + ">>"
SCHEMA = "path string, language string, error string, " + ", ".join(f"{n} {_kind(n)}" for n in FILE_COUNTS) + f", scopes {SCOPE_SQL}"


def analyzer(path: str) -> tuple[str, Callable[[str, str], FileRow]]:
    """(language, scan) by the last suffix."""
    from scopelake.sources.analyzers import css_scan, generic_scan, md_scan, notebook_scan, py_scan, ts_scan  # notebooks one by one; analyze() reads them in the JVM

    end = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if end in ("ts", "tsx"):
        return "typescript", ts_scan.scan_typescript
    if end in ("css", "scss"):
        return end, css_scan.scan_css
    if end in ("md", "markdown"):
        return "markdown", md_scan.scan_markdown
    if end == "ipynb":
        return "notebook", notebook_scan.scan_notebook
    if end == "py":
        return "python", py_scan.scan_python
    return "generic", generic_scan.scan_generic


@contextmanager
def time_limit(seconds: float):
    """TimeoutError after so many seconds; no limit where signals can't be used."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"more than {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def flat_scopes(f: FileRow) -> list[dict]:
    out: list[dict] = []

    def add(s: Scope, parent: int | None, depth: int, above: str) -> None:
        own = len(out)
        row = {n: getattr(s, n) for n in SCOPE_FIELDS}
        names = f"{above}::{s.name}" if above else s.name
        out.append({"scope_id": own, "parent_scope_id": parent, "depth": depth, "name_path": names, **row, "complexity": float(s.complexity)})
        for c in s.children:
            add(c, own, depth + 1, names)

    for s in f.scopes:
        add(s, None, 0, "")
    return out


def analyze_text(path: str, content: str, seconds: float = 10.0) -> dict:
    """The row of one file; what goes wrong is in ``error`` and the rest is null."""
    language, scan = analyzer(path)
    try:
        with time_limit(seconds):
            f = scan(content, path)
        row = {n: getattr(f, n) for n in FILE_COUNTS}
        return {"path": path, "language": language, "error": None, **row, "scopes": flat_scopes(f)}
    except (Exception, RecursionError) as e:  # one file never fails the job
        return {"path": path, "language": language, "error": f"{type(e).__name__}: {e}"[:500], **dict.fromkeys(FILE_COUNTS), "scopes": None}


def analyze(files: DataFrame, seconds: float = 10.0) -> DataFrame:
    """files (path, content) -> file metrics with their scopes.

    Notebooks are read by expressions on their JSON text; other files by one Python call
    each, in one pass.  files is read by both, so where contents are read from a store it
    should be persisted.
    """
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [analyze_text(p, c or "", seconds) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            for lo in range(0, len(rows), 200):
                yield pa.RecordBatch.from_pylist(rows[lo : lo + 200], schema=schema)

    f = files.select("path", F.col("content").cast("string").alias("content"))
    notebook = F.lower("path").endswith(".ipynb")
    return f.where(~notebook).mapInArrow(run, SCHEMA).unionByName(notebook_files(f.where(notebook)))


def notebook_files(files: DataFrame) -> DataFrame:
    """Rows as analyze() gives them of notebooks (path, content): a scope for every cell with ink."""
    from scopelake.operators.notebooks import cell_array

    cells = F.filter(F.transform(cell_array(F.col("content")), lambda c, i: F.struct(i.alias("i"), c["cell_type"].alias("kind"), F.size(c["lines"]).cast("long").alias("n"))), lambda c: c["n"] > 0)
    f = files.withColumn("c", cells)
    before = lambda i: F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda s, c: s + c["n"])

    def scope(c, i):
        name = F.concat(F.lit("["), c["kind"], F.lit("] cell "), (c["i"] + 1).cast("string"))
        own = {"name": name, "origin_type": F.concat(F.lit("notebook_"), c["kind"]), "nloc": c["n"], "start_line": before(i) + 1, "end_line": before(i) + c["n"]}
        fields = [own.get(n, F.lit(0)).cast(_kind(n)).alias(n) for n in SCOPE_FIELDS]
        return F.struct(i.cast("long").alias("scope_id"), F.lit(None).cast("long").alias("parent_scope_id"), F.lit(0).alias("depth"), name.alias("name_path"), *fields)

    n, total = F.size("c").cast("long"), F.aggregate("c", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    held = {"loc": total, "function_count": n, "average_function_length": F.when(n > 0, total / n).otherwise(0.0)}
    bad = F.col("c").isNull()
    counts = [F.when(~bad, held.get(m, F.lit(0))).cast(_kind(m)).alias(m) for m in FILE_COUNTS]
    error = F.when(bad, F.lit("ValueError: no notebook")).alias("error")
    return f.select("path", F.lit("notebook").alias("language"), error, *counts, F.when(~bad, F.transform("c", scope)).cast(SCOPE_SQL).alias("scopes"))


def _arrow_schema() -> pa.Schema:
    kinds = {"double": pa.float64(), "long": pa.int64(), "string": pa.string()}
    scope = pa.struct([("scope_id", pa.int64()), ("parent_scope_id", pa.int64()), ("depth", pa.int32()), ("name_path", pa.string()), *[(n, kinds[_kind(n)]) for n in SCOPE_FIELDS]])
    return pa.schema([("path", pa.string()), ("language", pa.string()), ("error", pa.string()), *[(n, kinds[_kind(n)]) for n in FILE_COUNTS], ("scopes", pa.list_(scope))])


def scopes(analyzed: DataFrame) -> DataFrame:
    """One row per scope of every file that could be read."""
    return analyzed.where("error IS NULL").select("path", F.explode("scopes").alias("s")).select("path", "s.*")


def with_body_loc(found: DataFrame) -> DataFrame:
    """scopes() with body_loc: the lines of a scope that none of its children covers; 0 without children."""
    from scopelake.operators.tree import interval_union

    parents = found.select("path", F.col("scope_id").alias("parent_scope_id"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    spans = found.select("path", "parent_scope_id", "start_line", "end_line").join(parents, ["path", "parent_scope_id"])
    spans = spans.select(F.struct("path", F.col("parent_scope_id").alias("scope_id")).alias("key"), F.greatest("start_line", "_a").alias("start_line"), F.least("end_line", "_b").alias("end_line"))
    covered = interval_union(spans).select("key.*", "covered")
    lines = F.col("end_line") - F.col("start_line") + 1
    return found.join(covered, ["path", "scope_id"], "left").withColumn("body_loc", F.coalesce(F.greatest(F.lit(0), lines - F.col("covered")), F.lit(0)).cast("long")).drop("covered")


def failed(analyzed: DataFrame) -> DataFrame:
    return analyzed.where("error IS NOT NULL").select("path", "error")


def file_rows(analyzed: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Files that could be read with every metric (0 where it is not measured); sizes: path, file_size, last_modified."""
    from scopelake.functions.catalogue import FIELDS, metric_type

    f = analyzed.where("error IS NULL").drop("scopes", "error")
    if sizes is not None:
        f = f.join(sizes, "path", "left")
    for m in FIELDS:
        present = F.col(m) if m in f.columns else F.lit(1 if m == "file_count" else 0)
        f = f.withColumn(m, F.coalesce(present, F.lit(0)).cast(metric_type(m)))
    return f


def nodes(analyzed: DataFrame, sizes: DataFrame | None = None, folders: DataFrame | None = None) -> DataFrame:
    """Folder, file and scope nodes with the metrics of each (0 where a metric is not measured).

    sizes: path, file_size, last_modified.  folders: their metrics, where they are kept and
    need no roll-up.  Scopes that have children and lines of their own get a ``(body)`` child.
    """
    from scopelake.functions.catalogue import FIELDS, metric_type
    from scopelake.operators.tree import parent_path, rollup_metrics

    f = file_rows(analyzed, sizes)
    name = F.substring_index("path", "/", -1)

    def shaped(df: DataFrame, kind: str, node_id, parent, name, start, end, depth=None) -> DataFrame:
        depth = F.size(F.split("path", "/")) if depth is None else depth
        return df.select(
            node_id.alias("node_id"), parent.alias("parent"), F.lit(kind).alias("node_type"), name.alias("name"), "path", depth.cast("int").alias("depth"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"),
            *[(F.col(m) if m in df.columns else F.lit(0)).cast(metric_type(m)).alias(m) for m in FIELDS],
        )

    zero = F.lit(0)
    files = shaped(f, "file", F.col("path"), parent_path(F.col("path")), name, zero, zero)
    folders = shaped(rollup_metrics(f) if folders is None else folders, "folder", F.col("path"), parent_path(F.col("path")), name, zero, zero)
    s = with_body_loc(scopes(analyzed)).withColumns({"loc": F.col("nloc"), "comment_density": F.when(F.col("nloc") > 0, F.col("comment_lines") / F.col("nloc")).otherwise(0.0)})
    key = lambda c: F.concat_ws("::", F.col("path"), F.col(c).cast("string"))
    s = s.withColumns({"_id": key("scope_id"), "_parent": F.when(F.col("parent_scope_id").isNull(), F.col("path")).otherwise(key("parent_scope_id")), "depth": F.size(F.split("path", "/")) + F.col("depth") + 1, "path": F.concat_ws("::", "path", "name_path")})
    # eight metrics and the place; the rest stays 0 below files
    kept = ["loc", "complexity", "comment_lines", "comment_density", "max_nesting_depth", "parameter_count", "todo_count", "ts_type_interface_count", "md_data_url_count"]
    s = s.select("path", "name", "_id", "_parent", "depth", "start_line", "end_line", "body_loc", *kept)
    own = shaped(s, "function", F.col("_id"), F.col("_parent"), F.col("name"), F.col("start_line"), F.col("end_line"), F.col("depth"))
    bodies = s.where("body_loc > 0").select(F.concat("_id", F.lit("::(body)")).alias("_body"), "_id", F.concat("path", F.lit("::(body)")).alias("path"), F.col("body_loc").alias("loc"), (F.col("depth") + 1).alias("depth"), "start_line", "end_line")
    body = shaped(bodies, "function_body", F.col("_body"), F.col("_id"), F.lit("(body)"), F.col("start_line"), F.col("end_line"), F.col("depth"))
    return folders.unionByName(files).unionByName(own).unionByName(body)
