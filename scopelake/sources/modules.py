"""Dependency graph of TypeScript files: one Arrow pass for imports and exports, then joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelake.functions.text import label_of_path
from scopelake.operators import deps
from scopelake.sources.analyze import time_limit
from scopelake.sources.analyzers.ts_scan import imports_exports

SQL = "path string, error string, imports array<struct<source:string,symbols:array<string>>>, exports array<struct<name:string,type:string>>"


def scan_modules(files: DataFrame, seconds: float = 10.0) -> DataFrame:
    """files (path, content) -> path, error, imports, exports; a file that takes longer is an error."""
    imports = pa.list_(pa.struct([("source", pa.string()), ("symbols", pa.list_(pa.string()))]))
    exports = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
    schema = pa.schema([("path", pa.string()), ("error", pa.string()), ("imports", imports), ("exports", exports)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with time_limit(seconds):
                        i, e = imports_exports(content or "", path)
                    rows.append({"path": path, "error": None, "imports": i, "exports": e})
                except (Exception, RecursionError) as x:
                    rows.append({"path": path, "error": f"{type(x).__name__}: {x}"[:500], "imports": [], "exports": []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, SQL)


def failed(modules: DataFrame) -> DataFrame:
    """path, error of files that could not be read: nodes without imports and exports."""
    return modules.where("error IS NOT NULL").select("path", "error")


def dependency_graph(modules: DataFrame, base: str, alias_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, type, parent; edges: source, target, label, edge_kind).

    Files point at what they import; exports point at those who import them.  Imports of
    one module twice give two edges; relative imports that resolve to nothing give none.
    """
    files = modules.select("path")
    imports = modules.select(F.col("path").alias("importer"), F.posexplode("imports").alias("n", "i")).select(
        "importer", F.concat_ws("#", "importer", F.col("n").cast("string")).alias("import_id"), F.col("i.source").alias("specifier"), F.col("i.symbols").alias("symbols")
    )
    relative = F.col("specifier").startswith(".")
    folder = F.regexp_replace("importer", "/?[^/]*$", "")
    own = imports.where(relative).select("import_id", F.lit(0).alias("ord"), deps.relative_target(folder, F.col("specifier")).alias("target"))
    specifiers = imports.where(~relative).select("specifier").distinct()
    via = deps.expand_aliases(specifiers, alias_rows).select("specifier", F.col("preference").alias("ord"), deps.relative_target(F.lit(base), F.col("target")).alias("target"))
    aliased = imports.where(~relative).join(via, "specifier").select("import_id", "ord", "target")
    tried = own.unionByName(aliased).select("import_id", "ord", F.posexplode(deps.candidates(F.col("target"))).alias("k", "path"))
    best = tried.join(files, "path").groupBy("import_id").agg(F.min_by("path", F.struct("ord", "k")).alias("resolved"))
    r = imports.join(best, "import_id", "left")
    routed = deps.route(r)
    exports = modules.select(F.col("path").alias("file"), F.explode("exports").alias("e")).select("file", F.col("e.name").alias("name"), F.col("e.type").alias("kind"))
    exports = exports.withColumn("export_id", F.concat("file", F.lit("::"), "name"))
    outside, out_edges = deps.external_edges(routed)
    none = F.lit(None).cast("string")
    nodes = (
        files.select(F.col("path").alias("id"), label_of_path(F.col("path")).alias("label"), F.lit("file").alias("type"), none.alias("parent"))
        .unionByName(exports.select(F.col("export_id").alias("id"), F.col("name").alias("label"), F.lit("export").alias("type"), F.col("file").alias("parent")).distinct())
        .unionByName(outside.select("id", F.col("id").alias("label"), F.lit("external").alias("type"), none.alias("parent")))
    )
    inner = r.where("resolved IS NOT NULL")
    by_symbol = deps.symbol_edges(inner, exports.select("file", "name", "export_id").distinct())
    edges = (
        deps.file_edges(inner).withColumn("label", none)
        .unionByName(by_symbol.select("source", "target", F.when(F.col("name") == "default", "default").alias("label"), "edge_kind"))
        .unionByName(out_edges.withColumn("label", none))
    )
    return nodes, edges
