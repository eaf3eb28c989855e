"""Data flow, focus overlay and scope graph of TypeScript files: one Arrow pass, then joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopelake.functions.storage import written
from scopelake.operators import deps
from scopelake.operators import flow as ops
from scopelake.sources.analyze import time_limit
from scopelake.sources.analyzers.flow_scan import BUILTINS, flow_rows

#: Suffixes that are read; any other file gives no rows.
SUFFIXES = (".ts", ".tsx", ".mts", ".cts")
FIELDS = {
    "scopes": [("scope_id", "long"), ("parent_id", "long"), ("ancestors", "array<long>"), ("depth", "long"), ("kind", "string"), ("label", "string"), ("start_line", "long"), ("end_line", "long")],
    "defs": [("def_id", "long"), ("scope_id", "long"), ("name", "string"), ("kind", "string"), ("line", "long"), ("col", "long"), ("preorder", "long"), ("source", "string")],
    "usages": [("usage_id", "long"), ("scope_id", "long"), ("name", "string"), ("line", "long"), ("start_col", "long"), ("end_col", "long"), ("preorder", "long"), ("attribute", "string")],
}


def scan(files: DataFrame, view: str, seconds: float = 10.0) -> DataFrame:
    """files (path, content) -> path, error, scopes, defs, usages; a file that takes longer is an error."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    lists = {k: pa.list_(pa.struct([(n, kinds[t]) for n, t in f])) for k, f in FIELDS.items()}
    schema = pa.schema([("path", pa.string()), ("error", pa.string()), *lists.items()])
    sql = "path string, error string, " + ", ".join(f"{k} array<struct<{','.join(f'{n}:{t}' for n, t in f)}>>" for k, f in FIELDS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with time_limit(seconds):
                        s, d, u = flow_rows(content or "", path, view)
                    rows.append({"path": path, "error": None, "scopes": s, "defs": d, "usages": u})
                except (Exception, RecursionError) as e:
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:500], "scopes": [], "defs": [], "usages": []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    supported = F.lit(False)
    for s in SUFFIXES:
        supported = supported | F.lower("path").endswith(s)
    return files.where(supported).select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, sql)


def scanned(files: DataFrame, view: str) -> DataFrame:
    """scan() as a table: it is read for scopes, definitions and usages."""
    return written(scan(files, view), "flow-scan")


def failed(scanned: DataFrame) -> DataFrame:
    """path, error of files that could not be read; they have no rows in any view."""
    return scanned.where("error IS NOT NULL").select("path", "error")


def _rows(scanned: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind with ids that are unique over all files."""
    r = scanned.select("path", F.explode(kind).alias("x")).select("path", "x.*")
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("#", "path", F.col(c).cast("string")))
    for c in ("scope_id", "parent_id", "def_id", "usage_id"):
        if c in r.columns:
            r = r.withColumn(c, key(c))
    return r


def closure(scopes: DataFrame) -> DataFrame:
    """node, ancestor, distance with every scope its own ancestor at 0; the scan has listed them."""
    far = scopes.select("path", F.col("scope_id").alias("node"), F.posexplode("ancestors").alias("distance", "_a"))
    return far.select("node", F.concat_ws("#", "path", F.col("_a").cast("string")).alias("ancestor"), "distance")


def resolved(scanned: DataFrame, ordered: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scopes, defs, usages with def_id, closure)."""
    s, d, u = (_rows(scanned, k) for k in ("scopes", "defs", "usages"))
    c = closure(s)
    # of one name in one scope the last definition counts, as in a map
    last = d.groupBy("scope_id", "name").agg(F.max_by(F.struct("def_id", "kind", "line", "col", "source", "preorder"), "preorder").alias("d")).select("scope_id", "name", "d.*")
    names = d if ordered else last
    usages = u.withColumnRenamed("scope_id", "scope")
    defs = names.withColumnRenamed("scope_id", "scope").select("scope", "name", "def_id", "preorder")
    found = ops.resolve_ordered(usages, c, defs) if ordered else ops.resolve_hoisted(usages, c, defs.drop("preorder"))
    return s, last if not ordered else d, found.withColumnRenamed("scope", "scope_id"), c


def overlay(files: DataFrame, focus: tuple[int, int], slice_: tuple[int, int] | None = None, modules: DataFrame | None = None, base: str = "", aliases: DataFrame | None = None) -> DataFrame:
    """Tokens in the focused lines with category, tooltip and the line of their definition.

    An import is internal if it is relative, or if one of the aliases leads it to a file
    of modules (path).
    """
    s, d, u, c = resolved(scanned(files, "focus"), ordered=False)
    u = ops.focus_lines(u, "line", slice_ or focus, focus)
    dd = d.select("def_id", F.col("kind").alias("def_kind"), F.col("line").alias("def_line"), F.col("col").alias("def_col"), "source", F.col("scope_id").alias("def_scope"))
    depth = s.select(F.col("scope_id").alias("def_scope"), F.col("depth").alias("def_depth"))
    # the function around a usage: the nearest ancestor of that kind, else the file
    fn = c.join(s.where("kind = 'function' OR depth = 0").select(F.col("scope_id").alias("ancestor")), "ancestor", "left_semi")
    fn = fn.groupBy("node").agg(F.min_by("ancestor", "distance").alias("fn")).withColumnRenamed("node", "scope_id")
    j = u.join(dd, "def_id", "left").join(depth, "def_scope", "left").join(fn, "scope_id", "left")
    internal = F.col("source").startswith(".")
    if modules is not None and aliases is not None:
        away = d.where("source IS NOT NULL AND NOT startswith(source, '.')").select(F.col("source").alias("specifier")).distinct()
        j = j.join(deps.aliased_files(away, modules, base, aliases).select(F.col("specifier").alias("source"), F.lit(True).alias("by_alias")), "source", "left")
        internal = internal | F.coalesce("by_alias", F.lit(False))
    below = c.select(F.col("node").alias("def_scope"), F.col("ancestor").alias("fn"), F.lit(True).alias("fn_holds_def"))
    above = c.select(F.col("node").alias("fn"), F.col("ancestor").alias("def_scope"), F.lit(True).alias("def_holds_fn"))
    j = j.join(below, ["def_scope", "fn"], "left").join(above, ["fn", "def_scope"], "left")
    start, end = max(1, focus[0]), max(1, *focus)
    flag = lambda x: F.coalesce(F.col(x), F.lit(False))
    category = ops.overlay_category(
        inside_focus=F.col("def_line").between(start, end) & (F.col("def_depth") > 0),
        kind=F.col("def_kind"),
        builtin=F.col("name").isin(*BUILTINS),
        import_internal=F.coalesce(internal, F.lit(False)),
        module_level=F.col("def_depth") == 0,
        own=flag("fn_holds_def"),
        ancestor=flag("def_holds_fn"),
    )
    tooltip = (
        F.when(F.col("category") == "builtin", "Builtin/global")
        .when(F.col("category") == "unresolved", "Unresolved identifier")
        .when(F.col("category") == "importInternal", F.concat(F.lit("Import (internal): "), "source"))
        .when(F.col("category") == "importExternal", F.concat(F.lit("Import (external): "), "source"))
        .when(F.col("category") == "param", "Parameter")
        .when(F.col("category") == "module", F.concat(F.lit("Module scope (line "), F.col("def_line").cast("string"), F.lit(")")))
        .when(F.col("category") == "capture", F.concat(F.lit("Captured from outer scope (line "), F.col("def_line").cast("string"), F.lit(")")))
        .otherwise(F.concat(F.lit("Local declaration (line "), F.col("def_line").cast("string"), F.lit(")")))
    )
    out = j.withColumn("category", category).withColumn("tooltip", tooltip)
    return out.select("path", "line", "start_col", "end_col", "name", "category", "tooltip", "def_line").orderBy("path", "line", "start_col")


def scope_graph(files: DataFrame) -> DataFrame:
    """Per scope the names it declares and those it captures; empty scopes that are no JSX and hold nothing go."""
    s, d, u, c = resolved(scanned(files, "focus"), ordered=False)
    declared = d.where("kind <> 'import'").groupBy("scope_id").agg(F.sort_array(F.collect_set("name")).alias("declared"))
    dd = d.join(s.select("scope_id", "depth"), "scope_id").where("depth > 0 AND kind <> 'import'").select("def_id", F.col("scope_id").alias("ancestor"))
    caught = u.where(~F.col("name").isin(*BUILTINS)).join(dd, "def_id").join(c.where("distance > 0").withColumnRenamed("node", "scope_id"), ["scope_id", "ancestor"], "left_semi")
    captured = caught.groupBy("scope_id").agg(F.sort_array(F.collect_set("name")).alias("captured"))
    g = s.join(declared, "scope_id", "left").join(captured, "scope_id", "left")
    none = F.array().cast("array<string>")
    g = g.withColumns({"declared": F.coalesce("declared", none), "captured": F.coalesce("captured", none)})
    full = g.where((F.col("kind") == "jsx") | (F.size("declared") > 0) | (F.size("captured") > 0) | (F.col("depth") == 0)).select("scope_id")
    kept = c.join(full.withColumnRenamed("scope_id", "node"), "node", "left_semi").select(F.col("ancestor").alias("scope_id")).distinct()
    return g.join(kept, "scope_id", "left_semi").select("path", "scope_id", "parent_id", "kind", F.when(F.col("label") != "", F.col("label")).otherwise(F.concat("kind", F.lit("@"), F.col("start_line").cast("string"))).alias("name"), "start_line", "end_line", "depth", "declared", "captured")


def data_flow(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: scopes, variables and usages; edges: definition -> usage and control flow)."""
    s, d, u, _ = resolved(scanned(files, "flow"), ordered=True)
    shown = d.where("kind <> 'function'")
    hidden = u.join(d.select("def_id", F.col("scope_id").alias("_ds"), F.col("line").alias("_dl")), "def_id", "left")
    used = hidden.where(~F.coalesce((F.col("_ds") == F.col("scope_id")) & (F.col("_dl") == F.col("line")), F.lit(False)))
    label = F.when(F.col("attribute").isNotNull(), F.concat("attribute", F.lit(": "), "name")).otherwise(F.col("name"))
    nodes = (
        s.select("path", F.col("scope_id").alias("id"), F.col("parent_id").alias("parent"), F.col("kind").alias("type"), "label", "start_line", "end_line")
        .unionByName(shown.select("path", F.concat(F.lit("d:"), "def_id").alias("id"), F.col("scope_id").alias("parent"), F.lit("variable").alias("type"), F.concat("name", F.lit(" ("), "kind", F.lit(")")).alias("label"), F.col("line").alias("start_line"), F.col("line").alias("end_line")))
        .unionByName(used.select("path", F.concat(F.lit("u:"), "usage_id").alias("id"), F.col("scope_id").alias("parent"), F.lit("usage").alias("type"), label.alias("label"), F.col("line").alias("start_line"), F.col("line").alias("end_line")))
    )
    flows = u.where("def_id IS NOT NULL").select("path", F.concat(F.lit("d:"), "def_id").alias("source"), F.concat(F.lit("u:"), "usage_id").alias("target"), F.lit("data").alias("type"))
    siblings = s.where(F.col("parent_id").isNotNull()).withColumn("_o", F.struct("start_line", F.length("scope_id"), "scope_id"))
    follows = {"try": ["catch", "finally"], "catch": ["finally"], "case": ["case", "default"], "default": ["case", "default"]}
    control = ops.sibling_edges(siblings, "parent_id", "_o", "kind", follows, {"if_branch": "else_branch"})
    edges = control.select(F.substring_index(F.col("source.scope_id"), "#", 1).alias("path"), F.col("source.scope_id").alias("source"), F.col("target.scope_id").alias("target"), F.lit("control-flow").alias("type"))
    return nodes, flows.unionByName(edges)
