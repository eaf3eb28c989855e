"""What the interactive views ask: sorts, lookups, counts by parent, display positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explorer_order(kind: Column, field: Column, name: Column, descending: bool = True) -> list[Column]:
    """Folders first, then the field, then the name in any case."""
    return [(kind != "folder").asc(), field.desc() if descending else field.asc(), F.lower(name).asc()]


def treemap_order(kind: Column, value: Column) -> list[Column]:
    """Synthetic bodies last, larger values first."""
    return [kind.isin("function_body", "file_body").asc(), value.desc()]


def flow_order(line: Column, kind: Column, key: Column) -> list[Column]:
    rank = F.when(kind == "declaration", 0).when(kind == "variable", 1).when(kind == "usage", 2).otherwise(3)
    return [line.asc_nulls_last(), rank.asc(), key.asc()]


def child_counts(nodes: DataFrame, parent: str, kind: str, kinds: list[str]) -> DataFrame:
    """parent with one count per kind; the kinds are given, so no extra pass finds them."""
    return nodes.where(F.col(parent).isNotNull()).groupBy(parent).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def by_name(files: DataFrame) -> DataFrame:
    """One row per file name; of several the last in preorder."""
    return files.groupBy("name").agg(F.max_by(F.struct("path", "loc"), "preorder").alias("f")).select("name", "f.*")


def by_range(scopes: DataFrame, start: int, end: int) -> DataFrame:
    """Scopes with exactly that range, the first in preorder of each file."""
    hit = scopes.where((F.col("start_line") == start) & (F.col("end_line") == end))
    return hit.groupBy("path").agg(F.min_by("scope_id", "preorder").alias("scope_id"))


def _by_file(kept: DataFrame, *fields: Column | str) -> DataFrame:
    """path, held: the given fields of all rows of a file, sorted; ``kept`` are few of its scopes.

    Rows are dealt by path before they are gathered, so no task holds more than its share of a shuffle.
    """
    rows = kept.select("path", F.struct(*fields).alias("x")).repartition("path")
    return rows.groupBy("path").agg(F.sort_array(F.collect_list("x")).alias("held"))


def focused_scope(scopes: DataFrame, closed: DataFrame, start: int, end: int) -> DataFrame:
    """path, scope_id: the deepest scope that is reached from the top through scopes that all hold the range.

    Of siblings that hold it the first is entered.  Only scopes that hold the range are looked
    at, a file's in one walk from the top; ``closed`` is not read.
    """
    holds = scopes.where((F.col("start_line") <= start) & (F.col("end_line") >= end))
    kinds = {f.name: f.dataType for f in scopes.schema}
    at = lambda i, d: F.struct(i.cast(kinds["scope_id"]).alias("scope_id"), d.cast(kinds["depth"]).alias("depth"))
    below = lambda a, x: (x["depth"] == a["depth"] + 1) & ((x["depth"] == 0) | (x["parent_id"] == a["scope_id"]))
    walk = F.aggregate("held", at(F.lit(None), F.lit(-1)), lambda a, x: F.when(below(a, x), at(x["scope_id"], x["depth"])).otherwise(a))
    found = _by_file(holds, "depth", "preorder", "scope_id", "parent_id").select("path", walk["scope_id"].alias("scope_id"))
    return found.where("scope_id IS NOT NULL")


def breadcrumb_trail(scopes: DataFrame, closed: DataFrame, start: int, end: int) -> DataFrame:
    """path, scope_id, depth of the scopes on the way down to a range of lines, the file's own scope first.

    At each step the narrowest child that holds the range is entered, of equal ones the
    first.  A child as wide as its parent is entered only if one of its own children holds
    the range and is narrower.  Only the files' own scopes and those that hold the range are
    looked at, a file's in one walk from the top; ``closed`` is not read.
    """
    holds = (F.col("start_line") <= start) & (F.col("end_line") >= end)
    kept = scopes.where((F.col("depth") == 0) | holds).withColumns({"span": F.col("end_line") - F.col("start_line"), "holds": F.coalesce(holds, F.lit(False))})
    step = lambda x, entered: F.struct(*[x[n].alias(n) for n in ("depth", "scope_id", "parent_id", "span")], entered.alias("entered"))

    def way(steps: Column, x: Column) -> Column:
        """steps with x where it is the first child of one that was entered; whether it is entered too."""
        parent = F.filter(steps, lambda p: p["entered"] & (p["scope_id"] == x["parent_id"]))
        met = F.exists(steps, lambda p: (p["depth"] == x["depth"]) & p["parent_id"].eqNullSafe(x["parent_id"]))
        inner = F.array_min(F.transform(F.filter("held", lambda c: c["holds"] & (c["parent_id"] == x["scope_id"])), lambda c: c["span"]))
        outer = F.get(parent, F.lit(0))["span"]
        wide = F.coalesce(x["span"] >= outer, F.lit(False)) & ~F.coalesce(inner < x["span"], F.lit(False))
        entered = ~wide & (x["span"] <= F.coalesce(outer, x["span"]))
        return F.when(~met & ((x["depth"] == 1) | (F.size(parent) > 0)), F.concat(steps, F.array(step(x, entered)))).otherwise(steps)

    tops = F.transform(F.filter("held", lambda x: x["depth"] == 0), lambda x: step(x, F.lit(True)))
    steps = F.aggregate(F.filter("held", lambda x: x["depth"] > 0), tops, way)
    trail = _by_file(kept, "depth", "span", "preorder", "scope_id", "parent_id", "holds").select("path", F.explode(F.filter(steps, lambda x: x["entered"])).alias("x"))
    return trail.select("path", "x.scope_id", "x.depth")


def relative_depth(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """node_id, file_depth: steps below the nearest file; null above files."""
    files = nodes.where("node_type = 'file'").select(F.col("node_id").alias("ancestor"))
    near = closed.join(files, "ancestor", "left_semi").groupBy("node").agg(F.min("distance").alias("file_depth"))
    return nodes.join(near, F.col("node_id") == F.col("node"), "left").select("node_id", "file_depth")


def first_consumers(captures: DataFrame) -> DataFrame:
    """Per symbol of a subtree its first consumer in preorder, in the order of names."""
    w = Window.partitionBy("root", "symbol").orderBy("preorder")
    return captures.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").orderBy("root", "symbol")


def declared_pills(declared: DataFrame, scopes: DataFrame, closed: DataFrame, collapsed: DataFrame, captured: DataFrame) -> DataFrame:
    """Declarations to show: none that names a scope below; of a collapsed scope only what is captured below."""
    below = closed.where("distance > 0").join(scopes.select(F.col("scope_id").alias("node"), F.col("label").alias("name")), "node").select(F.col("ancestor").alias("scope_id"), "name").distinct()
    shown = declared.join(below, ["scope_id", "name"], "left_anti")
    caught = captured.join(closed.where("distance > 0"), captured.scope_id == closed.node).select(F.col("ancestor").alias("scope_id"), "name").distinct()
    small = collapsed.select("scope_id")
    return shown.join(small, "scope_id", "left_anti").unionByName(shown.join(small, "scope_id", "left_semi").join(caught, ["scope_id", "name"], "left_semi"))


def display_tokens(tokens: DataFrame, first_line: int, cut: int) -> DataFrame:
    """Tokens on the lines and columns of a slice with its indent cut, right to left within a line."""
    col = lambda c: F.greatest(F.lit(0), F.col(c) - cut)
    shown = tokens.withColumns({"display_line": F.col("line") - first_line, "start_col": col("start_col"), "end_col": col("end_col")})
    return shown.where("display_line >= 0 AND end_col > start_col").orderBy("display_line", F.desc("start_col"))


def chain_groups(rows: DataFrame, parent: str, order: str, kind: str) -> DataFrame:
    """rows with group: if + else*, and try + (catch | finally)*, are one; anything else is one by itself."""
    w = Window.partitionBy(parent).orderBy(order)
    before = F.lag(kind).over(w)
    goes_on = ((F.col(kind) == "else") & before.isin("if", "else")) | (F.col(kind).isin("catch", "finally") & before.isin("try", "catch", "finally"))
    new = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def colour_position(value: Column, stops: list[float]) -> Column:
    """Where a value lies on a clamped piecewise-linear scale: 0 at the first stop, 1 more at each next."""
    out = F.when(value <= stops[0], 0.0)
    for i, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
        out = out.when(value <= b, i + (value - a) / (b - a))
    return out.otherwise(float(len(stops) - 1))
