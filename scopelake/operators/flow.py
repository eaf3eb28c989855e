"""Scopes, definitions and usages: resolution, captures, control flow, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelake.operators.sweep import asof


def resolve_hoisted(usages: DataFrame, closed: DataFrame, defs: DataFrame) -> DataFrame:
    """usages (usage_id, scope, name) with def_id of the nearest scope that defines the name, null if none.

    closed: node, ancestor, distance, with every scope its own ancestor at distance 0.
    """
    seen = usages.join(closed, usages.scope == closed.node).join(defs.withColumnRenamed("scope", "ancestor"), ["ancestor", "name"])
    best = seen.groupBy("usage_id").agg(F.min_by("def_id", F.struct("distance", "def_id")).alias("def_id"))
    return usages.join(best, "usage_id", "left")


#: Places in a file that one bucket of the sweep takes.
PLACES = 1 << 16


def resolve_ordered(usages: DataFrame, closed: DataFrame, defs: DataFrame, width: int = PLACES) -> DataFrame:
    """As resolve_hoisted, but only definitions met before the usage count; the last of the nearest scope wins.

    A sweep over the definitions and usages of a name in each scope above: a row for every
    usage and ancestor, however often the name is defined.
    """
    at = usages.select("usage_id", "scope", "name", "preorder").join(closed, F.col("scope") == F.col("node")).select("usage_id", "ancestor", "name", "preorder", "distance")
    d = defs.select(F.col("scope").alias("ancestor"), "name", "preorder", "def_id")
    # names that a scope never defines are no part of the sweep
    seen = at.join(d.select("ancestor", "name").distinct(), ["ancestor", "name"], "left_semi")
    found = asof(seen, d, ["ancestor", "name"], "preorder", "def_id", width, strict=True).where("found IS NOT NULL")
    best = found.groupBy("usage_id").agg(F.min_by("found", "distance").alias("def_id"))
    return usages.join(best, "usage_id", "left")


def latest_before(points: DataFrame, events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """points with the value of the last event of their key at or before them (as-of).

    Both sides are one sorted stream per key: a running last value, linear in the rows,
    where a join on the inequality would make a pair for every earlier event.
    """
    w = Window.partitionBy(key).orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    e = events.select(F.col(key), F.col(at), F.lit(0).alias("_side"), F.col(value).alias("_tie"), F.col(value).alias("_v"), F.lit(None).cast("long").alias("point_id"))
    p = points.select(F.col(key), F.col(at), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), F.lit(None).cast("long").alias("_v"), F.col("point_id"))
    both = e.unionByName(p).withColumn("found", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(key, at, "point_id", "found")


def captured(resolved: DataFrame, defs: DataFrame, closed: DataFrame) -> DataFrame:
    """usage_id, def_id of usages whose definition lies in a proper, non-global ancestor of their scope."""
    d = defs.select("def_id", F.col("scope").alias("def_scope"), "def_depth")
    proper = closed.where("distance > 0").select(F.col("node").alias("scope"), F.col("ancestor").alias("def_scope"))
    return resolved.where("def_id IS NOT NULL").join(d, "def_id").where("def_depth > 0").join(proper, ["scope", "def_scope"], "left_semi")


def overlay_category(inside_focus: Column, kind: Column, builtin: Column, import_internal: Column, module_level: Column, own: Column, ancestor: Column) -> Column:
    """Category of a usage from its resolution: kind is null where nothing defines the name."""
    return (
        F.when(kind.isNull() & builtin, "builtin")
        .when(kind.isNull(), "unresolved")
        .when((kind == "import") & import_internal, "importInternal")
        .when(kind == "import", "importExternal")
        .when(kind == "param", "param")
        .when(inside_focus, "local")
        .when(module_level, "module")
        .when(own, "local")
        .when(ancestor, "capture")
        .otherwise("local")
    )


def sibling_edges(rows: DataFrame, parent: str, order: str, kind: str, follows: dict[str, list[str]], first_later: dict[str, str] | None = None) -> DataFrame:
    """source, target for siblings where the next one's kind may follow this one's kind.

    first_later: kinds that point at the first later sibling of another kind, whatever lies between.
    """
    w = Window.partitionBy(parent).orderBy(order)
    # backwards, so that what comes later is a running last: linear in the siblings
    later = Window.partitionBy(parent).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    targets = [F.when((F.col(kind) == k) & F.lead(kind).over(w).isin(*after), F.lead(order).over(w)) for k, after in follows.items()]
    targets += [F.when(F.col(kind) == k, F.last(F.when(F.col(kind) == t, F.col(order)), ignorenulls=True).over(later)) for k, t in (first_later or {}).items()]
    held = rows.select(parent, F.col(order).alias("source"), F.array(*targets).alias("_to"))
    return held.select(parent, "source", F.explode(F.array_distinct(F.array_compact("_to"))).alias("target"))


def chains(rows: DataFrame, parent: str, order: list[str], same: str) -> DataFrame:
    """rows with chain: the number of the run of equal values they belong to, from 1."""
    w = Window.partitionBy(parent).orderBy(*order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def line_clusters(defs: DataFrame, usages: DataFrame) -> DataFrame:
    """scope, line, n_defs, n_usages of lines that hold at least one of both."""
    both = defs.select("scope", "line", F.lit(1).alias("d"), F.lit(0).alias("u")).unionByName(usages.select("scope", "line", F.lit(0).alias("d"), F.lit(1).alias("u")))
    return both.groupBy("scope", "line").agg(F.sum("d").alias("n_defs"), F.sum("u").alias("n_usages")).where("n_defs > 0 AND n_usages > 0")


def unresolved_counts(names: DataFrame, builtins: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent names that are not built in."""
    counted = names.groupBy("name").count()
    return counted.join(builtins, "name", "left_anti").orderBy(F.desc("count"), "name").limit(k)


def focus_lines(rows: DataFrame, line: str, slice_: tuple[int, int], focus: tuple[int, int]) -> DataFrame:
    """Rows whose line lies in both closed ranges; starts are at least 1, ends not before starts."""
    out = rows
    for start, end in (slice_, focus):
        a = max(1, start)
        out = out.where(F.col(line).between(a, max(a, end)))
    return out


def nesting_depth(tokens: DataFrame, key: str, order: str, step: str) -> DataFrame:
    """key, max_depth: the highest running sum of +1/-1 steps."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("_d", F.sum(step).over(w)).groupBy(key).agg(F.greatest(F.max("_d"), F.lit(0)).cast("long").alias("max_depth"))


def scope_counts(events: DataFrame, closed: DataFrame) -> DataFrame:
    """scope, complexity, depth and comments from events (scope, kind, value): branches count in their own scope, the rest in every open one."""
    own = events.where("kind = 'branch'").groupBy("scope").agg(F.sum("value").alias("branches"))
    up = events.where("kind <> 'branch'").join(closed, events.scope == closed.node).groupBy(F.col("ancestor").alias("scope"), "kind").agg(F.sum("value").alias("n"), F.max("value").alias("m"))
    every = up.groupBy("scope").pivot("kind", ["comment", "nesting"]).agg(F.max(F.when(F.col("kind") == "nesting", F.col("m")).otherwise(F.col("n"))))
    return every.join(own, "scope", "full_outer")
