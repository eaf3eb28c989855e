"""Trees as tables: adjacency rows (node_id, parent_id, ...) and closures of paths.

Nothing here recurses at run time: a path knows all its ancestors, so roll-ups and
subtree filters are an explode and an aggregate, and partial aggregation leaves one row
per task and folder before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixes(path: Column, sep: str = "/", proper: bool = False) -> Column:
    """Every ancestor path of a path, outermost first; with itself unless proper."""
    parts = F.split(path, sep)
    n = F.size(parts) - (1 if proper else 0)
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), sep))
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(every)


def parent_path(path: Column, sep: str = "/") -> Column:
    n = F.size(F.split(path, sep))
    return F.when(n > 1, F.array_join(F.slice(F.split(path, sep), 1, n - 1), sep))


def folders_of(files: DataFrame, path: str = "path") -> DataFrame:
    """path, parent, depth of every folder that holds a file."""
    f = files.select(F.explode(prefixes(F.col(path), proper=True)).alias("path")).distinct()
    return f.select("path", parent_path(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"))


def rollup(files: DataFrame, sums: list[str], maxima: list[str], path: str = "path") -> DataFrame:
    """Folder rows: path with the sums and maxima of all files below."""
    up = files.select(F.explode(prefixes(F.col(path), proper=True)).alias("folder"), *sums, *maxima)
    return up.groupBy("folder").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima]).withColumnRenamed("folder", path)


def rollup_metrics(files: DataFrame) -> DataFrame:
    """Folder rows with the metrics that roll up; file nodes are not touched.

    Complexity is the maximum of file averages; the mean function length is weighted by
    function count; density is taken from the sums.
    """
    return folder_metrics(rollup(with_length(files), FOLDER_SUMS, FOLDER_MAXIMA))


#: What is summed and what is maximized up the folders.
FOLDER_SUMS = ["loc", "function_count", "file_size", "file_count", "comment_lines", "parameter_count", "todo_count", "classes_count", "ts_type_interface_count", "ts_export_count", "md_data_url_count", "python_import_count", "_length"]
FOLDER_MAXIMA = ["complexity", "max_nesting_depth", "last_modified"]


def with_length(files: DataFrame) -> DataFrame:
    """files with the lines of all their functions, in a type whose sums don't depend on their order."""
    return files.withColumn("_length", (F.col("average_function_length") * F.col("function_count")).cast("decimal(24,6)"))


def folder_metrics(r: DataFrame) -> DataFrame:
    """Rolled-up sums and maxima with the ratios that are taken from them."""
    return r.select(
        "path",
        *FOLDER_SUMS[:-1],
        *FOLDER_MAXIMA,
        ratio(F.col("comment_lines"), F.col("loc")).alias("comment_density"),
        ratio(F.col("_length").cast("double"), F.col("function_count")).alias("average_function_length"),
        F.lit(0).cast("long").alias("gitignored_count"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def closure(edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """node, ancestor, distance (from 1) for child -> parent rows (node, parent) of unknown depth.

    Distances double each round, so a tree of depth d takes log2(d) joins.
    """
    known = edges.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    reach = 1
    while reach < most_depth:
        a, b = known.alias("a"), known.alias("b")
        far = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(
            F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance")
        )
        grown = known.unionByName(far).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        deepest = grown.agg(F.max("distance")).first()[0]
        known, reach = grown, reach * 2
        if deepest is None or deepest < reach:
            break
    return known


def fixed_closure(edges: DataFrame, levels: int) -> DataFrame:
    """As closure(), for trees of at most ``levels`` edges: one plan without any action."""
    step = edges.where("parent IS NOT NULL").select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
    at = step.select(F.col("_n").alias("node"), F.col("_p").alias("ancestor"), F.lit(1).alias("distance"))
    out = at
    for d in range(2, levels + 1):
        at = at.join(step, F.col("ancestor") == F.col("_n")).select("node", F.col("_p").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.unionByName(at)
    return out


def name_filter(nodes: DataFrame, closed: DataFrame, term: str) -> DataFrame:
    """Nodes whose name holds the term (any case) and all their ancestors."""
    hit = nodes.where(F.lower("name").contains(term.lower())).select("node_id")
    above = closed.join(hit, closed.node == hit.node_id, "left_semi").select(F.col("ancestor").alias("node_id"))
    return nodes.join(hit.union(above).distinct(), "node_id", "left_semi")


def without_subtrees(nodes: DataFrame, excluded: list[str], sep: str = "/") -> DataFrame:
    """Nodes that neither are an excluded path nor lie below one."""
    out = nodes
    for e in excluded:
        out = out.where((F.col("path") != e) & ~F.col("path").startswith(e + sep))
    return out


def attribute_filter(files: DataFrame, suffixes: list[str], most_loc: int | None, excluded: list[str]) -> DataFrame:
    """Files that pass, and the folders that still hold one with their loc summed anew."""
    kept = without_subtrees(files, excluded)
    if suffixes:
        kept = kept.where(F.lower(F.col("suffix")).isin(*[s.lower() for s in suffixes]))
    if most_loc is not None:
        kept = kept.where(F.col("loc") <= most_loc)
    leaves = kept.select("path", "loc", F.lit("file").alias("node_type"))
    return leaves.unionByName(rollup(kept, ["loc"], []).withColumn("node_type", F.lit("folder")))


def top_children(nodes: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k children of every parent; rank groups are cut before the sort (window group limit)."""
    w = Window.partitionBy("parent").orderBy(*order)
    return nodes.withColumn("child_rank", F.row_number().over(w)).where(F.col("child_rank") <= k)


def summary(nodes: DataFrame, depth: int, k: int, *order: Column) -> DataFrame:
    """nodes (node_id, parent, depth) down to a depth: the first k children of every parent that stays itself."""
    kept = top_children(nodes.where(F.col("depth") <= depth), k, *order)
    for _ in range(depth - 1):  # a node stays only where its parent does
        parents = kept.select(F.col("node_id").alias("_p")).distinct()
        kept = kept.join(parents, F.col("parent") == F.col("_p"), "left_semi").unionByName(kept.where("parent IS NULL"))
    return kept


def with_scores(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """nodes with the score (node_id, score) of each; 0 for those that have none."""
    return nodes.join(scores.select("node_id", "score"), "node_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def nearest_holder(paths: DataFrame, holders: DataFrame) -> DataFrame:
    """path, folder: the nearest folder above each path that is among the holders (folder; '' is the top); null where none is."""
    above = F.array_distinct(F.concat(F.array(F.lit("")), prefixes(F.col("path"), proper=True)))
    up = paths.select("path", F.posexplode(above).alias("_d", "folder")).join(holders.select("folder").distinct(), "folder")
    near = up.groupBy("path").agg(F.max_by("folder", "_d").alias("folder"))
    return paths.select("path").join(near, "path", "left")


def breadcrumbs(closed: DataFrame, names: DataFrame, sep: str = " > ") -> DataFrame:
    """node, trail: names of the ancestors, outermost first, then the node's own."""
    steps = closed.select("node", "ancestor", "distance").unionByName(names.select(F.col("node_id").alias("node"), F.col("node_id").alias("ancestor"), F.lit(0).alias("distance")))
    named = steps.join(names.select(F.col("node_id").alias("ancestor"), "name"), "ancestor")
    parts = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    return named.groupBy("node").agg(F.array_join(F.transform(parts, lambda x: x["name"]), sep).alias("trail"))


def interval_union(spans: DataFrame, key: str = "key") -> DataFrame:
    """key, covered: lines that closed intervals (start_line, end_line) cover together.

    Islands by a running maximum of ends: linear in the spans, whatever they cover.
    """
    w = Window.partitionBy(key).orderBy("start_line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("end_line") - F.greatest(F.col("start_line") - 1, F.coalesce(before, F.col("start_line") - 1))
    return spans.withColumn("_new", F.greatest(fresh, F.lit(0))).groupBy(key).agg(F.sum("_new").cast("long").alias("covered"))


def leaf_sums(nodes: DataFrame, value: str = "loc") -> DataFrame:
    """node_id, total: of every container the value summed over leaves below it (path based)."""
    parents = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("path")).distinct()
    leaves = nodes.join(parents, "path", "left_anti")
    return rollup(leaves, [value], [])


def body_remainder(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """file_id, body_loc: a file's loc less that of its direct scopes, at least 0."""
    inner = scopes.where("parent_scope_id IS NULL").groupBy("file_id").agg(F.sum("nloc").alias("_inner"))
    return files.join(inner, "file_id", "left").select("file_id", F.greatest(F.lit(0), F.col("loc") - F.coalesce("_inner", F.lit(0))).alias("body_loc"))


def hide_bodies(nodes: DataFrame) -> DataFrame:
    """Nodes without synthetic bodies, unless a parent has nothing else."""
    body = F.col("node_type").isin("function_body", "file_body") | (F.col("name") == "(body)")
    w = Window.partitionBy("parent")
    return nodes.withColumn("_others", F.sum((~body).cast("int")).over(w)).where(~body | (F.col("_others") == 0)).drop("_others")
