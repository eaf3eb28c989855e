"""Import resolution and dependency graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelake.functions.storage import written
from scopelake.functions.text import collapsed_path, without_comments
from scopelake.operators.tree import prefixes

# Suffixes of assets, which never resolve to code, and of code.
ASSETS = [".css", ".scss", ".sass", ".less", ".styl", ".json", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp", ".avif"]
CODE = [".js", ".jsx", ".ts", ".tsx", ".d.ts"]
#: Suffixes in the order they are tried.
TRIED = [".ts", ".tsx", ".d.ts"]


def candidates(target: Column) -> Column:
    """Paths to try for a resolved specifier, in order of preference.

    The path itself; then, except for assets, its stem with the suffixes, its whole name
    with them if its own suffix is unknown, and its index files.
    """
    s = F.regexp_extract(target, r"[^/.][^/]*?(\.[^./]+)$", 1)
    stem = F.when(s != "", F.regexp_replace(target, r"\.[^./]+$", "")).otherwise(target)
    by_stem = [F.concat(stem, F.lit(e)) for e in TRIED]
    by_name = [F.concat(target, F.lit(e)) for e in TRIED]
    index = [F.concat(target, F.lit("/index" + e)) for e in (".ts", ".tsx")]
    tried = (
        F.when(s.isin(*ASSETS), F.array(target))
        .when((s == "") | s.isin(*CODE), F.array(target, *by_stem, *index))
        .otherwise(F.array(target, *by_stem, *by_name, *index))
    )
    return F.array_distinct(tried)


def resolve(imports: DataFrame, files: DataFrame, tried: Column) -> DataFrame:
    """imports with resolved: the first candidate that is a file (path), null if none.

    Each import tries a handful of paths in one equi join; the best is an aggregate, so no
    import's candidates are ever sorted.
    """
    every = imports.select("import_id", F.posexplode(tried).alias("preference", "candidate"))
    found = every.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    best = found.groupBy("import_id").agg(F.min_by("candidate", "preference").alias("resolved"))
    return imports.join(best, "import_id", "left")


def expand_aliases(specifiers: DataFrame, aliases: DataFrame) -> DataFrame:
    """specifier, preference, target for aliases (ord, pattern, targets) that match; ``*`` captures.

    The alias table is a configuration file: some rows, broadcast.
    """
    a = F.broadcast(aliases)
    head, tail = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    wild = F.col("pattern").contains("*")
    s = F.col("specifier")
    fits = F.when(wild, s.startswith(head) & s.endswith(tail) & (F.length(s) >= F.length(head) + F.length(tail))).otherwise(s == F.col("pattern"))
    middle = F.when(wild, F.substr(s, F.length(head) + 1, F.length(s) - F.length(head) - F.length(tail))).otherwise("")
    hit = specifiers.join(a, fits).withColumn("middle", middle)
    out = hit.select("specifier", "ord", "middle", F.posexplode("targets").alias("n", "to"))
    slash = F.when(F.col("to").endswith("/") | F.col("middle").startswith("/") | (F.col("middle") == ""), "").otherwise("/")
    to = F.when(F.col("to").contains("*"), F.concat(F.substring_index("to", "*", 1), "middle", F.expr("substring(`to`, instr(`to`, '*') + 1)"))).otherwise(F.concat("to", slash, "middle"))
    return out.select("specifier", (F.col("ord") * 1000 + F.col("n")).alias("preference"), to.alias("target"))


def alias_rows(configs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, base, ord, pattern, targets of the aliases in configuration texts (JSON with comments and trailing commas).

    A target may be one string or a list; what cannot be read gives no rows.
    """
    plain = F.regexp_replace(without_comments(F.col(text)), r",(\s*[}\]])", "$1")
    read = F.from_json(plain, "compilerOptions struct<baseUrl:string,paths:map<string,string>>")["compilerOptions"]
    rows = configs.select(key, read.alias("o")).where("o.paths IS NOT NULL")
    rows = rows.select(key, F.coalesce("o.baseUrl", F.lit(".")).alias("base"), F.posexplode(F.map_entries("o.paths")).alias("ord", "e"))
    to = F.col("e.value")
    targets = F.when(F.startswith(to, F.lit("[")), F.from_json(to, "array<string>")).otherwise(F.array(to))
    return rows.select(key, "base", "ord", F.col("e.key").alias("pattern"), targets.alias("targets"))


def best_alias(expanded: DataFrame) -> DataFrame:
    return expanded.groupBy("specifier").agg(F.min_by("target", "preference").alias("target"))


def relative_target(base_dir: Column, specifier: Column) -> Column:
    """A relative specifier against the folder of its file."""
    return collapsed_path(F.concat(base_dir, F.lit("/"), specifier))


def aliased_files(specifiers: DataFrame, files: DataFrame, base: str, aliases: DataFrame) -> DataFrame:
    """specifier, resolved of those that an alias (ord, pattern, targets) leads to a file of files (path)."""
    via = expand_aliases(specifiers, aliases).select("specifier", "preference", relative_target(F.lit(base), F.col("target")).alias("target"))
    tried = via.select("specifier", "preference", F.posexplode(candidates(F.col("target"))).alias("k", "path"))
    return tried.join(files.select("path"), "path").groupBy("specifier").agg(F.min_by("path", F.struct("preference", "k")).alias("resolved"))


def route(imports: DataFrame) -> DataFrame:
    """imports (specifier, resolved, alias) with kind: internal, dropped (relative, unresolved) or external."""
    relative = F.col("specifier").startswith(".")
    return imports.withColumn("kind", F.when(F.col("resolved").isNotNull(), "internal").when(relative, "dropped").otherwise("external"))


def file_edges(resolved: DataFrame) -> DataFrame:
    """source -> target, one per import statement (a bag)."""
    return resolved.where("resolved IS NOT NULL").select(F.col("importer").alias("source"), F.col("resolved").alias("target"), F.lit("import").alias("edge_kind"))


def external_edges(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct external nodes, one edge per import)."""
    out = routed.where("kind = 'external'")
    return out.select(F.col("specifier").alias("id")).distinct(), out.select(F.col("importer").alias("source"), F.col("specifier").alias("target"), F.lit("external").alias("edge_kind"))


def symbol_edges(resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """export -> importer for every imported name that its target exports; imports without names take all exports."""
    named = resolved.where(F.size("symbols") > 0).select("importer", F.col("resolved").alias("file"), F.explode("symbols").alias("name"))
    by_name = named.join(exports, ["file", "name"]).select("export_id", "importer", "name")
    whole = resolved.where(F.size("symbols") == 0).select("importer", F.col("resolved").alias("file"))
    every = whole.join(exports, "file").select("export_id", "importer", "name")
    return by_name.unionByName(every).select(F.col("export_id").alias("source"), F.col("importer").alias("target"), "name", F.lit("export").alias("edge_kind"))


def in_degree(edges: DataFrame, distinct_sources: bool = False) -> DataFrame:
    counted = F.count_distinct("source") if distinct_sources else F.count("*")
    return edges.groupBy("target").agg(counted.alias("in_degree"))


def super_nodes(edges: DataFrame, threshold: int, distinct_sources: bool = False) -> DataFrame:
    return in_degree(edges, distinct_sources).where(F.col("in_degree") > threshold)


#: Log2 of the registers of a sketch, and its relative error (three standard deviations) by the published bound.
SKETCH = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH / 2)


def fan_in_sketches(edges: DataFrame) -> DataFrame:
    """target, sketch: the distinct sources of each target as a mergeable sketch of at most some kilobytes."""
    return edges.groupBy("target").agg(F.hll_sketch_agg("source", F.lit(SKETCH)).alias("sketch"))


def merged_fan_in(sketches: DataFrame, path: str) -> DataFrame:
    """path, fan_in: about how many distinct sources each path and everything below it has; edges are not read again."""
    up = sketches.select(F.explode(prefixes(F.col(path))).alias("path"), "sketch")
    return up.groupBy("path").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("fan_in"))


#: Bytes of super nodes up to which all are broadcast, and how many of the largest are beyond.
FEW_BYTES, LARGEST = 8 << 20, 1000


def collapse_super_nodes(edges: DataFrame, supers: DataFrame, most_bytes: int = FEW_BYTES) -> DataFrame:
    """edges with those to a super node (as super_nodes() gives them) replaced by one badge per (source, super node).

    Edges are added up per (source, target), in the tasks first: badges count once, plain edges
    as often as before.  As long as the super nodes' ids are few bytes they are broadcast; beyond,
    only the largest are, so that no other target holds more than a thousandth of what points to
    super nodes, and the others meet their edges in a sort-merge join.  Edges to the largest are
    dealt over its partitions by their source.
    """
    marked = written(supers.select("target", "in_degree", F.lit(True).alias("_super")), "super-nodes")
    size = marked.agg(F.coalesce(F.sum(F.octet_length(F.col("target").cast("string")) + 32), F.lit(0))).first()[0]
    own = edges.groupBy("source", "target").agg(F.count("*").cast("int").alias("_n"))
    if size <= most_bytes:
        counted = own.join(F.broadcast(marked.drop("in_degree")), "target", "left")
    else:
        largest = marked.orderBy(F.desc("in_degree")).limit(LARGEST).select("target", F.lit(True).alias("_large"))
        dealt = own.join(F.broadcast(largest), "target", "left").withColumn("_salt", F.when(F.col("_large"), F.xxhash64("source")).otherwise(F.lit(0)))
        others = marked.select("target", "_super", F.lit(0).cast("long").alias("_salt")).hint("merge")  # the file's size would have it broadcast
        counted = dealt.join(others, ["target", "_salt"], "left").withColumn("_super", F.coalesce("_large", "_super"))
    each = F.explode(F.array_repeat(F.when(F.col("_super"), "badge").otherwise("edge"), F.when(F.col("_super"), 1).otherwise(F.col("_n"))))
    return counted.select("source", "target", each.alias("kind"))


def without_externals(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where("type <> 'external'")
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def without_exports(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = nodes.where("type = 'export'").select("id")
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.where("type <> 'export'"), kept


def with_exports(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between files go where the target owns an export."""
    owners = nodes.where("type = 'export'").select(F.col("parent").alias("target")).distinct().withColumn("_owns", F.lit(True))
    files = nodes.where("type = 'file'").select(F.col("id").alias("source"), F.lit(True).alias("_file"))
    e = edges.join(owners, "target", "left").join(files, "source", "left")
    return nodes, e.where(~(F.coalesce("_owns", F.lit(False)) & F.coalesce("_file", F.lit(False)))).drop("_owns", "_file")


def only_imported(nodes: DataFrame, edges: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that something imports (or that own a used export), used exports, and the root."""
    targets = edges.select(F.col("target").alias("id"))
    sources = edges.join(nodes.where("type = 'export'").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"))
    used = targets.union(sources).distinct()
    parents = nodes.where("type = 'export'").join(used, "id", "left_semi").select(F.col("parent").alias("id"))
    keep = used.union(parents).distinct()
    kept = nodes.join(keep, "id", "left_semi")
    if root is not None:
        kept = kept.unionByName(nodes.where(F.col("id") == root)).distinct()
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def exports_by_file(nodes: DataFrame, contains: str = "") -> DataFrame:
    """Sidebar groups: file label with its exports in order."""
    ex = nodes.where("type = 'export'").where(F.lower("label").contains(contains.lower()))
    return ex.groupBy("parent").agg(F.sort_array(F.collect_list("label")).alias("exports"), F.count("*").alias("n"))


def hydrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the labels of both ends."""
    n = nodes.select("id", "label")
    a = edges.join(n.withColumnsRenamed({"id": "source", "label": "source_label"}), "source", "left")
    return a.join(n.withColumnsRenamed({"id": "target", "label": "target_label"}), "target", "left")


def codes(label: Column) -> Column:
    """Two-letter code candidates of a label: initials of its words, then its first letters."""
    words = F.regexp_extract_all(label, F.lit("([A-Z]?[a-z0-9]+|[A-Z]+)"), F.lit(1))
    flat = F.upper(F.array_join(words, ""))
    initials = F.upper(F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.coalesce(F.get(words, F.lit(1)), F.lit("")), 1, 1)))
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(F.length(flat), F.lit(2))), lambda i: F.concat(F.substring(flat, 1, 1), F.substr(flat, i, F.lit(1))))
    return F.array_distinct(F.filter(F.concat(F.array(initials), pairs), lambda x: F.length(x) == 2))


def assign_codes(labelled: list[tuple[str, list[str]]]) -> dict[str, str]:
    """Unique codes in order, each the first of its candidates that is free, else a number.  For the few super nodes."""
    taken: set[str] = set()
    out = {}
    for label, wanted in labelled:
        free = next((c for c in wanted if c not in taken), None)
        n = 1
        while free is None:
            free = f"{(label[:1] or '?').upper()}{n}" if f"{(label[:1] or '?').upper()}{n}" not in taken else None
            n += 1
        taken.add(free)
        out[label] = free
    return out


def assigned_codes(labelled: DataFrame) -> DataFrame:
    """label, code for rows (label, ord, wanted: code candidates): what assign_codes gives in the order of ord, which is unique.

    Every label asks for its first candidate, after them its first letter with a number; a
    code keeps the first label that asks.  What an earlier label holds stays with it or goes
    to an even earlier one, so those turned away ask for their next candidate that none
    holds.  Once no label is turned away each has the first code that no earlier one took.
    """
    n = labelled.count()
    letter = F.upper(F.coalesce(F.nullif(F.substring("label", 1, 1), F.lit("")), F.lit("?")))
    numbered = F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: F.concat(letter, i.cast("string")))
    asks = written(labelled.select("label", "ord", F.posexplode(F.concat("wanted", numbered)).alias("i", "code")), "candidates")
    state = asks.groupBy("label", "ord").agg(F.min_by("code", "i").alias("code"))
    while True:
        held = written(state.groupBy("code").agg(F.min("ord").alias("_by"), F.count("*").alias("_n"), F.min_by("label", "ord").alias("label")), "codes")
        if not held.where("_n > 1").limit(1).count():
            return held.select("label", "code")
        open_ = asks.join(held.select("code", "_by"), "code", "left").where("_by IS NULL OR _by >= ord")
        state = open_.groupBy("label", "ord").agg(F.min_by("code", "i").alias("code"))


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
