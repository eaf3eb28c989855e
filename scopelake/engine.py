"""The engine: everything a user asks of a source tree, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopelake.functions.catalogue import FIELDS, profile
from scopelake.functions.storage import written
from scopelake.operators import deps, explorer, notebooks, rank, tree
from scopelake.operators import flow as ops
from scopelake.operators import lines as rows
from scopelake.sources import analyze, flow, modules, trees
from scopelake.sources.cache import Cache

# Paths that count less unless asked otherwise.
DEPRIORITIZED = [".agents/", "docs/idea/", "vendor/", "vendors/", "node_modules/"]


class Engine:
    """One source tree.  The analysis is the dominant cost; it is written to the shared folder once it is made.

    With a ``cache`` folder it outlives the session, and refresh() analyzes only files
    whose content has changed.
    """

    def __init__(self, spark: SparkSession, root: str, cache: str | None = None):
        self.spark, self.root = spark, root
        self.cache = Cache(spark, root, cache) if cache else None
        self._files: DataFrame | None = None
        self._analyzed: DataFrame | None = None
        self._nodes: DataFrame | None = None
        self._graph: tuple[DataFrame, DataFrame] | None = None
        self._modules: DataFrame | None = None
        self.refreshed: dict[str, int] = {}

    def analyzed(self) -> DataFrame:
        if self._analyzed is None and self.cache:
            if not self.cache.version():
                self.refreshed = self.cache.refresh()
            self._files, self._analyzed = self.cache.manifest(), self.cache.rows()
        elif self._analyzed is None:
            content = trees.source_files(self.spark, self.root).persist()  # two readings
            self._analyzed = written(analyze.analyze(content), "analyzed")
            self._files = written(content.select("path", "file_size", "last_modified"), "files")
            content.unpersist()
        return self._analyzed

    def release(self) -> None:
        """Forget what is known of the tree; the next question reads it anew (with a cache: reads the cache)."""
        self._files = self._analyzed = self._nodes = self._graph = self._modules = None

    def refresh(self) -> DataFrame:
        """Read the tree anew; with a cache, only what has changed (``refreshed`` counts it)."""
        self.release()
        if self.cache:
            self.refreshed = self.cache.refresh()
        return self.nodes()

    def failed(self) -> DataFrame:
        """path, error of files that could not be analyzed; they are in no other result."""
        return analyze.failed(self.analyzed())

    def nodes(self) -> DataFrame:
        """Folders, files, scopes and bodies with their metrics."""
        if self._nodes is None:
            a = self.analyzed()
            folders = self.cache.folders() if self.cache else None
            self._nodes = written(analyze.nodes(a, self._files.select("path", "file_size", "last_modified"), folders), "nodes")
        return self._nodes

    def ranked(self, weights: str | dict[str, float] = "general", focus: list[str] = (), deprioritized: list[str] = DEPRIORITIZED, within: str | None = None) -> DataFrame:
        """Nodes other than folders with score, drivers, evidence and category; maxima are those of what is ranked."""
        w = profile(weights) if isinstance(weights, str) else weights
        n = self.nodes().where("node_type <> 'folder'")
        if within is not None:
            n = n.where((F.col("path") == within) | F.col("path").startswith(within + "/") | F.col("path").startswith(within + "::"))
        s = rank.with_score(n, w).withColumn("path_priority", rank.priority_label(F.col("path"), list(focus), list(deprioritized)))
        s = s.withColumn("score", rank.adjusted(F.col("raw_score"), F.col("path_priority"))).withColumn("raw_score", F.round("raw_score", 4))
        s = s.withColumn("evidence", rank.evidence(list(w))).withColumn("category", rank.category(F.col("evidence")))
        keep = ["node_id", "path", "name", "node_type", "start_line", "end_line", "score", "raw_score", "path_priority", "evidence", "category"]
        return s.select(*keep, rank.drivers(w).alias("drivers"), rank.reason().alias("reason"))

    def hotspots(self, limit: int = 50, **how) -> DataFrame:
        return rank.top_ranked(self.ranked(**how), limit, "node_id")

    def findings(self, limit: int = 50, **how) -> DataFrame:
        return rank.findings(rank.all_ranked(self.ranked(**how), "node_id"), limit)

    def explorer(self, metrics: list[str], limit: int = 50) -> DataFrame:
        """The interactive list: sums of normalized metrics over files and scopes."""
        n = self.nodes().where("node_type <> 'folder'")
        scored = n.crossJoin(F.broadcast(rank.maxima(n, metrics))).withColumn("score", rank.explorer_score(metrics))
        return rank.top_ranked(scored.where("score > 0"), limit, "node_id").select("rank", "path", "name", "node_type", "score", *metrics)

    def search(self, term: str) -> DataFrame:
        n = self.nodes()
        edges = n.select(F.col("node_id").alias("node"), "parent")
        return tree.name_filter(n, tree.closure(edges), term)

    def subtree(self, path: str) -> DataFrame:
        return self.nodes().where((F.col("path") == path) | F.col("path").startswith(path + "/") | F.col("path").startswith(path + "::"))

    def explain(self, path: str, limit: int = 25) -> DataFrame:
        """Hotspots of one file or folder, scored against its own maxima."""
        return self.hotspots(limit, within=path)

    def tree_summary(self, depth: int = 3, top: int = 6, **how) -> DataFrame:
        """Folders and files down to a depth, the top children of each by score then size, ancestors always kept."""
        n = tree.with_scores(self.nodes(), self.ranked(**how))
        n = n.withColumn("depth", F.size(F.split(F.regexp_replace("node_id", "::", "/"), "/")))
        kept = tree.summary(n, depth, top, F.desc("score"), F.desc("loc"), F.asc("node_id"))
        return kept.select("node_id", "path", "parent", "name", "node_type", "depth", "loc", "complexity", "function_count", "file_count", "score", rank.top_metrics([m for m in FIELDS if m not in ("last_modified", "gitignored_count")]).alias("top_metrics"))

    def dependencies(self) -> tuple[DataFrame, DataFrame]:
        if self._graph is None:
            files = trees.module_files(self.spark, self.root)
            base, aliases = trees.aliases(self.spark, trees.nearest_config(self.root), trees.folder_names(self.root))
            scanned = written(modules.scan_modules(files), "modules")
            self._modules, self._graph = scanned, tuple(written(x, "graph") for x in modules.dependency_graph(scanned, base, aliases))
        return self._graph

    def graph(self, externals: bool = True, exports: bool = True, imported_only: bool = False, root: str | None = None, collapse: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The dependency graph as it is drawn: (nodes, edges with the labels of both ends and a kind).

        Without exports, files point at files; with them, at what they take from each other.
        ``collapse``: nodes with more importers than that get one badge an importer.
        """
        nodes, edges = self.dependencies()
        if not externals:
            nodes, edges = deps.without_externals(nodes, edges)
        nodes, edges = deps.with_exports(nodes, edges) if exports else deps.without_exports(nodes, edges)
        if imported_only:
            nodes, edges = deps.only_imported(nodes, edges, root)
        drawn = edges.select("source", "target", F.col("edge_kind").alias("kind"))
        if collapse is not None:
            drawn = deps.collapse_super_nodes(drawn, deps.super_nodes(drawn, collapse, distinct_sources=True))
        return nodes, deps.hydrate(drawn, nodes)

    def fan_in(self) -> DataFrame:
        """path, fan_in: about how many modules import each file, and anything below each folder."""
        e = self.dependencies()[1].where("edge_kind = 'import'")
        return deps.merged_fan_in(deps.fan_in_sketches(e), "target")

    def exports(self, contains: str = "") -> DataFrame:
        """parent, exports, n: files with what they export, as the sidebar lists them."""
        return deps.exports_by_file(self.dependencies()[0], contains)

    def unread_modules(self) -> DataFrame:
        """path, error of modules that could not be read for the graph."""
        self.dependencies()
        return modules.failed(self._modules)

    # the explorer and the treemap

    def children(self, parent: str | None = None, field: str = "loc", descending: bool = True) -> DataFrame:
        """The nodes of a folder, file or scope as the explorer lists them, with how many children each has."""
        n = self.nodes()
        counts = explorer.child_counts(n, "parent", "node_type", ["folder", "file", "function"])
        here = n.where(F.col("parent").isNull() if parent is None else F.col("parent") == parent)
        j = here.join(counts.withColumnsRenamed({"parent": "node_id", "folder": "folders", "file": "files", "function": "functions"}), "node_id", "left")
        return j.orderBy(*explorer.explorer_order(F.col("node_type"), F.col(field), F.col("name"), descending), "node_id")

    def treemap(self, metric: str = "loc", show_bodies: bool = False) -> DataFrame:
        """node_id, parent, name, node_type, value, place: every node below its parent, larger ones first and bodies last."""
        n = self.nodes() if show_bodies else tree.hide_bodies(self.nodes())
        w = Window.partitionBy("parent").orderBy(*explorer.treemap_order(F.col("node_type"), F.col(metric)), "node_id")
        return n.select("node_id", "parent", "name", "node_type", F.col(metric).alias("value"), F.row_number().over(w).alias("place"))

    def leaf_sums(self, metric: str = "loc") -> DataFrame:
        """path and the metric summed over the files below it."""
        files = self.nodes().where("node_type IN ('folder', 'file')")
        return tree.leaf_sums(files.select("path", "parent", metric), metric)

    def filtered(self, suffixes: list[str] = (), most_loc: int | None = None, excluded: list[str] = ()) -> DataFrame:
        """path, loc, node_type: files of some suffixes (with the full stop), not too long, outside some paths, and the folders that hold any."""
        files = self.nodes().where("node_type = 'file'").withColumn("suffix", trees.last_suffix(F.col("path")))
        return tree.attribute_filter(files, list(suffixes), most_loc, list(excluded))

    def suffixes(self) -> DataFrame:
        """suffix, n: how many files end in each."""
        return self.nodes().where("node_type = 'file'").select(trees.last_suffix(F.col("path")).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))

    def breadcrumbs(self, path: str) -> str:
        """Names on the way to a node, by its path."""
        n = self.nodes()
        named = n.where(F.col("path") == path).select(F.col("node_id").alias("node")).limit(1)
        up = tree.closure(n.select(F.col("node_id").alias("node"), "parent")).join(named, "node", "left_semi")
        names = n.select("node_id", "name")
        found = tree.breadcrumbs(up, names).join(named, "node", "left_semi").first()
        return found["trail"] if found else ""

    # one file

    def _one(self, path: str) -> DataFrame:
        f = self.spark.createDataFrame([(path, 0, 0.0)], trees.LISTING)
        return trees.with_content(self.spark, self.root, f)

    def overlay(self, path: str, focus: tuple[int, int], slice_: tuple[int, int] | None = None) -> DataFrame:
        base, aliases = trees.aliases(self.spark, trees.nearest_config(self.root), trees.folder_names(self.root))
        return flow.overlay(self._one(path), focus, slice_, trees.module_files(self.spark, self.root).select("path"), base, aliases)

    def scope_graph(self, path: str) -> DataFrame:
        return flow.scope_graph(self._one(path))

    def data_flow(self, path: str) -> tuple[DataFrame, DataFrame]:
        return flow.data_flow(self._one(path))

    def _scopes(self, path: str) -> tuple[DataFrame, DataFrame]:
        """(scopes in preorder, closure) of a file."""
        s = flow._rows(flow.scanned(self._one(path), "focus"), "scopes")
        return s.withColumn("preorder", F.substring_index("scope_id", "#", -1).cast("long")), flow.closure(s)

    def focused_scope(self, path: str, lines: tuple[int, int]) -> DataFrame:
        """The scope that a range of lines is shown in: the deepest on the way down that holds it."""
        s, c = self._scopes(path)
        return s.join(explorer.focused_scope(s, c, *lines).select("scope_id"), "scope_id", "left_semi").drop("ancestors")

    def scope_at(self, path: str, lines: tuple[int, int]) -> DataFrame:
        """The scope with exactly that range."""
        s, _ = self._scopes(path)
        return s.join(explorer.by_range(s, *lines).select("scope_id"), "scope_id", "left_semi").drop("ancestors")

    def trail(self, path: str, lines: tuple[int, int]) -> DataFrame:
        """Scopes on the way down to a range of lines, the file's own first."""
        s, c = self._scopes(path)
        at = explorer.breadcrumb_trail(s, c, *lines).select("scope_id")
        return s.join(at, "scope_id", "left_semi").drop("ancestors").orderBy("depth")

    def display(self, path: str, lines: tuple[int, int], offset: int = 0, keep: int = 2) -> tuple[DataFrame, DataFrame]:
        """(first, last, shown: the lines with their common indent cut; tokens placed on them)."""
        f = self.content(path).withColumnRenamed("content", "text")
        cut = rows.display_slice(f, "path", F.lit(lines[0]), F.lit(lines[1]), offset)
        indent = rows.common_indent(cut, "path", "shown", keep).select("path", "cut")
        held = cut.join(indent, "path").withColumn("shown", F.array_join(F.transform(F.split("shown", "\n"), lambda x: F.when(F.trim(x) == "", "").otherwise(F.substr(x, F.col("cut") + 1))), "\n"))
        at = held.select("first", "cut").first()
        tokens = explorer.display_tokens(self.overlay(path, lines), at["first"], at["cut"]) if at else self.overlay(path, lines)
        return held.select("path", "first", "last", "shown"), tokens

    def pills(self, path: str, collapsed: list[str] = ()) -> DataFrame:
        """scope_id, name: declarations that are shown, those of collapsed scopes only where they are captured below."""
        g = self.scope_graph(path)
        s, c = self._scopes(path)
        names = lambda kind: g.select("scope_id", F.explode(kind).alias("name"))
        small = self.spark.createDataFrame([(x,) for x in collapsed], "scope_id string")
        return explorer.declared_pills(names("declared"), s, c, small, names("captured"))

    def line_clusters(self, path: str) -> DataFrame:
        """scope, line, n_defs, n_usages of lines that both define and use names."""
        scanned = flow.scanned(self._one(path), "flow")
        place = lambda kind: flow._rows(scanned, kind).select(F.col("scope_id").alias("scope"), "line")
        return ops.line_clusters(place("defs"), place("usages"))

    def content(self, path: str) -> DataFrame:
        """path, content: notebooks as their virtual text."""
        f = self._one(path)
        return f.select("path", (notebooks.virtual_text(F.col("content")) if path.endswith(".ipynb") else F.col("content")).alias("content"))

    def listing(self, folder: str = "") -> DataFrame:
        return trees.directory(self.spark, f"{self.root}/{folder}".rstrip("/"))

    def context(self) -> DataFrame:
        return trees.quick_count(self.spark, self.root)
