"""Further operators on the driver's tables: lookups, sorts and filters of the views, labels, languages' counts.

Importing this module registers its queries beside those of ``queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopelake.functions import text as T
from scopelake.operators import deps, explorer, flow, rank, tree
from scopelake.plans.queries import FILES_SQL, GEO_SQL, GRAPH_SQL, files, geo_closure, geo_nodes, joined, made_files, part_graph, query, table

# scopes of one file per customer: a file of 40 lines, two scopes in it (a, b), and scopes in those


def nested_scopes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(scopes, closure with every scope its own ancestor); how far each scope reaches depends on the customer's key."""
    k = F.col("c_custkey")
    shapes = [
        ("", None, F.lit(1), F.lit(40)),
        ("a", "", F.lit(2), F.when(k % 4 == 0, 6).otherwise(14)),
        ("a1", "a", F.lit(4), 6 + k % 7),
        ("a2", "a", F.lit(3), 5 + k % 3),
        ("b", "", F.lit(3), 30 + k % 2),
        ("b1", "b", F.when(k % 5 == 0, 3).otherwise(5), F.when(k % 5 == 0, 30).otherwise(9)),
        ("b2", "b1", F.lit(5), F.when(k % 3 == 0, 8).otherwise(6)),
    ]
    above = {name: parent for name, parent, *_ in shapes}
    t = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("c"), k.cast("string")).alias("path"))
    own = lambda name: F.concat_ws("/", "path", F.lit(name)) if name else F.col("path")

    def chain(name: str | None) -> list[str]:
        return [] if name is None else [name, *chain(above[name])]

    rows = [
        F.struct(own(name).alias("scope_id"), (F.lit(None).cast("string") if parent is None else own(parent)).alias("parent_id"), a.cast("long").alias("start_line"), b.cast("long").alias("end_line"), F.lit(len(chain(name)) - 1).alias("depth"), F.lit(i).alias("preorder"))
        for i, (name, parent, a, b) in enumerate(shapes)
    ]
    up = [F.struct(own(name).alias("node"), own(x).alias("ancestor"), F.lit(d).alias("distance")) for name, *_ in shapes for d, x in enumerate(chain(name))]
    return t.select("path", F.explode(F.array(*rows)).alias("s")).select("path", "s.*"), t.select(F.explode(F.array(*up)).alias("c")).select("c.*")


@query("""SELECT 'c' || c_custkey AS path, 'c' || c_custkey || '/' || CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'b2' ELSE 'b1' END
WHEN c_custkey % 7 >= 1 THEN 'a1' WHEN c_custkey % 3 = 2 THEN 'a2' ELSE 'a' END AS scope_id FROM customer""")
def focused_scope(spark, sf):
    """Lines 5 to 7: the first scope that holds them, at every depth."""
    return explorer.focused_scope(*nested_scopes(spark, sf), 5, 7)


@query("""SELECT 'c' || c_custkey AS path, 'c' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '/b' ELSE '/b1' END AS scope_id FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0""")
def scopes_by_range(spark, sf):
    """Lines 3 to 30 exactly: of a scope and one as wide inside it the outer one."""
    return explorer.by_range(nested_scopes(spark, sf)[0], 3, 30)


@query("""WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey AS path, c_custkey % 4 <> 0 AS a, c_custkey % 7 >= 1 AS a1, c_custkey % 3 = 2 AS a2, c_custkey % 5 <> 0 OR c_custkey % 3 = 0 AS b1, c_custkey % 3 = 0 AS b2 FROM customer),
t AS (SELECT path, '' AS s, 0 AS depth FROM c UNION ALL SELECT path, CASE WHEN a THEN '/a' ELSE '/b' END, 1 FROM c UNION ALL SELECT path, CASE WHEN a1 AND (NOT a2 OR k % 7 <= 2) THEN '/a1' ELSE '/a2' END, 2 FROM c WHERE a AND (a1 OR a2)
UNION ALL SELECT path, '/b1', 2 FROM c WHERE NOT a AND b1 UNION ALL SELECT path, '/b2', 3 FROM c WHERE NOT a AND b2)
SELECT path, path || s AS scope_id, CAST(depth AS INT) AS depth FROM t""")
def breadcrumb_descent(spark, sf):
    """The way down to lines 5 to 7 through the narrowest scopes; one as wide as its parent only where a narrower one follows."""
    return explorer.breadcrumb_trail(*nested_scopes(spark, sf), 5, 7)


@query("""SELECT name, path, loc FROM (SELECT p_brand AS name, 'p' || p_partkey AS path, CAST(p_size AS BIGINT) AS loc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1""")
def files_by_name(spark, sf):
    p = table(spark, sf, "part")
    return explorer.by_name(p.select(F.col("p_brand").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("loc"), F.col("p_partkey").alias("preorder")))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type IN ('error', 'view'), value DESC, event_id) AS INT) AS place FROM events""")
def treemap_sort(spark, sf):
    """Errors and views as synthetic bodies: last among their siblings."""
    kind = F.when(F.col("event_type") == "error", "function_body").when(F.col("event_type") == "view", "file_body").otherwise("file")
    w = Window.partitionBy("user_id").orderBy(*explorer.treemap_order(kind, F.col("value")), "event_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 > 0 THEN CAST(value AS BIGINT) END NULLS LAST, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, event_id) AS INT) AS place
FROM (SELECT event_id, user_id, event_type, floor(value) AS value FROM events)""")
def flow_sort(spark, sf):
    """Line, then declaration, variable, usage and the rest; rows without a line last."""
    kind = F.when(F.col("event_type") == "view", "declaration").when(F.col("event_type") == "click", "variable").when(F.col("event_type") == "purchase", "usage").otherwise("x")
    line = F.when(F.col("event_id") % 11 > 0, F.floor("value"))
    w = Window.partitionBy("user_id").orderBy(*explorer.flow_order(line, kind, F.col("event_id")))
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("""WITH n AS (SELECT *, event_type = 'view' OR event_id % 13 = 0 AS body, (user_id, floor(event_id / 3)) AS parent FROM events)
SELECT event_id FROM n WHERE NOT body OR parent NOT IN (SELECT parent FROM n WHERE NOT body)""")
def visible_nodes(spark, sf):
    """Synthetic bodies go, by kind or by name, unless their parent has nothing else."""
    e = table(spark, sf, "events").select(
        "event_id",
        F.concat_ws("/", "user_id", F.floor(F.col("event_id") / 3).cast("string")).alias("parent"),
        F.when(F.col("event_type") == "view", "function_body").otherwise("function").alias("node_type"),
        F.when(F.col("event_id") % 13 == 0, "(body)").otherwise("f").alias("name"),
    )
    return tree.hide_bodies(e).select("event_id")


@query("""WITH n AS (SELECT r_name AS path, NULL::VARCHAR AS parent, CAST(1000 AS BIGINT) AS loc FROM region UNION ALL SELECT r_name || '/' || n_name, r_name, CAST(100 AS BIGINT) FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_custkey, r_name || '/' || n_name, CAST(c_custkey % 17 AS BIGINT) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
l AS (SELECT * FROM n WHERE path NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL))
SELECT n.path, CAST(sum(l.loc) AS BIGINT) AS loc FROM n JOIN l ON starts_with(l.path, n.path || '/') GROUP BY n.path""")
def leaf_only_sums(spark, sf):
    """Lines of containers themselves are not counted."""
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("own", F.concat_ws("/", "r_name", "n_name"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(1000).cast("long").alias("loc"))
    n = place.select(F.col("own").alias("path"), F.col("r_name").alias("parent"), F.lit(100).cast("long").alias("loc"))
    c = table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = c.select(F.concat_ws("/", "own", F.col("c_custkey").cast("string")).alias("path"), F.col("own").alias("parent"), (F.col("c_custkey") % 17).cast("long").alias("loc"))
    return tree.leaf_sums(r.unionByName(n).unionByName(leaves))


@query("""SELECT o_orderkey AS file_id, CAST(greatest(0, o_orderkey % 200 - coalesce((SELECT sum(CAST(l_quantity AS BIGINT)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 3), 0)) AS BIGINT) AS body_loc FROM orders""")
def body_remainders(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 200).cast("long").alias("loc"))
    parent = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber"))
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_quantity").cast("long").alias("nloc"), parent.alias("parent_scope_id"))
    return tree.body_remainder(f, s).withColumn("body_loc", F.col("body_loc").cast("long"))


@query("""SELECT event_id, CAST(line - 3 AS BIGINT) AS display_line, CAST(greatest(0, a - 4) AS BIGINT) AS start_col, CAST(greatest(0, b - 4) AS BIGINT) AS end_col
FROM (SELECT event_id, event_id % 50 AS line, user_id % 9 AS a, user_id % 9 + floor(value) % 6 AS b FROM events) WHERE line >= 3 AND greatest(0, b - 4) > greatest(0, a - 4)""")
def overlay_tokens(spark, sf):
    """Tokens before the slice go, and those that the cut indent swallows."""
    a = F.col("user_id") % 9
    t = table(spark, sf, "events").select("event_id", (F.col("event_id") % 50).cast("long").alias("line"), a.cast("long").alias("start_col"), (a + F.floor("value") % 6).cast("long").alias("end_col"))
    return explorer.display_tokens(t, 3, 4).select("event_id", "display_line", "start_col", "end_col")


@query("""SELECT user_id AS root, event_type AS symbol, min(event_id) AS preorder FROM events GROUP BY ALL""")
def captured_once(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("root"), F.col("event_type").alias("symbol"), F.col("event_id").alias("preorder"))
    return explorer.first_consumers(e)


@query("""WITH d AS (SELECT n_nationkey AS n, unnest(range(15)) AS i FROM nation)
SELECT 'n' || n AS scope_id, 'L' || i AS name FROM d WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n AND s_suppkey % 10 = i) AND (n % 2 = 1 OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n AND s_suppkey % 7 + 8 = i))""")
def declared_pills(spark, sf):
    """Nations declare fifteen names; suppliers below are scopes that may bear one and capture one; every second nation is collapsed."""
    n = geo_nodes(spark, sf)
    key = F.substring("node_id", 2, 20).cast("long")
    nations, below = n.where("node_id LIKE 'n%'"), n.where("node_id LIKE 's%'")
    declared = nations.select(F.col("node_id").alias("scope_id"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i")).select("scope_id", F.concat(F.lit("L"), F.col("i").cast("string")).alias("name"))
    scopes = below.select(F.col("node_id").alias("scope_id"), F.concat(F.lit("L"), (key % 10).cast("string")).alias("label"))
    collapsed = nations.where(key % 2 == 0).select(F.col("node_id").alias("scope_id"))
    caught = below.select(F.col("node_id").alias("scope_id"), F.concat(F.lit("L"), (key % 7 + 8).cast("string")).alias("name"))
    return explorer.declared_pills(declared, scopes, geo_closure(n), collapsed, caught)


@query(f"""WITH {GRAPH_SQL}, l AS (SELECT id, type || ':' || substr(id, -1) AS label FROM n) SELECT a.label AS source_label, b.label AS target_label, CAST(count(*) AS BIGINT) AS n FROM e LEFT JOIN l a ON a.id = source LEFT JOIN l b ON b.id = target GROUP BY ALL""")
def hydrated_edges(spark, sf):
    n, e = part_graph(spark, sf)
    labelled = n.withColumn("label", F.concat(F.col("type"), F.lit(":"), F.substring("id", -1, 1)))
    return deps.hydrate(e, labelled).groupBy("source_label", "target_label").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(value - 10), event_id) AS r FROM events) WHERE r = 1""")
def nearest_candidate(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.abs(F.col("value") - 10).alias("away"))
    return deps.first_per(e, ["user_id", "event_type"], F.col("away"), F.col("event_id")).drop("away")


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type || p_size END AS label FROM part),
w AS (SELECT p_partkey, regexp_extract_all(label, '([A-Z]?[a-z0-9]+|[A-Z]+)', 1) AS w FROM l),
f AS (SELECT p_partkey, upper(array_to_string(w, '')) AS flat, upper(left(w[1], 1) || left(coalesce(w[2], ''), 1)) AS first FROM w),
c AS (SELECT p_partkey, list_filter(list_concat([first], list_transform(range(2, greatest(length(flat), 2) + 1), lambda i: flat[1] || flat[i])), lambda x: length(x) = 2) AS c FROM f)
SELECT p_partkey, c[1] AS first, array_to_string(list_sort(list_distinct(c)), ',') AS every FROM c""")
def label_codes(spark, sf):
    p = F.col("p_partkey")
    label = F.when(p % 3 == 0, F.col("p_name")).when(p % 3 == 1, F.col("p_brand")).otherwise(F.concat("p_type", F.col("p_size").cast("string")))
    c = table(spark, sf, "part").select("p_partkey", deps.codes(label).alias("c"))
    return c.select("p_partkey", F.get("c", F.lit(0)).alias("first"), F.array_join(F.sort_array("c"), ",").alias("every"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS m, source || '/' || lang || '/' AS folder, CASE doc_id % 4 WHEN 0 THEN 'index.tsx' WHEN 1 THEN '[' || doc_id || '].ts' WHEN 2 THEN 'Name' || doc_id || '.py' ELSE 'reindex.md' END AS base FROM documents)
SELECT doc_id, folder || base AS file, base, CASE WHEN m < 2 THEN string_split(folder, '/')[2] || '/' || base ELSE base END AS label, CASE WHEN length(base) > 8 THEN substr(base, 1, 7) || '…' ELSE base END AS short,
folder || base || CASE WHEN m = 3 THEN '' ELSE ':' || (doc_id + 1) || '-' || (doc_id + 5) END AS place FROM d""")
def path_labels(spark, sf):
    """File of a scope path, base name, label with its folder, truncated name, place with lines where they are known."""
    k = F.col("doc_id")
    base = F.when(k % 4 == 0, "index.tsx").when(k % 4 == 1, F.concat(F.lit("["), k.cast("string"), F.lit("].ts"))).when(k % 4 == 2, F.concat(F.lit("Name"), k.cast("string"), F.lit(".py"))).otherwise("reindex.md")
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", base).alias("path"))
    file = T.file_of_scope(F.concat("path", F.lit("::outer::inner")))
    line = lambda n: F.when(k % 4 != 3, k + n)
    return d.select("doc_id", file.alias("file"), T.base_name(file).alias("base"), T.label_of_path(file).alias("label"), T.truncated(T.base_name(file), 8).alias("short"), T.location(file, line(1), line(5)).alias("place"))


@query(f"""WITH f AS ({FILES_SQL}), e AS (SELECT doc_id, unnest([{{'m': 'complexity', 'n': 0, 'v': complexity}}, {{'m': 'loc', 'n': 1, 'v': loc}}, {{'m': 'todo_count', 'n': 2, 'v': todo_count}}, {{'m': 'parameter_count', 'n': 3, 'v': parameter_count}}, {{'m': 'n_lines', 'n': 4, 'v': n_lines}}]) AS x FROM f)
SELECT doc_id, string_agg(x.m || '=' || x.v, ',' ORDER BY x.v DESC, x.n) AS metrics FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x.v DESC, x.n) AS r FROM e WHERE x.v > 0) WHERE r <= 3 GROUP BY doc_id""")
def top_metrics_array(spark, sf):
    found = rank.top_metrics(["complexity", "loc", "todo_count", "parameter_count", "n_lines"], 3)
    shown = F.transform(found, lambda x: F.concat(x["name"], F.lit("="), x["value"].cast("long").cast("string")))
    return files(spark, sf).select("doc_id", F.array_join(shown, ",").alias("metrics")).where("metrics <> ''")


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS name, 'n' || c_nationkey AS scope, 'r' || n_regionkey AS above, c_acctbal AS b FROM customer JOIN nation ON n_nationkey = c_nationkey),
d AS (SELECT k, name, CASE WHEN b > 9000 THEN above ELSE scope END AS scope FROM c WHERE b > 9000 OR b < 0)
SELECT k AS usage_id, coalesce((SELECT max(d.k) FROM d WHERE d.scope = c.scope AND d.name = c.name AND d.k < c.k), (SELECT max(d.k) FROM d WHERE d.scope = c.above AND d.name = c.name AND d.k < c.k), -1) AS def_id FROM c""")
def ordered_resolution(spark, sf):
    """Rich customers define their segment for the region, indebted ones for the nation; only earlier definitions count, the last of the nearest scope."""
    n = geo_nodes(spark, sf).where("node_id NOT LIKE 's%'")
    closed = geo_closure(n).unionByName(n.select(F.col("node_id").alias("node"), F.col("node_id").alias("ancestor"), F.lit(0).alias("distance")))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own, above = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    defs = c.where("c_acctbal > 9000 OR c_acctbal < 0").select(F.when(F.col("c_acctbal") > 9000, above).otherwise(own).alias("scope"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("def_id"), F.col("c_custkey").alias("preorder"))
    usages = c.select(F.col("c_custkey").alias("usage_id"), own.alias("scope"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("preorder"))
    return flow.resolve_ordered(usages, closed, defs).select("usage_id", F.coalesce("def_id", F.lit(-1)).alias("def_id"))


@query(f"""WITH RECURSIVE {GEO_SQL}, a AS (SELECT node, ancestor FROM c UNION ALL SELECT node_id, node_id FROM g),
v AS (SELECT 's' || s_suppkey AS scope, CASE s_suppkey % 3 WHEN 0 THEN 'branch' WHEN 1 THEN 'comment' ELSE 'nesting' END AS kind, s_suppkey % 6 + 1 AS value FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'branch', n_nationkey + 1 FROM nation),
u AS (SELECT ancestor AS scope, sum(value) FILTER (kind = 'comment') AS comment, max(value) FILTER (kind = 'nesting') AS nesting FROM v JOIN a ON node = scope WHERE kind <> 'branch' GROUP BY 1),
b AS (SELECT scope, sum(value) AS branches FROM v WHERE kind = 'branch' GROUP BY 1)
SELECT coalesce(u.scope, b.scope) AS scope, CAST(coalesce(branches, 0) AS BIGINT) AS branches, CAST(coalesce(comment, 0) AS BIGINT) AS comment, CAST(coalesce(nesting, 0) AS BIGINT) AS nesting FROM u FULL JOIN b ON u.scope = b.scope""")
def scope_accumulators(spark, sf):
    """Branches count in their own scope, comments and nesting in every scope around them."""
    n, key = geo_nodes(spark, sf), F.col("s_suppkey")
    closed = geo_closure(n).unionByName(n.select(F.col("node_id").alias("node"), F.col("node_id").alias("ancestor"), F.lit(0).alias("distance")))
    kind = F.when(key % 3 == 0, "branch").when(key % 3 == 1, "comment").otherwise("nesting")
    e = table(spark, sf, "supplier").select(F.concat(F.lit("s"), key).alias("scope"), kind.alias("kind"), (key % 6 + 1).cast("long").alias("value"))
    e = e.unionByName(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("scope"), F.lit("branch").alias("kind"), (F.col("n_nationkey") + 1).cast("long").alias("value")))
    return flow.scope_counts(e, closed).select("scope", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("branches", "comment", "nesting")])


@query("""WITH w AS (SELECT ts, event_type, unnest([0, 1, 2, 3]) AS back, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events)
SELECT epoch_us(b - back * INTERVAL '15 minutes') AS start_us, event_type, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY ALL""")
def events_sliding(spark, sf):
    from scopelake.streaming.events import sliding

    return sliding(table(spark, sf, "events")).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("""SELECT path, CASE WHEN path LIKE '%/7' THEN false WHEN path LIKE 'src1/%' OR path LIKE '%/de/%' OR regexp_matches(path, '/[0-9]5$') THEN true ELSE false END AS ignored FROM (SELECT source || '/' || lang || '/' || doc_id AS path FROM documents)""")
def ignore_rules(spark, sf):
    """An anchored folder, a folder at any depth, a pattern of names, and a name that is let in again."""
    from scopelake.sources.trees import git_ignored, ignore_patterns

    rules = ignore_patterns([("", "# folders\n/src1/\nde/\n[0-9]5\n!7\n")])
    return files(spark, sf).select("path", git_ignored(F.col("path"), rules).alias("ignored"))


# analyzers, on source files written from the rows of the tables


@query(r"""WITH c AS (SELECT conv_id, turn, role, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS loc FROM conversations),
v AS (SELECT *, coalesce(sum(loc) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT conv_id || '.ipynb' AS path, '[' || role || '] cell ' || (turn + 1) AS name, CAST(before + 1 AS BIGINT) AS start_line, CAST(before + loc AS BIGINT) AS end_line FROM v WHERE loc > 0""")
def notebook_scopes(spark, sf):
    """Conversations as notebook files of a cell per turn, read by the notebook analyzer."""
    from scopelake.sources.analyze import analyze, scopes

    cells = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("cell_type"), x["text"].alias("source")))
    books = table(spark, sf, "conversations").groupBy("conv_id").agg(cells.alias("cells"))
    made = books.select(F.concat(F.col("conv_id").cast("string"), F.lit(".ipynb")).alias("path"), F.to_json(F.struct("cells")).alias("content"))
    return scopes(analyze(made)).select("path", "name", "start_line", "end_line")


@query("""SELECT s_suppkey || '.ts' AS path, CAST(s_suppkey % 4 AS BIGINT) AS todo_count, CAST(s_suppkey % 3 AS BIGINT) AS ts_ignore_count, CAST(s_nationkey % 5 AS BIGINT) AS ts_any_usage_count, CAST(2 AS BIGINT) AS ts_type_interface_count, CAST(1 AS BIGINT) AS ts_export_count FROM supplier""")
def ts_marks(spark, sf):
    """Remarks, suppressions, any types, type declarations and exports of suppliers' modules."""
    from scopelake.sources.analyze import analyze

    key, n = F.col("s_suppkey"), lambda c, m: (c % m).cast("int")
    parts = [F.repeat(F.lit("// TODO later\n"), n(key, 4)), F.repeat(F.lit("// @ts-ignore\nlet x = 1;\n"), n(key, 3)), joined(F.col("s_nationkey") % 5, lambda i: F.concat(F.lit("let a"), i.cast("string"), F.lit(": any;\n")), ""), "interface A { b: number }\ntype B = string;\nexport function f() { return 1; }\n"]
    made = made_files(table(spark, sf, "supplier"), F.concat(key.cast("string"), F.lit(".ts")), *parts)
    return analyze(made).select("path", "todo_count", "ts_ignore_count", "ts_any_usage_count", "ts_type_interface_count", "ts_export_count")


@query("""SELECT s_suppkey || '.go' AS path, 'f' || s_suppkey AS name, CAST(1 + s_suppkey % 5 AS DOUBLE) AS complexity, CAST(3 AS BIGINT) AS start_line, CAST(5 + 3 * (s_suppkey % 5) AS BIGINT) AS end_line, CAST(1 AS BIGINT) AS parameter_count FROM supplier""")
def generic_scopes(spark, sf):
    """Suppliers as files of a language without a parser here."""
    from scopelake.sources.analyze import analyze, scopes

    key = F.col("s_suppkey")
    made = made_files(table(spark, sf, "supplier"), F.concat(key.cast("string"), F.lit(".go")), "package p\n\nfunc f", key.cast("string"), "(a int) int {\n", F.repeat(F.lit("\tif a > 1 {\n\t\ta--\n\t}\n"), (key % 5).cast("int")), "\treturn a\n}\n")
    return scopes(analyze(made)).select("path", "name", "complexity", "start_line", "end_line", "parameter_count")
