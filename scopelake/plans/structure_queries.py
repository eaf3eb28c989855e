"""Queries on maintenance, listings, patterns, sections, notebooks, late rows, sketches and the views' categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelake.functions.storage import new_folder, written
from scopelake.operators import deps, flow, incremental, lines, markdown, notebooks, rank, tree
from scopelake.plans.queries import FILES_SQL, GEO_SQL, SCORE_SQL, WEIGHTS, files, geo_nodes, joined, made_files, numbered, part_edges, query, scored, table

# incremental maintenance: two versions of documents

#: The second version in SQL: some documents go, some have a line more, some only another time, some are new.
SECOND_SQL = r"""
SELECT doc_id, concat(source, '/', lang, '/', doc_id) AS path, CASE WHEN doc_id % 7 = 1 THEN coalesce(text, '') || chr(10) || 'More. Text!' ELSE text END AS text, doc_id % 5 = 2 AS later FROM documents WHERE doc_id % 11 <> 3
UNION ALL SELECT doc_id, concat('new/', source, '/', doc_id), text, false FROM documents WHERE doc_id % 13 = 4"""
MEASURED_SQL = r"""
SELECT path, CAST(coalesce(length(text), 0) AS BIGINT) AS file_size, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS loc,
  CAST(coalesce(length(text) - length(replace(text, '!', '')), 0) AS BIGINT) AS todo_count, CAST(coalesce(length(text) - length(replace(text, '.', '')), 0) AS BIGINT) AS complexity, 1 AS file_count FROM v"""
SUMS, MAXIMA = ["file_size", "loc", "todo_count", "file_count"], ["complexity"]


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """path, text, last_modified of the files of both versions."""
    d = table(spark, sf, "documents").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    first = d.select("path", "text", F.lit(1.0).alias("last_modified"))
    changed, later = F.col("doc_id") % 7 == 1, F.col("doc_id") % 5 == 2
    text = F.when(changed, F.concat(F.coalesce("text", F.lit("")), F.lit("\nMore. Text!"))).otherwise(F.col("text"))
    kept = d.where("doc_id % 11 <> 3").select("path", text.alias("text"), F.when(changed | later, 2.0).otherwise(1.0).alias("last_modified"))
    new = d.where("doc_id % 13 = 4").select(F.concat_ws("/", F.lit("new"), "source", F.col("doc_id").cast("string")).alias("path"), "text", F.lit(2.0).alias("last_modified"))
    return first, kept.unionByName(new)


def listed(version: DataFrame) -> DataFrame:
    return version.select("path", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("file_size"), "last_modified")


def measured(version: DataFrame) -> DataFrame:
    """What an analysis gives for files: the metrics that roll up."""
    from scopelake.functions.text import loc

    n = lambda c: F.coalesce(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))), F.lit(0)).cast("long")
    return version.select("path", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("file_size"), loc(F.coalesce("text", F.lit(""))).alias("loc"), n("!").alias("todo_count"), n(".").alias("complexity"), F.lit(1).cast("long").alias("file_count"))


def hashed(version: DataFrame, name: str) -> DataFrame:
    return version.select("path", F.xxhash64(F.coalesce("text", F.lit(""))).alias(name))


def decided(first: DataFrame, second: DataFrame) -> DataFrame:
    manifest = listed(first).join(hashed(first, "content_hash"), "path").withColumn("version", F.lit(1))
    compared = written(incremental.statuses(manifest, listed(second)), "compared")
    read = second.join(compared.where("status IN ('added', 'unsure')").select("path"), "path", "left_semi")
    return written(incremental.settled(compared, hashed(read, "new_hash")), "decided")


@query(f"""WITH v AS ({SECOND_SQL}), o AS (SELECT concat(source, '/', lang, '/', doc_id) AS path FROM documents)
SELECT path, CASE WHEN o.path IS NULL THEN 'added' WHEN v.path IS NULL THEN 'removed' WHEN v.doc_id % 7 = 1 THEN 'changed' WHEN v.later THEN 'touched' ELSE 'same' END AS status FROM v FULL JOIN o USING (path)""")
def refresh_statuses(spark, sf):
    """What a refresh finds: of files with another time, only those with another content have changed."""
    return decided(*versions(spark, sf)).select("path", "status")


@query(f"""WITH v AS ({SECOND_SQL}), m AS ({MEASURED_SQL}),
u AS (SELECT unnest(list_append(list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')), '')) AS path, * EXCLUDE (path) FROM m)
SELECT path, CAST(sum(file_size) AS BIGINT) AS file_size, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(todo_count) AS BIGINT) AS todo_count, CAST(sum(file_count) AS BIGINT) AS file_count, max(complexity) AS complexity FROM u GROUP BY path""")
def incremental_rollup(spark, sf):
    """The roll-up of the second version from that of the first and the files that differ; SQL takes it from scratch."""
    first, second = versions(spark, sf)
    status = decided(first, second)
    old = written(measured(first), "rows")
    put = second.join(status.where("status IN ('added', 'changed')").select("path"), "path", "left_semi")
    fresh = written(measured(put), "fresh")
    out = status.where("status IN ('removed', 'changed')").select("path")
    gone = old.join(out, "path", "left_semi")
    rows = old.join(out, "path", "left_anti").unionByName(fresh)
    folders = written(incremental.folder_table(old, SUMS, MAXIMA), "folders")
    return incremental.refreshed_folders(folders, gone, fresh, rows, SUMS, MAXIMA).select("path", *SUMS, *MAXIMA)


# listings and ignore patterns


@query("""WITH d AS (SELECT source, lang, length(coalesce(text, '')) AS n FROM documents WHERE lang <> 'fr')
SELECT concat('source=', source, '/lang=', lang) AS folder, CAST(sum(n) AS BIGINT) AS bytes FROM d GROUP BY ALL""")
def source_tree_listing(spark, sf):
    """A folder for each source and language, a third of them pruned by name, listed by the data source."""
    from scopelake.sources.tree_source import scan

    letters = F.repeat(F.lit("x"), F.greatest(F.length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)).cast("int"))  # a line has its end
    top = new_folder(spark, "listed")
    d = table(spark, sf, "documents").where("length(coalesce(text, '')) > 0")
    d.select("source", "lang", letters.alias("line")).where("lang <> 'fr'").repartition("source", "lang").write.mode("overwrite").partitionBy("source", "lang").text(top)
    table(spark, sf, "documents").where("lang = 'fr'").select(F.concat(F.lit("."), "lang").alias("lang"), letters.alias("line")).repartition("lang").write.mode("overwrite").partitionBy("lang").text(f"{top}/node_modules")
    found = scan(spark, top).where(F.substring_index("path", "/", -1).startswith("part-"))
    return found.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.sum("file_size").alias("bytes"))


PATTERNS_SQL = """
SELECT p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'c' || (p_partkey // 5 % 40) END AS folder, p_partkey % 5 AS kind,
  CASE p_partkey % 5 WHEN 0 THEN 'o' || p_partkey * 7 || '.log' WHEN 1 THEN '/' || (1 + p_partkey % 4) || '/o' || p_partkey * 3 || '.tmp' WHEN 2 THEN '!o' || (p_partkey - 2) * 7 || '.log'
  WHEN 3 THEN 'o' || p_partkey || '?.t*' ELSE CASE WHEN p_partkey % 200 = 4 THEN '*.ts' ELSE '*.x' || p_partkey END END AS line FROM part"""


@query(f"""WITH f AS (SELECT 'c' || (o_custkey % 40) || '/' || substr(o_orderpriority, 1, 1) || '/o' || o_orderkey || '.' || CASE o_orderstatus WHEN 'O' THEN 'log' WHEN 'F' THEN 'tmp' ELSE 'ts' END AS path FROM orders),
b AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '\\.[^.]*$') AS ext, regexp_extract(path, '^[^/]*') AS top FROM f), r AS ({PATTERNS_SQL}), p AS (SELECT *, ltrim(line, '!/') AS said, starts_with(line, '!') AS negated FROM r),
m AS (SELECT path, folder, n, negated FROM b JOIN p ON name = said AND (folder = '' OR folder = top) WHERE kind IN (0, 2)
  UNION ALL SELECT path, folder, n, negated FROM b JOIN p ON path = CASE folder WHEN '' THEN said ELSE folder || '/' || said END WHERE kind = 1
  UNION ALL SELECT path, folder, n, negated FROM b JOIN p ON ext = substr(said, 2) AND (folder = '' OR folder = top) WHERE kind = 4
  UNION ALL SELECT path, folder, n, negated FROM (SELECT *, regexp_extract(name, '^o([0-9]+)[0-9]\\.t', 1) AS head FROM b WHERE name LIKE 'o%.t%') b JOIN p ON head = CAST(n AS VARCHAR) AND (folder = '' OR folder = top) WHERE kind = 3)
SELECT path, folder, CAST(n AS BIGINT) AS n FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY folder DESC, n DESC) = 1 AND NOT negated""")
def ignore_table(spark, sf):
    """Orders as files, a pattern for every part - names, paths, suffixes, globs, exceptions - and the one that decides."""
    from scopelake.sources import ignore

    o, p, key = table(spark, sf, "orders"), table(spark, sf, "part"), F.col("p_partkey")
    ext = F.when(F.col("o_orderstatus") == "O", "log").when(F.col("o_orderstatus") == "F", "tmp").otherwise("ts")
    s = lambda c: c.cast("string")
    paths = o.select(F.concat(F.lit("c"), s(F.col("o_custkey") % 40), F.lit("/"), F.substring("o_orderpriority", 1, 1), F.lit("/o"), s(F.col("o_orderkey")), F.lit("."), ext).alias("path"))
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("o"), s(key * 7), F.lit(".log"))).when(key % 5 == 1, F.concat(F.lit("/"), s(1 + key % 4), F.lit("/o"), s(key * 3), F.lit(".tmp")))
        .when(key % 5 == 2, F.concat(F.lit("!o"), s((key - 2) * 7), F.lit(".log"))).when(key % 5 == 3, F.concat(F.lit("o"), s(key), F.lit("?.t*")))
        .otherwise(F.when(key % 200 == 4, "*.ts").otherwise(F.concat(F.lit("*.x"), s(key))))
    )
    folder = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("c"), s(F.floor(key / 5) % 40)))
    found = ignore.deciding(paths, written(ignore.patterns(p.select(folder.alias("folder"), key.alias("n"), line.alias("line"))), "patterns"))
    return found.where("NOT negated").select("path", "folder", "n")


# sinks


@query(f"""WITH RECURSIVE {GEO_SQL}, p AS (SELECT node, string_agg(ancestor, '/' ORDER BY distance DESC) || '/' || node AS id, count(*) + 1 AS depth FROM c GROUP BY node UNION ALL SELECT node_id, node_id, 1 FROM g WHERE parent IS NULL),
o AS (SELECT id, name, depth, CASE depth WHEN 3 THEN 'file' ELSE 'folder' END AS node_type, lag(depth) OVER (ORDER BY string_split(id, '/')) AS prev FROM p JOIN g ON g.node_id = p.node)
SELECT CASE WHEN prev IS NULL OR prev < depth THEN '' ELSE repeat(']}}', CAST(prev - depth + 1 AS INT)) || ',' END || '{{"node_id":"' || id || '","node_type":"' || node_type || '","name":"' || name || '", "children": [' AS line FROM o""")
def tree_json_lines(spark, sf):
    """Regions, nations and suppliers as one nested JSON text, written by the tasks and read back line by line."""
    from scopelake import sinks

    n = geo_nodes(spark, sf)
    up = tree.fixed_closure(n.select(F.col("node_id").alias("node"), "parent"), 3)
    above = up.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor"))).alias("a"))
    j = n.join(above.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("a", F.coalesce(F.transform("a", lambda x: x["ancestor"]), F.array().cast("array<string>")))
    named = j.select(F.array_join(F.concat("a", F.array("node_id")), "/").alias("id"), (F.size("a") + 1).alias("depth"), "name")
    nodes = named.select(F.col("id").alias("node_id"), F.when(F.col("depth") == 3, "file").otherwise("folder").alias("node_type"), "name", "depth")
    folder = new_folder(spark, "tree")
    sinks.write_tree(nodes, folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


# sections and notebooks


def as_markdown(line: Column) -> Column:
    """A document's line as a line of Markdown: by its length a heading, a fence, or text."""
    n = F.length(line) % 9
    return F.when(n.between(1, 6), F.concat(F.repeat(F.lit("#"), n), F.lit(" "), line)).when(n == 8, F.concat(F.lit("```"))).otherwise(line)


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line, len(l) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
k AS (SELECT *, length(line) % 9 AS level FROM l), f AS (SELECT *, count(*) FILTER (level = 8) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM k),
h AS (SELECT * FROM f WHERE level BETWEEN 1 AND 6 AND fences % 2 = 0)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(level AS INT) AS level,
  CAST(coalesce((SELECT min(x.line_no) FROM h x WHERE x.doc_id = h.doc_id AND x.line_no > h.line_no AND x.level <= h.level) - 1, n_lines) AS INT) AS end_line,
  CAST(coalesce((SELECT max(x.line_no) FROM h x WHERE x.doc_id = h.doc_id AND x.line_no < h.line_no AND x.level < h.level), 0) AS INT) AS parent FROM h""")
def heading_sections(spark, sf):
    """Documents as Markdown: every heading with the lines it holds and the heading above it."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ls = lines.exploded(d, "doc_id").withColumn("line", as_markdown(F.col("line")))
    n = d.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    return markdown.sections(markdown.headings(ls, "doc_id"), n, "doc_id").select("doc_id", "line_no", "level", "end_line", F.coalesce("parent", F.lit(0)).alias("parent"))


def conversation_notebooks(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, text: conversations as notebooks; sources are strings or lists of lines, some strings look like lists."""
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("[1, 2]\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    c = table(spark, sf, "conversations").withColumn("s", said)
    parts = F.split("s", "\n")
    ended = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    one = F.to_json(F.struct(F.col("role").alias("cell_type"), F.col("s").alias("source")))
    many = F.to_json(F.struct(F.col("role").alias("cell_type"), ended.alias("source"), F.array(F.lit("ignored")).alias("outputs")))
    cells = c.select("conv_id", F.struct("turn", F.when(F.col("turn") % 2 == 0, one).otherwise(many).alias("json")).alias("c"))
    g = cells.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return g.select("conv_id", F.concat(F.lit('{"cells": ['), F.array_join(F.transform("c", lambda x: x["json"]), ", "), F.lit('], "nbformat": 4}')).alias("text"))


NOTEBOOK_SQL = r"""
c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cell, CASE WHEN turn % 4 = 0 THEN '[1, 2]' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS s FROM conversations),
l AS (SELECT *, list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM c)"""


@query(f"""WITH {NOTEBOOK_SQL}, v AS (SELECT *, len(l) AS loc, coalesce(sum(len(l)) OVER (PARTITION BY conv_id ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT conv_id, CAST(cell AS INT) AS cell, '[' || role || '] cell ' || cell AS name, CAST(loc AS BIGINT) AS loc, CAST(before + 1 AS BIGINT) AS start_line, CAST(before + loc AS BIGINT) AS end_line FROM v WHERE loc > 0""")
def notebook_json_cells(spark, sf):
    return notebooks.notebook_cells(conversation_notebooks(spark, sf), "conv_id").drop("cell_type")


@query(f"""WITH {NOTEBOOK_SQL} SELECT conv_id, md5(coalesce(string_agg(array_to_string(l, chr(10)), chr(10) ORDER BY cell) FILTER (len(l) > 0), '')) AS text_md5 FROM l GROUP BY conv_id""")
def notebook_virtual_text(spark, sf):
    return conversation_notebooks(spark, sf).select("conv_id", F.md5(notebooks.virtual_text(F.col("text"))).alias("text_md5"))


# event time


@query("""WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half FROM events), e AS (SELECT event_id, ts, event_type, time_bucket(INTERVAL '1 hour', ts) AS start, ts < half AND event_id % 17 <> 0 AS first FROM events, m),
w AS (SELECT max(ts) FILTER (first) - INTERVAL '2 hours' AS mark FROM e), k AS (SELECT * FROM e, w WHERE first OR start + INTERVAL '1 hour' > mark)
SELECT epoch_us(start) AS start_us, event_type, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY ALL UNION ALL SELECT -1, 'dropped', CAST((SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS BIGINT)""")
def events_late_rows(spark, sf):
    """A stream in three runs from one checkpoint: the first half of the time, the rest with rows that come too late, and an end that closes all windows."""
    from scopelake.streaming import events

    e = table(spark, sf, "events")
    low, high = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    first = (F.unix_micros(F.col("ts").cast("timestamp")) < (low + high) / 2) & (F.col("event_id") % 17 != 0)
    top = new_folder(spark, "events")
    for part in (e.where(first), e.where(~first), events.closing_event(e)):
        part.coalesce(1).write.mode("append").parquet(f"{top}/in")
        events.closed_windows(spark, f"{top}/in", f"{top}/out", f"{top}/checkpoint")
    windows = spark.read.parquet(f"{top}/out")
    dropped = events.late_rows(e, windows).select(F.lit(-1).cast("long").alias("start_us"), F.lit("dropped").alias("event_type"), F.col("dropped").alias("n"))
    return windows.select(F.unix_micros("start").alias("start_us"), "event_type", "n").unionByName(dropped)


# distinct counts that merge


@query("""WITH e AS (SELECT p_type, p_brand, p_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT p_type AS path, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS exact, true AS within FROM e GROUP BY 1 UNION ALL SELECT p_type || '/' || p_brand, CAST(count(DISTINCT l_suppkey) AS BIGINT), true FROM e GROUP BY 1
UNION ALL SELECT p_type || '/' || p_brand || '/' || p_partkey, CAST(count(DISTINCT l_suppkey) AS BIGINT), true FROM e GROUP BY 1""")
def mergeable_fan_in(spark, sf):
    """Distinct suppliers of every part, brand and type: a sketch a part, merged upwards; whether it is within the stated error."""
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("target"), F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"))
    e = part_edges(spark, sf)
    about = deps.merged_fan_in(deps.fan_in_sketches(e).join(p, "target"), "path")
    exact = e.join(p, "target").select(F.explode(tree.prefixes(F.col("path"))).alias("path"), "source").groupBy("path").agg(F.count_distinct("source").alias("exact"))
    return about.join(exact, "path").select("path", "exact", (F.abs(F.col("fan_in") - F.col("exact")) <= F.ceil(F.col("exact") * deps.SKETCH_ERROR)).alias("within"))


# siblings with others in between, and what the views tell apart


@query("""WITH n AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'if_branch' WHEN 'click' THEN 'else_branch' WHEN 'purchase' THEN 'try' ELSE 'catch' END AS k FROM events),
x AS (SELECT *, lead(k) OVER w AS nk, lead(event_id) OVER w AS nx, first(CASE WHEN k = 'else_branch' THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ne FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id AS source, CASE k WHEN 'try' THEN nx ELSE ne END AS target FROM x WHERE (k = 'try' AND nk = 'catch') OR (k = 'if_branch' AND ne IS NOT NULL)""")
def branch_edges(spark, sf):
    """Every if-branch with the first later else-branch of its parent, whatever lies between; a try with a catch that follows it."""
    kind = F.when(F.col("event_type") == "view", "if_branch").when(F.col("event_type") == "click", "else_branch").when(F.col("event_type") == "purchase", "try").otherwise("catch")
    e = table(spark, sf, "events").withColumns({"kind": kind, "o": F.struct("ts", "event_id")})
    found = flow.sibling_edges(e, "user_id", "o", "kind", {"try": ["catch"]}, {"if_branch": "else_branch"})
    return found.select(F.col("source.event_id").alias("source"), F.col("target.event_id").alias("target"))


def closures(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as modules: a function in a function that reads names of every kind; the number of variables is the row's."""
    t = table(spark, sf, "supplier")
    n, key = F.col("s_suppkey") % 5 + 1, F.col("s_suppkey").cast("string")
    own = joined(n, lambda i: F.concat(F.lit("a"), i.cast("string"), F.lit(" = p + top")), ", ")
    parts = ['import { join as j } from "path";\nimport { b } from "./b";\nconst top = 1;\nfunction outer', key, "(p) {\n  const ", own, ";\n  function inner(q) {\n    console.log(a0);\n    return ", joined(n, numbered("a"), " + "), ' + p + q + top + j("x") + b + gone;\n  }\n  return inner(top);\n}\n']
    return made_files(t, F.concat(key, F.lit(".ts")), *parts)


@query("""WITH f AS (SELECT s_suppkey::VARCHAR || '.ts' AS path, s_suppkey % 5 + 1 AS n FROM supplier), c AS (SELECT * FROM (VALUES ('builtin', 0, 1), ('capture', 1, 1), ('param', 0, 2), ('module', 0, 1), ('importExternal', 0, 1), ('importInternal', 0, 1), ('unresolved', 0, 1)) t(category, each, more))
SELECT path, category, CAST(each * n + more AS BIGINT) AS n FROM f, c""")
def overlay_categories(spark, sf):
    """Tokens of the inner function by where their names come from: every category but local."""
    from scopelake.sources.flow import overlay

    return overlay(closures(spark, sf), (7, 8)).groupBy("path", "category").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT s_suppkey::VARCHAR || '.ts' AS path, s_suppkey, list_transform(range(s_suppkey % 5 + 1), lambda i: 'a' || i) AS a FROM supplier)
SELECT path, 'global@1' AS name, 'outer' || s_suppkey || ',top' AS declared, '' AS captured FROM f UNION ALL SELECT path, 'outer' || s_suppkey, array_to_string(a, ',') || ',inner,p', '' FROM f
UNION ALL SELECT path, 'inner', 'q', array_to_string(a, ',') || ',p' FROM f""")
def scope_captures(spark, sf):
    """Names that each scope declares and captures: the inner function captures the outer one's."""
    from scopelake.sources.flow import scope_graph

    return scope_graph(closures(spark, sf)).select("path", "name", F.array_join("declared", ",").alias("declared"), F.array_join("captured", ",").alias("captured"))


@query("""WITH f AS (SELECT s_suppkey::VARCHAR || '.ts' AS path, s_suppkey % 4 AS n, s_nationkey % 3 AS m FROM supplier)
SELECT path, 'if_branch' AS source, 'else_branch' AS target, CAST(n AS BIGINT) AS n FROM f WHERE n > 0 UNION ALL SELECT path, 'try', 'catch', CAST(m AS BIGINT) FROM f WHERE m > 0 UNION ALL SELECT path, 'catch', 'finally', CAST(m AS BIGINT) FROM f WHERE m > 0""")
def control_flow_edges(spark, sf):
    """Modules with as many branches and handlers as the row says: edges between siblings."""
    from scopelake.sources.flow import data_flow

    t = table(spark, sf, "supplier")
    n, m, key = (F.col("s_suppkey") % 4).cast("int"), (F.col("s_nationkey") % 3).cast("int"), F.col("s_suppkey").cast("string")
    f = made_files(t, F.concat(key, F.lit(".ts")), F.repeat(F.lit("if (x) { c(); } else { d(); }\n"), n), F.repeat(F.lit("try { a(); } catch (e) { b(); } finally { c(); }\n"), m), "const y = 1;\n")
    nodes, edges = data_flow(f)
    kinds = nodes.select("id", "type")
    e = edges.where("type = 'control-flow'").select("path", F.col("source").alias("s"), F.col("target").alias("t"))
    e = e.join(kinds.select(F.col("id").alias("s"), F.col("type").alias("source")), "s").join(kinds.select(F.col("id").alias("t"), F.col("type").alias("target")), "t")
    return e.groupBy("path", "source", "target").agg(F.count("*").alias("n"))


# subtrees, summaries and configurations

INSIDE_SQL = SCORE_SQL.replace(FILES_SQL, f"SELECT * FROM ({FILES_SQL}) WHERE starts_with(path, 'src1/')")


@query(f"WITH {INSIDE_SQL} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 25")
def subtree_hotspots(spark, sf):
    """One folder explained: scored against its own maxima."""
    f = written(files(spark, sf).where(F.col("path").startswith("src1/")), "file-metrics")
    s = rank.with_score(f, WEIGHTS).withColumn("score", F.round("raw_score", 4))
    return rank.top_ranked(s, 25, "doc_id").select("doc_id", "score", "rank")


@query(f"""WITH {SCORE_SQL}, n AS (SELECT path AS node_id, regexp_extract(path, '^(.*)/', 1) AS parent, 3 AS depth, loc, score FROM f LEFT JOIN s USING (path, loc)
UNION ALL SELECT regexp_extract(path, '^[^/]*/[^/]*'), regexp_extract(path, '^[^/]*'), 2, CAST(sum(loc) AS BIGINT), 0 FROM f GROUP BY ALL UNION ALL SELECT regexp_extract(path, '^[^/]*'), NULL, 1, CAST(sum(loc) AS BIGINT), 0 FROM f GROUP BY ALL),
k AS (SELECT node_id, parent, depth, loc, coalesce(score, 0) AS score FROM n QUALIFY row_number() OVER (PARTITION BY parent ORDER BY coalesce(score, 0) DESC, loc DESC, node_id) <= 3),
a AS (SELECT * FROM k WHERE depth = 1), b AS (SELECT * FROM k WHERE depth = 2 AND parent IN (SELECT node_id FROM a)), c AS (SELECT * FROM k WHERE depth = 3 AND parent IN (SELECT node_id FROM b))
SELECT node_id, CAST(depth AS INT) AS depth, loc, CAST(score AS DOUBLE) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def tree_summary_rows(spark, sf):
    """Three levels, the first three children of each node that stays, by score, then size; folders have no score."""
    s = written(scored(spark, sf, stored=True).select(F.col("path").alias("node_id"), "score"), "scores")
    f = files(spark, sf).select("path", "loc")
    nodes = f.unionByName(tree.rollup(f, ["loc"], [])).select(F.col("path").alias("node_id"), tree.parent_path(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), "loc")
    kept = tree.summary(tree.with_scores(nodes, s), 3, 3, F.desc("score"), F.desc("loc"), F.asc("node_id"))
    return kept.select("node_id", "depth", "loc", "score")


@query("""SELECT concat(source, '/', lang, '/', doc_id) AS path, CASE WHEN lang = 'en' THEN source || '/en' WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN source ELSE '' END AS folder FROM documents""")
def nearest_configuration(spark, sf):
    """Of configurations at the top, in every second source and in every English folder the nearest above each file."""
    d = table(spark, sf, "documents")
    own = d.where("lang = 'en'").select(F.concat_ws("/", "source", "lang").alias("folder"))
    even = d.where(F.substring("source", 4, 9).cast("int") % 2 == 0).select(F.col("source").alias("folder"))
    top = d.select(F.lit("").alias("folder")).limit(1)
    return tree.nearest_holder(d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")), own.unionByName(even).unionByName(top))


@query("""SELECT n_regionkey AS region, '.' AS base, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS ord, '@' || n_name || '/*' AS pattern,
CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey || '/*' ELSE 'n' || n_nationkey || '/*,//other/*' END AS targets FROM nation""")
def configuration_aliases(spark, sf):
    """Regions as configuration texts with comments and trailing commas, an alias for each nation, to one folder or two."""
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    to = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('"n'), key, F.lit('/*"'))).otherwise(F.concat(F.lit('["n'), key, F.lit('/*", "//other/*", ]')))
    one = F.concat(F.lit('"@'), "n_name", F.lit('/*": '), to)
    texts = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", one.alias("t")))), lambda x: x["t"]), ", // next\n").alias("t"))
    made = texts.select("region", F.concat(F.lit('{ /* aliases */ "compilerOptions": {"baseUrl": ".", "paths": {'), "t", F.lit(",}, }, }")).alias("text"))
    return deps.alias_rows(made, "region").withColumn("targets", F.array_join("targets", ","))


CODES_SQL = """WITH RECURSIVE l AS (SELECT n_name AS label FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT p_type FROM part),
w AS (SELECT label, row_number() OVER (ORDER BY label) AS ord, upper(array_to_string(regexp_extract_all(label, '([A-Z]?[a-z0-9]+|[A-Z]+)'), '')) AS flat, regexp_extract_all(label, '([A-Z]?[a-z0-9]+|[A-Z]+)') AS words FROM l),
c AS (SELECT label, ord, list_filter(list_concat([upper(coalesce(words[1][1], '') || coalesce(words[2][1], ''))], list_transform(range(2, greatest(length(flat), 2) + 1), lambda i: flat[1] || flat[i])), lambda x: length(x) = 2) AS wanted FROM w),
r AS (SELECT 0 AS ord, NULL::VARCHAR AS label, NULL::VARCHAR AS code, []::VARCHAR[] AS taken UNION ALL
  SELECT o, label, code, list_append(taken, code) FROM (SELECT c.ord AS o, c.label, r.taken, list_filter(list_concat(c.wanted, list_transform(range(1, 100), lambda i: upper(c.label[1]) || i)), lambda x: NOT list_contains(r.taken, x))[1] AS code FROM r JOIN c ON c.ord = r.ord + 1))
SELECT label, code FROM r WHERE label IS NOT NULL"""


@query(CODES_SQL)
def unique_codes(spark, sf):
    """Names of nations, regions, segments and types, each with a two-letter code of its own."""
    names = [table(spark, sf, t).select(F.col(c).alias("label")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("part", "p_type"))]
    every = names[0].union(names[1]).union(names[2]).union(names[3]).distinct()
    ranked = rank.all_ranked(every.withColumn("one", F.lit(1)), "label", by="one")
    return deps.assigned_codes(ranked.select("label", F.col("rank").alias("ord"), deps.codes(F.col("label")).alias("wanted")))
