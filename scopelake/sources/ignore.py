"""Ignore files as a table of patterns, and paths matched against it by joins.

Most patterns name a path, a name below a folder, or a suffix below a folder: these meet
paths by equal keys (the path's folders, its names, its suffixes).  Globs are tried as
regular expressions only on paths that share what they spell out: the beginning of a name
below a folder, or the folders that the pattern begins with.  The last pattern
that matches decides, an aggregate.  The plan is the same for one pattern or a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelake.functions.storage import written
from scopelake.operators.tree import prefixes
from scopelake.sources.trees import pattern_regex, translated

PATTERNS = "folder string, n long, negated boolean, kind string, at string, key string, only_dirs boolean, regex string"
#: Globs up to whose number they are broadcast: some megabytes, as lines of ignore files.
FEW_GLOBS = 10_000
#: Characters of a name's beginning that globs are looked up by.
HEAD = 12
#: Bits of the filter of patterns' keys (8 MB when broadcast, however many patterns there are), and of a row of it.
FILTER_BITS, BLOCK_BITS = 1 << 26, 1 << 15
_WILD = set("*?[\\")


def spelled(pattern: str) -> str:
    """What stands before a pattern's first sign."""
    return pattern[: min((pattern.index(c) for c in _WILD if c in pattern), default=len(pattern))]


def parts_of(line: str, folder: str) -> tuple | None:
    """(negated, kind, at, key, only_dirs, regex) of a line of the ignore file in a folder; None for blanks and comments.

    kind: ``path`` (key is the path), ``name`` and ``suffix`` (key below the folder ``at``), ``head`` (regex on names
    below ``at`` that begin with key), ``glob`` (regex on paths below ``at``).
    """
    p = translated(line, folder)
    if not p:
        return None
    body = p.removeprefix("!")
    regex, b = pattern_regex(body), body.rstrip()
    only_dirs, b = b.endswith("/"), b.strip("/")
    below = f"{folder}/**/" if folder else "**/"
    rest = b.removeprefix(below) if b.startswith(below) else b
    plain_folder = not _WILD & set(folder)
    kind, at, key = "glob", folder, ""
    if rest != b and "/" not in rest and plain_folder and not _WILD & set(rest):
        kind, key = "name", rest
    elif rest != b and "/" not in rest and plain_folder and rest.startswith("*.") and not _WILD & set(rest[1:]):
        kind, key = "suffix", rest[1:]
    elif rest == b and not _WILD & set(b):
        kind, key = "path", b
    elif rest != b and "/" not in rest and plain_folder and rest[0] not in _WILD:
        kind, key = "head", spelled(rest)[:HEAD]
    elif rest == b and not b.startswith("**"):
        at = spelled(b).rpartition("/")[0]
    elif not plain_folder:
        at = ""  # the folder's own signs are read as a pattern too
    return p.startswith("!"), kind, at, key, only_dirs, regex


def patterns(lines: DataFrame) -> DataFrame:
    """Pattern rows of the lines (folder, n, line) of ignore files."""
    names = [c.split()[0] for c in PATTERNS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for folder, n, line in zip(*(b.column(c).to_pylist() for c in ("folder", "n", "line")), strict=True):
                found = parts_of(line or "", folder)
                if found:
                    rows.append((folder, n, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return lines.select("folder", F.col("n").cast("long").alias("n"), "line").mapInArrow(run, PATTERNS)


def ignore_lines(files: DataFrame) -> DataFrame:
    """folder, n, line of ignore files (path, content)."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return files.where("content IS NOT NULL").select(folder.alias("folder"), F.posexplode(F.split("content", "\r\n|\n|\r")).alias("n", "line"))


def suffixes(name: Column) -> Column:
    """Every suffix of a name that starts with a full stop."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, 1000), ".")))


def distinct_patterns(table: DataFrame) -> DataFrame:
    """Of patterns that match the same paths the last one: no other can decide.

    Lines repeat in the ignore files of a tree, so without this every path met all copies of a line.
    Paths are met below the root (``at`` is '') wherever their ignore file lies.
    """
    at = F.when(F.col("kind") == "path", "").otherwise(F.col("at")).alias("at")
    regex = F.when(F.col("kind").isin("head", "glob"), F.col("regex")).alias("regex")
    last = F.max(F.struct("folder", "n", "negated"))
    return table.groupBy("kind", at, "key", "only_dirs", regex).agg(last.alias("by"))


def key_bits(keyed: DataFrame) -> DataFrame:
    """block, words: a bit for the hash of every (kind, at, key) of patterns and every ('at', at); FILTER_BITS / 8 bytes at most."""
    h = _hashed("kind", "at", "key")
    own = keyed.select(h.alias("h")).unionByName(keyed.select(_hashed(F.lit("at"), F.col("at"), F.lit("")).alias("h")))
    words = own.groupBy(F.expr(f"h div {BLOCK_BITS}").alias("block"), F.expr(f"h % {BLOCK_BITS} div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("bits"))
    blocks = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BLOCK_BITS // 64 - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return blocks.select("block", every.alias("words"))


def _hashed(*key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))


def maybe_held(rows: DataFrame, bits: DataFrame, *key: Column) -> DataFrame:
    """rows less those whose (kind, at, key) no pattern has; a few others stay until they are joined."""
    rows = rows.withColumn("_h", _hashed(*key))
    block, bit = F.expr(f"_h div {BLOCK_BITS}"), F.expr(f"get(words, CAST(_h % {BLOCK_BITS} div 64 AS INT)) & shiftleft(1L, CAST(_h % 64 AS INT))")
    return rows.join(F.broadcast(bits), (block == F.col("block")) & (bit != 0)).drop("_h", "block", "words")


def deciding(paths: DataFrame, table: DataFrame) -> DataFrame:
    """path, folder, n, negated: of each path that any pattern matches the last one that does.

    A path has many keys by which a pattern could meet it and few by which one does, so keys pass
    a broadcast bit filter of fixed size in the tasks, and only what it leaves is joined.
    """
    every = distinct_patterns(table)
    own = paths.select("path")
    up = own.select("path", F.explode(prefixes(F.col("path"))).alias("prefix"))
    fits = ~F.col("only_dirs") | (F.col("prefix") != F.col("path"))
    # prefixes and names below each folder that has patterns for them, the root ('') included, with all keys they can be met by
    above = lambda p: F.array_distinct(F.concat(F.array(F.lit("")), prefixes(p, proper=True)))
    keyed = every.where("kind <> 'glob'")
    bits = key_bits(keyed)
    lengths = sorted(r[0] for r in table.where("kind = 'head'").select(F.length("key")).distinct().collect())  # HEAD at most
    at, name = F.col("at"), F.col("name")
    names = maybe_held(up.withColumn("at", F.explode(above(F.col("prefix")))), bits, F.lit("at"), at, F.lit("")).withColumn("name", F.substring_index("prefix", "/", -1))
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    none = F.array(key("name", F.lit(None).cast("string")))
    ends = F.when(name.contains("."), F.transform(suffixes(name), lambda k: key("suffix", k)))
    begins = [F.when(F.length("name") >= n, key("head", F.substring("name", 1, n))) for n in lengths]
    keys = F.array_compact(F.concat(F.array(key("name", name), F.when(at == "", key("path", F.col("prefix"))), *begins), F.coalesce(ends, none)))
    met = maybe_held(names.select("path", "prefix", "at", F.explode(keys).alias("k")).select("path", "prefix", "at", "k.*"), bits, F.col("kind"), at, F.col("key"))
    met = met.join(keyed, ["at", "kind", "key"]).where(F.when(F.col("kind") == "head", F.expr("path RLIKE regex")).otherwise(fits)).select("path", "by")
    globs = every.where("kind = 'glob'").select("at", "by", "regex")
    globs = F.broadcast(globs) if globs.limit(FEW_GLOBS + 1).count() <= FEW_GLOBS else globs
    by_glob = own.select("path", F.explode(above(F.col("path"))).alias("at")).join(globs, "at").where(F.expr("path RLIKE regex")).select("path", "by")
    return met.unionByName(by_glob).groupBy("path").agg(F.max("by").alias("by")).select("path", "by.*")


def ignored(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """path of those that the last pattern that matches them ignores."""
    return deciding(paths, written(patterns(lines), "patterns")).where("NOT negated").select("path")
