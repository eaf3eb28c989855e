"""Incremental maintenance of a file table and of its roll-up up the folders.

A new listing is compared with a manifest by a full outer join; only files that are new,
or whose content differs, are measured again.  Folder sums change by the difference of
their files' rows.  A maximum cannot be taken back, so each folder also keeps the maximum
of its own files: those of folders with a changed file are taken anew from that folder's
files, and the maxima of folders above them from the folder rows below - never from the
files of untouched folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelake.operators.tree import parent_path, prefixes


def statuses(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """path, status, file_size, last_modified, content_hash, version of every path of either side.

    manifest: path, file_size, last_modified, content_hash, version; listing: path,
    file_size, last_modified.  ``same`` has size and time as before, ``unsure`` differs in
    one of them (its content decides), ``added`` and ``removed`` are on one side only.
    Size and time are those of the listing, hash and version those of the manifest.
    """
    m = manifest.select("path", F.col("file_size").alias("_size"), F.col("last_modified").alias("_time"), "content_hash", "version", F.lit(True).alias("_old"))
    n = listing.select("path", "file_size", "last_modified", F.lit(True).alias("_new"))
    same = F.col("_size").eqNullSafe(F.col("file_size")) & F.col("_time").eqNullSafe(F.col("last_modified"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "same").otherwise("unsure")
    return m.join(n, "path", "full_outer").select("path", status.alias("status"), "file_size", "last_modified", "content_hash", "version")


def settled(compared: DataFrame, hashes: DataFrame) -> DataFrame:
    """statuses() with ``unsure`` decided by hashes (path, new_hash): ``touched`` (same content) or ``changed``.

    content_hash is the new one where the content was read.
    """
    j = compared.join(hashes, "path", "left")
    unsure = F.when(F.col("new_hash").eqNullSafe(F.col("content_hash")), "touched").otherwise("changed")
    status = F.when(F.col("status") == "unsure", unsure).otherwise(F.col("status"))
    return j.select("path", status.alias("status"), "file_size", "last_modified", F.coalesce("new_hash", "content_hash").alias("content_hash"), "version")


def new_manifest(decided: DataFrame, version: int) -> DataFrame:
    """The manifest after a refresh: files measured now carry its version, the others the one they had."""
    measured = F.col("status").isin("added", "changed")
    return decided.where("status <> 'removed'").select("path", "file_size", "last_modified", "content_hash", F.when(measured, F.lit(version)).otherwise(F.col("version")).alias("version"))


def own_folder(path: Column) -> Column:
    return F.coalesce(parent_path(path), F.lit(""))


def _own(m: str) -> str:
    return f"own_{m}"


def folder_table(rows: DataFrame, sums: list[str], maxima: list[str]) -> DataFrame:
    """Folder rows from scratch: path ('' is the top), sums, maxima, and own_ maxima (of the folder's own files)."""
    every = lambda p: F.array_distinct(F.concat(F.array(F.lit("")), prefixes(p, proper=True)))
    up = rows.select(F.explode(every(F.col("path"))).alias("folder"), own_folder(F.col("path")).alias("_at"), *sums, *maxima)
    own = [F.max(F.when(F.col("_at") == F.col("folder"), F.col(m))).alias(_own(m)) for m in maxima]
    return up.groupBy(F.col("folder").alias("path")).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(m).alias(m) for m in maxima], *own)


def refreshed_folders(folders: DataFrame, gone: DataFrame, fresh: DataFrame, rows: DataFrame, sums: list[str], maxima: list[str], count: str = "file_count") -> DataFrame:
    """folder_table() of rows, from the folder table before.

    gone and fresh are the file rows that a refresh took out and put in, rows all of them
    after it.  ``count`` is the sum that says how many files a folder holds; folders
    without any go.
    """
    zero = lambda c, sign: (F.col(c) * sign).alias(c)
    moved = gone.select("path", *[zero(c, -1) for c in sums]).unionByName(fresh.select("path", *[zero(c, 1) for c in sums]))
    every = F.array_distinct(F.concat(F.array(F.lit("")), prefixes(F.col("path"), proper=True)))
    delta = moved.select(F.explode(every).alias("path"), own_folder(F.col("path")).alias("_at"), *sums)
    delta = delta.groupBy("path").agg(*[F.sum(c).alias(f"_{c}") for c in sums], F.max(F.col("_at") == F.col("path")).alias("_direct"))
    total = [(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_{c}"), F.lit(0))).cast(folders.schema[c].dataType).alias(c) for c in sums]
    held = folders.join(delta, "path", "full_outer")
    held = held.select("path", *total, *maxima, *map(_own, maxima), F.col("_direct").isNotNull().alias("_touched"), F.coalesce("_direct", F.lit(False)).alias("_direct")).where(F.col(count) > 0)
    # maxima of the own files of folders that hold a changed file
    direct = held.where("_direct").select("path")
    own = rows.select(own_folder(F.col("path")).alias("path"), *maxima).join(direct, "path", "left_semi").groupBy("path").agg(*[F.max(m).alias(f"_{m}") for m in maxima])
    held = held.join(own, "path", "left")
    held = held.select("path", *sums, *maxima, "_touched", *[F.when(F.col("_direct"), F.col(f"_{m}")).otherwise(F.col(_own(m))).alias(_own(m)) for m in maxima])
    # maxima of touched folders, from the own maxima of folders below
    above = F.array_distinct(F.concat(F.array(F.lit("")), prefixes(F.col("path"))))
    below = held.select(F.explode(above).alias("path"), *map(_own, maxima)).join(held.where("_touched").select("path"), "path", "left_semi")
    best = below.groupBy("path").agg(*[F.max(_own(m)).alias(f"_{m}") for m in maxima])
    return held.join(best, "path", "left").select("path", *sums, *[F.when(F.col("_touched"), F.col(f"_{m}")).otherwise(F.col(m)).alias(m) for m in maxima], *map(_own, maxima))
