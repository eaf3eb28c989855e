"""A kept analysis of a source tree: versions of a manifest, of folder rows, and segments of analyzed files.

    <folder>/rows/version=N/      analyzed files of version N only: what was new or changed then
    <folder>/manifest/version=N/  path, file_size, last_modified, content_hash, version of its rows
    <folder>/folders/version=N/   folder rows, written last: a version without them does not count

A refresh lists the tree, reads only files whose size or time differ, analyzes only those
whose content differs, and brings the folder rows up to date (``operators.incremental``).
A refresh that fails leaves the version before; the next one writes its number anew.
``compact`` brings the segments together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scopelake.operators import incremental
from scopelake.operators.tree import FOLDER_MAXIMA, FOLDER_SUMS, folder_metrics, with_length
from scopelake.sources import analyze, trees

MANIFEST = "path string, file_size long, last_modified double, content_hash long, version int"
#: Versions that stay readable; older manifests and folder rows are deleted.
KEPT = 2


class Cache:
    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")

    def version(self) -> int:
        """The last whole version, 0 without any."""
        return max(self._versions("folders"), default=0)

    def _versions(self, kind: str) -> list[int]:
        fs, top = trees.file_system(self.folder)
        from pyarrow import fs as pafs

        there = fs.get_file_info(pafs.FileSelector(f"{top}/{kind}", allow_not_found=True))
        whole = [e for e in there if e.base_name.startswith("version=") and fs.get_file_info(f"{e.path}/_SUCCESS").is_file]
        return sorted(int(e.base_name.partition("=")[2]) for e in whole)

    def _read(self, kind: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}/version={version}")

    def _write(self, df: DataFrame, kind: str, version: int) -> DataFrame:
        path = f"{self.folder}/{kind}/version={version}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def manifest(self) -> DataFrame:
        n = self.version()
        return self._read("manifest", n) if n else self.spark.createDataFrame([], MANIFEST)

    def rows(self, manifest: DataFrame | None = None) -> DataFrame:
        """The analyzed row of every file of the manifest."""
        return self._rows(self.manifest() if manifest is None else manifest, self.version())

    def _rows(self, manifest: DataFrame, most: int) -> DataFrame:
        n = [v for v in self._versions("rows") if v <= most]
        if not n:
            return self.spark.createDataFrame([], analyze.SCHEMA)
        every = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/version={v}" for v in n])
        return every.join(manifest.select("path", "version"), ["path", "version"], "left_semi").drop("version")

    def folders(self) -> DataFrame:
        """Folder rows as nodes() takes them."""
        return folder_metrics(self._read("folders", self.version()).where("path <> ''"))

    @staticmethod
    def measured(analyzed: DataFrame, manifest: DataFrame) -> DataFrame:
        """What rolls up, of files that could be read."""
        f = with_length(analyze.file_rows(analyzed, manifest.select("path", "file_size", "last_modified")))
        return f.select("path", *FOLDER_SUMS, *FOLDER_MAXIMA)

    def refresh(self, gitignore: bool = True) -> dict[str, int]:
        """Bring the analysis up to date; gives how many files have which status.  Without any difference nothing is written."""
        before, old = self.version(), self.manifest()
        n = before + 1
        # the comparison and the hashes are read several times: small tables
        compared = self._write(incremental.statuses(old, trees.source_listing(self.spark, self.root, gitignore)), "compared", n)
        unsure = compared.where("status IN ('added', 'unsure')").select("path", "file_size", "last_modified")
        hashes = self._write(trees.with_content(self.spark, self.root, unsure).select("path", F.xxhash64(F.coalesce("content", F.lit(""))).alias("new_hash")), "hashes", n)
        decided = incremental.settled(compared, hashes).persist()
        counts = {r["status"]: r["count"] for r in decided.groupBy("status").count().collect()}
        if before and not set(counts) - {"same"}:
            decided.unpersist()
            return counts
        manifest = self._write(incremental.new_manifest(decided, n), "manifest", n)
        again = decided.where("status IN ('added', 'changed')").select("path", "file_size", "last_modified")
        content = trees.with_content(self.spark, self.root, again).persist()  # notebooks and other files are two readings
        fresh = self._write(analyze.analyze(content), "rows", n)
        content.unpersist()
        if not before:
            self._write(incremental.folder_table(self.measured(fresh, manifest), FOLDER_SUMS, FOLDER_MAXIMA), "folders", n)
        else:
            # files that were only touched have another time, which rolls up too
            moved = decided.where("status <> 'same'").select("path")
            past = self.measured(self._rows(old.join(moved, "path", "left_semi"), before), old)
            rows = self._rows(manifest, n)
            now = self.measured(rows, manifest)
            put = self.measured(self._rows(manifest.join(moved, "path", "left_semi"), n), manifest)
            self._write(incremental.refreshed_folders(self._read("folders", before), past, put, now, FOLDER_SUMS, FOLDER_MAXIMA), "folders", n)
        decided.unpersist()
        self._forget(n)
        return counts

    def compact(self) -> None:
        """All rows in one segment, as a version of its own; older segments go."""
        before = self.version()
        manifest, folders, n = self.manifest(), self._read("folders", before), before + 1
        self._write(self._rows(manifest, before), "rows", n)
        self._write(manifest.withColumn("version", F.lit(n)), "manifest", n)
        self._write(folders, "folders", n)
        self._forget(n, rows=True)

    def _forget(self, n: int, rows: bool = False) -> None:
        fs, top = trees.file_system(self.folder)
        from pyarrow import fs as pafs

        gone = [(kind, n - KEPT + 1) for kind in ("manifest", "folders")] + [("compared", n + 1), ("hashes", n + 1)] + [("rows", n)] * rows
        for kind, least in gone:
            for e in fs.get_file_info(pafs.FileSelector(f"{top}/{kind}", allow_not_found=True)):
                if e.base_name.startswith("version=") and int(e.base_name.partition("=")[2]) < least:
                    fs.delete_dir(e.path)
