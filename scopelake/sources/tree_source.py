"""A source tree as a data source: ``spark.read.format("source_tree").option("root", ...)``.

Folders are split level by level until there are about as many as tasks; each task then
walks some of them and streams their entries in batches.  Pruned folders are never
listed, neither in the split nor in a walk, and filters on ``path`` (equal, one of,
starts with) prune further.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from scopelake.sources import trees

NAME = "source_tree"
#: Entries of a batch.
BATCH = 10_000


@dataclass
class Folders(InputPartition):
    """Folders of one task: (path below the root, whether folders inside are walked too)."""

    items: list[tuple[str, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.dot_dirs, self.tasks = options["root"], options.get("dot_dirs", "true") == "true", int(options.get("tasks", "64"))
        #: Of every filter on the path: what a path must equal, or start with.
        self.wanted: list[tuple[list[str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters prune folders; Spark applies them to the entries."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, EqualTo):
                    self.wanted.append(([f.value], False))
                elif isinstance(f, In):
                    self.wanted.append((list(f.value), False))
                elif isinstance(f, StringStartsWith):
                    self.wanted.append(([f.value], True))
            yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether a path that all filters take can lie below the folder."""
        below = f"{folder}/" if folder else ""
        return all(any(v.startswith(below) or prefix and below.startswith(v) for v in values if isinstance(v, str)) for values, prefix in self.wanted)

    def _list(self, fs, top: str, folder: str) -> tuple[list, list[str]]:
        """(files, paths of the folders that are walked) of a folder."""
        files, folders = [], []
        for e in trees._entries(fs, f"{top}/{folder}".rstrip("/")):
            path = f"{folder}/{e.base_name}" if folder else e.base_name
            if e.is_file:
                files.append((path, e.size, e.mtime_ns / 1e9 if e.mtime_ns else 0.0))
            elif trees.keeps_dir(e.base_name, self.dot_dirs) and self._may_hold(path):
                folders.append(path)
        return files, folders

    def partitions(self) -> list[InputPartition]:
        fs, top = trees.file_system(self.root)
        items: list[tuple[str, bool]] = []
        level = [""]
        # a folder that is listed here is one item, for its own files; those of the next level come on top
        while level and len(items) + len(level) < self.tasks:
            items += [(f, False) for f in level]
            level = [x for f in level for x in self._list(fs, top, f)[1]]
        items += [(f, True) for f in level]
        n = max(1, min(self.tasks, len(items)))
        return [Folders(items[k::n]) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        fs, top = trees.file_system(self.root)
        rows: list[tuple[str, int, float]] = []

        def batch() -> pa.RecordBatch:
            kinds = pa.string(), pa.int64(), pa.float64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "file_size", "last_modified"])

        waiting = list(reversed(partition.items))
        while waiting:
            folder, deep = waiting.pop()
            files, folders = self._list(fs, top, folder)
            waiting += [(f, True) for f in reversed(folders)] if deep else []
            for f in files:
                rows.append(f)
                if len(rows) >= BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return trees.LISTING

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, root: str, dot_dirs: bool = True, tasks: int | None = None) -> DataFrame:
    """path, file_size, last_modified of every file outside pruned folders, in up to ``tasks`` tasks (four a core)."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    n = tasks or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(NAME).option("root", root).option("dot_dirs", str(dot_dirs).lower()).option("tasks", str(n)).load()
