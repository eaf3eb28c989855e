"""JSON files written from the tasks: trees and graphs of any size, no row on the driver.

A tree is written in document order.  Rows are range-sorted by their place; each line
opens a node and first closes what the line before left open, which takes its depth only:
the last depth of each partition goes on to the next, a row per partition.  A folder of
parts is the result; one after another, with the head and tail beside them, they are one
JSON text, and ``merged`` copies them into one file by blocks of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scopelake.functions.storage import written
from scopelake.sources.trees import file_system


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows sorted and written, with their partition _p and running number _i."""
    return written(rows.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "placed")


def _write(lines: DataFrame, folder: str, head: str, tail: str) -> None:
    """lines (_p, _i, line) as text, a part for each _p, its lines in order; head and tail in files of their own."""
    lines.repartition("_p").sortWithinPartitions("_p", "_i").select("_p", "line").write.mode("overwrite").partitionBy("_p").text(folder)
    fs, top = file_system(folder)
    for name, text in (("_head", head), ("_tail", tail)):
        with fs.open_output_stream(f"{top}/{name}", compression=None) as f:
            f.write(text.encode())


def _json(columns: list[str], schema) -> Column:
    """The row as JSON, nulls included; fractions to 4 places."""
    fields = [F.round(F.col(c), 4).alias(c) if schema[c].dataType.typeName() == "double" else F.col(c) for c in columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def tree_place() -> list[Column]:
    """The order of nodes in a document: folders and files by their path, then scopes as they were met, a body first in its scope."""
    inside = r"^(.*?)(?:::(\d+))?(::\(body\))?$"
    number = F.when(F.col("node_type").isin("function", "function_body"), F.regexp_extract("node_id", inside, 2).cast("long")).otherwise(-1)
    file = F.when(F.col("node_type").isin("function", "function_body"), F.regexp_extract("node_id", inside, 1)).otherwise(F.col("node_id"))
    return [F.split(file, "/").alias("_path"), number.alias("_number"), (F.col("node_type") == "function_body").alias("_body")]


def write_tree(nodes: DataFrame, folder: str, name: str = "tree") -> None:
    """nodes (node_id, node_type, depth, ...) as {name: [{..., "children": [...]}, ...]}; every ancestor of a node is among them."""
    columns = [c for c in nodes.columns if c != "depth"]
    line = _json(columns, nodes.schema)
    rows = nodes.select(*tree_place(), "depth", line.alias("_json"))
    placed = _placed(rows, [F.col("_path"), F.col("_number"), F.col("_body")]).select("_p", "_i", "depth", "_json")
    ends = placed.groupBy("_p").agg(F.max_by("depth", "_i").alias("_last"))  # a row per partition
    before = ends.select("_p", F.lag("_last").over(Window.orderBy("_p")).alias("_before"))
    w = Window.partitionBy("_p").orderBy("_i")
    d = placed.withColumn("_prev", F.lag("depth").over(w)).join(F.broadcast(before), "_p").withColumn("_prev", F.coalesce("_prev", "_before"))
    closing = F.repeat(F.lit("]}"), (F.col("_prev") - F.col("depth") + 1).cast("int"))
    lead = F.when(F.col("_prev").isNull(), "").when(F.col("_prev") < F.col("depth"), "").otherwise(F.concat(closing, F.lit(",")))
    opened = F.concat(F.expr("left(_json, length(_json) - 1)"), F.lit(', "children": ['))
    last = ends.orderBy(F.desc("_p")).first()
    _write(d.select("_p", "_i", F.concat(lead, opened).alias("line")), folder, f'{{"{name}": [', ("]}" * last["_last"] if last else "") + "]}\n")


def write_rows(rows: DataFrame, folder: str, head: str, tail: str, *order: str) -> None:
    """rows as a JSON array between head and tail, in order."""
    columns = rows.columns
    placed = _placed(rows.select(*order, _json(columns, rows.schema).alias("_json")), [F.col(c) for c in order]).select("_p", "_i", "_json")
    first = placed.agg(F.min("_i")).first()[0]
    comma = F.when(F.col("_i") == F.lit(first), "").otherwise(",")
    _write(placed.select("_p", "_i", F.concat(comma, "_json").alias("line")), folder, head, tail)


def parts(folder: str) -> list[str]:
    """The files of a written text in order."""
    fs, top = file_system(folder)
    from pyarrow import fs as pafs

    found = [e.path for e in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if e.is_file and "/_p=" in e.path and not e.base_name.startswith((".", "_"))]
    number = lambda p: int(p.rsplit("/_p=", 1)[1].partition("/")[0])
    return [f"{top}/_head", *sorted(found, key=lambda p: (number(p), p)), f"{top}/_tail"]


def blocks(folders: list[str], size: int = 1 << 20) -> Iterator[bytes]:
    """The parts of written texts one after another, a block at a time."""
    for folder in folders:
        fs, _ = file_system(folder)
        for part in parts(folder):
            with fs.open_input_stream(part, compression=None) as f:
                while raw := f.read(size):
                    yield raw


def merged(folders: list[str], target: str) -> int:
    """The parts of written texts in one file; gives its bytes."""
    fs, path = file_system(target)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:
        for raw in blocks(folders):
            out.write(raw)
            size += len(raw)
    return size
