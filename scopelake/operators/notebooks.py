"""Cells of notebooks from their JSON text, without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopelake.functions.text import has_ink
from scopelake.operators.lines import virtual_lines

# Fixed value: where a line ends.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def source_text(source: Column) -> Column:
    """The text of a cell's source (variant): a list of strings end to end, or the string itself."""
    is_list = F.coalesce(F.schema_of_variant(source).startswith("ARRAY"), F.lit(False))
    joined = F.array_join(F.coalesce(F.try_variant_get(source, "$", "array<string>"), F.array().cast("array<string>")), "")
    return F.coalesce(F.when(is_list, joined).otherwise(F.try_variant_get(source, "$", "string")), F.lit(""))


def cell_array(text: Column) -> Column:
    """Cells (cell_type, lines with ink) of a notebook in order; null where the text is no JSON."""
    cells = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$.cells", "array<variant>"), F.array().cast("array<variant>"))

    def cell(c: Column) -> Column:
        kind = F.coalesce(F.try_variant_get(c, "$.cell_type", "string"), F.lit("cell"))
        lines = F.filter(F.split(source_text(F.try_variant_get(c, "$.source", "variant")), LINE_ENDS), has_ink)
        return F.struct(kind.alias("cell_type"), lines.alias("lines"))

    return F.when(F.try_parse_json(text).isNotNull(), F.transform(cells, cell))


def notebook_cells(notebooks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, cell (from 1), name, cell_type, loc, start_line, end_line of cells with ink, laid end to end."""
    c = notebooks.select(key, F.posexplode(cell_array(F.col(text))).alias("_i", "c"))
    c = c.select(key, (F.col("_i") + 1).alias("cell"), F.col("c.cell_type").alias("cell_type"), F.size("c.lines").cast("long").alias("loc")).where("loc > 0")
    v = virtual_lines(c, key, "cell", "loc")
    return v.select(key, "cell", F.concat(F.lit("["), "cell_type", F.lit("] cell "), F.col("cell").cast("string")).alias("name"), "cell_type", "loc", "start_line", "end_line")


def virtual_text(text: Column) -> Column:
    """The lines with ink of all cells, as the lines that notebook_cells counts."""
    return F.array_join(F.flatten(F.transform(cell_array(text), lambda c: c["lines"])), "\n")
