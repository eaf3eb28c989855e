"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that is not ASCII white space.
INK = r"[^\x20\x09-\x0D]"
#: Line ends of source files.
LINE_END = "\r\n|\n|\r"
DATA_URL = r"""(data:[^\s\)\]">]*)"""


def lines(text: Column) -> Column:
    """Lines of a source text; a final newline starts no line."""
    found = F.split(text, LINE_END)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def has_ink(line: Column) -> Column:
    return line.rlike(INK)


def loc(text: Column) -> Column:
    """Lines with anything but white space."""
    return F.size(F.filter(F.split(text, "\n"), has_ink)).cast("long")


def suffix(name: Column) -> Column:
    """Last suffix in lower case with its dot, null without one."""
    s = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    return F.when(s != "", F.lower(s))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_of_scope(path: Column) -> Column:
    """The file part of a scope path ``file::scope::scope``."""
    return F.substring_index(path, "::", 1)


def language(path: Column) -> Column:
    """Language by suffix; anything unknown is plain text."""
    by = {"typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "javascript": ["js", "mjs", "cjs"], "jsx": ["jsx"], "css": ["css"], "scss": ["scss"], "markdown": ["md", "markdown"], "python": ["py"], "json": ["json", "ipynb"], "html": ["html"]}
    s, out = suffix(path), None
    for name, ends in by.items():
        is_it = s.isin(*["." + e for e in ends])
        out = F.when(is_it, name) if out is None else out.when(is_it, name)
    return out.otherwise("text")


def truncated(text: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit(mark))).otherwise(text)


def scope_header(text: Column, most: int = 80) -> Column:
    """First line with ink up to a brace, spaces collapsed, truncated."""
    first = F.coalesce(F.get(F.filter(F.split(text, "\n"), has_ink), F.lit(0)), F.lit(""))
    return truncated(F.trim(F.regexp_replace(F.substring_index(first, "{", 1), r"[ \t]+", " ")), most)


def data_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATA_URL), F.lit(1))


def mime_label(url: Column) -> Column:
    """Between the first colon and the first comma."""
    return F.substring_index(F.regexp_replace(url, "^[^:]*:", ""), ",", 1)


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset in code points."""
    return F.regexp_count(F.substr(text, F.lit(1), offset), F.lit("\n")) + 1


#: A string (first group, kept) or a comment of JSON with comments.
COMMENT = r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/'


def without_comments(jsonc: Column) -> Column:
    """JSON with // and /* */ comments taken out; strings stay as they are."""
    return F.regexp_replace(jsonc, COMMENT, "$1")


def percent_g(x: Column) -> Column:
    """A number in C's %g for metrics: whole numbers without a point, else up to six digits."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.6g", x), r"\.?0+$", ""))


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(F.format_number(n / 1024 / 1024, 1), F.lit(" MB")))
    )


def location(path: Column, start: Column, end: Column) -> Column:
    known = (F.coalesce(start, F.lit(0)) > 0) & (F.coalesce(end, F.lit(0)) > 0)
    return F.when(known, F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(path)


def path_filter(prefix: str) -> str:
    """A prefix in normal form: folders end in a slash, files do not."""
    p = prefix.strip().replace("\\", "/").strip("/")
    return p + "/" if p and "." not in p.rsplit("/", 1)[-1].lstrip(".") else p


def collapsed_path(path: Column) -> Column:
    """A path with ``.`` and ``..`` resolved; ``..`` at the top is dropped."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))),
    )
    return F.array_join(folded, "/")


def label_of_path(path: Column) -> Column:
    """File name; index files and [parameter] names are shown with their folder."""
    name, parent = base_name(path), F.element_at(F.split(path, "/"), -2)
    odd = name.rlike(r"^index\.[^/]*$") | name.rlike(r"^\[.*\]")
    return F.when(odd & (F.size(F.split(path, "/")) > 1), F.concat(parent, F.lit("/"), name)).otherwise(name)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
