"""What the analyzers give: one file row with its scopes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Scope:
    name: str
    origin_type: str
    complexity: float
    start_line: int
    end_line: int
    nloc: int = -1
    parameter_count: int = 0
    max_nesting_depth: int = 0
    comment_lines: int = 0
    todo_count: int = 0
    ts_type_interface_count: int = 0
    md_data_url_count: int = 0
    is_jsx: bool = False
    tsx_lines: tuple[int, int] | None = None
    tsx_root: str = ""
    span: tuple[int, int] = (0, 0)
    children: list[Scope] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.nloc < 0:
            self.nloc = self.end_line - self.start_line + 1

    def walk(self) -> Iterator[Scope]:
        yield self
        for c in self.children:
            yield from c.walk()


@dataclass
class FileRow:
    loc: int = 0
    complexity: float = 0.0
    function_count: int = 0
    comment_lines: int = 0
    comment_density: float = 0.0
    max_nesting_depth: int = 0
    average_function_length: float = 0.0
    parameter_count: int = 0
    todo_count: int = 0
    classes_count: int = 0
    tsx_nesting_depth: int = 0
    tsx_render_branching_count: int = 0
    tsx_react_use_effect_count: int = 0
    tsx_anonymous_handler_count: int = 0
    tsx_prop_count: int = 0
    ts_any_usage_count: int = 0
    ts_ignore_count: int = 0
    ts_import_coupling_count: int = 0
    tsx_hardcoded_string_volume: int = 0
    tsx_duplicated_string_count: int = 0
    ts_type_interface_count: int = 0
    ts_export_count: int = 0
    python_import_count: int = 0
    md_data_url_count: int = 0
    scopes: list[Scope] = field(default_factory=list)

    def finish(self) -> None:
        """Averages and counts over the top-level scopes, the one for imports included."""
        n = len(self.scopes)
        self.function_count = n
        self.complexity = sum(s.complexity for s in self.scopes) / n if n else 0.0
        self.average_function_length = sum(s.nloc for s in self.scopes) / n if n else 0.0
        self.parameter_count = sum(s.parameter_count for s in self.scopes)
        self.comment_density = self.comment_lines / self.loc if self.loc else 0.0


def inked_lines(text: str) -> int:
    return sum(1 for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip(" \t\f\v"))


def import_scope(spans: list[tuple[int, int]], lines: list[str]) -> Scope | None:
    """The ``(imports)`` scope: all import lines count; its range is the largest block.

    Spans with nothing but blank lines between them are one block; most lines wins, then
    the earliest.
    """
    if not spans:
        return None
    blocks: list[list[int]] = []
    for a, b in sorted(spans):
        if blocks and not any(x.strip() for x in lines[blocks[-1][1] : a - 1]):
            blocks[-1][1] = max(b, blocks[-1][1])
            blocks[-1][2] += b - a + 1
        else:
            blocks.append([a, b, b - a + 1])
    best = max(blocks, key=lambda x: (x[2], -x[0]))
    return Scope("(imports)", "imports", 0, best[0], best[1], nloc=sum(b - a + 1 for a, b in spans))
