"""Scopes of CSS and SCSS files, by matching braces."""

from __future__ import annotations

import re
from bisect import bisect_left

from scopelake.sources.analyzers.rows import FileRow, Scope, inked_lines

#: At-rules whose block holds no scope in plain CSS; SCSS adds its own that do.
_PIECE = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|\#\{[^}]*\}|url\([^)]*\)|[{};]""")


def header(raw: str, most: int = 80) -> str:
    """First line with ink, up to a brace, spaces collapsed, truncated."""
    first = next((x for x in raw.splitlines() if x.strip()), "")
    said = " ".join(first.split("{")[0].split())
    return said[: most - 1] + "…" if len(said) > most else said


def scan_css(text: str, path: str = "") -> FileRow:
    scss = path.endswith(".scss")
    f = FileRow(loc=inked_lines(text))
    stack: list[Scope] = []
    top: list[Scope] = []
    began = 0
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at) + 1
    for m in _PIECE.finditer(text):
        t = m[0]
        if t.startswith("//") and not scss:
            continue
        if t.startswith(("/*", "//")):
            f.comment_lines += t.count("\n") + 1
            f.todo_count += "TODO" in t or "FIXME" in t
            if not text[began : m.start()].strip():
                began = m.end()
        elif t == ";":
            began = m.end()
        elif t == "{":
            raw = text[began : m.start()]
            start = began + len(raw) - len(raw.lstrip())
            name = header(raw) or "{}"
            s = Scope(name, "scss_scope" if scss else "css_scope", 0, line(start), 0, nloc=0)
            (stack[-1].children if stack else top).append(s)
            stack.append(s)
            began = m.end()
        elif t == "}":
            if stack:
                s = stack.pop()
                s.end_line = line(m.start())
                s.nloc = s.end_line - s.start_line + 1
            began = m.end()
    for s in stack:  # never closed
        s.end_line = text.count("\n") + 1
        s.nloc = s.end_line - s.start_line + 1
    f.scopes = top
    f.finish()
    return f
