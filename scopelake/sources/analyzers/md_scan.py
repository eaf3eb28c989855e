"""Sections, quotes, code blocks and data URLs of Markdown files."""

from __future__ import annotations

import re

from scopelake.sources.analyzers.rows import FileRow, Scope, inked_lines

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`\n]*)$")
_DATA = re.compile(r"""data:[^\s)\]">]*""")


def truncated(text: str, most: int = 40) -> str:
    return text[: most - 1] + "…" if len(text) > most else text


def blocks(lines: list[str]) -> list[tuple[str, int, int, str]]:
    """(kind, first line, last line, text) of headings, quotes and code, in order."""
    out: list[tuple[str, int, int, str]] = []
    i, n, paragraph = 0, len(lines), False
    while i < n:
        line = lines[i]
        if fence := _FENCE.match(line):
            mark, j = fence[1], i + 1
            while j < n and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            out.append(("code", i + 1, min(j, n - 1) + 1, fence[2].strip()))
            i, paragraph = j + 1, False
        elif atx := _ATX.match(line):
            out.append(("h" + str(len(atx[1])), i + 1, i + 1, f"{atx[1]} {atx[2] or ''}".strip()))
            i, paragraph = i + 1, False
        elif line.lstrip(" ").startswith(">") and len(line) - len(line.lstrip(" ")) < 4:
            j = i
            while j < n and (lines[j].lstrip().startswith(">") or lines[j].strip() and j > i and not _ATX.match(lines[j]) and not _FENCE.match(lines[j])):
                j += 1
            out.append(("quote", i + 1, j, re.sub(r"^\s*>\s?", "", line).strip()))
            i, paragraph = j, False
        elif not paragraph and re.match(r"(?: {4}|\t)\s*\S", line):
            j = i
            while j < n and (re.match(r" {4}|\t", lines[j]) or not lines[j].strip()):
                j += 1
            while not lines[j - 1].strip():
                j -= 1
            out.append(("code", i + 1, j, ""))
            i = j
        elif paragraph and re.match(r" {0,3}(=+|-+)\s*$", line):
            out.append(("h1" if "=" in line else "h2", i, i + 1, lines[i - 1].strip()))
            i, paragraph = i + 1, False
        else:
            paragraph = bool(line.strip())
            i += 1
    return out


def scan_markdown(text: str, path: str = "") -> FileRow:
    f = FileRow(loc=inked_lines(text))
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and not lines[-1]:
        lines.pop()
    top: list[Scope] = []
    open_: list[tuple[int, Scope]] = []

    def close(level: int, before: int) -> None:
        while open_ and open_[-1][0] >= level:
            s = open_.pop()[1]
            s.end_line = max(s.start_line, before)
            s.nloc = s.end_line - s.start_line + 1

    for kind, a, b, said in blocks(lines):
        if kind[0] == "h":
            level = int(kind[1])
            close(level, a - 1)
            s = Scope(said or "(section)", "markdown_section", 0, a, b)
            (open_[-1][1].children if open_ else top).append(s)
            open_.append((level, s))
        elif open_:
            shown = truncated(said)
            name = (f"> {shown}" if shown else "> quote") if kind == "quote" else f"``` {said}".strip()
            open_[-1][1].children.append(Scope(name, "markdown_block_quote" if kind == "quote" else "markdown_code_block", 0, a, b))
    close(1, len(lines))
    every = [s for t in top for s in t.walk()]
    for m in _DATA.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        label = m[0].split(":", 1)[1].split(",", 1)[0]
        leaf = Scope(f"data-url {label}".strip(), "markdown_data_url", 0, line, line, md_data_url_count=1)
        holders = [s for s in every if s.start_line <= line <= s.end_line]
        # the innermost: latest start, then earliest end, then the later one
        best = max(enumerate(holders), key=lambda x: (x[1].start_line, -x[1].end_line, x[0]))[1] if holders else None
        (best.children if best else top).append(leaf)
        f.md_data_url_count += 1
    f.scopes = top
    f.finish()
    return f
