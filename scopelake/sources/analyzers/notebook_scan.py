"""Cells of notebooks as scopes, on virtual lines that count only lines with ink."""

from __future__ import annotations

import json

from scopelake.sources.analyzers.rows import FileRow, Scope


def cell_lines(text: str) -> list[tuple[int, str, list[str]]]:
    """(index, cell type, lines with ink) of every cell, empty ones included."""
    out = []
    for i, cell in enumerate(json.loads(text).get("cells", [])):
        source = cell.get("source", "")
        whole = "".join(source) if isinstance(source, list) else source
        out.append((i, cell.get("cell_type", "unknown"), [x for x in whole.splitlines() if x.strip()]))
    return out


def scan_notebook(text: str, path: str = "") -> FileRow:
    f, at = FileRow(), 1
    for i, kind, lines in cell_lines(text):
        if lines:
            f.scopes.append(Scope(f"[{kind}] cell {i + 1}", f"notebook_{kind}", 0, at, at + len(lines) - 1))
            at += len(lines)
    f.loc = at - 1
    f.finish()
    return f


def virtual_text(text: str) -> str:
    return "\n".join(x for _, _, lines in cell_lines(text) for x in lines)
