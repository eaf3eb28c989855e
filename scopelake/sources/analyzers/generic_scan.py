"""Functions and branches of other languages with braces, by keywords: an approximation."""

from __future__ import annotations

import re
from bisect import bisect_right as bisect

from scopelake.sources.analyzers.rows import FileRow, Scope, inked_lines

_BLANK = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""")
_BRACE = re.compile("[{}]")
_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|elif|except)\b|&&|\|\||\?(?![.?:])")
_PARAMETERS = r"\(([^(){}]*(?:\([^()]*\)[^(){}]*)*)\)"
#: Only after a keyword for functions may a bare result type, or several in brackets, stand before the brace.
_RESULT = r"(?(2)(?:\([^(){}]*\)|[\w.*\[\]]+)?)"
_NAMES = re.compile(r"(?:\bfunction\s*\*?\s*([\w$]+)|\b(?:func|fn|def|sub)\s+(?:\([^)]*\)\s*)?([\w$]+)|(?<![\w$~])([\w$~]+))\s*(?:<[^<>{}()]*>|(?(2)\[[^\[\]{}()]*\]))?\s*" + _PARAMETERS + r"\s*" + _RESULT + r"(?:->\s*[^{;]+|:\s*[^{;=]+|const|noexcept|override|throws\s+[\w., ]+|\s)*\{")
_ARROWS = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\b\s*)?(?:" + _PARAMETERS + r"|([\w$]+))\s*=>\s*\{")
_NOT = {"if", "for", "while", "switch", "catch", "return", "function", "else", "do", "with", "synchronized", "match", "foreach"}


def _closed(text: str) -> dict[int, int]:
    """Where each brace that opens is closed."""
    out, open_ = {}, []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def scan_generic(text: str, path: str = "") -> FileRow:
    """Metrics and functions of one text, in one pass over its braces, functions and branches."""
    f = FileRow()
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    for m in _BLANK.finditer(text):
        if m[0].startswith(("//", "/*")):
            f.comment_lines += m[0].count("\n") + 1
            f.todo_count += "TODO" in m[0] or "FIXME" in m[0]
    bare = _BLANK.sub(blank, text)
    f.loc = inked_lines(bare)
    heads = [(m.start(), m.end() - 1, m[1] or m[2] or m[3], m[4]) for m in _NAMES.finditer(bare)]
    heads += [(m.start(), m.end() - 1, m[1], m[2] or m[3] or "") for m in _ARROWS.finditer(bare)]
    ends, lines = _closed(bare), [m.start() for m in re.finditer("\n", bare)]
    found: list[tuple[int, int, Scope]] = []
    for start, brace, name, given in sorted(heads):
        if name not in _NOT:
            end, n = ends.get(brace, len(bare)), len([p for p in given.split(",") if p.strip()])
            found.append((start, end, Scope(name, "function", 1, bisect(lines, start - 1) + 1, bisect(lines, end - 1) + 1, parameter_count=n)))
    ahead, around = iter([*found, (len(bare) + 1, 0, None)]), []
    following = next(ahead)
    for m in _BRANCH.finditer(bare):
        while following[0] <= m.start():
            around.append(following)
            following = next(ahead)
        while around and around[-1][1] <= m.start():
            around.pop()
        if around:
            around[-1][2].complexity += 1
    f.scopes = [s for _, _, s in found]
    f.finish()
    return f
