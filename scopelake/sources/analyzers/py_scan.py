"""Scopes and metrics of Python files, from the standard library's parser."""

from __future__ import annotations

import ast
import io
import tokenize
from bisect import bisect_left, bisect_right
from itertools import accumulate

from scopelake.sources.analyzers.rows import FileRow, Scope, import_scope, inked_lines

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match, ast.match_case)


def comments(text: str) -> list[tuple[int, str]]:
    """(line, comment) of every comment; what tokenizes before an error counts."""
    out = []
    if "#" not in text:
        return out
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                out.append((t.start[0], t.string))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    return out


def parameters(args: ast.arguments) -> int:
    return len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + (args.vararg is not None) + (args.kwarg is not None)


class Scan:
    def __init__(self, text: str):
        self.lines = text.splitlines()
        self.file = FileRow(loc=inked_lines(text))
        self.imports: list[tuple[int, int]] = []
        self.stack: list[tuple[Scope, int]] = []
        self.top: list[Scope] = []
        self.visit(ast.parse(text), 0)
        self.count(comments(text))

    def count(self, found: list[tuple[int, str]]) -> None:
        """Comments and marks of the file, and of every scope by sums up to a line."""
        marks = ["TODO" in said or "FIXME" in said for _, said in found]
        self.file.comment_lines, self.file.todo_count = len(found), sum(marks)
        lines, before = [line for line, _ in found], [0, *accumulate(marks)]
        for s in (s for t in self.top for s in t.walk()):
            lo, hi = bisect_left(lines, s.start_line), bisect_right(lines, s.end_line)
            s.comment_lines, s.todo_count = hi - lo, before[hi] - before[lo]

    def opened(self, n: ast.AST) -> Scope | None:
        if isinstance(n, FUNCTIONS):
            return Scope(n.name, "function_definition", 1, n.lineno, n.end_lineno, parameter_count=parameters(n.args))
        if isinstance(n, ast.ClassDef):
            return Scope(f"(class) {n.name}", "class_definition", 1, n.lineno, n.end_lineno)
        if isinstance(n, ast.Lambda):
            return Scope("(lambda)", "lambda", 1, n.lineno, n.end_lineno, parameter_count=parameters(n.args))
        return None

    def is_elif(self, n: ast.AST) -> bool:
        """An ``elif`` is an If alone in an else branch whose text begins with that word."""
        return isinstance(n, ast.If) and self.lines[n.lineno - 1].encode()[n.col_offset :].startswith(b"elif")

    def visit(self, n: ast.AST, nesting: int) -> None:
        if isinstance(n, ast.ClassDef):
            self.file.classes_count += 1
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            self.file.python_import_count += 1
            self.imports.append((n.lineno, n.end_lineno))
        counted = not self.is_elif(n)
        nests = isinstance(n, NESTING) and counted
        inner = nesting + nests
        self.file.max_nesting_depth = max(self.file.max_nesting_depth, inner)
        if nests:
            for s, base in self.stack:
                s.max_nesting_depth = max(s.max_nesting_depth, inner - base)
        if self.stack:
            if isinstance(n, BRANCHES) and counted:
                self.stack[-1][0].complexity += 1
            elif isinstance(n, ast.BoolOp):
                self.stack[-1][0].complexity += len(n.values) - 1
        scope = self.opened(n)
        if scope:
            (self.stack[-1][0].children if self.stack else self.top).append(scope)
            self.stack.append((scope, nesting))
        for k in ast.iter_child_nodes(n):
            self.visit(k, inner)
        if scope:
            self.stack.pop()


def scan_python(text: str, path: str = "") -> FileRow:
    s = Scan(text)
    found = import_scope(s.imports, s.lines)
    s.file.scopes = ([found] if found else []) + s.top
    s.file.finish()
    return s.file
