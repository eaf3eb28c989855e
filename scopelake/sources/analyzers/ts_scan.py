"""Scopes, metrics, imports and exports of TypeScript and TSX files."""

from __future__ import annotations

from scopelake.sources.analyzers.rows import FileRow, Scope, import_scope, inked_lines
from scopelake.sources.analyzers.ts_parser import Node, Parser, parse

NESTING = {"if", "for", "for_each", "while", "do", "switch", "try", "catch"}
BRANCHES = {"if", "for", "for_each", "while", "do", "catch", "ternary"}
SCOPES = {"function", "method", "arrow", "function_expression", "class", "interface", "type_alias", "object"}
FUNCTIONS = {"function", "method", "arrow", "function_expression"}
ELEMENTS = {"jsx_element", "jsx_self_closing", "jsx_fragment"}


def has_function(n: Node) -> bool:
    return any(x.kind in ("arrow", "function_expression") for x in n.walk())


def is_jsx_scope(n: Node) -> bool:
    """Whether an attribute value or a child expression of the element defines a function."""
    if n.kind not in ("jsx_element", "jsx_self_closing"):
        return False
    for k in n.kids:
        if k.kind == "jsx_attribute" and any(v.kind == "jsx_expression" and has_function(v) for v in k.kids):
            return True
        if k.kind == "jsx_expression" and n.kind == "jsx_element" and has_function(k):
            return True
    return False


class Place:
    """What stands around a node: a name that is given to it, and what it lies in."""

    __slots__ = ("given", "attribute", "callee", "called", "tag")

    def __init__(self, given="", attribute="", callee="", called=False, tag=""):
        self.given, self.attribute, self.callee, self.called, self.tag = given, attribute, callee, called, tag


def scope_name(n: Node, at: Place) -> str:
    if n.kind in ("function", "method"):
        return n.name or "(anonymous)"
    if n.kind in ("class", "interface", "type_alias"):
        what = {"class": "class", "interface": "interface", "type_alias": "type"}[n.kind]
        return f"{n.name} ({what})" if n.name else what
    if n.kind == "jsx_element":
        return f"<{n.name}>"
    if n.kind == "jsx_self_closing":
        return f"<{n.name} />"
    if n.kind == "object":
        if at.attribute:
            return f"{at.attribute} (obj)"
        return f"{at.given} (object)" if at.given else "object"
    if at.given:
        return at.given
    if at.attribute:
        return at.attribute
    if at.callee:
        return f"{at.callee}(ƒ)"
    if at.called:
        return "IIFE(ƒ)"
    return f"<{at.tag}>(ƒ)" if at.tag else "(anonymous)"


def parameter_count(n: Node) -> int:
    return next((len(k.kids) for k in n.kids if k.kind == "parameters" and not k.info.get("bare")), 0)


def places(n: Node, at: Place, text: str) -> list[Place]:
    """The place of each child of n."""
    inner = Place(attribute=at.attribute, tag=at.tag)
    if n.kind in FUNCTIONS or n.kind in ("block", "program"):
        inner = Place()
    if n.kind == "declarator":
        return [inner, Place(n.name, inner.attribute, tag=inner.tag)]
    if n.kind == "assign":
        return [inner, Place(text[n.kids[0].start : n.kids[0].end], inner.attribute, tag=inner.tag)]
    if n.kind == "pair":
        return [Place(n.name, inner.attribute, tag=inner.tag)] * len(n.kids)
    if n.kind == "jsx_attribute":
        return [Place(attribute=n.name)] * len(n.kids)
    if n.kind == "jsx_element":
        return [Place(tag=n.name) if k.kind == "jsx_expression" else Place() for k in n.kids]
    if n.kind in ("jsx_self_closing", "jsx_fragment"):
        return [Place()] * len(n.kids)
    if n.kind == "jsx_expression":
        return [Place(attribute=at.attribute, tag=at.tag)] * len(n.kids)
    if n.kind in ("call", "new"):
        callee = n.kids[0]
        name = callee.name if callee.kind == "ident" or callee.kind == "member" and n.kind == "call" else ""
        first = Place(attribute=inner.attribute, tag=inner.tag, called=n.kind == "call" and callee.kind == "paren")
        return [first, *[Place(attribute=inner.attribute, callee=name, tag=inner.tag)] * (len(n.kids) - 1)]
    if n.kind == "arguments":
        return [Place(attribute=at.attribute, callee=at.callee, tag=at.tag)] * len(n.kids)
    if n.kind == "paren":
        return [Place(attribute=at.attribute, called=at.called, tag=at.tag)] * len(n.kids)
    return [inner] * len(n.kids)


class Scan:
    def __init__(self, text: str, tree: Node, p: Parser):
        self.text, self.p = text, p
        self.file = FileRow()
        self.top: list[Scope] = []
        self.stack: list[tuple[Scope, int]] = []
        self.strings: dict[str, int] = {}
        self.sources: set[str] = set()
        self.imports: list[tuple[int, int]] = []
        self.comments = sorted(p.comments.items())
        self.visit(tree, Place(), 0, 0)
        self.all_comments()
        self.file.ts_any_usage_count = len(p.any_types)
        self.file.ts_import_coupling_count = len(self.sources)
        self.file.tsx_duplicated_string_count = sum(n > 1 for n in self.strings.values())

    def lines(self, n: Node) -> tuple[int, int]:
        return self.p.line(n.start), self.p.line(max(n.start, n.end - 1))

    def said(self, text: str) -> None:
        if text:
            self.file.tsx_hardcoded_string_volume += len(text)
            self.strings[text] = self.strings.get(text, 0) + 1

    def visit(self, n: Node, at: Place, nesting: int, jsx: int) -> None:
        f, kind = self.file, n.kind
        scope = self.stack[-1][0] if self.stack else None
        if kind in ("class", "class_expression"):
            f.classes_count += 1
        elif kind == "export":
            f.ts_export_count += 1
        elif kind == "import":
            if n.info["source"] is not None:
                self.sources.add(n.info["source"])
            self.imports.append(self.lines(n))
        elif kind == "jsx_text":
            self.said(n.name)
        elif kind in ("jsx_attribute", "jsx_expression"):
            for k in n.kids:
                if k.kind == "string":
                    self.said(k.name.strip("'\""))
        elif kind in ("interface", "type_alias"):
            f.ts_type_interface_count += 1
            if scope:
                scope.ts_type_interface_count += 1
        if kind == "call":
            callee = n.kids[0]
            if callee.kind in ("ident", "member") and callee.name == "useEffect":
                f.tsx_react_use_effect_count += 1
        inner = nesting + (kind in NESTING)
        if kind in NESTING:
            f.max_nesting_depth = max(f.max_nesting_depth, inner)
            for s, base in self.stack:
                s.max_nesting_depth = max(s.max_nesting_depth, inner - base)
        if scope:
            logical = kind == "binary" and n.name in ("&&", "||", "??")
            if kind in BRANCHES or logical:
                scope.complexity += 1
            if (kind == "ternary" or logical and n.name != "||") and (scope.is_jsx or scope.tsx_lines):
                f.tsx_render_branching_count += 1
        if kind in ELEMENTS:
            jsx += 1
            f.tsx_nesting_depth = max(f.tsx_nesting_depth, jsx)
            if scope:
                a, b = self.lines(n)
                if not scope.tsx_lines:
                    scope.tsx_root = "<fragment>" if kind == "jsx_fragment" else scope_name(n, at)
                    scope.tsx_lines = (a, b)
                scope.tsx_lines = (min(a, scope.tsx_lines[0]), max(b, scope.tsx_lines[1]))
        if kind == "jsx_attribute":
            f.tsx_prop_count += 1
            if n.name.startswith("on") and any(v.kind == "jsx_expression" and any(k.kind in ("arrow", "function_expression") for k in v.kids) for v in n.kids):
                f.tsx_anonymous_handler_count += 1
        opened = kind in SCOPES or is_jsx_scope(n)
        if opened:
            a, b = self.lines(n)
            new = Scope(scope_name(n, at), kind, 1, a, b, parameter_count=parameter_count(n), is_jsx=kind in ELEMENTS, span=(n.start, n.end))
            (scope.children if scope else self.top).append(new)
            self.stack.append((new, nesting))
        for k, place in zip(n.kids, places(n, at, self.text), strict=False):
            self.visit(k, place, inner, jsx)
        if opened:
            self.stack.pop()

    def all_comments(self) -> None:
        """Comments count in the file and in every scope that holds them."""
        every = [s for t in self.top for s in t.walk()]
        for start, end in self.comments:
            said = self.text[start:end]
            n = said.count("\n") + 1
            todo = "TODO" in said or "FIXME" in said
            self.file.comment_lines += n
            self.file.todo_count += todo
            self.file.ts_ignore_count += "@ts-ignore" in said or "@ts-expect-error" in said
            for s in every:
                if s.span[0] <= start < s.span[1]:
                    s.comment_lines += n
                    s.todo_count += todo


def virtual_roots(scopes: list[Scope]) -> None:
    """One root per function or other scope with TSX of its own; it adopts the element scopes directly below."""
    for s in scopes:
        virtual_roots(s.children)
        if not s.tsx_lines or s.is_jsx:
            continue
        a, b = s.tsx_lines
        adopted = [c for c in s.children if c.is_jsx]
        root = Scope(s.tsx_root, "jsx_virtual_root", 0, a, b, is_jsx=True, children=adopted)
        first = s.children.index(adopted[0]) if adopted else 0
        rest = [c for c in s.children if not c.is_jsx]
        before = sum(not c.is_jsx for c in s.children[:first])
        s.children = [*rest[:before], root, *rest[before:]]


def scan_typescript(text: str, path: str) -> FileRow:
    tree, p = parse(text, path.endswith("x"))
    s = Scan(text, tree, p)
    virtual_roots(s.top)
    lines = text.splitlines()
    s.file.loc = inked_lines(text)
    found = import_scope(s.imports, lines)
    s.file.scopes = ([found] if found else []) + s.top
    s.file.finish()
    return s.file


def imports_exports(text: str, path: str) -> tuple[list[dict], list[dict]]:
    """(imports: source, symbols; exports: name, type).  Type-only imports do not count."""
    tree, _ = parse(text, path.endswith("x"))
    imports, exports = [], []
    for n in tree.walk():
        if n.kind == "import" and not n.info["type_only"] and n.info["source"] is not None:
            imports.append({"source": n.info["source"], "symbols": n.info["symbols"]})
        elif n.kind == "export":
            if n.info["source"] is not None:
                imports.append({"source": n.info["source"], "symbols": n.info["symbols"]})
            kind = "default" if n.info.get("default") else "declaration" if n.kids and n.kids[0].kind in ("function", "class") else "variable" if n.kids else "value"
            exports += [{"name": x, "type": kind} for x in n.info["names"] if x]
    return imports, exports
