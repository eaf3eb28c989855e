"""Scopes, definitions and usages of a TypeScript file as rows; resolution is left to joins.

Two views of one tree.  ``focus``: functions, catch clauses, blocks and JSX elements are
scopes, imports are definitions, and names are hoisted.  ``flow``: every control
structure and object is a scope, imports are none, and only earlier definitions count.
"""

from __future__ import annotations

from scopelake.sources.analyzers.ts_parser import Node, parse
from scopelake.sources.analyzers.ts_scan import FUNCTIONS, Place, places, scope_name

ELEMENTS = {"jsx_element", "jsx_self_closing", "jsx_fragment"}
# Names that are built in.
BUILTINS = [
    "console", "Math", "JSON", "Promise", "Array", "String", "Number", "Boolean", "Date", "RegExp", "Set", "Map", "WeakMap", "WeakSet", "Error",
    "TypeError", "RangeError", "ReferenceError", "SyntaxError", "URIError", "Symbol", "BigInt", "Intl", "Proxy", "Reflect", "Atomics", "DataView",
    "ArrayBuffer", "SharedArrayBuffer", "AggregateError", "FinalizationRegistry", "WeakRef", "Int8Array", "Uint8Array", "Uint8ClampedArray",
    "Int16Array", "Uint16Array", "Int32Array", "Uint32Array", "Float32Array", "Float64Array", "BigInt64Array", "BigUint64Array", "fetch", "Request",
    "Response", "Headers", "URL", "URLSearchParams", "ReadableStream", "WritableStream", "TransformStream", "TextEncoder", "TextDecoder", "window",
    "document", "globalThis", "process", "Buffer", "navigator", "location", "history", "screen", "frames", "performance", "structuredClone",
    "queueMicrotask", "requestIdleCallback", "cancelIdleCallback", "Object", "requestAnimationFrame", "cancelAnimationFrame", "localStorage",
    "sessionStorage", "confirm", "alert", "prompt", "Node", "NodeFilter", "HTMLElement", "Element", "Event", "CustomEvent", "CSS",
    "IntersectionObserver", "ResizeObserver", "MutationObserver", "AbortController", "AbortSignal", "Crypto", "crypto", "indexedDB", "ShadowRoot",
    "DocumentFragment", "setTimeout", "clearTimeout", "setInterval", "clearInterval", "require", "module", "exports", "__dirname", "__filename",
    "undefined", "NaN", "Infinity",
]
#: Words that the parser reads as names but that name nothing.
NOT_NAMES = {"this", "super", "true", "false", "null", "new.target", "import"}
CONTROL = {"for": "for", "while": "while", "do": "do", "catch": "catch", "finally": "finally", "switch": "switch", "case": "case", "default_case": "default", "if": "if", "for_each": "for"}


class Flow:
    def __init__(self, text: str, path: str, view: str):
        self.tree, self.p = parse(text, path.endswith("x"))
        self.text, self.view = text, view
        self.scopes: list[dict] = []
        self.defs: list[dict] = []
        self.usages: list[dict] = []
        self.order = 0
        root = self.scope("global", self.tree, None, "global" if view == "flow" else "")
        self.scopes[root]["start_line"], self.scopes[root]["end_line"] = 1, text.count("\n") + 1
        for k, at in zip(self.tree.kids, places(self.tree, Place(), text), strict=False):
            self.visit(k, at, root, self.tree, "")

    # rows

    def scope(self, kind: str, n: Node, parent: int | None, label: str) -> int:
        depth = 0 if parent is None else self.scopes[parent]["depth"] + 1
        a, b = self.p.line(n.start), self.p.line(max(n.start, n.end - 1))
        above = [len(self.scopes)] + ([] if parent is None else self.scopes[parent]["ancestors"])
        self.scopes.append({"scope_id": len(self.scopes), "parent_id": parent, "ancestors": above, "depth": depth, "kind": kind, "label": label, "start_line": a, "end_line": b})
        return len(self.scopes) - 1

    def place(self, offset: int) -> tuple[int, int]:
        line = self.p.line(offset)
        return line, offset - (self.p.breaks[line - 2] + 1 if line > 1 else 0)

    def define(self, name: str, offset: int, kind: str, scope: int, source: str | None = None) -> None:
        if name:
            line, col = self.place(offset)
            self.order += 1
            self.defs.append({"def_id": len(self.defs), "scope_id": scope, "name": name, "kind": kind, "line": line, "col": col, "preorder": self.order, "source": source})

    def use(self, name: str, offset: int, scope: int, attribute: str) -> None:
        if name and name not in NOT_NAMES:
            line, col = self.place(offset)
            self.order += 1
            self.usages.append({"usage_id": len(self.usages), "scope_id": scope, "name": name, "line": line, "start_col": col, "end_col": col + len(name), "preorder": self.order, "attribute": attribute or None})

    # scopes of the two views

    def opened(self, n: Node, at: Place, parent: Node) -> tuple[str, str] | None:
        """(kind, label) if the node is a scope."""
        if n.kind in FUNCTIONS:
            named = scope_name(n, at)
            if self.view == "focus":
                return "function", n.name or at.given or (at.attribute if parent.kind == "jsx_expression" else "")
            return "function", f"{named} (function)" if named != "(anonymous)" else "function"
        if n.kind in ELEMENTS:
            if self.view == "focus":
                return "jsx", "<>" if n.kind == "jsx_fragment" else f"<{n.name}>"
            return None if n.kind == "jsx_fragment" else ("jsx", f"<{n.name}>" if n.name else "JSX")
        if n.kind == "block":
            return self.block(parent)
        if n.kind == "catch":
            return "catch", "catch" if self.view == "flow" else ""
        if self.view == "focus":
            return None
        if n.kind == "class":
            return "class", scope_name(n, at)
        if n.kind == "object":
            return "object", f"{at.given} (object)" if at.given else "object"
        if n.kind in CONTROL and n.kind != "for_each":
            return CONTROL[n.kind], CONTROL[n.kind]
        return None

    def block(self, parent: Node) -> tuple[str, str] | None:
        if parent.kind in FUNCTIONS or self.view == "focus" and parent.kind == "catch":
            return None
        if self.view == "flow":
            if parent.kind == "try":
                return "try", "try"
            if parent.kind == "if":
                return "if_branch", "then"
            if parent.kind == "else":
                return "else_branch", "else"
        return "block", "block" if self.view == "flow" else ""

    # the walk

    def bind(self, n: Node, kind: str, scope: int, attribute: str, skip: bool) -> None:
        """Names of a pattern; defaults inside are expressions, except where skip says they are no usages."""
        if n.kind == "binding":
            self.define(n.name, n.start, kind, scope)
            return
        for i, k in enumerate(n.kids):
            if n.kind == "default" and i == 1:
                if not skip:
                    self.visit(k, Place(), scope, n, attribute)
            else:
                self.bind(k, kind, scope, attribute, skip)

    def visit(self, n: Node, at: Place, scope: int, parent: Node, attribute: str) -> None:
        kind = n.kind
        outer = scope
        if kind == "function" and n.name and self.view == "focus":
            self.define(n.name, n.info["name_at"], "module" if self.scopes[outer]["kind"] == "global" else "local", outer)
        if kind == "class" and n.name and self.view == "focus":
            self.define(n.name, n.info["name_at"], "module" if self.scopes[outer]["kind"] == "global" else "local", outer)
        opened = self.opened(n, at, parent)
        if opened:
            scope = self.scope(opened[0], n, outer, opened[1])
            attribute = "" if kind not in ELEMENTS else attribute
        if self.view == "flow" and kind in ("function", "class") and n.name:
            self.define(n.name, n.info["name_at"], kind, outer)
        if kind == "import":
            if self.view == "focus" and not n.info["type_only"]:
                for name, offset in n.info["locals"]:
                    self.define(name, offset, "import", 0, n.info["source"])
            return
        if kind == "declarator":
            target = n.kids[0]
            value = n.kids[1] if len(n.kids) > 1 else None
            named = "local"
            if self.view == "flow":
                named = "function" if target.kind == "binding" and value is not None and value.kind in ("arrow", "function_expression") else "variable"
            self.bind(target, named, scope, attribute, skip=True)
            if value is not None:
                self.visit(value, places(n, at, self.text)[1], scope, n, attribute)
            return
        if kind == "parameter":
            if self.view == "flow" and n.info.get("loose"):  # names of a catch clause or a bare arrow are no definitions there
                for b in n.kids[0].walk():
                    if b.kind == "binding":
                        self.use(b.name, b.start, scope, attribute)
            else:
                self.bind(n.kids[0], "param", scope, attribute, skip=True)
            return
        if kind == "ident":
            self.use(n.name, n.start, scope, attribute)
        elif kind == "shorthand":
            self.use(n.name, n.start, scope, attribute)
        elif kind in ("jsx_element", "jsx_self_closing") and self.view == "focus" and n.name:
            head = n.name.split(".")[0]
            if not head[0].islower() or "." in n.name:
                self.use(head, n.info["name_at"], scope, attribute)
        inner = n.name if kind == "jsx_attribute" else attribute
        for k, place in zip(n.kids, places(n, at, self.text), strict=False):
            self.visit(k, place, scope, n, inner)


def flow_rows(text: str, path: str, view: str = "focus") -> tuple[list[dict], list[dict], list[dict]]:
    """(scopes, defs, usages) of one file."""
    f = Flow(text, path, view)
    return f.scopes, f.defs, f.usages
