"""A tolerant parser for TypeScript and TSX: statements, expressions and JSX as plain nodes.

Types are read only as far as needed to find their end.  What cannot be read becomes an
``error`` node up to the next statement, so a file never fails as a whole.
"""

from __future__ import annotations

import bisect
import re

WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))")
MARKS = [">>>=", "...", "===", "!==", "**=", "<<=", ">>=", ">>>", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "**"]
#: Binding power of binary operators.
POWER = {"??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "get", "set"}


class Node:
    __slots__ = ("kind", "start", "end", "kids", "name", "info")

    def __init__(self, kind: str, start: int, end: int = 0, kids: list | None = None, name: str = "", **info):
        self.kind, self.start, self.end, self.kids, self.name, self.info = kind, start, end, kids or [], name, info

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


class Broken(Exception):
    """The text is not what was expected here."""


class Parser:
    def __init__(self, text: str, jsx: bool):
        self.s, self.jsx, self.at, self.depth = text, jsx, 0, 0
        self.comments: dict[int, int] = {}
        self.any_types: set[int] = set()
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.no_in = False

    def line(self, offset: int) -> int:
        """1-based line of an offset."""
        return bisect.bisect_left(self.breaks, offset) + 1

    # tokens

    def skip(self) -> bool:
        """Over white space and comments; whether a newline was among them."""
        began = self.at
        while m := SPACE.match(self.s, self.at):
            if m[0][:2] in ("//", "/*"):
                self.comments[m.start()] = m.end()
            self.at = m.end()
        return "\n" in self.s[began : self.at]

    def peek(self) -> str:
        self.skip()
        if self.at >= len(self.s):
            return ""
        if m := WORD.match(self.s, self.at):
            return m[0]
        if m := NUMBER.match(self.s, self.at):
            return m[0]
        for t in MARKS:
            if self.s.startswith(t, self.at):
                return t
        return self.s[self.at]

    def take(self, *wanted: str) -> str:
        t = self.peek()
        if wanted and t not in wanted or not t:
            raise Broken(f"{t!r} at {self.at}, not {wanted}")
        self.at += len(t)
        return t

    def maybe(self, *wanted: str) -> str:
        return self.take(*wanted) if self.peek() in wanted else ""

    def is_word(self, t: str) -> bool:
        return bool(t) and bool(WORD.match(t))

    def word(self) -> str:
        t = self.peek()
        if not self.is_word(t):
            raise Broken(f"{t!r} at {self.at}, not a name")
        return self.take()

    def attempt(self, f):
        """f's result, or None with the position as it was."""
        at = self.at
        try:
            return f()
        except (Broken, RecursionError):
            self.at = at
            return None

    def string(self) -> Node:
        q, start = self.s[self.at], self.at
        i = start + 1
        while i < len(self.s) and self.s[i] != q and self.s[i] != "\n":
            i += 2 if self.s[i] == "\\" else 1
        self.at = min(i + 1, len(self.s))
        return Node("string", start, self.at, name=self.s[start + 1 : i])

    def template(self) -> Node:
        n = Node("template", self.at)
        self.at += 1
        while self.at < len(self.s):
            c = self.s[self.at]
            if c == "`":
                self.at += 1
                break
            if c == "\\":
                self.at += 2
            elif self.s.startswith("${", self.at):
                self.at += 2
                n.kids.append(self.expression())
                self.take("}")
            else:
                self.at += 1
        n.end = self.at
        return n

    def regex(self) -> Node:
        start, i, in_set = self.at, self.at + 1, False
        while i < len(self.s) and self.s[i] != "\n" and (in_set or self.s[i] != "/"):
            in_set = True if self.s[i] == "[" else False if self.s[i] == "]" else in_set
            i += 2 if self.s[i] == "\\" else 1
        self.at = i + 1
        while self.at < len(self.s) and self.s[self.at].isalpha():
            self.at += 1
        return Node("regex", start, self.at)

    def balanced(self, open_: str, close: str) -> None:
        """Over a bracketed stretch; strings and comments inside do not count."""
        self.take(open_)
        pairs = {"(": ")", "[": "]", "{": "}"}
        while True:
            t = self.peek()
            if not t:
                raise Broken("not closed")
            if t == close:
                self.at += 1
                return
            if t in pairs:
                self.balanced(t, pairs[t])
            elif t in "'\"":
                self.string()
            elif t == "`":
                self.template()
            else:
                if t == "any":
                    self.any_types.add(self.at)
                self.at += len(t) if t[0] not in "<>" else 1

    # types

    def type(self) -> None:
        self.maybe("|", "&")
        while True:
            self.type_operand()
            if self.peek() not in ("|", "&"):
                break
            self.take()
        if self.peek() == "extends" and not self.no_in:
            self.take()
            self.type_operand()
            while self.maybe("|", "&"):
                self.type_operand()
            if self.maybe("?"):
                self.type()
                self.take(":")
                self.type()
        elif self.peek() == "is":
            self.take()
            self.type()

    def type_operand(self) -> None:
        t = self.peek()
        while t in ("keyof", "readonly", "unique", "infer", "asserts", "typeof", "new", "abstract", "-"):
            at = self.at
            self.take()
            if self.peek() in ("", ",", ")", ">", ";", "=", "|", "]", "}"):
                self.at = at
                break
            t = self.peek()
        if t == "<":
            self.type_parameters()
            t = self.peek()
        if t == "(":
            self.balanced("(", ")")
            if self.maybe("=>"):
                self.type()
                return
        elif t == "{":
            self.balanced("{", "}")
        elif t == "[":
            self.balanced("[", "]")
        elif t in "'\"" and t:
            self.string()
        elif t == "`":
            self.template()
        elif t and (t[0].isdigit()):
            self.take()
        elif t == "import":
            self.take()
            self.balanced("(", ")")
        elif self.is_word(t):
            if t == "any":
                self.any_types.add(self.at)
            self.take()
        else:
            raise Broken(f"no type at {self.at}")
        while True:
            t = self.peek()
            if t == ".":
                self.take()
                self.word()
            elif t == "<" or t == "<<":
                self.type_arguments()
            elif t == "[" and "\n" not in self.s[self.at_before() : self.at]:
                self.balanced("[", "]")
            else:
                return

    def at_before(self) -> int:
        i = self.at
        while i and self.s[i - 1].isspace():
            i -= 1
        return i

    def type_arguments(self) -> None:
        self.skip()
        if self.s[self.at] != "<":
            raise Broken("no <")
        self.at += 1
        while self.peek()[:1] != ">":
            self.type()
            if not self.maybe(","):
                break
        self.skip()
        if self.s[self.at : self.at + 1] != ">":
            raise Broken("type arguments not closed")
        self.at += 1

    def type_parameters(self) -> None:
        self.take("<")
        while self.peek()[:1] != ">":
            while self.peek() in ("const", "in", "out"):
                self.take()
            self.word()
            if self.maybe("extends"):
                self.type()
            if self.maybe("="):
                self.type()
            if not self.maybe(","):
                break
        self.skip()
        if self.s[self.at : self.at + 1] != ">":
            raise Broken("type parameters not closed")
        self.at += 1

    def annotation(self) -> None:
        if self.maybe(":"):
            self.type()

    # patterns and parameters

    def pattern(self) -> Node:
        """A binding target; names that it binds are ``binding`` nodes."""
        t, start = self.peek(), self.at
        if t == "{":
            self.take()
            n = Node("object_pattern", start)
            while self.peek() != "}":
                if self.maybe("..."):
                    n.kids.append(self.pattern())
                else:
                    key_at = self.at
                    key = self.property_key()
                    if self.maybe(":"):
                        n.kids.append(self.with_default(self.pattern()))
                    else:
                        n.kids.append(self.with_default(Node("binding", key_at if not key.start else key.start, key.end, name=key.name, shorthand=True)))
                if not self.maybe(","):
                    break
            self.take("}")
        elif t == "[":
            self.take()
            n = Node("array_pattern", start)
            while self.peek() != "]":
                if self.maybe(","):
                    continue
                self.maybe("...")
                n.kids.append(self.with_default(self.pattern()))
                if not self.maybe(","):
                    break
            self.take("]")
        else:
            self.skip()
            start = self.at
            n = Node("binding", start, name=self.word())
        n.end = self.at
        return n

    def with_default(self, target: Node) -> Node:
        if self.maybe("="):
            return Node("default", target.start, kids=[target, v := self.assignment()], end=v.end)
        return target

    def parameters(self) -> Node:
        n = Node("parameters", self.at)
        self.take("(")
        while self.peek() != ")":
            while self.peek() == "@":
                self.take()
                self.postfix(self.primary())
            self.skip()
            start = self.at
            while self.peek() in MODIFIERS and self.attempt(lambda: (self.take(), self.pattern() and None)) is not None:
                pass
            while self.peek() in MODIFIERS:
                at = self.at
                self.take()
                if self.peek() in (",", ")", ":", "?", "="):
                    self.at = at
                    break
            rest = bool(self.maybe("..."))
            p = self.pattern()
            self.maybe("?")
            self.annotation()
            p = self.with_default(p)
            n.kids.append(Node("parameter", start, self.at, [p], rest=rest))
            if not self.maybe(","):
                break
        self.take(")")
        n.end = self.at
        return n

    def property_key(self) -> Node:
        t = self.peek()
        start = self.at
        if t == "[":
            self.take()
            inner = self.assignment()
            self.take("]")
            return Node("computed", start, self.at, [inner], name=self.s[start : self.at])
        if t in "'\"" and t:
            k = self.string()
            return Node("key", k.start, k.end, name=self.s[k.start : k.end])
        if t == "#":
            self.take()
        elif t and t[0].isdigit():
            self.take()
            return Node("key", start, self.at, name=t)
        w = self.word()
        return Node("key", start, self.at, name=w)

    # functions and classes

    def body(self) -> Node:
        self.skip()
        n = Node("block", self.at)
        self.take("{")
        n.kids = self.statements("}")
        self.take("}")
        n.end = self.at
        return n

    def function_rest(self, n: Node) -> Node:
        """Type parameters, parameters, return type and body of a function that has begun."""
        if self.peek() == "<":
            self.type_parameters()
        n.kids.append(self.parameters())
        self.annotation()
        if self.peek() == "{":
            n.kids.append(self.body())
        else:
            n.info["bodyless"] = True
            self.maybe(";")
        n.end = self.at
        return n

    def function(self, kind: str, start: int) -> Node:
        self.take("function")
        generator = bool(self.maybe("*"))
        t = self.peek()
        n = Node(kind, start, generator=generator)
        if self.is_word(t):
            n.info["name_at"] = self.at
            n.name = self.take()
        return self.function_rest(n)

    def arrow(self) -> Node:
        self.skip()
        n = Node("arrow", self.at)
        if self.peek() == "async" and self.s[self.at + 5 : self.at + 6] in (" ", "(", "<"):
            self.take()
        if self.peek() == "<":
            self.type_parameters()
        if self.peek() == "(":
            n.kids.append(self.parameters())
            self.annotation()
        else:
            self.skip()
            b = Node("binding", self.at, name=self.word())
            b.end = self.at
            n.kids.append(Node("parameters", b.start, b.end, [Node("parameter", b.start, b.end, [b], rest=False, loose=True)], bare=True))
        self.take("=>")
        keep, self.no_in = self.no_in, False
        n.kids.append(self.body() if self.peek() == "{" else self.assignment())
        self.no_in = keep
        n.end = self.at
        return n

    def class_(self, kind: str, start: int) -> Node:
        self.take("class")
        n = Node(kind, start)
        if self.is_word(self.peek()) and self.peek() not in ("extends", "implements"):
            n.info["name_at"] = self.at
            n.name = self.take()
        if self.peek() == "<":
            self.type_parameters()
        if self.maybe("extends"):
            n.kids.append(self.postfix(self.primary()))
            if self.peek() == "<":
                self.type_arguments()
        if self.maybe("implements"):
            self.type()
            while self.maybe(","):
                self.type()
        self.take("{")
        while self.peek() != "}":
            if self.maybe(";"):
                continue
            n.kids.append(self.member())
        self.take("}")
        n.end = self.at
        return n

    def member(self) -> Node:
        self.skip()
        start = self.at
        decorators = []
        while self.peek() == "@":
            self.take()
            decorators.append(self.postfix(self.primary()))
        if self.peek() == "static" and self.attempt(lambda: (self.take(), self.take("{"))[1]):
            self.at -= 1
            return Node("static_block", start, kids=[b := self.body()], end=b.end)
        while self.peek() in MODIFIERS:
            at = self.at
            self.take()
            if self.peek() in ("(", "=", ";", ":", "?", "!", "}", "<") or self.at >= len(self.s):
                self.at = at
                break
        self.maybe("*")
        if self.peek() == "[":
            found = self.attempt(self.index_signature)
            if found is not None:
                return found
        key = self.property_key()
        self.maybe("?", "!")
        if self.peek() in ("(", "<"):
            return self.function_rest(Node("method", start, kids=[*decorators, *([key] if key.kind == "computed" else [])], name=key.name, name_at=key.start))
        self.annotation()
        n = Node("field", start, kids=decorators, name=key.name)
        if self.maybe("="):
            n.kids.append(self.assignment())
        n.end = self.at
        self.maybe(";")
        return n

    def index_signature(self) -> Node:
        start = self.at
        self.take("[")
        self.word()
        self.take(":")
        self.type()
        self.take("]")
        self.annotation()
        self.maybe(";")
        return Node("index_signature", start, self.at)

    # expressions

    def expression(self) -> Node:
        n = self.assignment()
        while self.peek() == ",":
            self.take()
            n = Node("sequence", n.start, kids=[n, m := self.assignment()], end=m.end)
        return n

    def assignment(self) -> Node:
        self.depth += 1
        try:
            if self.depth > 180:
                raise Broken("too deep")
            return self._assignment()
        finally:
            self.depth -= 1

    def _assignment(self) -> Node:
        t = self.peek()
        start = self.at
        if (t == "(" or t == "<" or self.is_word(t)) and self.may_be_arrow(t):
            found = self.attempt(self.arrow)
            if found is not None:
                return found
        if t == "yield":
            self.take()
            self.maybe("*")
            if self.peek() in (")", "]", "}", ",", ";", "") or self.newline_before():
                return Node("yield", start, self.at)
            return Node("yield", start, kids=[v := self.assignment()], end=v.end)
        left = self.binary(0)
        t = self.peek()
        if t == "?":
            self.take()
            keep, self.no_in = self.no_in, False
            a = self.assignment()
            self.take(":")
            self.no_in = keep
            b = self.assignment()
            return Node("ternary", start, b.end, [left, a, b])
        if t in ASSIGN:
            self.take()
            right = self.assignment()
            return Node("assign", start, right.end, [left, right], name=t)
        return left

    def newline_before(self) -> bool:
        return "\n" in self.s[self.at_before() : self.at]

    def may_be_arrow(self, t: str) -> bool:
        """A cheap look ahead, so that few attempts are in vain."""
        if t == "<":
            return True
        if t == "(":
            at = self.at
            ok = self.attempt(lambda: (self.balanced("(", ")"), self.peek() in ("=>", ":"))[1])
            self.at = at
            return bool(ok)
        if t == "async":
            return True
        m = re.compile(r"\s*=>").match(self.s, self.at + len(t))
        return m is not None

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            t = self.peek()
            if t in ("as", "satisfies") and not self.newline_before():
                self.take()
                if not self.maybe("const"):
                    self.type()
                left = Node("cast", left.start, self.at, [left])
                continue
            power = POWER.get(t, 0)
            if not power or power <= least or t == "in" and self.no_in:
                return left
            self.take()
            right = self.binary(power - (t == "**"))
            left = Node("binary", left.start, right.end, [left, right], name=t)

    def unary(self) -> Node:
        t = self.peek()
        start = self.at
        if t in ("!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"):
            self.take()
            if t == "await" and self.peek() in (")", ",", ";", "=", ".", ""):
                return self.postfix(Node("ident", start, self.at, name=t))
            inner = self.unary()
            return Node("unary", start, inner.end, [inner], name=t)
        n = self.postfix(self.primary())
        if self.peek() in ("++", "--") and not self.newline_before():
            self.take()
            n = Node("update", n.start, self.at, [n])
        return n

    def arguments(self) -> Node:
        n = Node("arguments", self.at)
        self.take("(")
        keep, self.no_in = self.no_in, False
        while self.peek() != ")":
            start = self.at
            if self.maybe("..."):
                v = self.assignment()
                n.kids.append(Node("spread", start, v.end, [v]))
            else:
                n.kids.append(self.assignment())
            if not self.maybe(","):
                break
        self.no_in = keep
        self.take(")")
        n.end = self.at
        return n

    def postfix(self, n: Node) -> Node:
        while True:
            t = self.peek()
            if t in (".", "?."):
                self.take()
                if t == "?." and self.peek() == "(":
                    a = self.arguments()
                    n = Node("call", n.start, a.end, [n, a])
                elif t == "?." and self.peek() == "[":
                    self.take()
                    i = self.expression()
                    self.take("]")
                    n = Node("index", n.start, self.at, [n, i])
                else:
                    self.maybe("#")
                    at = self.at
                    name = self.word()
                    n = Node("member", n.start, self.at, [n], name=name, name_at=at)
            elif t == "(":
                a = self.arguments()
                n = Node("call", n.start, a.end, [n, a])
            elif t == "[":
                self.take()
                keep, self.no_in = self.no_in, False
                i = self.expression()
                self.no_in = keep
                self.take("]")
                n = Node("index", n.start, self.at, [n, i])
            elif t == "`":
                q = self.template()
                n = Node("call", n.start, q.end, [n, q])
            elif t == "!" and not self.newline_before() and self.s[self.at + 1 : self.at + 2] != "=":
                self.take()
                n = Node("cast", n.start, self.at, [n])
            elif t in ("<", "<<") and n.kind in ("ident", "member"):
                at = self.at
                if self.attempt(lambda: (self.type_arguments(), self.peek() in ("(", "`"))[1]):
                    continue
                self.at = at
                return n
            else:
                return n

    def primary(self) -> Node:
        t = self.peek()
        start = self.at
        if not t:
            raise Broken("the end")
        if t in "'\"":
            return self.string()
        if t == "`":
            return self.template()
        if t in ("/", "/="):
            return self.regex()
        if t == "(":
            self.take()
            keep, self.no_in = self.no_in, False
            inner = self.expression()
            self.no_in = keep
            self.take(")")
            return Node("paren", start, self.at, [inner])
        if t == "[":
            self.take()
            n = Node("array", start)
            while self.peek() != "]":
                if self.maybe(","):
                    continue
                at = self.at
                if self.maybe("..."):
                    n.kids.append(Node("spread", at, kids=[v := self.assignment()], end=v.end))
                else:
                    n.kids.append(self.assignment())
                if not self.maybe(","):
                    break
            self.take("]")
            n.end = self.at
            return n
        if t == "{":
            return self.object()
        if t == "<":
            if self.jsx:
                return self.element()
            self.type_arguments()
            inner = self.unary()
            return Node("cast", start, inner.end, [inner])
        if t == "function":
            return self.function("function_expression", start)
        if t == "async" and re.compile(r"async[ \t]+function\b").match(self.s, self.at):
            self.take()
            return self.function("function_expression", start)
        if t == "class":
            return self.class_("class_expression", start)
        if t == "new":
            self.take()
            if self.maybe("."):
                self.word()
                return Node("ident", start, self.at, name="new.target")
            callee = self.primary()
            while self.peek() in (".", "["):
                if self.maybe("."):
                    at = self.at
                    callee = Node("member", callee.start, kids=[callee], name=self.word(), name_at=at)
                    callee.end = self.at
                else:
                    self.take()
                    callee = Node("index", callee.start, kids=[callee, self.expression()])
                    self.take("]")
                    callee.end = self.at
            if self.peek() == "<":
                self.attempt(self.type_arguments)
            kids = [callee]
            if self.peek() == "(":
                kids.append(self.arguments())
            return Node("new", start, self.at, kids)
        if t == "@":
            self.take()
            self.postfix(self.primary())
            return self.primary()
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            self.take()
            return Node("number", start, self.at)
        if t == "#":
            self.take()
            self.word()
            return Node("private", start, self.at)
        if self.is_word(t):
            if t in ("if", "for", "while", "return", "const", "let", "var", "else", "case", "export", "throw", "switch", "try", "catch"):
                raise Broken(f"{t} in an expression")
            self.take()
            return Node("ident", start, self.at, name=t)
        raise Broken(f"{t!r} at {self.at}")

    def object(self) -> Node:
        n = Node("object", self.at)
        self.take("{")
        keep, self.no_in = self.no_in, False
        while self.peek() != "}":
            start = self.at
            if self.maybe("..."):
                n.kids.append(Node("spread", start, kids=[v := self.assignment()], end=v.end))
            else:
                n.kids.append(self.property())
            if not self.maybe(","):
                break
        self.no_in = keep
        self.take("}")
        n.end = self.at
        return n

    def property(self) -> Node:
        self.skip()
        start = self.at
        while self.peek() in ("async", "get", "set"):
            at = self.at
            self.take()
            if self.peek() in (":", ",", "}", "(", "=", "<"):
                self.at = at
                break
        self.maybe("*")
        key = self.property_key()
        extra = key.kids if key.kind == "computed" else []
        if self.peek() in ("(", "<"):
            return self.function_rest(Node("method", start, kids=list(extra), name=key.name, name_at=key.start))
        if self.maybe(":"):
            v = self.assignment()
            return Node("pair", start, v.end, [*extra, v], name=key.name)
        short = Node("shorthand", key.start, key.end, name=key.name)
        return self.with_default(short)

    # JSX

    def tag_name(self) -> str:
        m = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)").match(self.s, self.at)
        if not m:
            raise Broken("no tag name")
        self.at = m.end()
        return m[1]

    def element(self) -> Node:
        self.skip()
        start = self.at
        self.take("<")
        n = Node("jsx_element", start)
        if self.peek() == ">":
            self.at += 1
            n.kind = "jsx_fragment"
        else:
            n.info["name_at"] = self.at
            n.name = self.tag_name()
            if self.peek() == "<":
                self.attempt(self.type_arguments)
            while self.peek() not in (">", "/", ">>", ">=", ">>>"):
                n.kids.append(self.attribute())
            if self.maybe("/"):
                self.skip()
                if self.s[self.at : self.at + 1] != ">":
                    raise Broken("no end of a tag")
                self.at += 1
                n.kind, n.end = "jsx_self_closing", self.at
                return n
            self.at += 1
        while True:
            at = self.at
            ends = [i for i in (self.s.find("<", at), self.s.find("{", at)) if i >= 0]
            if not ends:
                raise Broken("an element is not closed")
            end = min(ends)
            if self.s[at:end].strip():
                n.kids.append(Node("jsx_text", at, end, name=self.s[at:end].strip()))
            self.at = end
            if self.s[end] == "{":
                n.kids.append(self.container())
            elif re.compile(r"<\s*/").match(self.s, end):
                close = self.s.find(">", end)
                if close < 0:
                    raise Broken("a closing tag is not closed")
                self.at = n.end = close + 1
                return n
            else:
                n.kids.append(self.element())

    def container(self) -> Node:
        n = Node("jsx_expression", self.at)
        self.take("{")
        if self.peek() != "}":
            self.maybe("...")
            keep, self.no_in = self.no_in, False
            n.kids.append(self.expression())
            self.no_in = keep
        self.take("}")
        n.end = self.at
        return n

    def attribute(self) -> Node:
        self.skip()
        start = self.at
        if self.peek() == "{":
            return self.container()
        n = Node("jsx_attribute", start, name=self.tag_name())
        if self.peek() == "=":
            self.take()
            t = self.peek()
            if t in "'\"" and t:
                q, at = t, self.at
                end = self.s.find(q, at + 1)
                if end < 0:
                    raise Broken("a value is not closed")
                self.at = end + 1
                n.kids.append(Node("string", at, self.at, name=self.s[at + 1 : end]))
            elif t == "{":
                n.kids.append(self.container())
            else:
                n.kids.append(self.element())
        n.end = self.at
        return n

    # statements

    def program(self) -> Node:
        n = Node("program", 0, len(self.s))
        if self.s.startswith("#!"):
            self.at = (self.s.find("\n") + 1) or len(self.s)
        while True:
            n.kids += self.statements("")
            if not self.peek():
                return n
            self.at += 1  # a bracket that closes nothing

    def statements(self, close: str) -> list[Node]:
        out = []
        while True:
            t = self.peek()
            if not t or t == close or t == "}":
                return out
            at = self.at
            keep = self.depth, self.no_in
            try:
                out.append(self.statement())
            except (Broken, RecursionError):
                self.depth, self.no_in = keep
                self.at = at
                out.append(self.error())

    def error(self) -> Node:
        """Over what cannot be read, up to the end of a line outside brackets."""
        start = self.at
        while True:
            t = self.peek()
            if not t or t == "}":
                break
            if self.at > start and self.newline_before():
                break
            if t in ("(", "[", "{"):
                close = {"(": ")", "[": "]", "{": "}"}[t]
                if self.attempt(lambda t=t, close=close: (self.balanced(t, close), True)[1]):
                    continue
            self.at += len(t)
            if t == ";":
                break
        if self.at == start:
            self.at += 1
        return Node("error", start, self.at)

    def finish(self, n: Node) -> Node:
        n.end = self.at
        self.maybe(";")
        return n

    def condition(self) -> Node:
        self.take("(")
        e = self.expression()
        self.take(")")
        return e

    def statement(self) -> Node:
        t = self.peek()
        start = self.at
        rest = self.s[self.at + len(t) : self.at + len(t) + 40].lstrip()
        if t == "{":
            return self.body()
        if t == ";":
            self.take()
            return Node("empty", start, self.at)
        if t == "if":
            self.take()
            c = self.condition()
            then = self.statement()
            n = Node("if", start, then.end, [c, then])
            if self.maybe("else"):
                other = self.statement()
                n.kids.append(Node("else", other.start, other.end, [other]))
                n.end = other.end
            return n
        if t == "for":
            return self.for_(start)
        if t == "while":
            self.take()
            c = self.condition()
            b = self.statement()
            return Node("while", start, b.end, [c, b])
        if t == "do":
            self.take()
            b = self.statement()
            self.take("while")
            c = self.condition()
            return self.finish(Node("do", start, kids=[b, c]))
        if t == "switch":
            return self.switch(start)
        if t == "try":
            self.take()
            n = Node("try", start, kids=[self.body()])
            if self.peek() == "catch":
                at = self.at
                self.take()
                c = Node("catch", at)
                if self.maybe("("):
                    c.kids.append(Node("parameters", self.at, kids=[Node("parameter", self.at, kids=[self.pattern()], rest=False, loose=True)]))
                    self.annotation()
                    self.take(")")
                c.kids.append(self.body())
                c.end = self.at
                n.kids.append(c)
            if self.peek() == "finally":
                at = self.at
                self.take()
                b = self.body()
                n.kids.append(Node("finally", at, b.end, [b]))
            n.end = self.at
            return n
        if t in ("return", "throw"):
            self.take()
            n = Node(t, start)
            if self.peek() not in (";", "}", "") and not self.newline_before():
                n.kids.append(self.expression())
            return self.finish(n)
        if t in ("break", "continue", "debugger"):
            self.take()
            if self.is_word(self.peek()) and not self.newline_before():
                self.take()
            return self.finish(Node(t, start))
        if t == "import" and not rest.startswith(("(", ".")):
            return self.import_(start)
        if t == "export":
            return self.export(start)
        declared = self.declaration(t, start, rest)
        if declared is not None:
            return declared
        if self.is_word(t) and rest.startswith(":") and not rest.startswith("::"):
            self.take()
            self.take(":")
            return self.statement()
        e = self.expression()
        return self.finish(Node("expression", start, kids=[e]))

    def declaration(self, t: str, start: int, rest: str) -> Node | None:
        if t == "function" or t == "async" and re.match(r"function\b", rest):
            self.maybe("async")
            return self.function("function", start)
        if t in ("const", "let", "var") and not (t == "let" and not re.match(r"[\w$\[{]", rest)):
            if t == "const" and re.match(r"enum\b", rest):
                self.take()
                return self.enum(start)
            n = self.variables(start)
            return self.finish(n)
        if t == "class" or t == "abstract" and re.match(r"class\b", rest):
            self.maybe("abstract")
            return self.class_("class", start)
        if t == "@":
            while self.peek() == "@":
                self.take()
                self.postfix(self.primary())
            self.maybe("export")
            self.maybe("default")
            self.maybe("abstract")
            return self.class_("class", start)
        if t == "interface" and WORD.match(rest):
            self.take()
            name = self.word()
            if self.peek() == "<":
                self.type_parameters()
            if self.maybe("extends"):
                self.type()
                while self.maybe(","):
                    self.type()
            self.balanced("{", "}")
            return Node("interface", start, self.at, name=name)
        if t == "type" and WORD.match(rest) and re.match(r"[\w$]+\s*[=<]", rest):
            self.take()
            name = self.word()
            if self.peek() == "<":
                self.type_parameters()
            self.take("=")
            self.type()
            return self.finish(Node("type_alias", start, name=name))
        if t == "enum" and WORD.match(rest):
            return self.enum(start)
        if t in ("namespace", "module") and re.match(r"[\w$.]+\s*\{|['\"]", rest):
            self.take()
            if self.peek() in "'\"":
                self.string()
            else:
                while self.word() and self.maybe("."):
                    pass
            b = self.body()
            return Node("namespace", start, b.end, [b])
        if t == "declare" and re.match(r"[a-z]", rest):
            self.take()
            if self.peek() == "global":
                self.take()
                b = self.body()
                return Node("namespace", start, b.end, [b])
            return self.statement()
        return None

    def enum(self, start: int) -> Node:
        self.take("enum")
        name = self.word()
        self.balanced("{", "}")
        return Node("enum", start, self.at, name=name)

    def variables(self, start: int) -> Node:
        n = Node("variables", start, name=self.take("const", "let", "var"))
        while True:
            self.skip()
            at = self.at
            p = self.pattern()
            self.maybe("!")
            self.annotation()
            d = Node("declarator", at, kids=[p], name=p.name or self.s[p.start : p.end])
            if self.maybe("="):
                d.kids.append(self.assignment())
            d.end = self.at
            n.kids.append(d)
            if not self.maybe(","):
                break
        n.end = self.at
        return n

    def for_(self, start: int) -> Node:
        self.take("for")
        self.maybe("await")
        self.take("(")
        kids, kind = [], "for"
        if self.peek() != ";":
            self.no_in = True
            self.skip()
            if self.peek() in ("const", "let", "var"):
                kids.append(self.variables(self.at))
            else:
                kids.append(self.expression())
            self.no_in = False
        if self.peek() in ("of", "in"):
            kind = "for_each"
            self.take()
            kids.append(self.expression())
        else:
            self.take(";")
            if self.peek() != ";":
                kids.append(self.expression())
            self.take(";")
            if self.peek() != ")":
                kids.append(self.expression())
        self.take(")")
        b = self.statement()
        return Node(kind, start, b.end, [*kids, b])

    def switch(self, start: int) -> Node:
        self.take("switch")
        n = Node("switch", start, kids=[self.condition()])
        self.take("{")
        while self.peek() != "}":
            at = self.at
            if self.maybe("default"):
                c = Node("default_case", at)
            else:
                self.take("case")
                c = Node("case", at, kids=[self.expression()])
            self.take(":")
            while self.peek() not in ("case", "default", "}", ""):
                c.kids.append(self.statement())
            c.end = self.at_before()
            n.kids.append(c)
        self.take("}")
        n.end = self.at
        return n

    def specifiers(self) -> list[tuple[str, str, int]]:
        """[(name, alias, place of the local name)] of a braced list."""
        out = []
        self.take("{")
        while self.peek() != "}":
            self.attempt(lambda: (self.take("type"), self.is_word(self.peek()) and self.peek() != "as" or self.take("}"))[1])
            t = self.peek()
            at = self.at
            name = self.string().name if t in "'\"" else self.word()
            alias = name
            if self.maybe("as"):
                self.skip()
                at = self.at
                alias = self.string().name if self.peek() in "'\"" else self.word()
            out.append((name, alias, at))
            if not self.maybe(","):
                break
        self.take("}")
        return out

    def import_(self, start: int) -> Node:
        self.take("import")
        n = Node("import", start, symbols=[], locals=[], source=None, type_only=False)
        if self.peek() == "type" and re.compile(r"type\s+(?!from\b|,|=)[\w${*]").match(self.s, self.at):
            self.take()
            n.info["type_only"] = True
        if self.peek() not in ("'", '"'):
            self.skip()
            if self.is_word(self.peek()):
                at = self.at
                local = self.word()
                if self.maybe("="):  # import a = require("b")
                    self.expression()
                    return self.finish(n)
                n.info["symbols"].append("default")
                n.info["locals"].append((local, at))
                self.maybe(",")
            if self.maybe("*"):
                self.take("as")
                self.skip()
                at = self.at
                n.info["locals"].append((self.word(), at))
            elif self.peek() == "{":
                found = self.specifiers()
                # names in braces come before the default name
                n.info["symbols"] = [x for x, _, _ in found] + n.info["symbols"]
                n.info["locals"] += [(alias, at) for _, alias, at in found]
            self.take("from")
            self.skip()
        self.peek()
        n.info["source"] = self.string().name
        if self.maybe("with", "assert"):
            self.balanced("{", "}")
        return self.finish(n)

    def export(self, start: int) -> Node:
        self.take("export")
        n = Node("export", start, symbols=[], names=[], source=None)
        t = self.peek()
        rest = self.s[self.at + len(t) : self.at + len(t) + 40].lstrip()
        if t == "*":
            self.take()
            if self.maybe("as"):
                self.word()
            self.take("from")
            self.peek()
            n.info["source"] = self.string().name
            return self.finish(n)
        if t == "{" or t == "type" and rest.startswith("{"):
            self.maybe("type")
            found = self.specifiers()
            n.info["names"] = [alias for _, alias, _ in found]
            if self.maybe("from"):
                self.peek()
                n.info["source"] = self.string().name
                n.info["symbols"] = [name for name, _, _ in found]
            return self.finish(n)
        if self.maybe("default"):
            n.info["names"] = ["default"]
            n.info["default"] = True
            self.skip()
            at, t = self.at, self.peek()
            rest = self.s[self.at + len(t) : self.at + len(t) + 40].lstrip()
            if t in ("function", "class", "async", "abstract", "interface"):
                d = self.declaration(t, at, rest)
                if d is not None:
                    n.kids.append(d)
                    n.end = d.end
                    return n
            n.kids.append(self.assignment())
            return self.finish(n)
        if t == "=":
            self.take()
            n.kids.append(self.expression())
            return self.finish(n)
        self.skip()
        d = self.statement()
        n.kids.append(d)
        n.end = d.end
        if d.kind in ("function", "class"):
            n.info["names"] = [d.name]
        elif d.kind == "variables":
            n.info["names"] = [v.name for v in d.kids] if d.name != "var" else []
        return n


def parse(text: str, jsx: bool) -> tuple[Node, Parser]:
    p = Parser(text, jsx)
    return p.program(), p
