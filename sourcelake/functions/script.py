"""Structure of JavaScript and TypeScript sources: tokens, brackets, then declarations by descent into blocks."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*(?s:.*?)\*/)
    |(?P<string>"(?:\\(?s:.)|[^"\\\n])*"|'(?:\\(?s:.)|[^'\\\n])*')
    |(?P<name>\#?[A-Za-z_$\u0080-\U0010ffff][\w$]*)
    |(?P<number>(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?)
    |(?P<mark>=>|\?\.(?!\d)|\?\?=?|\.\.\.|[=!]==?|&&=?|\|\|=?|\+\+|--|[-+*/%&|^<>]=|(?s:.))""",
    re.VERBOSE,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words before which a slash divides nothing.
BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "delete", "void", "throw", "in", "of", "case", "do", "else", "instanceof", "constructor", "with"}
MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare", "accessor"}
PAIRS = {")": "(", "]": "[", "}": "{"}
MAX_OPTIONS = 4096


class Token(NamedTuple):
    kind: str
    text: str
    at: int


def tokens(source: str) -> tuple[list[Token], bool]:
    """The tokens without white space and comments, and whether all of the source was understood. A template is one token but for the code in it."""
    out, at, whole, inner = [], 0, True, []
    while at < len(source):
        c = source[at]
        if c == "`" or (c == "}" and inner and inner[-1] == 0):
            if c == "}":
                inner.pop()
                out.append(Token("mark", ")", at))
            end = at + 1
            while end < len(source) and source[end] != "`" and not source.startswith("${", end):
                end += 2 if source[end] == "\\" else 1
            whole &= end < len(source)
            if c == "`":
                out.append(Token("template", source[at : end + 1], at))
            if source.startswith("${", end):
                out.append(Token("mark", "(", end))
                inner.append(0)
                end += 1
            at = end + 1
            continue
        if c == "/" and source[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1] if out else None
            if last is None or (last.kind == "mark" and last.text not in (")", "]", "}", "++", "--")) or last.text in BEFORE_REGEX:
                if m := REGEX.match(source, at):
                    out.append(Token("regex", m[0], at))
                    at = m.end()
                    continue
        m = TOKEN.match(source, at)
        kind, text = m.lastgroup, m[0]
        if kind != "space":
            if inner and text in "{}":
                inner[-1] += 1 if text == "{" else -1
            whole &= not (kind == "mark" and text in "\"'")
            out.append(Token(kind, text, at))
        at = m.end()
    return out, whole and not inner


class Script:
    """One file; ``out`` gathers its record."""

    def __init__(self, source: str, typed: bool):
        self.source, self.typed = source, typed
        self.tokens, whole = tokens(source)
        self.lines = [i for i, c in enumerate(source) if c == "\n"]
        self.pair: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in "([{":
                open_.append(i)
            elif t.kind == "mark" and t.text in PAIRS:
                if open_ and self.tokens[open_[-1]].text == PAIRS[t.text]:
                    self.pair[i] = open_[-1]
                    self.pair[open_.pop()] = i
                else:
                    whole = False
        self.whole = whole and not open_
        self.symbols, self.imports, self.dependencies, self.calls = [], [], [], []
        self.declared: set[int] = set()
        self.functions = 0

    # ---- places

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.lines, self.tokens[min(i, len(self.tokens) - 1)].at) + 1

    def column(self, i: int) -> int:
        at = self.tokens[i].at
        n = bisect.bisect_left(self.lines, at)
        return at - (self.lines[n - 1] + 1 if n else 0) + 1

    def close(self, i: int) -> int:
        """The partner of a bracket; the end of the file for one that is never closed."""
        return self.pair.get(i, len(self.tokens) - 1)

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def past_type(self, i: int, stop: str) -> int:
        """The first token from i on, at this depth, that is one of ``stop`` (or ends the statement)."""
        while i < len(self.tokens) and self.text(i) not in stop and self.text(i) not in (";", ")", "]", "}"):
            # an object type stands where a body would: it follows a mark
            i = self.close(i) + 1 if self.text(i) in ("(", "[") or (self.text(i) == "{" and "{" not in stop) else i + 1
        return i

    def angle(self, i: int) -> int:
        """Past the type parameters that may begin at i."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            depth += {"<": 1, ">": -1}.get(self.text(i), 0)
            i = self.close(i) + 1 if self.text(i) in ("(", "[", "{") else i + 1
            if depth == 0:
                break
        return i

    def header(self, i: int) -> int:
        """The brace of the body of the class or interface whose header goes on at i."""
        while i < len(self.tokens) and self.text(i) not in ("{", ";", ")", "]", "}"):
            i = self.angle(i) if self.text(i) == "<" else self.close(i) + 1 if self.text(i) in ("(", "[") else i + 1
        return i

    def signature(self, i: int) -> int | None:
        """The index of the body's brace, or past the end of a signature without one, from type parameters or ``(`` on; None if there is neither."""
        i = self.angle(i)
        if self.text(i) != "(":
            return None
        i = self.close(i) + 1
        if self.text(i) == ":":
            i += 1
            while i < len(self.tokens) and self.text(i) not in (";", ",", ")", "=>", "="):
                if self.text(i) == "{" and self.text(i - 1) not in (":", "|", "&", "<", "is"):
                    break
                if self.text(i) in ("(", "[", "{"):
                    i = self.close(i)
                elif self.text(i) == "}" or (self.line(i) > self.line(i - 1) and self.text(i - 1) not in (":", "|", "&", "=>")):
                    break
                i += 1
        return i

    def symbol(self, kind: str, name: str, scope: list[str], first: int, last: int) -> None:
        self.symbols.append({"kind": kind, "name": name, "qualified_name": ".".join([*scope, name]), "start_line": self.line(first), "end_line": self.line(max(first, last))})

    # ---- declarations

    def block(self, lo: int, hi: int, scope: list[str]) -> None:
        i = first = lo
        fresh = True
        while i < hi:
            t = self.text(i)
            if self.tokens[i].kind == "mark" and t == "@" and self.is_name(i + 1):
                first, fresh = (i if fresh else first), False
                i = self.close(i + 2) + 1 if self.text(i + 2) == "(" else i + 2
                continue
            if self.tokens[i].kind == "name" and t in ("export", "default", "declare", "abstract", "async") and self.text(i - 1) != ".":
                first, fresh = (i if fresh else first), False
                i += 1
                continue
            start = i if fresh else first
            to = self.declaration(i, start, scope) if self.tokens[i].kind == "name" and self.text(i - 1) not in (".", "?.") else None
            if to is not None:
                i, fresh = to, True
                continue
            if self.tokens[i].kind == "mark" and t in "([{":
                self.block(i + 1, self.close(i), scope)
                i = self.close(i)
            i, fresh = i + 1, True

    def declaration(self, i: int, first: int, scope: list[str]) -> int | None:
        """Past the declaration that begins at i, or None."""
        t, name = self.text(i), self.text(i + 1)
        if t == "class":
            named = self.is_name(i + 1) and name not in ("extends", "implements")
            body = self.header(i + 1)
            if self.text(body) != "{":
                return None
            return self.class_body(i, body, name if named else None, first, scope)
        if t == "interface" and self.typed and self.is_name(i + 1):
            body = self.header(i + 1)
            self.symbol("interface", name, scope, first, self.close(body))
            self.members(body + 1, self.close(body), [*scope, name])
            return self.close(body) + 1
        if t in ("namespace", "module") and self.typed and (self.is_name(i + 1) or self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "string"):
            body = self.past_type(i + 1, "{")
            if self.text(body) == "{":
                self.symbol("module", name.strip("\"'"), scope, first, self.close(body))
                self.block(body + 1, self.close(body), [*scope, name.strip("\"'")])
                return self.close(body) + 1
        if t == "function":
            at = i + 1 + (name == "*")
            named = self.is_name(at)
            body = self.signature(at + named)
            if body is None:
                return None
            self.declared.add(at)
            self.functions += 1
            return self.body(self.text(at) if named else None, "function", first, at + named, body, scope)
        if t in ("const", "let", "var") and name != "enum":
            return self.declarators(i, first, scope)
        if t == "import" and name not in ("(", "."):
            return self.import_(i)
        return None

    def body(self, name: str | None, kind: str, first: int, params: int, body: int, scope: list[str]) -> int:
        inner = [*scope, name] if name else scope
        has = self.text(body) == "{"
        last = self.close(body) if has else min(body, len(self.tokens)) - (self.text(body) != ";")
        if name:
            self.symbol(kind, name, scope, first, last)
        opened = self.angle(params)
        self.block(opened + 1, self.close(opened), inner)
        if has:
            self.block(body + 1, last, inner)
        return last + 1

    def class_body(self, i: int, body: int, name: str | None, first: int, scope: list[str]) -> int:
        if name:
            self.symbol("class", name, scope, first, self.close(body))
        self.block(i + 1 + bool(name), body, scope)
        self.members(body + 1, self.close(body), [*scope, name] if name else scope)
        return self.close(body) + 1

    def members(self, lo: int, hi: int, scope: list[str]) -> None:
        i = lo
        while i < hi:
            first = i
            while i < hi and ((self.text(i) in MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ":", "?", "<", "!", ",")) or self.text(i) in ("*", "@")):
                if self.text(i) == "@":
                    i = self.close(i + 2) if self.text(i + 2) == "(" else i + 1
                i += 1
            named = i < hi and self.tokens[i].kind in ("name", "string", "number")
            at = i + 1 + (self.text(i + 1) in ("?", "!"))
            body = self.signature(at) if named else None
            if body is not None:
                name = self.text(i).strip("\"'")
                self.declared.add(i)
                self.functions += 1
                i = self.body(name, "constructor" if name == "constructor" else "method", first, at, body, scope)
                continue
            # a field, up to the end of its statement
            while i < hi and self.text(i) not in (";", ","):
                if self.text(i) in ("(", "[", "{"):
                    self.block(i + 1, self.close(i), scope)
                    i = self.close(i)
                if i + 1 < hi and self.line(i + 1) > self.line(i) and self.text(i) not in ("=", ":", "|", "&", "=>", "?", "+", "."):
                    break
                i += 1
            i += 1

    def value_end(self, i: int) -> int:
        """Past the expression that begins at i: at ``,`` or ``;`` of this depth, a closing bracket, or a line that cannot go on."""
        begin = i
        while i < len(self.tokens) and self.text(i) not in (",", ";", ")", "]", "}"):
            t = self.tokens[i]
            if i > begin and self.line(i) > self.line(i - 1) and (t.kind in ("name", "string", "number") and t.text not in ("in", "of", "instanceof", "as", "satisfies")) and not (self.tokens[i - 1].kind == "mark" and self.text(i - 1) not in (")", "]", "}")):
                break
            i = self.close(i) + 1 if t.kind == "mark" and t.text in "([{" else i + 1
        return i

    def declarators(self, i: int, first: int, scope: list[str]) -> int:
        constant, single = self.text(i) == "const", True
        i += 1
        while i < len(self.tokens):
            at, names = i, self.is_name(i)
            i = self.close(i) + 1 if self.text(i) in ("{", "[") else i + 1
            if self.text(i) == "!":
                i += 1
            if self.text(i) == ":":
                i = self.past_type(i + 1, "=,")
            if self.text(i) != "=":
                if self.text(i) in ("of", "in") or not names:
                    return i
            else:
                value, end = i + 1, self.value_end(i + 1)
                multiple = self.text(end) == ","
                start = first if single and not multiple else at
                self.bound(at, value, end)
                name = self.text(at)
                v = value + (self.text(value) == "async" and self.line(value + 1) == self.line(value))
                if names and self.text(v) == "function":
                    self.functions += 1
                    star = v + 1 + (self.text(v + 1) == "*")
                    params = star + self.is_name(star)
                    self.declared.add(star)
                    body = self.signature(params)
                    i = self.body(name, "function", start, params, body, scope) if body is not None else end
                elif names and self.text(v) == "class":
                    body = self.header(v + 1)
                    i = self.class_body(v, body, name, start, scope)
                elif names and (arrow := self.arrow(v, end)) is not None:
                    self.functions += 1
                    self.symbol("function", name, scope, start, end - 1)
                    self.block(v, end, [*scope, name])
                    i = end
                else:
                    if names and constant:
                        self.symbol("constant", name, scope, start, end - 1)
                    self.block(value, end, scope)
                    i = end
            if self.text(i) != ",":
                return i
            single = False
            i += 1
        return i

    def arrow(self, i: int, end: int) -> int | None:
        """The arrow of an arrow function that begins at i."""
        if self.is_name(i) and self.text(i + 1) == "=>":
            return i + 1
        body = self.signature(i)
        return body if body is not None and body < end and self.text(body) == "=>" else None

    # ---- modules

    def module(self, i: int) -> str | None:
        return self.text(i)[1:-1] if i < len(self.tokens) and self.tokens[i].kind == "string" else None

    def import_(self, i: int) -> int:
        at = i + 1
        typed = self.text(at) == "type" and self.text(at + 1) not in ("from", ",", "=")
        at += typed
        if (module := self.module(at)) is not None:
            self.depends(module, i)
            return at + 1
        found = []
        if self.is_name(at) and self.text(at + 1) == "=" and self.text(at + 2) == "require":
            module = self.module(at + 4)
            if module is not None:
                self.imports.append({"module": module, "imported_name": None, "local_name": self.text(at)})
                self.depends(module, i)
            self.declared.add(at + 2)
            return self.close(at + 3) + 1
        while at < len(self.tokens) and self.text(at) != "from" and self.text(at) != ";":
            if self.text(at) == "{":
                end, k = self.close(at), at + 1
                while k < end:
                    only_type = self.text(k) == "type" and self.text(k + 1) not in (",", "}", "as")
                    k += only_type
                    local = self.text(k + 2) if self.text(k + 1) == "as" else self.text(k)
                    if not only_type and (self.is_name(k) or self.module(k)):
                        found.append((self.text(k).strip("\"'"), local))
                    k = next((j for j in range(k, end) if self.text(j) == ","), end) + 1
                at = end
            elif self.text(at) == "*" and self.text(at + 1) == "as":
                found.append((None, self.text(at + 2)))
                at += 2
            elif self.is_name(at):
                found.append(("default", self.text(at)))
            at += 1
        module = self.module(at + 1)
        if module is None:
            return at + 1
        self.depends(module, i)
        if not typed:
            self.imports += [{"module": module, "imported_name": a, "local_name": b} for a, b in found]
        return at + 2

    def depends(self, module: str | None, i: int) -> None:
        self.dependencies.append({"syntax": "static" if module is not None else "dynamic", "module": module, "line": self.line(i)})

    def bound(self, at: int, value: int, end: int) -> None:
        """The imports of ``name = require("m")`` and ``{a: b} = require("m")``."""
        if self.text(value) != "require" or self.text(value + 1) != "(" or self.close(value + 1) + 1 < end or (module := self.module(value + 2)) is None:
            return
        if self.is_name(at):
            self.imports.append({"module": module, "imported_name": None, "local_name": self.text(at)})
        elif self.text(at) == "{":
            k, stop = at + 1, self.close(at)
            while k < stop:
                if self.is_name(k):
                    self.imports.append({"module": module, "imported_name": self.text(k), "local_name": self.text(k + 2) if self.text(k + 1) == ":" else self.text(k)})
                k = next((j for j in range(k, stop) if self.text(j) == ","), stop) + 1

    # ---- calls

    def callee(self, i: int) -> tuple[str, int] | None:
        """(name, first token) of what is called by the bracket at i."""
        parts, i = [], i - 1
        if self.text(i) == "?.":
            i -= 1
        while True:
            if self.is_name(i) and self.text(i - 1) in (".", "?."):
                parts.append(self.text(i))
                i -= 2
            elif self.text(i) == "]" and self.close(i) == i - 2 and self.tokens[i - 1].kind == "string":
                parts.append(self.text(i - 1)[1:-1])
                i -= 3
            elif self.is_name(i):
                parts.append(self.text(i))
                break
            elif self.text(i) == ")" and self.text(self.close(i) - 1) == "require" and self.module(self.close(i) + 1) in ("child_process", "node:child_process"):
                parts.append("child_process")
                i = self.close(i) - 1
                break
            elif self.text(i) in (")", "]", "}") or self.tokens[max(i, 0)].kind in ("string", "template", "regex", "number"):
                if not parts:
                    return None
                parts.append("<dynamic>")
                i = self.close(i) if i in self.pair else i
                break
            else:
                return None
        return ".".join(parts[::-1]), i

    def options(self, lo: int, hi: int) -> list[dict]:
        """Literal booleans of the objects among the arguments between lo and hi."""
        out, i, argument = [], lo, 0
        starts = [lo]
        while i < hi:
            if self.text(i) == ",":
                starts.append(i + 1)
            i = self.close(i) + 1 if self.tokens[i].kind == "mark" and self.text(i) in "([{" else i + 1
        if any(self.text(s) == "..." for s in starts if s < hi):
            return []
        for argument, s in enumerate(starts):
            if s >= hi or self.text(s) != "{":
                continue
            values, k, end = {}, s + 1, self.close(s)
            while k < end and values is not None:
                stop = k
                while stop < end and self.text(stop) != ",":
                    stop = self.close(stop) + 1 if self.tokens[stop].kind == "mark" and self.text(stop) in "([{" else stop + 1
                if self.text(k) in ("...", "["):
                    values = None
                    break
                name = self.text(k).strip("\"'")
                literal = self.text(k + 1) == ":" and stop == k + 3 and self.text(k + 2) in ("true", "false")
                values[name] = self.text(k + 2) == "true" if literal else None
                k = stop + 1
            out += [{"name": n, "value": v, "argument": argument} for n, v in (values or {}).items() if v is not None]
        return out[:MAX_OPTIONS]

    def all_calls(self) -> None:
        for i, t in enumerate(self.tokens):
            if t.kind == "name" and t.text == "export" and self.text(i - 1) != ".":
                at = i + 1
                if self.text(at) == "type":
                    at += 1
                if self.text(at) in ("*", "{"):
                    at = self.close(at) + 1 if self.text(at) == "{" else at + 1 + 2 * (self.text(at + 1) == "as")
                    if self.text(at) == "from" and self.module(at + 1) is not None:
                        self.depends(self.module(at + 1), i)
            if t.kind != "mark" or t.text != "(" or i == 0:
                continue
            before = self.angle_back(i)
            if before - 1 in self.declared or self.tokens[before - 1].kind not in ("name", "mark") and self.text(before - 1) != "]":
                continue
            found = self.callee(before)
            if found is None or found[0] in NOT_CALLED or self.text(found[1] - 1) == "function":
                continue
            name, at = found
            arguments = (i + 1, self.close(i))
            if name == "import":
                self.depends(None, at)
                continue
            if name == "require" and self.text(at - 1) != ".":
                self.depends(self.module(i + 1) if self.close(i) == i + 2 else None, at)
            options = self.options(*arguments)
            shell = [o["value"] for o in options if o["name"] == "shell" and o["argument"] in (1, 2)]
            self.calls.append({"callee": name, "line": self.line(at), "column": self.column(at), "shell": any(shell) if shell else None, "options": options})

    def angle_back(self, i: int) -> int:
        """Where the type arguments before the bracket at i begin, or i."""
        if self.text(i - 1) != ">" or not self.typed:
            return i
        depth, k = 0, i - 1
        while k >= max(0, i - 64):
            depth += {">": 1, "<": -1}.get(self.text(k), 0)
            if depth == 0:
                return k
            k -= 1
        return i

    # ---- control flow

    def control(self) -> tuple[int, int]:
        """(branches, deepest nesting of them)."""
        spans, ends_do = [], set()
        for i, t in enumerate(self.tokens):
            if t.kind == "name" and self.text(i - 1) not in (".", "?.") and self.text(i + 1) not in (":", "=>") or t.text == "case":
                if t.text == "do":
                    end = self.close(i + 1) if self.text(i + 1) == "{" else self.value_end(i + 1)
                    ends_do.add(end + 1 + (self.text(end) == ";"))
                    spans.append((i, end))
                elif t.text in ("if", "for", "while", "catch") and i not in ends_do and i not in self.declared:
                    head = i + 1 + (self.text(i + 1) == "await")
                    end = self.close(head) + 1 if self.text(head) == "(" else head
                    spans.append((i, self.close(end) if self.text(end) == "{" else self.value_end(end)))
                elif t.text == "case" and self.text(i - 1) in ("{", ";", "}", ":") or (t.text == "case" and self.line(i) > self.line(i - 1)):
                    spans.append((i, i))
            elif t.kind == "mark" and t.text == "?" and self.text(i + 1) not in (":", ")", ",", ";", "=", "(") or (t.text == "?" and self.text(i + 1) == "(" and not self.typed):
                spans.append((i, i))
        deepest, open_ = 0, []
        for a, b in sorted(spans):
            open_ = [x for x in open_ if x >= a]
            open_.append(b)
            deepest = max(deepest, len(open_))
        return len(spans), deepest


def parse_script(source: str, typed: bool) -> dict:
    """The record of a JavaScript or TypeScript source; ``partial`` where brackets, strings or templates do not close."""
    script = Script(source, typed)
    branches = nesting = 0
    if script.tokens:
        script.block(0, len(script.tokens), [])
        script.all_calls()
        branches, nesting = script.control()
    script.symbols.sort(key=lambda s: (s["start_line"], -s["end_line"], s["qualified_name"]))
    script.dependencies = [dict(x) for x in dict.fromkeys(tuple(d.items()) for d in sorted(script.dependencies, key=lambda d: d["line"]))]
    return {
        "status": "complete" if script.whole else "partial", "symbols": script.symbols, "calls": script.calls, "imports": script.imports, "dependencies": script.dependencies,
        "functions": script.functions, "branch_points": branches, "max_nesting": nesting, "flows": [], "flow_status": "unsupported",
    }
