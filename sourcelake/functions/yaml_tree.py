"""Execution signals of workflow and compose files, from a bounded subset of block YAML, and of manifests.

A file is read into a tree of maps, lists and texts by descent over its indentation; a file that is one JSON document
gives such a tree too, all of it at its start, where equal signals cannot be told apart. What a kind of file signals
is a table of paths through the tree. Constructs outside the subset (flow maps, anchors, aliases, tags, escapes
in keys, explicit and merge keys, tabs as indentation, other directives) and shapes that no path allows make the file
partial, never an error; what could be read still counts. Null contents count as empty.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F

#: Lines after this one are not read, and the file is partial.
MAX_LINES = 100_000
#: Members or items of one JSON value, and maps and lists inside each other; more make the file partial.
MAX_MEMBERS, MAX_DEPTH = 16_384, 100
SIGNALS = "struct<partial:boolean,signals:array<struct<kind:string,line:long,column:long>>>"
#: What may stand before a JSON document.
PREAMBLE = re.compile(r"\ufeff?(?:[ \t\r\n]|#[^\n]*(?:\n|$)|%YAML 1\.[12]\r?\n|---(?=\s|$))*")
DASH = re.compile(r"-(?:\s+|$)")
KEY = re.compile(r"""(?:"(?P<double>[^"\\]+)"|'(?P<single>[^']+)'|(?P<plain>[^\s"'&*!{}\[\]#?:,|>%@`](?:[^:#]|:(?=\S)|(?<=\S)\#)*?))\s*:(?=\s|$)""")
SCALAR = re.compile(r"[|>][-+0-9]{0,2}$")
COMMENTED = re.compile(r"""(?P<value>"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|.*?)(?:\s+\#.*|\s*)$""")
#: Values under these keys may have any form.
FREE = ("on", "permissions")
MUTABLE = re.compile(r"(?!$)(?:docker://(?!.*@sha256:[0-9a-fA-F]{64}$)|(?!docker://)(?!\./)(?!.*@[0-9a-fA-F]{40}$))")


class Node(NamedTuple):
    """``value`` is a list of (key, line, column, Node), a list of Nodes, or the source of a text."""

    kind: str
    value: list | str


class Row(NamedTuple):
    line: int
    indent: int
    column: int
    text: str


class Reader:
    """Descent over the rows of a text; ``partial`` and the lines inside block scalars (``hidden``) are found on the way."""

    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.partial, self.hidden = len(self.raw) > MAX_LINES, []
        del self.raw[MAX_LINES:]
        self.at, self.rest = 0, None

    def peek(self) -> Row | None:
        """The next row with content; the start or end of a document has indent -1."""
        while self.rest is None and self.at < len(self.raw):
            raw = self.raw[self.at].rstrip()
            text = raw.lstrip()
            if text and text[0] == "%":
                self.partial |= text not in ("%YAML 1.1", "%YAML 1.2")
            elif text and text[0] != "#":
                indent = len(raw) - len(raw.lstrip(" "))
                self.partial |= "\t" in raw[: len(raw) - len(text)]
                if re.match(r"(?:---|\.\.\.)(?:\s+#.*)?$", text):
                    indent = -1
                return Row(self.at + 1, indent, indent + 1, text)
            self.at += 1
        return self.rest

    def take(self) -> None:
        if self.rest is not None:
            self.rest = None
        self.at += 1

    def documents(self) -> Iterator[Node]:
        while (row := self.peek()) is not None:
            if row.indent < 0:
                self.take()
            else:
                yield self.block(0, 0)

    def block(self, least: int, depth: int) -> Node:
        """What the rows from here on that stand at ``least`` or deeper say."""
        row = self.peek()
        if row is not None and row.indent >= least and depth < MAX_DEPTH:
            if DASH.match(row.text):
                return self.sequence(row.indent, depth)
            if KEY.match(row.text):
                return self.mapping(row.indent, depth)
        self.partial |= depth >= MAX_DEPTH
        lines = []
        while (row := self.peek()) is not None and row.indent >= least and row.indent >= 0:
            lines.append(self.plain(row.text))
            self.take()
            if self.peek() is not None and (DASH.match(self.peek().text) or KEY.match(self.peek().text)) and least == 0:
                break
        return Node("text", " ".join(lines))

    def plain(self, text: str, free: bool = False) -> str:
        """A text without its comment; marks the file where the text is more than a text."""
        value = COMMENTED.match(text)["value"]
        quoted = value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1
        odd = value[:1] in ("&", "*", "!", "{") or value[:2] == "? " or (value[:1] == "[" and re.search("[:{]", value)) or (not quoted and re.search(r":(?:\s|$)", value) is not None)
        self.partial |= bool(odd) and not free
        return value

    def sequence(self, indent: int, depth: int) -> Node:
        items = []
        while (row := self.peek()) is not None and row.indent == indent and (m := DASH.match(row.text)):
            text = row.text[m.end() :]
            if not text or text[0] == "#":
                self.take()
                items.append(self.block(indent + 1, depth + 1))
            else:
                # what follows a dash stands as deep as it begins
                self.rest = Row(row.line, indent + m.end(), row.column, text)
                items.append(self.block(indent + 1, depth + 1))
        return Node("list", items)

    def mapping(self, indent: int, depth: int) -> Node:
        entries = []
        while (row := self.peek()) is not None and row.indent >= indent:
            m = KEY.match(row.text) if row.indent == indent else None
            if m is None:
                if row.indent == indent and DASH.match(row.text):
                    break
                # a text that goes on, or rows that belong to nothing
                self.plain(row.text.removeprefix("- "))
                self.take()
                continue
            key = m["double"] or m["single"] or m["plain"].rstrip()
            value = self.plain(row.text[m.end() :].strip(), key in FREE)
            self.partial |= key == "<<"
            self.take()
            below = self.peek()
            if SCALAR.match(value):
                self.skip_scalar(indent)
                child = Node("text", "")
            elif value:
                child = Node("text", value)
            elif below is not None and (below.indent > indent or (below.indent == indent and DASH.match(below.text))):
                child = self.sequence(indent, depth + 1) if below.indent == indent else self.block(indent + 1, depth + 1)
            else:
                child = Node("text", "")
            entries.append((key, row.line, row.column, child))
        return Node("map", entries)

    def skip_scalar(self, indent: int) -> None:
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > indent):
            self.hidden.append(self.at + 1)
            self.at += 1


def json_tree(value, depth: int = 0) -> Node | None:
    """The tree of a JSON value; None where a value has too many members or lies too deep."""
    if not isinstance(value, (dict, list)):
        return Node("text", json.dumps(value))
    if len(value) > MAX_MEMBERS or depth > MAX_DEPTH:
        return None
    if isinstance(value, list):
        return Node("list", [json_tree(x, depth + 1) for x in value])
    return Node("map", [(k, 1, 1, json_tree(v, depth + 1)) for k, v in value.items()])


#: Paths that signal, by kind of file: keys, ``*`` for any key and ``[]`` for the items of a list.
PATHS = {
    "workflow": {("on",): "github_workflow_triggers", ("permissions",): "github_workflow_permissions", ("jobs", "*", "permissions"): "github_workflow_permissions", ("jobs", "*", "uses"): "github_workflow_uses", ("jobs", "*", "steps", "[]", "uses"): "github_workflow_uses"},
    "compose": {("services", "*", "privileged"): "docker_privileged"},
}


def signalled(node: Node | None, paths: dict[tuple, str], at: int = 0) -> Iterator[tuple[str, int, int, Node | None] | None]:
    """(kind, line, column, value) of every key at the end of a path; None where the tree has another shape than the paths."""
    if node is None:
        yield None
        return
    steps = {p[at] for p in paths if len(p) > at}
    if not steps or (node.kind == "text" and node.value in ("", "null", "~")):
        return
    if node.kind == "list" and "[]" in steps:
        for item in node.value:
            yield from signalled(item, {p: k for p, k in paths.items() if p[at] == "[]"}, at + 1)
    elif node.kind == "map" and steps - {"[]"}:
        for key, line, column, child in node.value:
            own = {p: k for p, k in paths.items() if p[at] in (key, "*")}
            for kind in {k for p, k in own.items() if len(p) == at + 1}:
                yield kind, line, column, child
            if deeper := {p: k for p, k in own.items() if len(p) > at + 1}:
                yield from signalled(child, deeper, at + 1)
    elif at:
        yield None


def kinds_of(kind: str, value: Node | None) -> list[str] | None:
    """The signals of a key; None where its value is none that can be told."""
    text = value.value if value is not None and value.kind == "text" else None
    if kind == "github_workflow_uses":
        return None if text is None else [kind] + ["github_workflow_mutable_ref"] * bool(MUTABLE.match(text.strip("\"'")))
    if kind == "docker_privileged":
        return {"true": [kind], "false": []}.get(text.lower()) if text is not None else None
    return [kind]


def scan(text: str | None, kind: str | None) -> dict:
    """Whether the file is partial, and its signals."""
    paths, text = PATHS.get(kind, {}), text or ""
    start, partial = PREAMBLE.match(text).end(), False
    if not paths:
        return {"partial": False, "signals": []}
    if text[start : start + 1] in ("{", "["):
        try:
            trees = [json_tree(json.loads(text[start:]))]
        except (ValueError, RecursionError):
            trees = [None]
        partial = trees[0] is not None and trees[0].kind != "map"
    else:
        reader = Reader(text.removeprefix("\ufeff"))
        trees = list(reader.documents())
        partial = reader.partial
    out, seen = [], set()
    for found in (x for tree in trees for x in signalled(tree, paths)):
        kinds = kinds_of(found[0], found[3]) if found else None
        partial |= kinds is None
        for k in kinds or ():
            signal = {"kind": k, "line": found[1], "column": found[2]}
            key = tuple(signal.values())
            partial |= key in seen
            out += [signal] * (key not in seen)
            seen.add(key)
    out.sort(key=lambda s: s["line"])
    return {"partial": bool(partial), "signals": out}


def scalar_lines(text: str | None) -> list[int]:
    """The lines inside block scalars of a YAML text."""
    reader = Reader((text or "").removeprefix("\ufeff"))
    for _ in reader.documents():
        pass
    return reader.hidden


def scan_manifest(text: str | None, kind: str | None) -> dict:
    """Signals of package.json and composer.json (``package``, ``composer``: a non-empty object of scripts) and of Cargo.toml (``cargo``)."""
    try:
        value = tomllib.loads(text or "") if kind == "cargo" else json.loads(text or "")
    except (ValueError, RecursionError):
        return {"partial": kind is not None, "signals": []}
    inner = lambda v, *keys: inner(v.get(keys[0]), *keys[1:]) if keys and isinstance(v, dict) else None if keys else v
    kinds = []
    if kind == "cargo":
        targets = inner(value, "target")
        with_build = [value, *(targets.values() if isinstance(targets, dict) else ())]
        if inner(value, "package", "build") not in (None, False):
            kinds.append("cargo_build_script")
        if any(isinstance(t, dict) and "build-dependencies" in t for t in with_build):
            kinds.append("cargo_build_dependencies")
    elif isinstance(inner(value, "scripts"), dict) and inner(value, "scripts"):
        kinds.append(f"{kind}_script")
    return {"partial": False, "signals": [{"kind": k, "line": 1, "column": 1} for k in kinds]}


def _scanned(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(c, k) for c, k in zip(content, kind)], columns=["partial", "signals"])


def _scanned_manifests(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan_manifest(c, k) for c, k in zip(content, kind)], columns=["partial", "signals"])


def _scalar_lines(content: pd.Series) -> pd.Series:
    return pd.Series([scalar_lines(c) for c in content], dtype=object)


def lines_in_scalars(content):
    """The lines inside block scalars of YAML contents, as a column of arrays."""
    return F.pandas_udf(_scalar_lines, "array<long>")(content)


#: Manifests with signals.
MANIFEST_KINDS = {"package.json": "package", "composer.json": "composer", "Cargo.toml": "cargo"}


def manifest_signals(files):
    """(relative_path, partial, signals) of package, Composer and Cargo manifests; other files never reach Python."""
    pairs = F.create_map(*[F.lit(x) for kv in MANIFEST_KINDS.items() for x in kv])
    rows = files.select("relative_path", "content", F.try_element_at(pairs, F.substring_index("relative_path", "/", -1)).alias("kind")).where("kind is not null")
    return rows.select("relative_path", F.pandas_udf(_scanned_manifests, SIGNALS)("content", "kind").alias("s")).select("relative_path", "s.partial", "s.signals")


def file_kind(path):
    """``workflow`` or ``compose`` by path, else null."""
    name = F.substring_index(path, "/", -1)
    return F.when(path.rlike(r"^\.github/workflows/.*\.ya?ml$"), "workflow").when(name.rlike(r"^(?:docker-)?compose(?:\.[^/]*)?\.ya?ml$"), "compose")


def yaml_signals(files):
    """(relative_path, partial, signals) of workflow and compose files; other files never reach Python."""
    rows = files.select("relative_path", "content", file_kind(F.col("relative_path")).alias("kind")).where("kind is not null")
    return rows.select("relative_path", F.pandas_udf(_scanned, SIGNALS)("content", "kind").alias("s")).select("relative_path", "s.partial", "s.signals")
