"""Structure of sources: Python by its syntax tree, JavaScript and TypeScript by descent, other languages by their tokens, as one nested record per file."""

from __future__ import annotations

import ast
import bisect
import re

import pandas as pd
from pyspark.sql import functions as F

from sourcelake.functions.script import parse_script
from sourcelake.functions.secrets import HINT, MAX_MATCHES, detect, mask

MAX_HOPS, MAX_BYTES, MAX_INSPECTED = 8, 8 << 20, 1024
SUBPROCESS = {"run", "call", "Popen", "check_call", "check_output"}
PARSED = (
    "struct<status:string,symbols:array<struct<kind:string,name:string,qualified_name:string,start_line:long,end_line:long>>,calls:array<struct<callee:string,line:long,column:long,shell:boolean,options:array<struct<name:string,value:boolean,argument:int>>>>,"
    "imports:array<struct<module:string,imported_name:string,local_name:string>>,dependencies:array<struct<syntax:string,module:string,line:long>>,functions:long,branch_points:long,max_nesting:long,flows:array<struct<kind:string,source_line:long,sink_line:long,hops:long>>,flow_status:string,reason:string>"
)


def _empty(status: str, reason: str | None = None) -> dict:
    return {"reason": reason, "status": status, "symbols": [], "calls": [], "imports": [], "dependencies": [], "functions": None, "branch_points": None, "max_nesting": None, "flows": [], "flow_status": "partial" if status == "partial" else "unsupported"}


def _callee(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{_callee(node.value)}.{node.attr}"
    return "<dynamic>"


def _boolean(node: ast.AST) -> bool | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, bool) else None


class _Python(ast.NodeVisitor):
    def __init__(self, lines: list[str]) -> None:
        self.lines = lines
        self.out = _empty("complete")
        self.out |= {"functions": 0, "branch_points": 0, "max_nesting": 0}
        self.scope: list[tuple[str, str]] = []
        self.depth = 0

    def _symbol(self, kind: str, name: str, node: ast.AST) -> None:
        first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
        self.out["symbols"].append({"kind": kind, "name": name, "qualified_name": ".".join([*[n for _, n in self.scope], name]), "start_line": first, "end_line": node.end_lineno})

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._symbol("class", node.name, node)
        self.scope.append(("class", node.name))
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        inside = self.scope and self.scope[-1][0] == "class"
        self._symbol("constructor" if inside and node.name == "__init__" else "method" if inside else "function", node.name, node)
        self.out["functions"] += 1
        self.scope.append(("function", node.name))
        self.generic_visit(node)
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def _branch(self, node: ast.AST) -> None:
        self.out["branch_points"] += 1
        self.depth += 1
        self.out["max_nesting"] = max(self.out["max_nesting"], self.depth)
        self.generic_visit(node)
        self.depth -= 1

    visit_If = visit_For = visit_AsyncFor = visit_While = visit_ExceptHandler = visit_IfExp = visit_match_case = _branch

    def visit_Assign(self, node: ast.Assign) -> None:
        if not self.scope or self.scope[-1][0] == "class":
            for t in node.targets:
                if isinstance(t, ast.Name) and re.fullmatch("[A-Z][A-Z0-9_]*", t.id):
                    self._symbol("constant", t.id, node)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.out["imports"].append({"module": a.name, "imported_name": None, "local_name": a.asname or a.name.split(".")[0]})
            self.out["dependencies"].append({"syntax": "static", "module": a.name, "line": node.lineno})

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.out["imports"].append({"module": base, "imported_name": a.name, "local_name": a.asname or a.name})
            self.out["dependencies"].append({"syntax": "static", "module": base if node.module else base + a.name, "line": node.lineno})

    def visit_Call(self, node: ast.Call) -> None:
        name = _callee(node.func)
        values: dict[str, bool | None] = {}
        for k in node.keywords:
            if k.arg is not None:  # a keyword that stands twice is an error of the source, not an override
                values[k.arg] = None if k.arg in values else _boolean(k.value)
        # offsets of the tree count bytes
        column = len(self.lines[node.lineno - 1].encode()[: node.col_offset].decode("utf-8", "replace")) + 1 if node.lineno <= len(self.lines) else 1
        options = [{"name": k, "value": v, "argument": None} for k, v in values.items() if v is not None]
        self.out["calls"].append({"callee": name, "line": node.lineno, "column": column, "shell": values.get("shell"), "options": options})
        if name in ("__import__", "importlib.import_module"):
            self.out["dependencies"].append({"syntax": "dynamic", "module": None, "line": node.lineno})
        self.generic_visit(node)


def _hops(node: ast.AST, taint: dict[str, tuple[int, int]]) -> tuple[int, int] | None:
    """(hops, line of the source) of the least tainted way into an expression."""
    if isinstance(node, ast.Name):
        return taint.get(node.id)
    if isinstance(node, ast.BinOp):
        return min(filter(None, (_hops(node.left, taint), _hops(node.right, taint))), default=None)
    if isinstance(node, ast.Call):
        best = min(filter(None, (_hops(a, taint) for a in [*node.args, *(k.value for k in node.keywords)])), default=None)
        return (best[0] + 1, best[1]) if best else None
    return None


def _way(node: ast.AST, taint: dict[str, tuple[int, int]]) -> tuple[tuple[int, int] | None, bool]:
    """(the least way, whether it is sure): an expression that names a tainted value in a form that is not followed is unsure."""
    found = _hops(node, taint)
    return found, found is not None or not any(isinstance(n, ast.Name) and n.id in taint for n in ast.walk(node))


def _sink(call: ast.Call) -> str | None:
    """What a call does with its first argument; names are taken as they stand, without the imports behind them."""
    callee = _callee(call.func)
    if callee in ("eval", "exec", "builtins.eval", "builtins.exec"):
        return "dynamic_evaluation"
    shell = [_boolean(k.value) for k in call.keywords if k.arg == "shell"]
    return "process_execution" if shell == [True] and callee.startswith("subprocess.") and callee.split(".", 1)[1] in SUBPROCESS else None


def _flows(tree: ast.Module, out: dict) -> None:
    sure, flows = True, set()
    for fn in [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]:
        taint = {a.arg: (0, fn.lineno) for a in [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs] if a.arg not in ("self", "cls")}
        for s in fn.body:
            if isinstance(s, (ast.Pass, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if not isinstance(s, (ast.Assign, ast.Return, ast.Expr)):
                sure = False  # control flow and other statements are not followed
                continue
            inspected = list(ast.walk(s.value)) if s.value is not None else []
            sure &= len(inspected) <= MAX_INSPECTED
            for call in [n for n in inspected[:MAX_INSPECTED] if isinstance(n, ast.Call)]:
                kind = _sink(call)
                first = next((a for a in call.args if not isinstance(a, ast.Starred)), None)
                if kind and first is not None:
                    found, known = _way(first, taint)
                    sure &= known and (found is None or found[0] <= MAX_HOPS)
                    if found and found[0] <= MAX_HOPS:
                        flows.add((call.lineno, found[1], found[0], kind))
            if isinstance(s, ast.Expr):
                sure &= isinstance(s.value, (ast.Call, ast.Name, ast.Constant))
            elif isinstance(s, ast.Assign):
                if len(s.targets) != 1 or not isinstance(s.targets[0], ast.Name):
                    sure = False
                    continue
                name, (found, known) = s.targets[0].id, _way(s.value, taint)
                sure &= known and (found is None or found[0] < MAX_HOPS)
                if found is None:
                    taint.pop(name, None)
                elif found[0] < MAX_HOPS:
                    taint[name] = (found[0] + 1, found[1])
    out["flows"] = [{"kind": k, "source_line": a, "sink_line": b, "hops": h} for b, a, h, k in sorted(flows)]
    out["flow_status"] = "complete" if sure else "partial"


def parse_python(source: str) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _empty("partial")
    v = _Python(re.split(r"\r\n|\r|\n", source))
    v.visit(tree)
    _flows(tree, v.out)
    v.out["symbols"].sort(key=lambda s: (s["start_line"], -s["end_line"], s["qualified_name"]))
    return v.out


#: Per language: comments and strings to blank out, symbols by kind, branch words.
_BLANK = {
    "shell": re.compile(r"(?m)(?<![\w$])#.*$|\"(?:\\.|[^\"\\])*\"|'[^']*'"),
    # a quote that closes behind one character is a literal, any other one a lifetime
    "rust": re.compile(r"//[^\n]*|/\*(?s:.*?)\*/|r(#*)\"(?s:.*?)\"\1|\"(?:\\(?s:.)|[^\"\\])*\"|'(?:\\(?:u\{[^}']*\}|x..|.)|[^'\\\n])'"),
    "php": re.compile(r"//[^\n]*|\#(?!\[)[^\n]*|/\*(?s:.*?)\*/|\"(?:\\(?s:.)|[^\"\\])*\"|'(?:\\(?s:.)|[^'\\])*'"),
}
_SYMBOLS = {
    "php": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("function", r"\bfunction\s+&?(\w+)"), ("constant", r"\bconst\s+(?:\w+\s+)?(\w+)\s*=")],
    "rust": [("class", r"\b(?:struct|enum)\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("function", r"\bfn\s+(\w+)"), ("module", r"\bmod\s+(\w+)"), ("impl", r"\bimpl\b(?:\s*<[^{;]*?>)?\s+(?:[^{;]*?\bfor\s+)?(\w+)")],
    "shell": [("function", r"(?m)^[ \t]*(?:function\s+)?([\w-]+)\s*\(\)\s*\{"), ("function", r"(?m)^[ \t]*function\s+([\w-]+)\s*\{")],
}
_BRANCHES = {
    "php": r"\b(?:if|elseif|for|foreach|do|case|catch)\b|(?<!\})\s*\bwhile\b|\?(?![>?:-])",
    "rust": r"\b(?:if|for(?!\s*<)|while|loop)\b|=>",
    "shell": r"\b(?:if|elif|for|while)\b|(?m:^[ \t]*[^()\s]+\)(?!\)))",
}
_WORDS = {"if", "for", "while", "switch", "catch", "function", "return", "match", "foreach", "elseif", "require", "array", "isset", "fn"}
#: Kinds that hold other symbols, and those whose functions are methods.
_SCOPES, _OWNERS = {"class", "interface", "trait", "module", "impl", "function", "method", "constructor"}, {"class", "interface", "trait", "impl"}


def _braces(code: str) -> tuple[dict[int, int], int, bool]:
    """Where each opening brace closes, the greatest depth, and whether all of them match."""
    pairs, open_, top, whole = {}, [], 0, True
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
            top = max(top, len(open_))
        elif open_:
            pairs[open_.pop()] = m.start()
        else:
            whole = False
    return pairs, top, whole and not open_


def parse_tokens(language: str, source: str) -> dict:
    code = _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    newlines = [m.start() for m in re.finditer("\n", source)]
    line = lambda i: bisect.bisect_left(newlines, i) + 1
    pairs, top, whole = _braces(code)
    out = _empty("complete" if whole or language == "shell" else "partial")
    found = []
    for kind, pattern in _SYMBOLS[language]:
        for m in re.finditer(pattern, code):
            brace, stop = code.find("{", m.end() - (code[m.end() - 1] == "{")), code.find(";", m.end())
            body = brace if brace >= 0 and not 0 <= stop < brace and kind != "constant" else None
            found.append((m.start(), pairs.get(body, len(code) - 1) if body is not None else stop if stop >= 0 else m.end(), kind, m[1]))
    namespace = re.search(r"\bnamespace\s+([\w\\]+)\s*;", code) if language == "php" else None
    scope: list[tuple[int, int, str, str]] = []
    for item in sorted(set(found)):
        start, end, kind, name = item
        scope = [x for x in scope if x[1] > start]
        owner = scope[-1][2] if scope else None
        if kind == "function" and owner in _OWNERS:
            kind = "constructor" if name == "__construct" else "method"
        if kind != "impl":
            names = ([namespace[1]] if namespace else []) + [x[3] for x in scope] + [name]
            out["symbols"].append({"kind": kind, "name": name, "qualified_name": ".".join(names), "start_line": line(start), "end_line": line(end)})
        if kind in _SCOPES:
            scope.append((start, end, kind, name))
    if language != "shell":
        for m in re.finditer(r"(?<![\w$])(?:new\s+)?([A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*!?\(", code):
            if m[1] not in _WORDS and not re.search(r"\b(?:function\s+&?|fn\s+)$", code[max(0, m.start() - 12) : m.start()]):
                before = code.rfind("\n", 0, m.start()) + 1
                out["calls"].append({"callee": m[1].lstrip("\\").replace("->", "."), "line": line(m.start()), "column": m.start() - before + 1, "shell": None, "options": []})
    functions = sum(s["kind"] in ("function", "method", "constructor") for s in out["symbols"])
    out |= {"functions": functions, "branch_points": len(re.findall(_BRANCHES[language], code)), "max_nesting": top, "flow_status": "unsupported"}
    out["symbols"].sort(key=lambda s: (s["start_line"], -s["end_line"], s["qualified_name"]))
    return out


def parse(language: str, source: str | None) -> dict:
    """The record of one file. A partial one has a reason: parse_error, parse_budget (over the limit of bytes) or redaction_budget
    (too many secrets to mask; nothing is extracted). Names that hold a secret are masked. Unsupported languages have no counts.
    """
    source = source or ""
    if len(source) > MAX_BYTES or (4 * len(source) > MAX_BYTES and len(source.encode("utf-8", "surrogatepass")) > MAX_BYTES):
        return _empty("partial", "parse_budget")
    secrets = detect(source) if re.search(HINT, source) else []
    if len(secrets) > MAX_MATCHES:
        return _empty("partial", "redaction_budget")
    if language == "python":
        out = parse_python(source)
    elif language in ("javascript", "typescript"):
        out = parse_script(source, language == "typescript")
    else:
        out = parse_tokens(language, source) if language in _SYMBOLS else _empty("unsupported")
    if secrets:
        for s in out["symbols"]:
            s |= {k: mask(s[k], detect(s[k])) for k in ("name", "qualified_name")}
    return {**out, "reason": "parse_error" if out["status"] == "partial" else None}


def _parse_columns(languages: pd.Series, sources: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(a, b) for a, b in zip(languages, sources)], columns=[*_empty("")])


def parse_source(language, source):
    """The record of a file as a column."""
    return F.pandas_udf(_parse_columns, PARSED)(language, source)
