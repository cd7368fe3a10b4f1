"""Structure of JavaScript, TypeScript and other sources."""

import pytest

from sourcelake.functions.parse import parse

TS = """import fs, {a as b, type T} from "m";
import type {X} from './x';
import * as ns from './ns.js';
import old = require("old");
import './side';
export * from "./again.ts";
const {c: d, e} = require('two');
@dec()
export abstract class A<T extends Map<string, {x: number}>> extends B implements I {
  private readonly x: {a: string} = {a: "1"};
  static #y = () => { go(); };
  constructor(private q: string) { super(q); }
  async *gen<T>(v: T): AsyncGenerator<T> { yield v; }
  get name(): string { return this.q; }
  abstract sig(x: number): void;
}
export interface I { m(a: string): {b: number}; p: string }
namespace N.M { export function inner() { if (a) { for (const x of y) { z(); } } } }
const LIMIT = 3, f = async (x: number): Promise<void> => { await ns.call(x); };
let g = function* () {}, h;
export default function () { return a ? b : c; }
do { k(); } while (1);
switch (x) { case 1: break; case 2: q?.r(); default: }
try {} catch (e) { require('child_process').exec("x"); }
const re = /[/"]}/.test(s), t = `a ${fn({b: 1})} \\` {`;
spawn("x", [], {shell: true, ...o}); cp["exec"]("y"); new Foo(); import("dyn"); obj.m({v: false, "w": true, u: z});
"""


def test_typescript():
    got = parse("typescript", TS)
    assert got["status"] == "complete"
    names = {s["qualified_name"]: (s["kind"], s["start_line"], s["end_line"]) for s in got["symbols"]}
    for name, what in {"A": ("class", 8, 16), "A.constructor": ("constructor", 12, 12), "A.gen": ("method", 13, 13), "A.name": ("method", 14, 14), "A.sig": ("method", 15, 15), "I": ("interface", 17, 17), "I.m": ("method", 17, 17), "LIMIT": ("constant", 19, 19), "f": ("function", 19, 19), "g": ("function", 20, 20), "re": ("constant", 25, 25)}.items():
        assert names[name] == what, name
    assert any(k.endswith("inner") and v[0] == "function" for k, v in names.items())
    calls = {c["callee"] for c in got["calls"]}
    assert {"dec", "go", "super", "z", "ns.call", "k", "q.r", "child_process.exec", "<dynamic>.test", "fn", "spawn", "cp.exec", "Foo", "obj.m"} <= calls
    assert not {"constructor", "gen", "sig", "m", "inner", "if", "while", "catch"} & calls
    options = {c["callee"]: c["options"] for c in got["calls"]}
    assert options["spawn"] == [] and options["obj.m"] == [{"name": "v", "value": False, "argument": 0}, {"name": "w", "value": True, "argument": 0}]
    imports = {(i["module"], i["imported_name"], i["local_name"]) for i in got["imports"]}
    assert imports == {("m", "default", "fs"), ("m", "a", "b"), ("./ns.js", None, "ns"), ("old", None, "old"), ("two", "c", "d"), ("two", "e", "e")}
    facts = {(d["syntax"], d["module"]) for d in got["dependencies"]}
    assert facts == {("static", m) for m in ("m", "./x", "./ns.js", "old", "./side", "./again.ts", "two", "child_process")} | {("dynamic", None)}
    assert got["branch_points"] == 2 + 1 + 1 + 2 + 1 and got["max_nesting"] == 2


@pytest.mark.parametrize(("source", "status"), [("", "complete"), ("f(", "partial"), ("'open", "partial"), ("`open ${a}", "partial"), ("}", "partial"), ("a = b / c / d; // } \n/* { */", "complete")])
def test_broken_scripts_are_partial(source, status):
    assert parse("javascript", source)["status"] == status


def test_long_scripts_take_linear_time():
    assert len(parse("javascript", "function f(a) { if (a) { g(a, {b: true}); } }\n" * 20_000)["symbols"]) == 20_000


def test_rust_lifetimes_and_arms():
    got = parse("rust", "impl<'a> S<'a> {\n  fn f(x: &'a str) -> char { match x { \"a\" => 'b', _ => '}' } }\n}\nfn g() { loop {} }\n")
    assert [(s["kind"], s["qualified_name"], s["end_line"]) for s in got["symbols"]] == [("method", "S.f", 2), ("function", "g", 4)]
    assert got["status"] == "complete" and got["branch_points"] == 3


def test_php_namespace_and_methods():
    got = parse("php", "<?php\nnamespace A\\B;\nclass C {\n  const X = 1;\n  function __construct() {}\n  public function m() { if (1) { unserialize($x); } }\n}\n")
    assert [(s["kind"], s["qualified_name"]) for s in got["symbols"]] == [("class", "A\\B.C"), ("constant", "A\\B.C.X"), ("constructor", "A\\B.C.__construct"), ("method", "A\\B.C.m")]


def test_python_flows():
    parsed = parse("python", "import subprocess\ndef f(x):\n    if x:\n        pass\n    y = x\n    subprocess.run(y, shell=True)\ndef g(x):\n    y = x if x else 1\n    eval(y)\n")
    assert parsed["flows"] == [{"kind": "process_execution", "source_line": 2, "sink_line": 6, "hops": 1}] and parsed["flow_status"] == "partial"
    call = parse("python", "é = f(a=True, b=1)")["calls"][0]
    assert (call["column"], call["options"]) == (5, [{"name": "a", "value": True, "argument": None}])
