"""Imports, secrets, rules and coverage over small sources."""

import pytest
from pyspark.sql import functions as F

from sourcelake.functions.parse import parse_source
from sourcelake.functions.secrets import detect
from sourcelake.operators import imports, security, statuses

AWS = "A" * 39 + "1"


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----\n", ["secret.private_key"]),
        ("-----BEGIN PRIVATE KEY-----\nno end", ["secret.private_key"]),
        ("ghp_" + "a" * 36, ["secret.github_token"]),
        ("ghp_" + "a" * 12, []),
        ("key AKIA" + "B" * 16, ["secret.aws_access_key"]),
        (f"aws_secret_access_key = '{AWS}'", ["secret.aws_secret_key"]),
        ("eyJhbGci.eyJzdWIi.c2lnbmF0", ["secret.jwt"]),
        ("Authorization: Bearer abcdefghijklmnop1234", ["secret.bearer_token"]),
        ("postgres://user:pa55word@host/db", ["secret.url_credentials"]),
        ("postgres://user:$PASS@host/db", []),
        ("https://abc123token@host/x", ["secret.url_token"]),
        ("api_key = 'a1b2c3d4e5f6g7h8i9'", ["secret.contextual_token"]),
        ("password = 'aaaaaaaaaaaaaaaaaaaa'", []),
        ("secret: process.env.SOME_SECRET_1234567", []),
    ],
)
def test_secret_rules(text, rules):
    assert [r for r, _, _ in detect("é " + text)] == rules
    for _, a, b in detect("é " + text):
        assert 3 <= a < b <= len(("é " + text).encode())


SOURCES = [
    ("a/x.ts", "typescript", "import {exec as run} from 'node:child_process';\nimport './y.ts';\nimport '../b/z.js';\nimport '../../out.js';\nimport './y';\nrun('x');\n"),
    ("a/y.ts", "typescript", "import cp from 'child_process';\ncp.spawn('x', [], {shell: true});\ncp.spawn('x', {shell: false});\nexec('no');\n"),
    ("b/z.js", "javascript", "const {execFile} = require('child_process');\nexecFile('x', [], {shell: true});\nfetch(u, {rejectUnauthorized: false});\n"),
    ("p/m.py", "python", "from .q import a\nfrom ..r import b\nfrom . import s\nfrom ...up import c\nimport os\n"),
    ("p/q.py", "python", "x = 1\n"),
    ("p/q/__init__.py", "python", ""),
    ("p/s/__init__.py", "python", ""),
    ("r.py", "python", "__import__(x)\n"),
]


@pytest.fixture(scope="module")
def code(spark):
    rows = spark.createDataFrame(SOURCES, "relative_path string, language string, content string")
    return rows.withColumn("parsed", parse_source("language", "content")).cache()


def test_imports_resolve_to_one_file(code):
    facts = imports.dependency_facts(code)
    got = {tuple(r) for r in imports.dependency_edges(facts, code).collect()}
    assert got == {("a/x.ts", "a/y.ts"), ("a/x.ts", "b/z.js"), ("p/m.py", "r.py"), ("p/m.py", "p/s/__init__.py")}  # q is a module and a package
    edges, n = imports.limited_edges(imports.dependency_edges(facts, code), 3)
    assert edges.count() == 3 and tuple(n.first()) == (3, 1)
    files = code.select("relative_path", "language", F.lit(False).alias("binary"))
    graph = imports.graph_statuses(statuses.file_statuses(files, code.select("relative_path", "parsed.status")), facts)
    assert {r.relative_path: r.graph_status for r in graph.collect()} == {p: "partial" if p == "r.py" else "complete" for p, _, _ in SOURCES}


def test_script_primitives_follow_aliases(code):
    got = {(r.relative_path, r.line, r.column) for r in security.primitive_findings(code).collect() if r.rule_id == "dangerous-process-execution"}
    assert got == {("a/x.ts", 6, 1), ("a/y.ts", 2, 1), ("b/z.js", 2, 1)}
    assert [tuple(r) for r in security.tls_signals(security.literal_options(code)).collect()] == [("tls_verification_disabled", "b/z.js", 3)]


def test_tracking(code):
    some = code.select("relative_path")
    assert {r.tracking for r in statuses.tracking(some, None).collect()} == {"unknown"}
    assert {r.relative_path for r in statuses.tracking(some, some.limit(2)).where("tracking = 'tracked'").collect()} == {r.relative_path for r in some.limit(2).collect()}


def test_configuration_skips_scalars_and_other_languages(spark):
    cors = "Access-Control-Allow-Origin: *"
    files = [(".github/workflows/w.yml", f"jobs:\n  a:\n    steps:\n      - run: |\n          uses: no/no@v1\n          {cors}\n      - uses: o/r@v1\n"), ("x.md", cors), ("x.yaml", f"a: |\n  {cors}\nb: 1\n{cors}\n"), ("x.py", f'h = "{cors}"')]
    got = security.configuration_findings(spark.createDataFrame(files, "relative_path string, content string")).collect()
    assert sorted((r.rule_id, r.relative_path, r.line) for r in got) == [("config-unpinned-github-action", ".github/workflows/w.yml", 7), ("config-wildcard-cors", "x.py", 1), ("config-wildcard-cors", "x.yaml", 4)]


def test_caps_tell_what_is_lost(spark):
    found = spark.range(7).select(F.lit("secret.x").alias("rule_id"), F.lit("high").alias("severity"), F.when(F.col("id") < 4, "a").otherwise("b").alias("relative_path"), F.col("id").alias("line"), F.lit(1).alias("column"), F.col("id").cast("string").alias("fingerprint"))
    assert {(r.relative_path, r.limited) for r in security.capped(found, 3).collect()} == {("a", True), ("b", False)}
    kept, lost = security.limited_report(found, 5)
    assert kept.count() == 5 and [tuple(r) for r in lost.collect()] == [("b", "secrets")]


def test_coverage_has_reasons_and_no_contradictions(spark):
    inv = spark.createDataFrame([("a.py", "python", False), ("b.bin", "unknown", True), ("c.go", "go", False), ("d.py", "python", False)], "relative_path string, language string, binary boolean")
    found = spark.createDataFrame([("a.py", "secrets")], "relative_path string, domain string")
    stopped = spark.createDataFrame([("a.py", "dangerous_primitives", "parse_error"), ("a.py", "dangerous_primitives", "finding_limit"), ("a.py", "dangerous_primitives", "x" * 65)], "relative_path string, domain string, reason string")
    table = security.file_coverage(inv, found, stopped, spark.createDataFrame([("d.py",)], "relative_path string"))
    rows = {(r.relative_path, r.domain): r for r in table.collect()}
    assert len(rows) == 20 and security.coverage_violations(table).count() == 0
    r = rows["a.py", "dangerous_primitives"]
    assert (r.status, r.reasons, r.finding_count, r.evaluated) == ("partial", ["finding_limit", "parse_error"], None, False)
    assert rows["a.py", "secrets"].finding_count == 1 and rows["b.bin", "secrets"].status == "excluded" and rows["c.go", "bounded_dataflow"].status == "unsupported"
    assert all(rows["d.py", d].status == "partial" and not rows["d.py", d].read for d in security.DOMAINS)
    bad = table.withColumn("finding_count", F.lit(None).cast("long"))
    assert {r.rule for r in security.coverage_violations(bad).collect()} == {"count_unless_complete"}
    kept, n = security.limited_files(table, 3)
    assert kept.count() == 15 and n.first().omitted == 1
