import hashlib
import json

import pytest

from sourcelake.__main__ import main
from sourcelake.sources import manifests
from sourcelake.sources.output import Output, OutputFailed

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {
        "src/app.py": "def f(value):\n    if value:\n        return eval(value)\n", "src/copy.py": "def f(value):\n    if value:\n        return eval(value)\n", "tests/test_app.py": "x = 1\n", "Dockerfile": "FROM a\nUSER root\n", "key.txt": f"x\n{AWS}\n",
        ".gitignore": "*.log\n", "a.log": "no", "package.json": '{"scripts": {"a": "b"}}', "Cargo.toml": "[build-dependencies]\ncc = '1'\n", "compose.yml": '{"services": {"a": {"privileged": true}}}', "a b*~.sh": "chmod 777 x\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "raw.bin").write_bytes(b"\x00\xff")
    return root


def run(tmp_path, name, *argv):
    out = tmp_path / name
    return main([argv[0], *map(str, argv[1:]), "--output", str(out)]), out


def test_analysis(spark, tmp_path, tree):
    code, out = run(tmp_path, "a.json", "analyze", tree)
    got = json.loads(out.read_text())
    assert code == 0 and got["summary"]["files"] == 11 and got["summary"]["binary_files"] == 1
    assert [d["relative_path"] for d in got["duplicates"]] == ["src/app.py", "src/copy.py"]
    assert {m["kind"] for m in got["manifests"]} == {"npm", "cargo", "docker", "compose"}
    code, text = run(tmp_path, "a.txt", "analyze", tree, "--format", "human")
    assert code == 0 and "Files: 11 (4 source, 1 binary)" in text.read_text()


def test_security(spark, tmp_path, tree):
    code, out = run(tmp_path, "s.json", "security", tree, "--fail-on", "high")
    got = json.loads(out.read_text())
    rules = {(f["rule_id"], f["relative_path"], f["line"]) for f in got["findings"]}
    assert rules == {("secret.aws_access_key", "key.txt", 2), ("dangerous-eval", "src/app.py", 3), ("dangerous-eval", "src/copy.py", 3), ("config-docker-root-user", "Dockerfile", 2), ("config-docker-privileged", "compose.yml", 1), ("config-world-writable-mode", "a b*~.sh", 1)}
    assert code == 5 and got["findings_by_severity"]["high"] == 2
    assert {s["kind"] for s in got["signals"]} == {"package_script", "cargo_build_dependencies", "docker_privileged", "docker_root_user", "dynamic_evaluation_primitive"}
    assert AWS not in out.read_text()
    code, out = run(tmp_path, "s.sarif", "security", tree, "--format", "sarif")
    doc = json.loads(out.read_text())["runs"][0]
    assert code == 0 and len(doc["results"]) == 6 and doc["invocations"] == [{"executionSuccessful": True}]
    assert all(doc["tool"]["driver"]["rules"][r["ruleIndex"]]["id"] == r["ruleId"] for r in doc["results"])
    assert "a%20b%2A~.sh" in {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in doc["results"]}


def events(path):
    return [json.loads(line) for line in path.read_text().splitlines()]


def apply(base, lines):
    state = dict(base)
    for e in lines:
        if e["event"] == "upsert":
            state[e["record"]["chunk_id"]] = e["record"]["record_hash"]
        elif e["event"] == "delete":
            del state[e["chunk_id"]]
    return state


def test_index_and_delta(spark, tmp_path, tree):
    code, out = run(tmp_path, "i.jsonl", "index", tree)
    rows = events(out)
    assert code == 0 and "".join(r["content"] for r in rows if r["relative_path"] == "src/app.py") == (tree / "src/app.py").read_text()
    assert AWS not in out.read_text() and [r["relative_path"] for r in rows] == sorted(r["relative_path"] for r in rows)
    code, full = run(tmp_path, "full.jsonl", "index", tree, "--format", "events-jsonl")
    first = events(full)
    assert code == 0 and [e["sequence"] for e in first] == list(range(len(first)))
    (tmp_path / "base.json").write_text(json.dumps(first[-1]["manifest"]))
    (tree / "src/app.py").write_text("y = 2\n")
    (tree / "src/copy.py").unlink()
    code, part = run(tmp_path, "delta.jsonl", "index", tree, "--format", "events-jsonl", "--since", tmp_path / "base.json")
    delta = events(part)
    # the function of either file is gone; what the first holds now belongs to no symbol
    assert code == 0 and [(e["event"], (e.get("record") or e).get("relative_path")) for e in delta[1:-1]] == [("upsert", "src/app.py"), ("delete", "src/app.py"), ("delete", "src/copy.py")]
    assert (delta[0]["event"], delta[-1]["event"]) == ("start", "complete")
    target = {c["chunk_id"]: c["record_hash"] for f in delta[-1]["manifest"]["files"] for c in f["chunks"]}
    assert apply(apply({}, first), delta) == target
    (tree / "link").symlink_to("src")
    (tree / "big.txt").write_text("x" * 100)
    code, none = run(tmp_path, "abort.jsonl", "index", tree, "--format", "events-jsonl", "--max-file-size", "90")
    assert code == 6 and [e["event"] for e in events(none)] == ["start", "abort"]
    code, _ = run(tmp_path, "other.jsonl", "index", tree, "--format", "events-jsonl", "--since", tmp_path / "base.json", "--max-chunk-bytes", "64")
    assert code == 3


def test_output_is_committed_whole_or_not_at_all(tmp_path, tree, capsys):
    code, out = run(tmp_path, "v.json", "version")
    assert code == 0 and json.loads(out.read_text())["version"]
    assert run(tmp_path, "v.json", "version")[0] == 4
    assert run(tree, "inside", "analyze", tree)[0] == 4 and not (tree / "inside").exists()
    assert main(["version", "--output", str(tmp_path / "small"), "--max-output-bytes", "3"]) == 4
    assert not (tmp_path / "small").exists() and not list(tmp_path.glob(".output-*"))
    capsys.readouterr()
    assert main(["doctor", "--output", str(tmp_path / "d"), "--diagnostics-format", "jsonl"]) == 0
    receipt = json.loads(capsys.readouterr().err)
    assert receipt["output"]["sha256"] == hashlib.sha256((tmp_path / "d").read_bytes()).hexdigest()
    with pytest.raises(OutputFailed), Output(str(tmp_path / "late")) as sink:
        (tmp_path / "late").write_text("other")
        sink.write("mine")
    assert (tmp_path / "late").read_text() == "other"
    with pytest.raises(SystemExit) as usage:
        main(["index", "x", "--max-chunk-bytes", "1"])
    assert usage.value.code == 2


def evidence(**changes):
    sha = "a" * 64
    e = {
        "schema_version": "1.0", "domain": "sast", "subject": {"repository_id": "r", "commit_sha": None, "snapshot_id": sha, "configuration_id": sha, "selection_id": sha},
        "producer": {"runner_name": "r", "runner_version": "1", "runner_binary_sha256": sha, "tool_name": "t", "tool_version": "1", "tool_binary_sha256": sha},
        "materials": [{"kind": k, "state": "not_reported", "sha256": None} for k in manifests.MATERIALS], "scope": {"include_patterns": ["a", "b"], "exclude_patterns": [], "languages": [], "selected_files": 2, "evaluated_files": 2},
        "execution": {"status": "complete", "termination_reason": "success", "exit_code": 0, "network_access": "denied", "repository_access": "read_only", "repository_code_executed": False},
        "result": {"state": "present", "format": "sarif", "sha256": hashlib.sha256(b"xy").hexdigest(), "size_bytes": 2, "finding_count": 3, "findings_by_severity": {"info": 0, "low": 3, "medium": 0, "high": 0, "critical": 0}},
    }
    for path, value in changes.items():
        *parts, last = path.split("__")
        at = e
        for p in parts:
            at = at[p]
        at[last] = value
    return {**e, "evidence_id": manifests.identity(e, "evidence_id", "evidence")}


BAD = [
    {"execution__exit_code": 1}, {"execution__termination_reason": "timeout"}, {"scope__evaluated_files": 1}, {"scope__include_patterns": ["b", "a"]}, {"result__finding_count": 4}, {"result__findings_by_severity": None}, {"execution__repository_code_executed": True},
    {"result__state": "absent"}, {"domain": "other"}, {"extra": 1}, {"execution__exit_code": True}, {"scope__selected_files": True, "scope__evaluated_files": True}, {"materials": []}, {"subject__commit_sha": "0" * 40}, {"execution__status": "failed", "execution__termination_reason": "timeout"},
]


def test_evidence(tmp_path):
    (tmp_path / "result").write_bytes(b"xy")
    (tmp_path / "good").write_text(json.dumps(evidence()))
    assert run(tmp_path, "1", "evidence", tmp_path / "good", "--result", tmp_path / "result", "--require-complete")[0] == 0
    (tmp_path / "result").write_bytes(b"xz")
    assert run(tmp_path, "2", "evidence", tmp_path / "good", "--result", tmp_path / "result")[0] == 3
    failed = evidence(execution__status="failed", execution__termination_reason="timeout", execution__exit_code=None, result={"state": "absent", "format": None, "sha256": None, "size_bytes": None, "finding_count": None, "findings_by_severity": None})
    (tmp_path / "failed").write_text(json.dumps(failed))
    assert run(tmp_path, "3", "evidence", tmp_path / "failed")[0] == 0
    assert run(tmp_path, "4", "evidence", tmp_path / "failed", "--require-complete")[0] == 6


@pytest.mark.parametrize("changes", BAD)
def test_refused_evidence(changes):
    with pytest.raises(manifests.Refused):
        manifests.evidence(json.dumps(evidence(**changes)).encode())


def test_refused_documents():
    good = evidence()
    for data in (b"", b"[]", b"\xff", b'{"a":1,"a":1}', json.dumps({**good, "evidence_id": "b" * 64}).encode(), b"[" * 100_000):
        with pytest.raises(manifests.Refused):
            manifests.evidence(data)
    with pytest.raises(manifests.Refused):
        manifests.evidence(json.dumps(good).encode(), {"repository_id": "x"})
    for path in ("/a", "a/../b", "a//b", "C:x", "a\\b", "", "a‮b", "./a"):
        assert not manifests.portable(path)


def history(entries):
    h = {"schema_version": "1.0", "producer": {"name": "a", "version": "1"}, "repository_id": "r", "base_commit_sha": "a" * 40, "target_commit_sha": "b" * 40, "configuration_id": "c" * 64, "history_mode": "first_parent", "rename_mode": "follow", "complete": True, "entries": entries}
    return {**h, "manifest_id": manifests.identity(h, "manifest_id", "history")}


def test_hotspots_of_a_history(spark, tmp_path, tree):
    entry = lambda p, n: {"relative_path": p, "commit_count": n, "lines_added": None, "lines_deleted": None}
    (tmp_path / "h").write_text(json.dumps(history([entry("src/app.py", 5), entry("src/copy.py", None)])))
    code, out = run(tmp_path, "h.json", "analyze", tree, "--history-manifest", tmp_path / "h")
    got = json.loads(out.read_text())
    assert code == 0 and got["status"] == "partial" and got["hotspots"] == [{"relative_path": "src/app.py", "branch_points": 1, "commit_count": 5, "product": 5}]
    with pytest.raises(manifests.Refused):
        manifests.history_manifest(json.dumps(history([entry("b", 1), entry("a", 1)])).encode())


def test_coverage_tells_what_was_not_seen(spark, tmp_path):
    from sourcelake.operators import security
    from sourcelake.plans import scan as plan

    (tmp_path / "good.py").write_text("x = 1\n")
    (tmp_path / "broken.py").write_text("def f(:\n")
    (tmp_path / "Makefile").write_text("all:\n\tcurl https://example.org/x.sh | sh\n")
    (tmp_path / "package.json").write_text('{"scripts": {"postinstall": "node x.js"}}\n')
    scan = plan.open_tree(spark, str(tmp_path))
    code = plan.parsed(scan)
    rows = plan.coverage(scan, plan.findings(scan, code), code).collect()
    got = {(r.relative_path, r.domain): (r.status, r.parsed, r.evaluated, r.finding_count) for r in rows}
    assert len(rows) == 20 and got["good.py", "dangerous_primitives"] == ("complete", True, True, 0)
    for domain in ("dangerous_primitives", "bounded_dataflow"):
        assert got["broken.py", domain] == ("partial", False, False, None)
    assert got["broken.py", "execution_surface"] == ("partial", None, False, None) and got["broken.py", "secrets"] == ("complete", None, True, 0)
    surface = plan.signals(scan, plan.findings(scan, code).select("rule_id", "severity", "relative_path", "line")).count()
    assert surface > 0 and sum(got[p, "execution_surface"][3] or 0 for p in ("good.py", "Makefile", "package.json")) == surface
    of = {r.domain: r for r in security.domain_coverage(plan.coverage(scan, plan.findings(scan, code), code)).collect()}
    assert of["dangerous_primitives"].partial == 1 and of["dangerous_primitives"].status == "partial"


def test_advanced_report(spark, tmp_path):
    tree = tmp_path / "advanced"
    (tree / "src").mkdir(parents=True)
    (tree / "tests").mkdir()
    (tree / "src/main.ts").write_text("export const a = 1;\n")
    (tree / "tests/main.test.ts").write_text("import {a} from '../src/main.ts';\n")
    code, out = run(tmp_path, "advanced.json", "analyze", tree, "--advanced")
    got = json.loads(out.read_text())["advanced"]
    assert code == 0 and got["edges"] == [{"relative_path": "tests/main.test.ts", "target": "src/main.ts"}]
    assert got["test_mappings"] == [{"relative_path": "tests/main.test.ts", "target": "src/main.ts", "basis": "exact_import"}] and got["report"] == "complete"
