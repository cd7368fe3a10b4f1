"""Strict readers of the three kinds of outside documents: snapshot manifests, history manifests and evidence.

A document is accepted whole or refused with ``Refused``. Its form is stated as a shape: a dict names every field it
must have, a list of one shape is an array of it, a set lists the allowed values, and a function tests a value.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# They must equal those of the contract.
MAX_MANIFEST, MAX_HISTORY, MAX_EVIDENCE, MAX_RESULT = 16 << 20, 16 << 20, 1 << 20, 64 << 20
MAX_FILES, MAX_CHUNKS, MAX_ENTRIES, MAX_PATTERNS, MAX_LANGUAGES, MAX_COUNT = 50_000, 50_000, 100_000, 1024, 64, 10_000_000
MATERIALS = ["configuration", "database", "ruleset"]
EVIDENCE_DOMAINS = {"sast", "secrets", "dependency_vulnerability", "cicd", "container_iac", "malware"}
REASONS = {"tool_exit_nonzero", "timeout", "cpu_limit", "memory_limit", "output_limit", "sandbox_violation", "parse_failure", "unsupported", "cancelled", "internal_error"}
SEVERITIES = ["info", "low", "medium", "high", "critical"]

UNSAFE = re.compile("[\\x00-\\x1f\\x7f-\\x9f\\u061c\\u200e\\u200f\\u2028-\\u202e\\u2066-\\u2069]")
DIGEST = re.compile(r"[0-9a-f]{64}")
COMMIT = re.compile(r"(?!0+$)(?:[0-9a-f]{40}|[0-9a-f]{64})")
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+@-]{0,127}")
VERSION = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+(?:[-+].*)?")


class Refused(ValueError):
    """The document is not accepted; the text says why without quoting it."""


def like(pattern: re.Pattern) -> Callable:
    return lambda v: isinstance(v, str) and pattern.fullmatch(v) is not None


def label(limit: int) -> Callable:
    return lambda v: isinstance(v, str) and 0 < len(v.encode("utf-8", "surrogatepass")) <= limit and not UNSAFE.search(v)


def portable(v) -> bool:
    """A relative path without empty, ``.`` and ``..`` parts, backslashes, drives and unsafe characters."""
    return label(4096)(v) and "\\" not in v and not re.match("[A-Za-z]:", v) and not {"", ".", ".."} & set(v.split("/"))


def count(v, top: int = 2**63 - 1) -> bool:
    return type(v) is int and 0 <= v <= top


def optional(shape) -> Callable:
    return lambda v: v is None or fits(v, shape)


def fits(value, shape) -> bool:
    if isinstance(shape, dict):
        return isinstance(value, dict) and value.keys() == shape.keys() and all(fits(value[k], s) for k, s in shape.items())
    if isinstance(shape, list):
        return isinstance(value, list) and all(fits(v, shape[0]) for v in value)
    if isinstance(shape, (set, frozenset)):
        return isinstance(value, (str, bool, int)) and any(value is v or (type(value) is type(v) and value == v) for v in shape)
    return bool(shape(value))


DIGESTS = like(DIGEST)
FLAG = {True, False}
MANIFEST = {
    "schema_version": {"2.0"}, "engine_version": like(VERSION), "repository_id": label(1024), "commit_sha": optional(like(COMMIT)), "configuration_id": DIGESTS, "selection_id": DIGESTS, "snapshot_id": DIGESTS, "complete": {True},
    "files": [{"relative_path": portable, "chunks": [{"chunk_id": DIGESTS, "content_hash": DIGESTS, "record_hash": DIGESTS}]}],
}
HISTORY = {
    "schema_version": {"1.0"}, "producer": {"name": label(128), "version": label(128)}, "repository_id": label(1024), "base_commit_sha": like(COMMIT), "target_commit_sha": like(COMMIT), "configuration_id": DIGESTS, "history_mode": {"first_parent", "all_parents"},
    "rename_mode": {"no_follow", "follow"}, "complete": FLAG, "entries": [{"relative_path": portable, "commit_count": optional(count), "lines_added": optional(count), "lines_deleted": optional(count)}], "manifest_id": DIGESTS,
}
EVIDENCE = {
    "schema_version": {"1.0"}, "evidence_id": DIGESTS, "domain": EVIDENCE_DOMAINS,
    "subject": {"repository_id": label(1024), "commit_sha": optional(like(COMMIT)), "snapshot_id": DIGESTS, "configuration_id": DIGESTS, "selection_id": DIGESTS},
    "producer": {"runner_name": like(TOKEN), "runner_version": like(TOKEN), "runner_binary_sha256": DIGESTS, "tool_name": like(TOKEN), "tool_version": like(TOKEN), "tool_binary_sha256": DIGESTS},
    "materials": [{"kind": set(MATERIALS), "state": {"present", "not_applicable", "not_reported"}, "sha256": optional(DIGESTS)}],
    "scope": {"include_patterns": [label(1024)], "exclude_patterns": [label(1024)], "languages": [like(TOKEN)], "selected_files": optional(count), "evaluated_files": optional(count)},
    "execution": {"status": {"complete", "incomplete", "failed"}, "termination_reason": REASONS | {"success"}, "exit_code": optional(lambda v: type(v) is int), "network_access": {"denied"}, "repository_access": {"read_only"}, "repository_code_executed": {False}},
    "result": {"state": {"present", "absent"}, "format": optional(like(TOKEN)), "sha256": optional(DIGESTS), "size_bytes": optional(count), "finding_count": optional(count), "findings_by_severity": optional({s: lambda v: count(v, MAX_COUNT) for s in SEVERITIES})},
}


def ordinary_file(path: str, limit: int, root: str | None = None) -> bytes:
    """The bytes of a regular file outside ``root``, at most ``limit`` of them, that did not change while it was read."""
    if root is not None and (os.path.realpath(path) + os.sep).startswith(os.path.realpath(root) + os.sep):
        raise Refused("the file lies inside the repository")
    try:
        with os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK), "rb") as f:
            before = os.fstat(f.fileno())
            data = f.read(limit + 1) if stat.S_ISREG(before.st_mode) else None
            after = os.fstat(f.fileno())
    except OSError as error:
        raise Refused("the file cannot be read") from error
    if data is None or len(data) > limit:
        raise Refused("the file is not regular or too large")
    if len(data) != before.st_size or (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        raise Refused("the file changed")
    return data


def verified_artifact(path: str, size: int, sha256: str, root: str | None = None) -> bytes:
    """A result file of exactly this size and digest."""
    data = ordinary_file(path, MAX_RESULT, root)
    if len(data) != size or hashlib.sha256(data).hexdigest() != sha256:
        raise Refused("the result differs from the evidence")
    return data


def parsed(data: bytes, shape: dict) -> dict:
    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise Refused("a field is repeated")
        return dict(pairs)

    try:
        value = json.loads(data.decode(), object_pairs_hook=once)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as error:
        raise Refused("the document is no JSON") from error
    if not fits(value, shape):
        raise Refused("the document has another form")
    return value


def identity(value: dict, field: str, domain: str) -> str:
    """Digest of a document without the field that holds it, with sorted keys."""
    rest = json.dumps({k: v for k, v in value.items() if k != field}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(f"{len(domain)}:{domain}{rest}".encode("utf-8", "surrogatepass")).hexdigest()


def increasing(values: list) -> bool:
    keys = [v.encode("utf-8", "surrogatepass") for v in values]
    return all(a < b for a, b in zip(keys, keys[1:]))


def _require(*conditions: tuple[bool, str]) -> None:
    for good, text in conditions:
        if not good:
            raise Refused(text)


def snapshot_manifest(data: bytes) -> dict:
    m = parsed(data, MANIFEST)
    ids = [c["chunk_id"] for f in m["files"] for c in f["chunks"]]
    _require(
        (len(m["files"]) <= MAX_FILES and len(ids) <= MAX_CHUNKS, "the manifest is too large"), (increasing([f["relative_path"] for f in m["files"]]), "paths are not in order"),
        (all(increasing([c["chunk_id"] for c in f["chunks"]]) for f in m["files"]), "chunks are not in order"), (len(set(ids)) == len(ids), "a chunk is listed twice"), (identity(m, "snapshot_id", "snapshot") == m["snapshot_id"], "the digest differs"),
    )
    return m


def history_manifest(data: bytes) -> dict:
    m = parsed(data, HISTORY)
    _require((len(m["entries"]) <= MAX_ENTRIES, "the history is too long"), (increasing([e["relative_path"] for e in m["entries"]]), "paths are not in order"), (identity(m, "manifest_id", "history") == m["manifest_id"], "the digest differs"))
    return m


def evidence(data: bytes, subject: dict | None = None) -> dict:
    """Evidence whose parts agree: complete runs succeeded on all selected files and count all findings, other runs count none."""
    e = parsed(data, EVIDENCE)
    scope, run, result = e["scope"], e["execution"], e["result"]
    patterns = [*scope["include_patterns"], *scope["exclude_patterns"]]
    counts, total = result["findings_by_severity"], result["finding_count"]
    complete = run["status"] == "complete"
    present = result["state"] == "present"
    described = [result[k] is not None for k in ("format", "sha256", "size_bytes")]
    _require(
        ([m["kind"] for m in e["materials"]] == MATERIALS, "materials are missing or out of order"), (all((m["state"] == "present") == (m["sha256"] is not None) for m in e["materials"]), "a material's state and digest disagree"),
        (all(increasing(scope[k]) for k in ("include_patterns", "exclude_patterns", "languages")), "the scope is not in order"), (len(patterns) <= MAX_PATTERNS and len(scope["languages"]) <= MAX_LANGUAGES, "the scope is too large"),
        (all(described) if present else not any(described), "the result's state and description disagree"), (not present or result["size_bytes"] <= MAX_RESULT, "the result is too large"),
        (complete == (run["termination_reason"] == "success"), "status and reason disagree"), ((counts is None) == (total is None), "totals are given in part"),
        (complete or total is None, "an incomplete run has totals"),
        (not complete or (run["exit_code"] == 0 and present and total is not None and scope["selected_files"] is not None and scope["selected_files"] == scope["evaluated_files"]), "a complete run lacks results"),
        (total is None or sum((counts or {}).values()) == total, "the severities do not add up"), (subject is None or e["subject"] == subject, "the evidence is about something else"), (identity(e, "evidence_id", "evidence") == e["evidence_id"], "the digest differs"),
    )
    return e


def subject_of(snapshot: dict) -> dict:
    """The five fields by which evidence names an accepted snapshot."""
    return {k: snapshot[k] for k in EVIDENCE["subject"]}


def manifest_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """One row per chunk of an accepted manifest."""
    rows = [(c["chunk_id"], f["relative_path"], c["content_hash"], c["record_hash"]) for f in manifest["files"] for c in f["chunks"]]
    return spark.createDataFrame(rows, "chunk_id string, relative_path string, content_hash string, record_hash string")


def history_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """One row per file of an accepted history; null counts stay null."""
    rows = [tuple(e[k] for k in ("relative_path", "commit_count", "lines_added", "lines_deleted")) for e in manifest["entries"]]
    return spark.createDataFrame(rows, "relative_path string, commit_count long, lines_added long, lines_deleted long")
