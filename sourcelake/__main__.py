"""Command line: analyze, index, security, evidence, doctor and version."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator

from sourcelake import __version__
from sourcelake.sources import manifests, output
from sourcelake.sources.manifests import Refused

# Exit codes of the contract.
DONE, USAGE, INPUT, INTERNAL, FOUND, INCOMPLETE = 0, 2, 3, 4, 5, 6
SEVERITIES = manifests.SEVERITIES


def arguments(argv: list[str]) -> argparse.Namespace:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--output")
    shared.add_argument("--max-output-bytes", type=int, default=output.MAX_OUTPUT)
    shared.add_argument("--diagnostics-format", choices=["human", "jsonl"], default="human")
    scan = argparse.ArgumentParser(add_help=False)
    scan.add_argument("path")
    scan.add_argument("--repo-id", default="")
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--max-file-size", type=int, default=2 << 20)
    scan.add_argument("--max-files", type=int, default=100_000)
    scan.add_argument("--max-depth", type=int, default=64)
    scan.add_argument("--max-total-bytes", type=int, default=1 << 30)
    scan.add_argument("--max-metadata-bytes", type=int, default=64 << 20)
    scan.add_argument("--require-complete", action="store_true")
    parser = argparse.ArgumentParser(prog="sourcelake")
    verbs = parser.add_subparsers(dest="command", required=True)
    a = verbs.add_parser("analyze", parents=[shared, scan])
    a.add_argument("--format", choices=["json", "human"], default="json")
    a.add_argument("--history-manifest")
    a.add_argument("--accepted-snapshot")
    a.add_argument("--advanced", action="store_true")
    i = verbs.add_parser("index", parents=[shared, scan])
    i.add_argument("--format", choices=["jsonl", "json", "events-jsonl"], default="jsonl")
    i.add_argument("--max-chunk-bytes", type=int, default=16 << 10)
    i.add_argument("--since")
    s = verbs.add_parser("security", parents=[shared, scan])
    s.add_argument("--format", choices=["json", "jsonl", "sarif"], default="json")
    s.add_argument("--fail-on", choices=SEVERITIES)
    e = verbs.add_parser("evidence", parents=[shared])
    e.add_argument("path")
    e.add_argument("--result")
    e.add_argument("--against")
    e.add_argument("--repository-root")
    e.add_argument("--require-complete", action="store_true")
    verbs.add_parser("doctor", parents=[shared])
    verbs.add_parser("version", parents=[shared])
    args = parser.parse_args(argv)
    bounds = {"max_output_bytes": (1, 4 << 30), "max_file_size": (1, 64 << 20), "max_files": (1, 1_000_000), "max_depth": (1, 256), "max_total_bytes": (1, 64 << 30), "max_metadata_bytes": (1 << 10, 1 << 30), "max_chunk_bytes": (4, 1 << 20)}
    for name, (low, high) in bounds.items():
        if not low <= getattr(args, name, low) <= high:
            parser.error(f"--{name.replace('_', '-')} must lie between {low} and {high}")
    if args.command == "index" and args.since and args.format != "events-jsonl":
        parser.error("--since needs --format events-jsonl")
    if args.command == "analyze" and args.accepted_snapshot and not args.history_manifest:
        parser.error("--accepted-snapshot needs --history-manifest")
    return args


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(frame) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in frame.toLocalIterator())


class Run:
    """One command: where it writes, its diagnostics, and its exit code."""

    def __init__(self, args: argparse.Namespace, sink: output.Output):
        self.args, self.sink, self.code, self.scan = args, sink, DONE, None

    def write(self, pieces) -> None:
        for piece in pieces:
            self.sink.write(piece)

    def open(self):
        from sourcelake.plans import scan

        a = self.args
        if os.path.islink(a.path) or not os.path.isdir(a.path):
            raise Refused("the path is not a directory")
        self.scan = scan.open_tree(session(), a.path, a.repo_id, excludes=a.exclude, max_file_size=a.max_file_size, max_files=a.max_files, max_depth=a.max_depth, max_total_bytes=a.max_total_bytes, max_metadata_bytes=a.max_metadata_bytes)
        if a.require_complete and scan.incomplete(self.scan):
            self.code = INCOMPLETE
        return scan

    def version(self) -> None:
        self.write([json.dumps({"version": __version__}) + "\n"])

    def doctor(self) -> None:
        import pyspark

        from sourcelake.functions.paths import LANGUAGES, MANIFESTS
        from sourcelake.operators.security import DOMAINS

        self.write([json.dumps({"version": __version__, "spark": pyspark.__version__, "languages": LANGUAGES, "manifests": len(MANIFESTS), "domains": DOMAINS, "max_output_bytes": output.MAX_OUTPUT}) + "\n"])

    def evidence(self) -> None:
        root = self.args.repository_root
        subject = manifests.subject_of(manifests.snapshot_manifest(manifests.ordinary_file(self.args.against, manifests.MAX_MANIFEST, root))) if self.args.against else None
        e = manifests.evidence(manifests.ordinary_file(self.args.path, manifests.MAX_EVIDENCE, root), subject)
        if self.args.result:
            if e["result"]["state"] != "present":
                raise Refused("the evidence has no result")
            manifests.verified_artifact(self.args.result, e["result"]["size_bytes"], e["result"]["sha256"], root)
        self.write([json.dumps(e, ensure_ascii=False) + "\n"])
        if self.args.require_complete and e["execution"]["status"] != "complete":
            self.code = INCOMPLETE

    def analyze(self) -> None:
        from pyspark.sql import functions as F

        from sourcelake.operators import analysis, reports

        plan = self.open()
        history = manifests.history_manifest(manifests.ordinary_file(self.args.history_manifest, manifests.MAX_HISTORY, self.args.path)) if self.args.history_manifest else None
        files = self.scan.files
        summary = next(rows_of(analysis.summary(files)))
        languages = list(rows_of(analysis.language_stats(files).orderBy("rank").drop("rank")))
        if self.args.format == "human":
            self.write(reports.analysis_text(summary, languages, self.scan.state.commit_sha))
            return
        head = {"version": __version__, "repository_id": self.args.repo_id, "commit_sha": self.scan.state.commit_sha, "summary": summary, "languages": languages, "largest_files": list(rows_of(analysis.largest_files(files).orderBy("rank")))}
        head["manifests"] = list(rows_of(analysis.manifests(files).orderBy("relative_path")))
        if history:
            if self.args.accepted_snapshot:
                self.bound(plan, manifests.snapshot_manifest(manifests.ordinary_file(self.args.accepted_snapshot, manifests.MAX_MANIFEST, self.args.path)), history)
            table = manifests.history_table(session(), history)
            code = plan.parsed(self.scan).select("relative_path", F.col("parsed.branch_points").alias("branch_points"))
            head |= next(rows_of(analysis.hotspot_status(code, table)))
            head["hotspots"] = list(rows_of(analysis.hotspots(code, table).orderBy(F.desc("product"), "relative_path"))) if history["complete"] else []
            if not history["complete"]:
                head["status"] = "partial"
        if self.args.advanced:
            head["advanced"] = plan.advanced(self.scan)
        duplicates = analysis.duplicate_members(files).orderBy("first_path", "relative_path")
        self.write(reports.json_array(head, "duplicates", rows_of(duplicates), {}))

    def bound(self, plan, accepted: dict, history: dict) -> None:
        """Refuses a snapshot of another repository, commit, selection or set of text files, and a history of another commit or configuration."""
        from sourcelake.operators import selection

        here = {"repository_id": self.args.repo_id, "commit_sha": self.scan.state.commit_sha, "selection_id": plan.selection_id(self.scan)}
        if accepted["commit_sha"] is None or any(accepted[k] != v for k, v in here.items()):
            raise Refused("the accepted snapshot is of another state")
        text = self.scan.files.where("content is not null")
        if not selection.unbound(text.select("relative_path"), session().createDataFrame([(f["relative_path"],) for f in accepted["files"]], "relative_path string")).isEmpty():
            raise Refused("the accepted snapshot is of other files")
        if any(history[k] != accepted[v] for k, v in {"repository_id": "repository_id", "target_commit_sha": "commit_sha", "configuration_id": "configuration_id"}.items()):
            raise Refused("the history is of another snapshot")

    def index(self) -> None:
        from sourcelake.operators import protocol, reports, selection, snapshot
        from sourcelake.sources import tree

        plan = self.open()
        a, state = self.args, self.scan.state
        text = self.scan.files.where("content is not null")
        chunks = snapshot.structural_chunks(text, a.max_chunk_bytes).persist()
        limits = chunks.where("code is not null").select("code", "relative_path").distinct()
        self.scan = self.scan._replace(diagnostics=self.scan.diagnostics.unionByName(limits))
        records = protocol.records(chunks, a.repo_id, state.commit_sha).persist()
        if a.format != "events-jsonl":
            ordered = rows_of(records.orderBy("relative_path", "start_byte"))
            self.write((json.dumps(r, ensure_ascii=False) + "\n" for r in ordered) if a.format == "jsonl" else reports.json_array({}, "records", ordered, {}))
            return
        settings = {"version": __version__, "excludes": a.exclude, "max_file_size": a.max_file_size, "max_files": a.max_files, "max_depth": a.max_depth, "max_total_bytes": a.max_total_bytes, "max_metadata_bytes": a.max_metadata_bytes, "max_chunk_bytes": a.max_chunk_bytes}
        head = {"engine_version": __version__, "repository_id": a.repo_id or "unnamed", "commit_sha": state.commit_sha, "configuration_id": manifests.identity(settings, "", "configuration"), "selection_id": plan.selection_id(self.scan)}
        base = manifests.snapshot_manifest(manifests.ordinary_file(a.since, manifests.MAX_MANIFEST, a.path)) if a.since else None
        if base and any(base[k] != head[k] for k in ("repository_id", "configuration_id", "selection_id")):
            raise Refused("the base is of another repository or configuration")
        old = manifests.manifest_table(session(), base or {"files": []})
        records.count()  # all is read: what differs from here on has changed during the run
        self.scan = self.scan._replace(diagnostics=self.scan.diagnostics.unionByName(selection.drift(self.scan.files, tree.reread(self.scan.files, a.path)).select("code", "relative_path")))
        reasons = sorted({r.code for r in protocol.abort_reasons(self.scan.diagnostics, old).select("code").distinct().collect()})
        if records.where("chunk_id is not null").limit(manifests.MAX_CHUNKS + 1).count() > manifests.MAX_CHUNKS:
            reasons.append("manifest_limit")
        new = protocol.manifest_of(records, head) if not reasons else {"files": []}
        if len(json.dumps(new, ensure_ascii=False).encode("utf-8", "surrogatepass")) > manifests.MAX_MANIFEST:
            reasons.append("manifest_limit")
        start = {**head, "base_snapshot_id": base["snapshot_id"] if base else None}
        self.write(line + "\n" for line in protocol.event_lines(records, old, start, new, reasons))
        if reasons:
            self.code = INCOMPLETE

    def security(self) -> None:
        from sourcelake.operators import reports, security

        plan, a = self.open(), self.args
        code = plan.parsed(self.scan).persist()
        found = plan.findings(self.scan, code).persist()
        counts = {r.severity: r.findings for r in security.by_severity(found).collect()}
        domains = list(rows_of(security.domain_coverage(plan.coverage(self.scan, found, code)).orderBy("domain")))
        unsure = plan.incomplete(self.scan) or bool(found.where("limited").limit(1).count()) or any(d["partial"] for d in domains if d["domain"] != "bounded_dataflow")
        shown = found.drop("place", "limited")
        if a.format == "sarif":
            self.write(reports.sarif(shown, unsure, {"findings_by_severity": counts}))
        else:
            ordered = rows_of(shown.orderBy(*reports.FINDING_ORDER))
            tail = {"signals": list(rows_of(plan.signals(self.scan, shown.select("rule_id", "severity", "relative_path", "line"), code).orderBy("kind", "relative_path", "line"))), "coverage": domains, "truncated": unsure} if a.format == "json" else {}
            head = {"version": __version__, "repository_id": a.repo_id, "commit_sha": self.scan.state.commit_sha, "findings_by_severity": {s: counts.get(s, 0) for s in SEVERITIES}}
            self.write((json.dumps(r, ensure_ascii=False) + "\n" for r in ordered) if a.format == "jsonl" else reports.json_array(head, "findings", ordered, tail))
        if unsure and (a.fail_on or a.require_complete):
            self.code = INCOMPLETE
        elif a.fail_on and any(counts.get(s) for s in SEVERITIES[SEVERITIES.index(a.fail_on) :]):
            self.code = FOUND


def diagnose(args: argparse.Namespace, scan) -> dict:
    """Writes diagnostics to standard error and returns how many were written and how many not."""
    from sourcelake.operators.reports import capped_diagnostics

    shown, counts = capped_diagnostics(scan.diagnostics)
    for r in shown.collect():
        event = {"event": "diagnostic", "diagnostic": {"code": r.code, "relative_path": r.relative_path}}
        print(json.dumps(event) if args.diagnostics_format == "jsonl" else output.safe_text(f"{r.code}: {r.relative_path}"), file=sys.stderr)
    return counts.first().asDict()


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    root = args.path if args.command in ("analyze", "index", "security") else None
    code, reason, sink, counts = INTERNAL, None, None, {"emitted": 0, "suppressed": 0}
    try:
        sink = output.Output(args.output, root, args.max_output_bytes)
        with sink:
            run = Run(args, sink)
            getattr(run, args.command)()
        if run.scan is not None:
            counts = diagnose(args, run.scan)
        code = run.code
    except Refused as error:
        code, reason = INPUT, str(error)
    except output.OutputFailed as error:
        code, reason = INTERNAL, str(error)
    if args.diagnostics_format == "jsonl" or reason:
        status = {DONE: "complete", FOUND: "policy_failed", INCOMPLETE: "incomplete"}.get(code, "failed")
        receipt = {"event": "run.failed" if reason else "run.completed", "command": args.command, "status": status, "exit_code": code, "reason_code": reason, "output": sink and sink.receipt(), "diagnostics": counts}
        print(json.dumps(receipt) if args.diagnostics_format == "jsonl" else f"error: {output.safe_text(reason)}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
