"""Whole scans of one tree: the selected files, and the findings, signals and records that follow from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelake.functions import registry
from sourcelake.functions.parse import parse_source
from sourcelake.functions.paths import is_binary
from sourcelake.functions.yaml_tree import manifest_signals, yaml_signals
from sourcelake.operators import analysis, ignores, imports, security, selection, statuses
from sourcelake.sources import git, tree
from sourcelake.sources.virtual import inventory

#: Diagnostics that leave the scan's coverage whole.
HARMLESS = ["ignored_engine", "excluded_user", "ignored_vcs", "symlink_skipped", "special_file_skipped"]


class Scan(NamedTuple):
    files: DataFrame  # repo_id, relative_path, content (text; null unless UTF-8 without NUL), size_bytes, language, binary, content_hash, ...
    diagnostics: DataFrame  # code, relative_path
    state: git.GitState
    ignore_files: DataFrame  # relative_path, content_hash of the ignore files that were read


def open_tree(spark: SparkSession, root: str, repo_id: str = "", **limits) -> Scan:
    """The files of a tree that its ignore files leave, with their Git state. Read once: later steps see the same bytes."""
    raw, notes = tree.read_tree(spark, root, repo_id, **limits)
    raw = raw.persist()
    state = git.inspect(root)
    tracked = spark.createDataFrame([(repo_id, p) for p in sorted(state.tracked or ())], "repo_id string, relative_path string")
    text = F.when(~is_binary(F.col("content")), F.col("content").cast("string"))
    rules = raw.where(F.col("relative_path").rlike(r"(?:^|/)\.gitignore$")).select("repo_id", "relative_path", text.alias("content"))
    decided = raw.join(ignores.ignored(raw, rules, tracked), ["repo_id", "relative_path"])
    unread = raw.where("content is null").select(F.lit("file_read_failed").alias("code"), "relative_path")
    skipped = decided.where("ignored").select(F.lit("ignored_vcs").alias("code"), "relative_path")
    kept = decided.where("not ignored and content is not null").drop("ignored")
    sources = rules.select("relative_path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
    return Scan(inventory(kept).withColumn("content", text).persist(), notes.select("code", "relative_path").unionByName(unread).unionByName(skipped), state, sources)


def selection_id(scan: Scan) -> str:
    """Digest of where the ignore files lie and of their bytes."""
    return selection.fingerprint(scan.ignore_files).first().fingerprint


def parsed(scan: Scan) -> DataFrame:
    return scan.files.where("content is not null and language in ('php', 'javascript', 'typescript', 'python', 'rust', 'shell')").select("relative_path", "language", parse_source("language", "content").alias("parsed"))


def findings(scan: Scan, code: DataFrame) -> DataFrame:
    """All findings in one form; at most the contract's number per file."""
    spark = scan.files.sparkSession
    text = scan.files.where("content is not null").select("relative_path", "content")
    tracked = spark.createDataFrame([(p,) for p in sorted(scan.state.tracked or ())], "relative_path string")
    privileged = signals_of(yaml_signals(text)).where("kind = 'docker_privileged'").select(F.lit("config-docker-privileged").alias("rule_id"), F.lit("high").alias("severity"), "relative_path", "line")
    plain = [security.primitive_findings(code), *[x.withColumn("column", F.lit(1).cast("long")) for x in (security.configuration_findings(text), security.environment_findings(scan.files, tracked), privileged)]]
    out = security.secret_findings(text).drop("preview")
    for part in plain:
        out = out.unionByName(part.withColumn("fingerprint", security.fingerprint(F.col("rule_id"), F.col("relative_path"), F.col("line"), F.col("column"))))
    return security.capped(security.described(out.dropDuplicates(["relative_path", "line", "column", "rule_id", "fingerprint"])))


def signals_of(scanned: DataFrame) -> DataFrame:
    return scanned.select("relative_path", F.explode("signals").alias("s")).select("s.kind", "relative_path", "s.line")


def signals(scan: Scan, found: DataFrame, code: DataFrame | None = None) -> DataFrame:
    text = scan.files.where("content is not null").select("relative_path", "content")
    out = security.execution_signals(text, found).unionByName(signals_of(yaml_signals(text))).unionByName(signals_of(manifest_signals(text)))
    if code is not None:
        out = out.unionByName(security.tls_signals(security.literal_options(code)))
    return out.distinct()


def coverage(scan: Scan, found: DataFrame, code: DataFrame) -> DataFrame:
    """Coverage by file and domain, with the findings of each: partial, with the reasons, where a parser, the dataflow, unsupported configuration or the limit of findings stopped."""
    text = scan.files.where("content is not null").select("relative_path", "content")
    of = lambda df, name, reason=None: df.select("relative_path", F.lit(name).alias("domain"), *([F.lit(reason).alias("reason")] if reason else []))
    seen = found.select("relative_path", security.domain_of(F.col("rule_id")).alias("domain"))
    seen = seen.unionByName(of(signals(scan, found.select("rule_id", "severity", "relative_path", "line"), code), "execution_surface"))
    seen = seen.unionByName(of(code.select("relative_path", F.explode("parsed.flows")), "bounded_dataflow"))
    stopped = of(code.where("parsed.flow_status = 'partial'"), "bounded_dataflow", "dataflow_partial")
    for name in ("dangerous_primitives", "execution_surface"):
        stopped = stopped.unionByName(code.where("parsed.status = 'partial'").select("relative_path", F.lit(name).alias("domain"), F.coalesce("parsed.reason", F.lit("parse_error")).alias("reason")))
    unsupported = yaml_signals(text).unionByName(manifest_signals(text)).where("partial")
    for name in ("configuration", "execution_surface"):
        stopped = stopped.unionByName(of(unsupported, name, "config_syntax_unsupported"))
    limited = found.where("limited")
    for name in ("secrets", "configuration", "dangerous_primitives", "execution_surface"):
        stopped = stopped.unionByName(of(limited, name, "finding_limit"))
    return security.file_coverage(scan.files, seen, stopped)


#: Dependency edges in a report; more are counted.
MAX_EDGES = 100_000


def advanced(scan: Scan) -> dict:
    """The advanced report: dependency edges, test mappings, and the statuses of files and of the report."""
    code = parsed(scan).persist()
    facts = imports.dependency_facts(code).persist()
    edges, counts = imports.limited_edges(imports.dependency_edges(facts, scan.files), MAX_EDGES)
    files = imports.graph_statuses(statuses.file_statuses(scan.files, code.select("relative_path", "parsed.status")), facts)
    n = counts.first()
    told = lambda df, *order: [r.asDict() for r in df.orderBy(*order).toLocalIterator()]
    mappings = analysis.test_mappings(scan.files.select("relative_path"), edges)
    mapped = selection.mapping_status(mappings, files, bool(n.suppressed) or incomplete(scan)).first()
    row = statuses.report_status(files, bool(n.suppressed)).first().asDict()
    row["report"] = row["report"] if mapped.status == "complete" else "partial"
    return {
        **row, "test_mapping_status": mapped.status, "test_mapping_count": mapped.mappings, "edges": told(edges, "relative_path", "target"), "edges_suppressed": n.suppressed,
        "test_mappings": told(mappings, "relative_path", "target"), "files": told(files, "relative_path"),
    }


def incomplete(scan: Scan) -> bool:
    """Whether something that the scan should have seen was lost."""
    return bool(scan.diagnostics.where(~F.col("code").isin(HARMLESS)).limit(1).count())


def register(scan: Scan, prefix: str = "") -> list[str]:
    """Temporary views of the scan's relations, and the library's functions, for SQL."""
    code = parsed(scan)
    found = findings(scan, code).drop("place", "limited")
    edges = imports.dependency_edges(imports.dependency_facts(code), scan.files)
    relations = {"files": scan.files, "diagnostics": scan.diagnostics, "code": code, "findings": found, "dependency_edges": edges, "test_mappings": analysis.test_mappings(scan.files.select("relative_path"), edges)}
    registry.register(scan.files.sparkSession)
    return registry.views(relations, prefix)
