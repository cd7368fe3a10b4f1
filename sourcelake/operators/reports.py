"""Reports as documents: JSON, text and SARIF. Rows are streamed to the writer in their final order."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from sourcelake import __version__
from sourcelake.functions.paths import relative_uri
from sourcelake.operators.security import LEVELS
from sourcelake.sources.output import MAX_DIAGNOSTICS, safe_text

SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
#: Order of findings in every report.
FINDING_ORDER = ["relative_path", "line", "column", "rule_id", "fingerprint"]


def capped_diagnostics(diagnostics: DataFrame, limit: int = MAX_DIAGNOSTICS) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` distinct diagnostics by path and code, one row with the numbers emitted and suppressed)."""
    rows = diagnostics.select("code", "relative_path").distinct()
    n = F.count(F.lit(1))
    return rows.orderBy("relative_path", "code").limit(limit), rows.agg(F.least(n, F.lit(limit)).cast("long").alias("emitted"), F.greatest(n - limit, F.lit(0)).cast("long").alias("suppressed"))


def json_array(head: dict, name: str, rows: Iterable[dict], tail: dict) -> Iterator[str]:
    """A JSON object in pieces: the fields of ``head``, a streamed array, then the fields of ``tail``."""
    yield "{" + "".join(f"{json.dumps(k)}: {json.dumps(v)},\n" for k, v in head.items()) + json.dumps(name) + ": ["
    for i, row in enumerate(rows):
        yield (",\n" if i else "\n") + json.dumps(row, ensure_ascii=False)
    yield "\n]" + "".join(f",\n{json.dumps(k)}: {json.dumps(v)}" for k, v in tail.items()) + "}\n"


def sarif(findings: DataFrame, truncated: bool, properties: dict) -> Iterator[str]:
    """A SARIF 2.1.0 document of findings (rule_id, severity, relative_path, line, column, fingerprint)."""
    rules = [r for r in findings.groupBy("rule_id").agg(F.max("severity").alias("severity")).orderBy("rule_id").collect()]  # a handful
    index = {r.rule_id: i for i, r in enumerate(rules)}
    described = [{"id": r.rule_id, "shortDescription": {"text": r.rule_id.replace("-", " ")}, "defaultConfiguration": {"level": LEVELS[r.severity]}, "properties": {"tags": ["security"]}} for r in rules]

    def result(r) -> dict:
        place = {"artifactLocation": {"uri": r.uri}, "region": {"startLine": r.line, "startColumn": r.column}}
        return {"ruleId": r.rule_id, "ruleIndex": index[r.rule_id], "level": LEVELS[r.severity], "message": {"text": r.rule_id.replace("-", " ")}, "locations": [{"physicalLocation": place}], "partialFingerprints": {"sourcelake/v1": r.fingerprint}}

    rows = findings.withColumn("uri", relative_uri(F.col("relative_path"))).orderBy(*FINDING_ORDER).toLocalIterator()
    run_tail = {"tool": {"driver": {"name": "sourcelake", "version": __version__, "rules": described}}, "columnKind": "unicodeCodePoints", "invocations": [{"executionSuccessful": not truncated}], "properties": properties}
    yield f'{{"$schema": {json.dumps(SARIF_SCHEMA)}, "version": "2.1.0", "runs": ['
    yield from json_array({}, "results", map(result, rows), run_tail)
    yield "]}\n"


def analysis_text(summary: dict, languages: list[dict], commit: str | None) -> Iterator[str]:
    """The summary for people."""
    yield f"sourcelake {__version__}: repository analysis\n"
    yield "Files: {files} ({source_files} source, {binary_files} binary)\nBytes: {total_bytes}\nLines: {total_lines}\nManifests: {manifests}\nTests: {test_files} | documentation: {documentation_files} | generated: {generated_files}\n".format(**summary)
    if commit:
        yield f"Git HEAD: {safe_text(commit)}\n"
    for row in languages:
        yield "  {language}: {files} files, {bytes} bytes, {lines} lines\n".format(**row)
