"""The snapshot protocol: record hashes, manifests, identities, reasons to abort, and the lines of an event stream."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from sourcelake import __version__
from sourcelake.operators import snapshot
from sourcelake.sources.manifests import identity

# Exclusions that are meant, so that they do not make a snapshot incomplete.
INTENTIONAL = ["ignored_engine", "excluded_user", "ignored_vcs", "binary_skipped", "symlink_skipped", "special_file_skipped", "unsupported_encoding"]
BUCKETS = 4096


def _tagged(*parts):
    return F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts])


def records(chunks: DataFrame, repo_id: str = "", commit_sha: str | None = None) -> DataFrame:
    """Structural chunks as records: with identities, provenance, and a hash of every field but the commit."""
    named = _tagged(F.lit("chunk"), F.lit(repo_id), "relative_path", "symbol_kind", F.coalesce("qualified_name", F.lit("")), F.col("occurrence").cast("string"), F.col("part_index").cast("string"))
    rows = chunks.where("content is not null").drop("code")
    rows = rows.withColumns({"schema_version": F.lit("1.0"), "engine_version": F.lit(__version__), "repository_id": F.lit(repo_id), "chunk_id": F.sha2(named.cast("binary"), 256), "content_hash": F.sha2(F.col("content").cast("binary"), 256)}).drop("occurrence")
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.withColumn("record_hash", F.sha2(line.cast("binary"), 256)).withColumn("commit_sha", F.lit(commit_sha).cast("string"))


def table_identity(manifest: DataFrame) -> DataFrame:
    """One row with a digest of a manifest's rows, whatever their order: rows are hashed, then buckets of rows, then the buckets.

    Repeated rows count as often as they occur, nulls as such; of no rows it is the digest of nothing.
    """
    row = F.sha2(F.to_json(F.struct("relative_path", "chunk_id", "content_hash", "record_hash"), {"ignoreNullFields": "false"}).cast("binary"), 256)
    rows = manifest.select(row.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(BUCKETS))
    fine = rows.groupBy(bucket.alias("bucket"), F.substring("digest", 9, 4).alias("fine")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("digest", F.lit("*"), F.col("n").cast("string")))), ",").cast("binary"), 256).alias("digest"))
    by_bucket = fine.groupBy("bucket").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("fine", F.lit("="), "digest"))), ",").cast("binary"), 256).alias("digest"))
    return by_bucket.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat(F.lpad(F.col("bucket").cast("string"), 4, "0"), F.lit("="), "digest"))), ",").cast("binary"), 256).alias("identity"))


def changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """As ``snapshot.delta``, where a chunk is unchanged only if its record is too."""
    both = lambda m: m.select("chunk_id", "relative_path", F.concat_ws(":", "content_hash", "record_hash").alias("content_hash"))
    return snapshot.delta(both(base), both(target)).select("chunk_id", "relative_path", "operation")


def abort_reasons(diagnostics: DataFrame, base: DataFrame) -> DataFrame:
    """(code, relative_path) of diagnostics that forbid a snapshot: all that are not intended, and intended ones that cover a path of the base.

    A diagnostic without a path covers the base if that has any path.
    """
    path = F.col("relative_path")
    meant = F.coalesce(F.col("code").isin(INTENTIONAL), F.lit(False))
    loud = diagnostics.where(~meant).select("code", "relative_path")
    quiet = diagnostics.where(meant).select("code", "relative_path").distinct()
    covered = snapshot.covers_base(quiet.where(path.isNotNull()).select(path.alias("candidate")).distinct(), base).where("covers_base").select(F.col("candidate").alias("relative_path"))
    somewhere = quiet.where(path.isNull()).withColumn("k", F.lit(1)).join(F.broadcast(base.where(path.isNotNull()).select(F.lit(1).alias("k")).limit(1)), "k", "left_semi").drop("k")
    return loud.unionByName(quiet.join(covered, "relative_path", "left_semi")).unionByName(somewhere).distinct()


def manifest_of(rows: DataFrame, header: dict) -> dict:
    """The manifest document of records that fit the contract's bound of chunks; ``header`` has its other fields."""
    files: dict[str, list] = {}
    for r in rows.select("relative_path", "chunk_id", "content_hash", "record_hash").orderBy(F.col("relative_path").cast("binary"), "chunk_id").toLocalIterator():
        files.setdefault(r.relative_path, []).append({"chunk_id": r.chunk_id, "content_hash": r.content_hash, "record_hash": r.record_hash})
    out = {**header, "schema_version": "2.0", "complete": True, "files": [{"relative_path": p, "chunks": c} for p, c in files.items()]}
    return {**out, "snapshot_id": identity(out, "snapshot_id", "snapshot")}


def event_lines(rows: DataFrame, base: DataFrame, start: dict, manifest: dict, aborts: list[str]) -> Iterator[str]:
    """JSON lines of one transaction in the contract's order; a transaction that aborts has a start and an end only.

    The last line of a whole transaction has ``events_hash``: the digest of the bytes of all lines before it, line ends included.
    """
    number, running = 0, hashlib.sha256()

    def line(event: str, **fields) -> str:
        nonlocal number
        number += 1
        text = json.dumps({"event": event, "sequence": number - 1, **fields}, ensure_ascii=False, separators=(",", ":"))
        running.update(f"{text}\n".encode("utf-8", "surrogatepass"))
        return text

    yield line("start", **start)
    if aborts:
        yield line("abort", reasons=aborts)
        return
    found = changes(base, rows)
    new = rows.join(found.where("operation = 'upsert'").select("chunk_id"), "chunk_id", "left_semi")
    totals = {"upserts": 0, "deletes": 0}
    for r in new.orderBy(F.col("relative_path").cast("binary"), "start_byte").toLocalIterator():
        totals["upserts"] += 1
        yield line("upsert", record=r.asDict())
    for r in found.where("operation = 'delete'").orderBy(F.col("relative_path").cast("binary"), "chunk_id").toLocalIterator():
        totals["deletes"] += 1
        yield line("delete", chunk_id=r.chunk_id, relative_path=r.relative_path)
    kept = sum(len(f["chunks"]) for f in manifest["files"]) - totals["upserts"]
    yield line("complete", **totals, unchanged=kept, events_hash=running.hexdigest(), manifest=manifest)
