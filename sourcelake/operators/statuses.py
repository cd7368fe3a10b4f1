"""Statuses of parts and of reports that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sourcelake.functions import paths

# They must equal those of the contract.
PARSED_LANGUAGES = ["php", "javascript", "typescript", "python"]
EXTENDED_LANGUAGES = [*PARSED_LANGUAGES, "rust", "shell"]
GRAPH_LANGUAGES = ["javascript", "typescript", "python"]


def overall(status: Column, limited: Column | None = None, without: str | None = None) -> Column:
    """Aggregate: of statuses that are all alike that one, complete of none, else partial; ``limited`` (a constant) makes it partial."""
    seen = F.collect_set(F.when(status != F.lit(without), status) if without else status)  # at most five values
    out = F.when(F.size(seen) == 0, "complete").when(F.size(seen) == 1, F.when(F.element_at(seen, 1).isin("complete", "unsupported"), F.element_at(seen, 1)).otherwise("partial")).otherwise("partial")
    return out if limited is None else F.when(limited, "partial").otherwise(out)


def file_statuses(inv: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per source file the status of its complexity and of its place in the dependency graph; ``parsed`` has (relative_path, status).

    Binary files are excluded, languages without a parser unsupported, files that no parse is known of partial. Null
    counts as not binary; repeated rows of ``parsed`` count once, the worse status (by name, the later) holding.
    """
    known = parsed.groupBy("relative_path").agg(F.max("status").alias("parse_status"))
    rows = inv.where(F.col("language").isin(paths.SOURCE_LANGUAGES)).select("relative_path", "language", F.coalesce("binary", F.lit(False)).alias("binary")).join(known, "relative_path", "left")
    of = lambda languages: F.when(F.col("binary"), "excluded").when(~F.col("language").isin(languages), "unsupported").when(F.col("parse_status") == "complete", "complete").otherwise("partial")
    return rows.select("relative_path", "language", of(EXTENDED_LANGUAGES).alias("complexity_status"), of(GRAPH_LANGUAGES).alias("graph_status"))


def report_status(files: DataFrame, limited: bool = False) -> DataFrame:
    """One row: the status of the complexities, of the graph, and of the report, which is complete only if both are."""
    row = files.agg(overall(F.col("complexity_status"), F.lit(limited), "excluded").alias("complexity"), overall(F.col("graph_status"), None, "excluded").alias("graph"))
    return row.withColumn("report", F.when((F.col("complexity") == "complete") & (F.col("graph") == "complete"), "complete").otherwise("partial"))


def tracking(files: DataFrame, tracked: DataFrame | None) -> DataFrame:
    """``files`` with ``tracking``: tracked or untracked by ``tracked`` (relative_path), and unknown without an index (None)."""
    if tracked is None:
        return files.withColumn("tracking", F.lit("unknown"))
    known = tracked.select("relative_path").distinct().withColumn("tracking", F.lit("tracked"))
    return files.join(known, "relative_path", "left").withColumn("tracking", F.coalesce("tracking", F.lit("untracked")))
