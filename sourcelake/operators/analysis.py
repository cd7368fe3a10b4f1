"""Analysis of the inventory: summaries, categories, top files, duplicates, test mapping and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sourcelake.functions import paths

TOP_FILES = 20


def _count(condition) -> F.Column:
    return F.count_if(condition)


def summary(inv: DataFrame) -> DataFrame:
    """One pass, one row. A null line count adds no lines."""
    path = F.col("relative_path")
    return inv.agg(
        F.count(F.lit(1)).alias("files"), _count(F.col("language").isin(paths.SOURCE_LANGUAGES)).alias("source_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("total_lines"),
        _count("binary").alias("binary_files"), _count(~F.col("utf8")).alias("non_utf8_files"), _count("generated").alias("generated_files"), _count(paths.manifest_kind(path).isNotNull()).alias("manifests"), _count(paths.is_test(path)).alias("test_files"), _count(paths.is_documentation(path)).alias("documentation_files"), F.count("line_count").alias("files_with_line_count"),
    )


def language_stats(inv: DataFrame) -> DataFrame:
    """Per language, with its place in the contract's order."""
    rows = inv.groupBy("language").agg(F.count(F.lit(1)).alias("files"), _count(F.col("language").isin(paths.SOURCE_LANGUAGES)).alias("source_files"), F.sum("size_bytes").alias("bytes"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines"), F.count("line_count").alias("files_with_line_count"))
    return rows.withColumn("rank", paths.language_rank(F.col("language")).cast("long"))


def manifests(files: DataFrame) -> DataFrame:
    return files.select("relative_path", paths.manifest_kind(F.col("relative_path")).alias("kind")).where("kind is not null")


def categories(inv: DataFrame) -> DataFrame:
    p = F.col("relative_path")
    return inv.select("relative_path", "generated", paths.is_test(p).alias("test"), paths.is_documentation(p).alias("documentation"), paths.excluded_by_engine(p).alias("excluded"), paths.source_stem(p).alias("source_stem"), paths.test_stem(p).alias("test_stem"))


def largest_files(inv: DataFrame, k: int = TOP_FILES) -> DataFrame:
    """The largest source files of each repository; ties by path."""
    w = Window.partitionBy("repo_id").orderBy(F.desc("size_bytes"), "relative_path")
    rows = inv.where(F.col("language").isin(paths.SOURCE_LANGUAGES)).select("repo_id", "relative_path", "size_bytes", "language", "line_count")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def duplicate_groups(inv: DataFrame) -> DataFrame:
    """Groups of equal contents as counts and their first path; ``duplicate_members`` lists them."""
    return inv.groupBy("content_hash", "size_bytes").agg(F.count(F.lit(1)).alias("files"), F.min("relative_path").alias("first_path")).where("files >= 2")


def duplicate_members(inv: DataFrame) -> DataFrame:
    groups = duplicate_groups(inv)
    return inv.select("content_hash", "size_bytes", "relative_path").join(groups, ["content_hash", "size_bytes"]).select("first_path", "relative_path", "files")


def test_mappings(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Each test file: mapped by an import of a source file, else by a stem that one source file alone has, else unmapped."""
    p = F.col("relative_path")
    lang = paths.language(p).isin(paths.SOURCE_LANGUAGES)
    tests = files.where(paths.is_test(p) & lang).select("relative_path", paths.test_stem(p).alias("stem"))
    sources = files.where(~paths.is_test(p) & lang).select(F.col("relative_path").alias("target"), paths.source_stem(p).alias("stem"))
    exact = edges.where(~paths.is_test(F.col("target"))).join(tests.drop("stem"), "relative_path").select("relative_path", "target", F.lit("exact_import").alias("basis")).distinct()
    left = tests.join(exact.select("relative_path").distinct(), "relative_path", "left_anti")
    # counted per stem before the join: a common stem would meet all its tests with all its sources
    single = sources.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    named = left.join(single, "stem", "left").select("relative_path", "target", F.when(F.col("target").isNotNull(), "naming_heuristic").otherwise("unmapped").alias("basis"))
    return exact.unionByName(named)


def hotspots(files: DataFrame, history: DataFrame) -> DataFrame:
    """(relative_path, branch_points) with (relative_path, commit_count): their product, for files that have both."""
    joined = files.join(history, "relative_path").where("commit_count is not null and branch_points is not null")
    return joined.select("relative_path", "branch_points", "commit_count", (F.col("branch_points") * F.col("commit_count")).alias("product"))


def hotspot_status(files: DataFrame, history: DataFrame) -> DataFrame:
    """Complete only if every file has a measured commit count; the number of hotspots is null otherwise."""
    joined = files.join(history.select("relative_path", "commit_count", F.lit(True).alias("known")), "relative_path", "left")
    row = joined.agg(F.coalesce(F.bool_and(F.col("commit_count").isNotNull()), F.lit(True)).alias("complete"), F.count("commit_count").alias("n"))
    return row.select(F.when(F.col("complete"), "complete").otherwise("partial").alias("status"), F.when(F.col("complete"), F.col("n")).alias("hotspots"))
