"""What a scan selected: its fingerprint, whether it is still there, and whether it is what a snapshot was made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Leading hex digits of a row's digest that choose its bucket.
BUCKET_DIGITS = 3


def fingerprint(sources: DataFrame) -> DataFrame:
    """One row (entries, fingerprint): a digest of (relative_path, content_hash) rows, whatever their order.

    Rows are hashed, then the rows of a bucket in order, then the buckets in order, so no task holds more than one
    bucket. A path is preceded by its length. Repeated rows count once, a null as empty; no rows have a digest too.
    """
    path, digest = F.coalesce("relative_path", F.lit("")), F.coalesce("content_hash", F.lit(""))
    row = F.sha2(F.concat(F.octet_length(path).cast("string"), F.lit(":"), path, digest).cast("binary"), 256)
    rows = sources.select(row.alias("digest")).distinct()
    in_order = lambda: F.array_join(F.sort_array(F.collect_list("digest")), "")
    buckets = rows.groupBy(F.substring("digest", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sha2(in_order().cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    # one digest per bucket: at most 16 ** BUCKET_DIGITS, ordered by bucket
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x.digest), "")
    entries = F.coalesce(F.sum("n"), F.lit(0))
    return buckets.agg(entries.alias("entries"), F.sha2(F.concat(entries.cast("string"), F.lit(":"), ordered).cast("binary"), 256).alias("fingerprint"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, code) of the files of ``before`` that ``after`` has no more, or with another size or hash.

    Both have (relative_path, size_bytes, content_hash), where a null hash means that the file could not be read. A path that is listed more than once
    has drifted unless all its rows of ``after`` are alike and equal those of ``before``.
    """
    of = lambda df, side: df.groupBy("relative_path").agg(F.sort_array(F.collect_set(F.struct(F.coalesce("size_bytes", F.lit(-1)).cast("long").alias("size_bytes"), F.coalesce("content_hash", F.lit("")).alias("content_hash")))).alias(side), F.bool_and(F.col("content_hash").isNull()).alias(f"{side}_lost"))
    joined = of(before, "a").join(of(after, "b"), "relative_path", "left")
    lost = F.col("b").isNull() | F.col("b_lost")
    return joined.where(lost | (F.col("a") != F.col("b"))).select("relative_path", F.when(lost, "file_read_failed").otherwise("file_changed").alias("code"))


def unbound(selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """(relative_path, side) of the paths that only the selection or only the manifest has: none if both are of the same files."""
    sides = selected.select("relative_path", F.lit(1).alias("side")).unionByName(manifest.select("relative_path", F.lit(2).alias("side")))
    seen = sides.groupBy("relative_path").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return seen.where("low = high").select("relative_path", F.when(F.col("low") == 1, "selection").otherwise("manifest").alias("side"))


def exactly_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and the number of rows of ``right`` for each distinct key of ``left``, and whether there is exactly one; nulls equal nulls."""
    counts = right.groupBy(*key).agg(F.count(F.lit(1)).alias("matches"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = left.select(*key).distinct().alias("l").join(counts.alias("r"), same, "left")
    matches = F.coalesce(F.col("r.matches"), F.lit(0)).cast("long")
    return joined.select(*[F.col(f"l.{k}").alias(k) for k in key], matches.alias("matches"), (matches == 1).alias("accepted"))


def index_summary(chunks: DataFrame) -> DataFrame:
    """One row: the files that have chunks, the chunks, and those with a secret masked; (relative_path, redacted)."""
    return chunks.agg(F.count_distinct("relative_path").alias("files_indexed"), F.count(F.lit(1)).alias("records_written"), F.count_if("redacted").alias("redacted_records"))


def mapping_status(mappings: DataFrame, files: DataFrame, limited: bool = False) -> DataFrame:
    """One row: the status of test mappings, and their number, which is null unless complete.

    A mapping has the graph status of its test file (``files``: relative_path, graph_status), or not_reported without one. All are complete, or
    there are none and nothing was cut off (``limited``): complete; else partial.
    """
    known = files.groupBy("relative_path").agg(F.max("graph_status").alias("graph_status"))
    rows = mappings.join(known, "relative_path", "left").withColumn("status", F.coalesce("graph_status", F.lit("not_reported")))
    whole = F.coalesce(F.bool_and(F.col("status") == "complete"), F.lit(True)) & ~F.lit(limited)
    row = rows.agg(whole.alias("whole"), F.count(F.lit(1)).alias("n"))
    return row.select(F.when(F.col("whole"), "complete").otherwise("partial").alias("status"), F.when(F.col("whole"), F.col("n")).alias("mappings"))
