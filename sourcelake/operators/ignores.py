"""Ignore files of a tree, applied as joins: every path meets the rules of the folders above it.

A path is decided by the innermost folder with a rule that fits it, and there by the last such rule. What lies in
an ignored folder is ignored. Tracked files, and folders with tracked files, are not ignored by their own rules.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sourcelake.functions.paths import glob_regex

#: Rules per ignore file, bytes per file and per line; more make the file's rules unknown, so they are left out.
MAX_RULES, MAX_BYTES, MAX_LINE = 8192, 64 << 10, 1024
RULES = "array<struct<regex:string,ignore:boolean,folders:boolean>>"


def rules(text: str | None) -> list[dict] | None:
    """Rules of an ignore file in order; None where a bound is exceeded. Null is empty."""
    if len((text or "").encode()) > MAX_BYTES:
        return None
    out = []
    for raw in (text or "").split("\n"):
        line = raw.removesuffix("\r")
        if len(line.encode()) > MAX_LINE:
            return None
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        pattern = line[1:] if keep else line
        if pattern.strip("/"):
            out.append({"regex": glob_regex(pattern, below=False), "ignore": not keep, "folders": pattern.endswith("/")})
    return out if len(out) <= MAX_RULES else None


def _rules(texts: pd.Series) -> pd.Series:
    return texts.map(rules)


def parent(path):
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path):
    """The folders above a path, outermost first, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def ignored(files: DataFrame, ignore_files: DataFrame, tracked: DataFrame) -> DataFrame:
    """(repo_id, relative_path, ignored) of ``files``; all tables by repo_id and relative_path.

    ``ignore_files`` has the text in ``content``; each applies to its own folder. Repeated rows count once; paths
    that are null have no row; of several ignore files of one folder the last by path and text holds.
    """
    path = F.col("relative_path")
    paths = files.select("repo_id", "relative_path").where(path.isNotNull()).distinct()
    scopes = ignore_files.where(path.isNotNull()).select("repo_id", parent(path).alias("scope"), F.struct("relative_path", "content").alias("file")).groupBy("repo_id", "scope").agg(F.max("file").alias("file"))
    scopes = scopes.select("repo_id", "scope", F.pandas_udf(_rules, RULES)("file.content").alias("rules")).where("size(rules) > 0")
    folders = paths.select("repo_id", F.explode(ancestors(path)).alias("relative_path")).distinct()
    entries = paths.withColumn("folder", F.lit(False)).unionByName(folders.withColumn("folder", F.lit(True)))
    above = entries.withColumn("scope", F.explode(F.concat(F.array(F.lit("")), ancestors(path))))
    inside = F.when(F.col("scope") == "", path).otherwise(F.expr("substring(relative_path, length(scope) + 2)"))
    fits = F.filter("rules", lambda r: F.rlike(F.col("inside"), r.regex) & (~r.folders | F.col("folder")))
    met = above.join(scopes, ["repo_id", "scope"]).withColumn("inside", inside).withColumn("rule", F.element_at(F.transform(fits, lambda r: r.ignore), F.when(F.size(fits) > 0, -1)))
    own = met.where("rule is not null").groupBy("repo_id", "relative_path", "folder").agg(F.max_by("rule", F.length("scope")).alias("rule")).where("rule")
    known = tracked.select("repo_id", "relative_path").where(path.isNotNull())
    kept = known.withColumn("folder", F.lit(False)).unionByName(known.select("repo_id", F.explode(ancestors(path)).alias("relative_path")).withColumn("folder", F.lit(True))).distinct()
    own = own.join(kept, ["repo_id", "relative_path", "folder"], "left_anti").select("repo_id", F.col("relative_path").alias("at"), "folder")
    reach = paths.select("repo_id", "relative_path", F.explode(F.concat(F.transform(ancestors(path), lambda p: F.struct(p.alias("at"), F.lit(True).alias("folder"))), F.array(F.struct(path.alias("at"), F.lit(False).alias("folder"))))).alias("e")).select("repo_id", "relative_path", "e.*")
    hit = reach.join(own, ["repo_id", "at", "folder"], "left_semi").select("repo_id", "relative_path").distinct()
    return paths.join(hit.withColumn("hit", F.lit(True)), ["repo_id", "relative_path"], "left").select("repo_id", "relative_path", F.col("hit").isNotNull().alias("ignored"))
