"""Resolution of imports inside a tree, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dependency_facts(parsed: DataFrame) -> DataFrame:
    """(relative_path, language, syntax, module) of every dependency of parsed files, once each; (relative_path, language, parsed)."""
    rows = parsed.select("relative_path", "language", F.explode("parsed.dependencies").alias("d"))
    return rows.select("relative_path", "language", "d.syntax", "d.module").distinct()


def _walk(start: Column, parts: Column) -> Column:
    """The segments ``start`` after the steps of ``parts``; null where they lead out of the tree."""

    def step(at: Column, part: Column) -> Column:
        up = F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.size(at) - 1))
        return F.when(at.isNull(), at).when(part.isin("", "."), at).when(part == "..", up).otherwise(F.concat(at, F.array(part)))

    return F.aggregate(parts, start, step)


def candidates(facts: DataFrame) -> DataFrame:
    """(relative_path, module, target) of the files that a relative import may mean: of a script the named file, which must have an extension; of Python a module or a package."""
    segments = F.split("relative_path", "/")
    folder = F.slice(segments, F.lit(1), F.size(segments) - 1)
    m = F.col("module")
    script = F.col("language").isin("javascript", "typescript") & (m.startswith("./") | m.startswith("../")) & ~m.rlike(r"[?#\\\p{Cntrl}]") & m.rlike(r"/(?!\.+$)[^/]+\.[^/]*$")
    named = F.when(script, _walk(folder, F.split(m, "/")))
    dots = F.length(F.regexp_extract(m, r"^\.+", 0))
    rest = F.regexp_replace(m, r"^\.+", "")
    python = (F.col("language") == "python") & (dots > 0) & rest.rlike(r"^[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*$") & (F.size(folder) >= dots - 1)
    stem = F.when(python, F.concat(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - dots + 1, F.lit(0))), F.split(rest, r"\.")))
    joined = lambda c: F.array_join(c, "/")
    targets = F.when(named.isNotNull() & (F.size(named) > 0), F.array(joined(named))).when(stem.isNotNull(), F.array(F.concat(joined(stem), F.lit(".py")), F.concat(joined(stem), F.lit("/__init__.py"))))
    return facts.where("module is not null").select("relative_path", "module", F.explode(targets).alias("target"))


def dependency_edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(relative_path, target) of the imports that mean exactly one of ``files``."""
    found = candidates(facts).join(files.select(F.col("relative_path").alias("target")).distinct(), "target")
    return found.groupBy("relative_path", "module").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1").select("relative_path", "target").distinct()


def graph_statuses(statuses: DataFrame, facts: DataFrame) -> DataFrame:
    """``statuses`` (relative_path, graph_status, ...) with a complete status made partial where a file has imports whose module is not literal."""
    dynamic = facts.where("syntax = 'dynamic' or module is null").select("relative_path").distinct().withColumn("dynamic", F.lit(True))
    joined = statuses.join(dynamic, "relative_path", "left")
    return joined.withColumn("graph_status", F.when(F.col("dynamic") & (F.col("graph_status") == "complete"), "partial").otherwise(F.col("graph_status"))).drop("dynamic")


def limited_edges(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` edges by path, one row with the number emitted and suppressed)."""
    rows = edges.select("relative_path", "target").distinct()
    n = F.count(F.lit(1))
    return rows.orderBy("relative_path", "target").limit(limit), rows.agg(F.least(n, F.lit(limit)).cast("long").alias("emitted"), F.greatest(n - limit, F.lit(0)).cast("long").alias("suppressed"))
