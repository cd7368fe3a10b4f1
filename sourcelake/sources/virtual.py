"""The documents as one repository of files: paths are arithmetic on doc_id, alike in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelake.functions import paths

_NAMES = ["composer.json", "package.json", "Cargo.toml", "go.mod", "requirements.txt", "pyproject.toml", "Gemfile", "pom.xml", "build.gradle", "Dockerfile", "compose.yml", "README", "yarn.lock", "app.min.js", "x.spec.ts"]
_EXT = ["py", "ts", "js", "php", "rs", "sh", "md", "json", "yml", "toml", "bin"]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PATH_SQL = f"""concat(CASE doc_id % 29 WHEN 7 THEN 'node_modules/' WHEN 8 THEN 'build/' WHEN 9 THEN '.Git/' ELSE '' END,
 {_case('doc_id % 5', ['src', 'docs', 'tests', 'lib', 'src/pkg'])}, '/d', CAST(doc_id - doc_id % 19 AS STRING), '/',
 CASE WHEN doc_id % 23 = 5 THEN {_case('doc_id % 15', _NAMES)}
      ELSE concat(CASE WHEN doc_id % 7 = 3 THEN 'test_f' ELSE 'f' END, CAST(doc_id % 19 AS STRING), '.', {_case('doc_id % 11', _EXT)}) END)"""
#: DuckDB: the files as a common table expression.
FILES_SQL = f"f AS (SELECT doc_id, source AS repo_id, coalesce(text, '') AS content, {PATH_SQL} AS relative_path FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo_id, relative_path and content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), F.expr(PATH_SQL).alias("relative_path"), F.coalesce("text", F.lit("")).alias("content"))


def inventory(files: DataFrame) -> DataFrame:
    """The file inventory of ``files``: classification, size, hash and lines."""
    path, content = F.col("relative_path"), F.col("content")
    out = files.withColumns({"size_bytes": F.octet_length(content).cast("long"), "language": paths.language(path), "utf8": paths.is_utf8(content), "binary": paths.is_binary(content), "generated": paths.is_generated(path, content), "content_hash": F.sha2(content.cast("binary"), 256)})
    return out.withColumn("line_count", F.when(~F.col("binary"), paths.line_count(content.cast("string"))))
