"""The library's functions and relations by name, for Spark SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelake.functions.parse import PARSED, _parse_columns
from sourcelake.functions.secrets import SPANS, _detect_column, _redact_column

REDACTED = "struct<content:string,redacted:boolean,redaction_count:long,redaction_complete:boolean>"


@F.udtf(returnType="part_index long, start_byte long, end_byte long, content string")
class ChunkRows:
    """The redacted pieces of a text of at most ``limit`` bytes each; none of a null or empty text."""

    def eval(self, text: str, limit: int):
        from sourcelake.functions.secrets import detect, mask
        from sourcelake.operators.snapshot import split_text

        data = (mask(text, detect(text)) or "").encode("utf-8", "surrogatepass")
        for i, (a, b) in enumerate(split_text(text or "", limit)):
            yield i, a, b, data[a:b].decode("utf-8", "replace")


def register(spark: SparkSession) -> list[str]:
    """Makes ``detect_secrets(text)``, ``redact_secrets(text)``, ``parse_source(language, text)`` and the table function
    ``chunk_rows(text, limit)`` known to SQL of this session, and gives their names."""
    made = {"detect_secrets": F.pandas_udf(_detect_column, SPANS), "redact_secrets": F.pandas_udf(_redact_column, REDACTED), "parse_source": F.pandas_udf(_parse_columns, PARSED)}
    for name, function in made.items():
        spark.udf.register(name, function)
    spark.udtf.register("chunk_rows", ChunkRows)
    return [*made, "chunk_rows"]


def views(relations: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """A temporary view for each relation, by its name; names that are not plain are refused."""
    names = [f"{prefix}{name}" for name in relations]
    for name in names:
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"{name!r} is no name of a view")
    for name, relation in zip(names, relations.values()):
        relation.createOrReplaceTempView(name)
    return names
