"""Budgets of the walk. Walk order compares paths part by part."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window


def _walk(files: DataFrame) -> Window:
    return Window.partitionBy("repo_id").orderBy(F.split("relative_path", "/"))


def file_count(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files of each repository in walk order."""
    rows = files.select("repo_id", "relative_path")
    return rows.withColumn("place", F.row_number().over(_walk(rows)).cast("long")).where(F.col("place") <= limit)


def metadata_bytes(files: DataFrame, limit: int) -> DataFrame:
    """Files before the first whose charge (256 and its path's bytes) runs over the budget."""
    rows = files.select("repo_id", "relative_path").withColumn("charge", (256 + F.octet_length("relative_path")).cast("long"))
    return rows.withColumn("charged", F.sum("charge").over(_walk(rows))).where(F.col("charged") <= limit).drop("charge")


def total_bytes(inv: DataFrame, limit: int) -> DataFrame:
    """Files that a greedy walk admits: one that is larger than what is left is skipped, the walk goes on.

    The window deals and orders the rows; it must stand right below the walk. A ``repartition`` does not do: it is left out
    where a join below has dealt by the same column, and the join may become a broadcast join while it runs.
    """
    w = Window.partitionBy("repo_id").orderBy(F.split("relative_path", "/"), "size_bytes")
    # a file over the whole budget is never admitted
    rows = inv.select("repo_id", "relative_path", "size_bytes").where(F.col("size_bytes") <= limit).withColumn("place", F.row_number().over(w))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = limit
        for frame in batches:
            keep = []
            for place, size in zip(frame.place.tolist(), frame.size_bytes.tolist()):
                if place == 1:
                    left = limit
                keep.append(size <= left)
                left -= size if keep[-1] else 0
            yield frame.loc[pd.Series(keep, index=frame.index, dtype=bool), ["repo_id", "relative_path", "size_bytes"]]

    return rows.mapInPandas(walk, "repo_id string, relative_path string, size_bytes long")
