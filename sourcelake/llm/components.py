"""Connected components of a table of links, as repeated large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sourcelake.llm.shared import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node that it reaches.

    Every step is a grouped minimum and a join, so a node with very many links is pre-aggregated and its join
    can be split; the steps' tables are written, so a lost executor costs one step. Stars and their like end
    after two steps, chains after a logarithmic number. Loops and repeated links are allowed.
    """
    edges = space.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}0")
    step, mark = 0, None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # every link now points down: the lesser neighbours of a node all move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        step += 1
        edges = space.keep(small, f"{name}{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        mark = tuple(now)
        if step > 1:
            space.drop(f"{name}{step - 2}")
