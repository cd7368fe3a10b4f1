"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of all words but stops at ``cap`` times its own size; what it cannot
take is shared again by weight among the others until none is above its cap. The fixed point has a closed
form: in order of size / weight the capped sources are a prefix, which two window sums over the table of
sources find. A source then takes every document ``whole`` times and, of a seeded order of its documents,
the leading ones once more until the remaining words are met.

Defined cases: null text or text without words has size 0 and is taken 0 times its size; a null source is a
source of its own, ordered last; rows that repeat a doc_id share one place in the seeded order (a null
doc_id counts as an empty one) and are taken alike; an empty table gives an empty result; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sourcelake.llm.shared import Workspace, fresh

WORDS = "[^\\x20\\x09-\\x0D]+"
#: Largest table of sources that is broadcast; beyond it the sources are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Hex digits of the hash that number the buckets of a source's seeded order.
BUCKET_DIGITS = 4


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def order_key(doc_id: str, seed: int):
    """Place of a document in its source's seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source, so one task holds the table of sources."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        ranked.withColumn("w", w)
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("left_over", F.sum("source_size").over(everything) - before)
        .withColumn("weight_left", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("most") * F.col("weight_left") <= F.col("left_over") * F.col("w"))
        .withColumn("open_words", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0)))
        .withColumn("open_weight", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
        .select("source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise((F.col("w") * F.col("open_words")).cast("double") / F.col("open_weight")).alias("target"))
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(narrow, sources): the documents as (doc_id, source, size, place), and per source its size, target, whole repetitions and the last place that is taken once more."""
    space = Workspace(docs.sparkSession, "mixing")
    narrow = space.keep(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), order_key(doc_id, seed).alias("place")), "narrow")
    sources = water_fill(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    sources = space.keep(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "sources")
    small = sources.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)

    bucket = F.substring("place", 1, BUCKET_DIGITS)
    sums = narrow.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    # the bucket of each source in which its remaining words run out: its documents alone are put in order
    edge = (
        sums.withColumn("start", up_to - F.col("words"))
        .alias("b").join(hint(sources).alias("s"), F.expr("b.source <=> s.source"))
        .where("start <= rest and start + words > rest")
        .select("b.source", "bucket", "start", "rest")
    )
    edge = space.keep(edge, "edge")
    inside = narrow.alias("n").join(hint(edge).alias("e"), F.expr(f"n.source <=> e.source and substring(place, 1, {BUCKET_DIGITS}) = e.bucket"))
    places = inside.groupBy("e.source", "e.bucket", "start", "rest", "place").agg(F.sum("size").alias("words"))
    over = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("place"))
    taken = places.withColumn("over", over).where("2 * over - words <= 2 * rest").groupBy("source").agg(F.max("place").alias("last"))
    cut = edge.alias("e").join(taken.alias("t"), F.expr("e.source <=> t.source"), "left").select("e.source", F.coalesce("last", "bucket").alias("last"))
    sources = sources.alias("s").join(cut.alias("c"), F.expr("s.source <=> c.source"), "left").select("s.source", "source_size", "target", "whole", F.coalesce("last", F.lit("")).alias("last"))
    return narrow, space.keep(sources, "plan")


def _times(hinted: DataFrame, rows: DataFrame, source: str, place, names: dict[str, str]) -> DataFrame:
    rows = rows.withColumn(names["place"], place)
    joined = rows.join(hinted.select([F.col(c).alias(names[c]) for c in hinted.columns]), F.col(source).eqNullSafe(F.col(names["source"])))
    return joined.withColumn(names["times"], F.col(names["whole"]) + (F.col(names["place"]) <= F.col(names["last"])).cast("long"))


def _names(columns: list[str]) -> dict[str, str]:
    own = ["source", "source_size", "target", "whole", "last", "place", "times", "copy"]
    return dict(zip(own, fresh(columns, *[f"__mix_{c}" for c in own])))


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, times (repetitions in the mix) and taken (words)."""
    narrow, sources = plan(docs, **options)
    hinted = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    names = _names(narrow.columns)
    rows = _times(hinted, narrow, "source", F.col("place"), names)
    return rows.select("doc_id", "source", "size", F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"), F.col(names["times"]).alias("times"), (F.col("size") * F.col(names["times"])).alias("taken"))


def mix_rows(docs: DataFrame, seed: int = 0, doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    _, sources = plan(docs, seed=seed, doc_id=doc_id, source=source, **options)
    hinted = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    names = _names(docs.columns)
    rows = _times(hinted, docs, source, order_key(doc_id, seed), names)
    return rows.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(0), F.col(names["times"]).cast("int")))).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
s1 AS (SELECT *, CAST((rank - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, total - CAST(coalesce(sum(most) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over,
              CAST(sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left FROM s1),
s3 AS (SELECT *, most * weight_left <= left_over * w AS capped FROM s2),
s4 AS (SELECT *, total - CAST(coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0) AS BIGINT) AS open_words, CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS BIGINT) AS open_weight FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(w * open_words AS DOUBLE) / CAST(open_weight AS DOUBLE) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / CAST(source_size AS DOUBLE)) AS BIGINT) END AS whole FROM s5),
s AS (SELECT *, target - CAST(whole * source_size AS DOUBLE) AS rest FROM s6),
p AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
q AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) AS over FROM p)
SELECT d.doc_id, d.size, s.source_size, s.target,
       CAST(d.size * (s.whole + CASE WHEN CAST(2 * q.over - q.words AS DOUBLE) <= 2 * s.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN q ON q.source IS NOT DISTINCT FROM d.source AND q.place = d.place
"""
