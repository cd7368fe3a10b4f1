"""Chunks, snapshots and their deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sourcelake.functions.parse import parse
from sourcelake.functions.secrets import detect, mask
from sourcelake.functions.segments import pieces, segments

CHUNK_BYTES = 16 << 10
CHUNK = "relative_path string, part_index long, start_byte long, end_byte long, start_line long, end_line long, content string, redaction_count long"


def split_text(text: str, limit: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Byte ranges of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    return pieces(data, 0, len(data), limit)


def chunks(files: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Redacted chunks of whole files; secrets are found in the file before it is cut, so none is left readable at a cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for path, text in zip(frame.relative_path, frame.content):
                spans = detect(text)
                data = mask(text, spans).encode()
                line = 1
                for i, (a, b) in enumerate(split_text(text, limit)):
                    piece = data[a:b]
                    lines = piece.count(b"\n")
                    last = line + lines - (1 if piece.endswith(b"\n") else 0)
                    rows.append((path, i, a, b, line, max(line, last), piece.decode("utf-8", "replace"), sum(s < b and e > a for _, s, e in spans)))
                    line += lines
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    out = files.select("relative_path", "content").mapInPandas(run, CHUNK)
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("\u0001", F.lit("chunk"), "relative_path", F.col("part_index").cast("string")).cast("binary"), 256)).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


RECORD = "relative_path string, language string, symbol_kind string, symbol_name string, qualified_name string, occurrence long, part_index long, start_byte long, end_byte long, start_line long, end_line long, content string, redacted boolean, redaction_count long, code string"


def structural_chunks(files: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Redacted chunks along the symbols of each file (Python; files of other languages are cut by size alone).

    ``files`` has relative_path, language and content. Null and empty contents have no chunks. A row whose ``code``
    is not null tells of a bound: the file's chunks ignore its symbols, or, with a null content, there are none.
    Repeated files give repeated chunks.
    """

    def of(path: str, language: str, text: str | None) -> Iterator[tuple]:
        text = text or ""
        spans = detect(text)
        data = text.encode("utf-8", "surrogatepass")
        shown = mask(text, spans).encode("utf-8", "surrogatepass")
        found, code = segments(data, parse(language, text)["symbols"] if language == "python" else [], limit)
        if code and not found:
            yield path, language, "file", None, None, 0, 0, 0, 0, 1, 1, None, False, 0, code
        line = 1
        for owner, part, a, b in found:
            newlines = data.count(b"\n", a, b)
            last = max(line, line + newlines - data.endswith(b"\n", a, b))
            hit = sum(s < b and e > a for _, s, e in spans)
            yield path, language, owner.kind, owner.name, owner.qualified_name, owner.occurrence, part, a, b, line, last, shown[a:b].decode("utf-8", "replace"), hit > 0, hit, code
            line += newlines

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for frame in batches:
            for row in frame.itertuples(index=False):  # one file at a time: the chunks of a batch are never all held
                yield pd.DataFrame(of(*row), columns=names)

    return files.select("relative_path", "language", "content").mapInPandas(run, RECORD)


def delta(base: DataFrame, target: DataFrame) -> DataFrame:
    """Full outer join of two manifests (chunk_id, relative_path, content_hash): upsert, delete or unchanged per chunk."""
    b = base.select("chunk_id", F.col("relative_path").alias("bp"), F.col("content_hash").alias("bh"))
    t = target.select("chunk_id", F.col("relative_path").alias("tp"), F.col("content_hash").alias("th"))
    j = t.join(b, "chunk_id", "full_outer")
    op = F.when(F.col("th").isNull(), "delete").when(F.col("th").eqNullSafe(F.col("bh")) & F.col("tp").eqNullSafe(F.col("bp")), "unchanged").otherwise("upsert")
    return j.select("chunk_id", F.coalesce("tp", "bp").alias("relative_path"), op.alias("operation"), F.col("th").alias("content_hash"))


def delta_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("operation") == o).alias(f"{o}s" if o != "unchanged" else o) for o in ("upsert", "delete", "unchanged")])


#: Ranges of paths in which events are numbered, and paths sampled to place them.
EVENT_RANGES, EVENT_SAMPLE = 64, 6400


def _numbered(rows: DataFrame, first: list[str]) -> DataFrame:
    """``rows`` with ``seq``: their place by ``first``, relative_path and chunk_id, numbered within each of ``first``.

    Rows are numbered within ranges of paths, whose bounds come from one sample of fixed size, and the ranges'
    sizes are summed; no task sorts more than a range.
    """
    sample = sorted(r[0] for r in rows.select("relative_path").where("relative_path is not null").orderBy(F.xxhash64("relative_path", "chunk_id")).limit(EVENT_SAMPLE).collect())
    bounds = sorted({sample[i * len(sample) // EVENT_RANGES] for i in range(1, EVENT_RANGES)}) if sample else []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b <= F.col("relative_path")))
    ranged = rows.withColumn("__part", F.when(F.col("relative_path").isNull(), -1).otherwise(part))
    # a few rows per range: one task
    sizes = ranged.groupBy(*first, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*first).orderBy("__part")) - F.col("__n")).drop("__n")
    on = [*first, "__part"]
    place = F.row_number().over(Window.partitionBy(*on).orderBy("relative_path", "chunk_id"))
    return ranged.withColumn("__place", place).join(F.broadcast(before), on).withColumn("seq", (F.col("__before") + F.col("__place")).cast("long")).select(*rows.columns, "seq")


def events(changes: DataFrame) -> DataFrame:
    """The changes in the contract's order: upserts by path, then deletes by path; ``seq`` is the order within each kind."""
    return _numbered(changes.where("operation <> 'unchanged'"), ["operation"])


def event_stream(changes: DataFrame) -> DataFrame:
    """The whole stream with one sequence from 0: start, upserts, deletes, complete, the last with the numbers of each."""
    rows = events(changes)
    counts = rows.groupBy().agg(F.count_if(F.col("operation") == "upsert").alias("upserts"), F.count_if(F.col("operation") == "delete").alias("deletes"))
    body = rows.crossJoin(F.broadcast(counts.select("upserts"))).withColumn("seq", F.when(F.col("operation") == "delete", F.col("seq") + F.col("upserts")).otherwise(F.col("seq")))
    none = F.lit(None)
    start = counts.select(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("event"), none.cast("string").alias("chunk_id"), none.cast("string").alias("relative_path"), none.cast("string").alias("content_hash"), none.cast("long").alias("upserts"), none.cast("long").alias("deletes"))
    end = counts.select((F.col("upserts") + F.col("deletes") + 1).alias("seq"), F.lit("complete").alias("event"), none.cast("string").alias("chunk_id"), none.cast("string").alias("relative_path"), none.cast("string").alias("content_hash"), "upserts", "deletes")
    body = body.select("seq", F.col("operation").alias("event"), "chunk_id", "relative_path", "content_hash", none.cast("long").alias("upserts"), none.cast("long").alias("deletes"))
    return start.unionByName(body).unionByName(end)


def apply_changes(base: DataFrame, changes: DataFrame, commit: str | None = None) -> DataFrame:
    """``base`` after the changes; equals the target they were made from. With ``commit`` every row that stays or comes is bound to it (``commit_sha``)."""
    gone = changes.where("operation in ('upsert', 'delete')").select("chunk_id")
    new = changes.where("operation = 'upsert'").select("chunk_id", "relative_path", "content_hash")
    out = base.select("chunk_id", "relative_path", "content_hash").join(gone, "chunk_id", "left_anti").unionByName(new)
    return out if commit is None else out.withColumn("commit_sha", F.lit(commit))


def mismatches(state: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of either side that the other does not have as often: none if a state equals its target manifest."""
    keys = ["chunk_id", "relative_path", "content_hash"]
    both = state.select(*keys, F.lit(1).alias("n")).unionByName(manifest.select(*keys, F.lit(-1).alias("n")))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0").select(*keys, F.when(F.col("n") > 0, "unexpected").otherwise("missing").alias("problem"))


def covers_base(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Whether a base path equals each candidate or lies below it, as an equi join over the base paths' ancestors."""
    parts = F.split("relative_path", "/")
    ancestors = base.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("candidate")).distinct()
    found = candidates.join(ancestors.withColumn("hit", F.lit(True)), "candidate", "left")
    return found.select("candidate", F.col("hit").isNotNull().alias("covers_base"))
