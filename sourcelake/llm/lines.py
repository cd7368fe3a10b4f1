"""Line dedup by pairwise alignment.

A block is a run of lines that is the same in two documents, line by line, lines without a word aside and without
white space at their ends. Single lines are common; what tells that two documents overlap are their rare ones, so
lines are taken with their neighbours: a seed is the shortest run of at least ``MIN_BLOCK_WORDS`` words from a line
on, or back from it. Two documents that share a block share all its seeds.

1. Of the documents that share a seed the first (by doc_id, then text hash) owns it. A later document is paired with
   the owners of its seeds: as many pairs as it has owners, however many documents share a passage.
2. Each pair is aligned by patience: of the seeds that the pair shares, in the later document's order, a longest run
   of rising places in the earlier one is in order, and seeds on one diagonal are one block. The other shared seeds
   are blocks that were moved or repeated.
3. Aligned blocks go from the later document; with ``moved`` (as in the query) those out of order go too, so that no
   run of ``MIN_BLOCK_WORDS`` words stays in two documents. Then the result is that of aligning all pairs.

The first document that has a line keeps it, or an even earlier one does.

Defined cases: null or empty texts have no lines and stay as they are; rows of one doc_id and text are one
document and get the same result; rows of one doc_id and different texts are different documents; null
doc_ids are not compared and stay whole; an empty table gives an empty result; other columns, whatever their
names, pass through ``remove_lines``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sourcelake.llm import scan
from sourcelake.llm.shared import Workspace, fresh

MIN_BLOCK_WORDS = 20


def _line_bounds(chunk: scan.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all lines."""
    cuts = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate((chunk.offsets[:-1], cuts + 1)), kind="stable")
    ends = np.sort(np.concatenate((chunk.offsets[1:], cuts)), kind="stable")
    return starts, ends


def seeds_of(h: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, past last) of the seeds of texts, from the hashes and numbers of words of their lines and the bounds of each text's lines."""
    total, at = np.concatenate(([0], np.cumsum(words))), np.arange(len(h))
    to = np.searchsorted(total, total[:-1] + MIN_BLOCK_WORDS)
    from_ = np.searchsorted(total, total[1:] - MIN_BLOCK_WORDS, "right") - 1
    owner = scan.owners(bounds)
    forth = to <= bounds[1:][owner]
    back = from_ >= bounds[:-1][owner]
    back[back] = to[from_[back]] != at[back] + 1  # the others are seeds already
    lo, hi = np.concatenate((at[forth], from_[back])), np.concatenate((to[forth], at[back] + 1))
    up, down = scan.powers(len(h) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return scan.mix((prefix[hi] - prefix[lo]) * down[lo] + (hi - lo).astype(np.uint64)), lo, hi


def _seeds(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, t, lo, hi, key) of every seed; lo and hi count lines with a word from 0, t is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in scan.chunks(batch.column(1)):
                starts, ends = chunk.runs(~scan.SPACE[chunk.data])
                lines, line_ends = _line_bounds(chunk)
                first, last = np.searchsorted(starts, lines), np.searchsorted(starts, line_ends)
                some = last > first
                first, last = first[some], last[some]
                h = chunk.hashes(starts[first], ends[last - 1])
                bounds = np.searchsorted(starts[first], chunk.offsets)
                key, lo, hi = seeds_of(h, last - first, bounds)
                owner = scan.owners(bounds)[lo]
                whole = chunk.hashes(chunk.offsets[:-1], chunk.offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[chunk.first + owner].astype(np.int64)), pa.array(whole[owner].view(np.int64)), pa.array((lo - bounds[owner]).astype(np.int32)), pa.array((hi - bounds[owner]).astype(np.int32)), pa.array(key.view(np.int64))],
                    ["d", "t", "lo", "hi", "key"],
                )

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, "d long, t long, lo int, hi int, key long")


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence, by patience."""
    tails, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect.bisect_left(tails, v)
        before[i] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(v), at.append(i)
        else:
            tails[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """Blocks (first line, past the last, first line in the partner, moved) of a pair's shared seeds, which cover lines lo to hi and begin at line ``at`` of the partner."""
    order = np.lexsort((at, hi, lo))
    lo, hi, at = lo[order], hi[order], at[order]
    moved = np.ones(len(lo), bool)
    # a line may begin two seeds; both are on one diagonal
    first = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (at[1:] != at[:-1]))))
    ordered = first[rising(at[first].tolist())]
    moved[ordered] = False
    moved = np.minimum.reduceat(moved, first)[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(lo))))]
    out = []
    for is_moved in (False, True):
        i = np.flatnonzero(moved == is_moved)
        i = i[np.lexsort((lo[i], at[i] - lo[i]))]
        shift, a, b = at[i] - lo[i], lo[i], hi[i]
        for j in range(len(i)):
            if out and out[-1][3] == is_moved and out[-1][2] - out[-1][0] == shift[j] and a[j] <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], int(b[j])), out[-1][2], is_moved)
            else:
                out.append((int(a[j]), int(b[j]), int(at[i][j]), is_moved))
    return out


BLOCKS = "array<struct<lo:int,hi:int,d:bigint,t:bigint,at:int,moved:boolean>>"


def aligned_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, blocks): per document that shares blocks with earlier ones, the blocks (lo, hi) of its lines with a word, the partner d, t and its first line ``at``, and whether the block is out of order there."""
    space = Workspace(docs.sparkSession, "lines")
    seeds = space.keep(_seeds(docs, doc_id, text), "seeds")
    place = F.struct("d", "t", "lo")
    owned = seeds.groupBy("key").agg(F.min(place).alias("own"), F.max(F.struct("d", "t")).alias("last"))
    owned = owned.where("own.d <> last.d or own.t <> last.t").select("key", F.col("own.d").alias("od"), F.col("own.t").alias("ot"), F.col("own.lo").alias("at"))
    shared = seeds.join(owned, "key").where("d <> od or t <> ot")
    found = shared.groupBy("d", "t").agg(F.collect_list(F.struct("od", "ot", "lo", "hi", "at")).alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, ends = [[] for _ in range(6)], [0]
            for found in batch.column(2):
                od, ot, lo, hi, at = (found.values.field(c).to_numpy() for c in range(5))
                order = np.lexsort((ot, od))
                od, ot, lo, hi, at = od[order], ot[order], lo[order], hi[order], at[order]
                cuts = np.flatnonzero(np.concatenate(([True], (od[1:] != od[:-1]) | (ot[1:] != ot[:-1]), [True])))
                n = 0
                for a, b in zip(cuts[:-1], cuts[1:]):
                    for block in align(lo[a:b], hi[a:b], at[a:b]):
                        for c, x in zip(columns, (block[0], block[1], od[a], ot[a], block[2], block[3])):
                            c.append(x)
                        n += 1
                ends.append(ends[-1] + n)
            if len(batch):
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
                blocks = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lo", "hi", "d", "t", "at", "moved"])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks)], ["d", "t", "blocks"])

    return space.keep(found.mapInArrow(run, f"d long, t long, blocks {BLOCKS}"), "blocks")


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", moved: bool = True, counts: tuple[str, str] = ("__l_lines", "__l_deleted")) -> DataFrame:
    """``docs`` with deleted lines taken out of ``text``, and its lines with a word, before, and how many of these went, named by ``counts`` (with underscores behind where ``docs`` has such names).

    ``moved``: whether blocks go that stand out of order in the two documents.
    """
    names, counts = docs.columns, fresh(docs.columns, *counts)
    d, salt, all_found, t, own = fresh(names, "__l_d", "__l_salt", "__l_found", "t", "ranges")
    wanted = F.col("blocks") if moved else F.filter("blocks", lambda x: ~x.moved)
    ranges = aligned_blocks(docs, doc_id, text).select(F.col("d").alias(d), F.col("t").alias(t), F.transform(wanted, lambda x: F.struct(x.lo.alias("lo"), x.hi.alias("hi"))).alias(own))
    # several texts of one doc_id meet the ranges of all of them; the text's hash picks its own
    per_id = ranges.groupBy(d).agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col(own).alias("ranges"))).alias(all_found)).withColumn(salt, F.lit(0).cast("long"))
    # by a shuffle at every size: the ranges grow with the corpus. Rows without a doc_id find nothing and are dealt by their text
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(0)
    rows = docs.join(per_id.hint("merge"), (F.col(doc_id) == F.col(d)) & (key == F.col(salt)), "left").drop(d, salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            texts, found = batch.column(at), batch.column(batch.schema.names.index(all_found))
            new, total, gone = texts.to_pylist(), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for chunk in scan.chunks(texts):
                starts, _ = chunk.runs(~scan.SPACE[chunk.data])
                lines, ends = _line_bounds(chunk)
                some = np.searchsorted(starts, ends) > np.searchsorted(starts, lines)
                total[chunk.first : chunk.first + len(chunk)] = np.diff(np.searchsorted(lines[some], chunk.offsets))
                whole = None
                for i in range(len(chunk)):
                    row = chunk.first + i
                    if found[row].is_valid and new[row]:
                        whole = chunk.hashes(chunk.offsets[:-1], chunk.offsets[1:]).view(np.int64) if whole is None else whole
                        drop = np.zeros(total[row] + 1, np.int64)
                        for x in found[row].as_py():
                            if x["t"] == whole[i]:
                                for r in x["ranges"]:
                                    drop[r["lo"]] += 1
                                    drop[r["hi"]] -= 1
                        drop = np.cumsum(drop) > 0
                        kept, k = [], 0
                        for line in new[row].split("\n"):
                            has = any(c not in " \t\n\v\f\r" for c in line)
                            if not (has and drop[k]):
                                kept.append(line)
                            k += has
                        new[row], gone[row] = "\n".join(kept), drop.sum()
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(batch.schema.names.index(c)) for c in names] + [pa.array(total), pa.array(gone)], [*names, *counts])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]]))


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, kept_chars and kept_sha256 of the text that stays (null: empty)."""
    rows = remove_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    left = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.col("__l_lines").alias("n_lines"), F.col("__l_deleted").alias("n_deleted"), F.length(left).cast("long").alias("kept_chars"), F.sha2(left.cast("binary"), 256).alias("kept_sha256"))
