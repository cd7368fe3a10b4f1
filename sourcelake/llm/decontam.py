"""Benchmark decontamination by a prefix-filtered set join of word shingles.

A window of an item (``WINDOW`` consecutive words; a shorter item is one window) occurs in a document only if
all shingles of the window do, so of a window's shingles, ordered by their frequency in the corpus, the rarest
alone is the necessary prefix. Documents are scanned for these prefix shingles; each match fixes where the
window would start (positional bound), windows that leave the document are dropped (length bound), and the
rest are compared with the whole window. Words inside a confirmed window are hit.

The windows of ``BLOCK_WINDOWS`` at a time are broadcast (some hundred bytes each); a larger benchmark is worked off
in such blocks, one after another against all documents. Each block's hits are written by the text's hash and its
broadcasts given free, so executors hold one block; in the end the ranges are merged per text and joined.

Defined cases: null or empty texts have no words; an item without words matches nothing; repeated rows each
get a result; items with equal texts all count; null item_ids are left out; an empty benchmark or corpus
gives no hits or no rows; other columns, whatever their names, pass through ``clean_documents``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sourcelake.llm import scan
from sourcelake.llm.shared import Workspace, small_batches

WINDOW, SHINGLE = 10, 3
BLOCK_WINDOWS = 500_000
_MASK = np.uint64((1 << 22) - 1)


def words_of(chunk: scan.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and per-text bounds of the words of a folded chunk."""
    starts, ends = chunk.runs(~scan.NOT_ALNUM[chunk.data])
    return starts, ends, chunk.hashes(starts, ends), chunk.bounds(starts)


class Windows:
    """Distinct windows of a block of items: word hashes, the items of each, and their shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        found: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.items: list[list[int]] = []
        texts = pa.array([t for _, t in items], pa.string())
        for chunk in scan.chunks(texts):
            chunk = chunk.fold()
            _, _, h, bounds = words_of(chunk)
            for i in range(len(chunk)):
                own = h[bounds[i] : bounds[i + 1]]
                for at in range(max(1, len(own) - WINDOW + 1)) if len(own) else []:
                    w = own[at : at + WINDOW]
                    key = w.tobytes()
                    if key not in found:
                        found[key] = len(self.words)
                        self.words.append(w)
                        self.items.append([])
                    item = items[chunk.first + i][0]
                    if not self.items[found[key]] or self.items[found[key]][-1] != item:
                        self.items[found[key]].append(item)
        self.shingles = []  # per window: shingle length and the hash at each offset
        for w in self.words:
            k = min(SHINGLE, len(w))
            self.shingles.append((k, scan.windows(w, np.array([0, len(w)]), k)[0]))

    def all_shingles(self) -> dict[int, np.ndarray]:
        return {k: np.unique(np.concatenate([s for n, s in self.shingles if n == k])) for k in {n for n, _ in self.shingles}}

    def prefix(self, frequency: dict[int, dict[int, int]]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Per shingle length: prefix shingle to (window, offset of the shingle in it)."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, (k, hashes) in enumerate(self.shingles):
            rare = min(range(len(hashes)), key=lambda o: (frequency.get(k, {}).get(int(hashes[o]), 0), int(hashes[o])))
            out.setdefault(k, {}).setdefault(int(hashes[rare]), []).append((i, rare))
        return out


class Lookup:
    """Membership of hashes in a fixed set: a bit table first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(int(_MASK) + 1, bool)
        self.bits[(self.keys & _MASK).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(h & _MASK).astype(np.int64)])
        at = np.searchsorted(self.keys, h[maybe])
        return maybe[self.keys[np.minimum(at, len(self.keys) - 1)] == h[maybe]]


def _frequencies(docs: DataFrame, text: str, shingles) -> dict[int, dict[int, int]]:
    """How often each of the block's shingles occurs in the corpus; at most as many rows as the block has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: Lookup(h) for k, h in shingles.value.items()}
        total = {k: np.zeros(len(t.keys), np.int64) for k, t in tables.items()}
        for batch in batches:
            for chunk in scan.chunks(batch.column(0)):
                _, _, h, bounds = words_of(chunk.fold())
                for k, t in tables.items():
                    s, _ = scan.windows(h, bounds, k)
                    hit = s[t.find(s)]
                    total[k] += np.bincount(np.searchsorted(t.keys, hit), minlength=len(t.keys))
        for k, t in tables.items():
            some = total[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k), pa.int32()), pa.array(t.keys[some].view(np.int64)), pa.array(total[k][some])], ["k", "h", "n"])

    rows = docs.select(text).mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r.k, {})[r.h & (2**64 - 1)] = r.n
    return out


def find(column, block: Windows, prefix: dict) -> Iterator[tuple[int, int, list[tuple[int, int]], list[int]]]:
    """(row, number of words, merged hit ranges of words, items) of each text."""
    tables = {k: Lookup(np.fromiter(p, np.uint64, len(p))) for k, p in prefix.items()}
    for chunk in scan.chunks(column):
        chunk = chunk.fold()
        _, _, h, bounds = words_of(chunk)
        ranges: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for k, table in tables.items():
            s, at = scan.windows(h, bounds, k)
            for j in table.find(s):
                p = int(at[j])
                doc = int(np.searchsorted(bounds, p, "right")) - 1
                for window, offset in prefix[k][int(s[j])]:
                    w, start = block.words[window], p - offset
                    if start >= bounds[doc] and start + len(w) <= bounds[doc + 1] and np.array_equal(h[start : start + len(w)], w):
                        lo = int(start - bounds[doc])
                        ranges.setdefault(doc, []).append((lo, lo + len(w)))
                        items.setdefault(doc, set()).update(block.items[window])
        for i in range(len(chunk)):
            yield chunk.first + i, int(bounds[i + 1] - bounds[i]), merged(ranges.get(i, [])), sorted(items.get(i, ()))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``most`` windows (or one longer item), by item_id."""
    block, held = [], 0
    words = F.regexp_count(F.col("t"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    items = items.withColumn("n", F.greatest(words - (WINDOW - 1), F.least(words, F.lit(1)))).where("n > 0").orderBy("i", "t")
    for r in items.toLocalIterator():
        if block and held + r.n > most:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += r.n
    yield block


EMPTY = {"__d_n_words": T.LongType(), "__d_ranges": T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])), "__d_items": T.ArrayType(T.LongType())}
_PA = {"__d_n_words": pa.int64(), "__d_ranges": pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), "__d_items": pa.list_(pa.int64())}


def _arrays(ranges: list, items: list) -> list[pa.Array]:
    return [pa.array([[{"lo": a, "hi": b} for a, b in x] for x in ranges], _PA["__d_ranges"]), pa.array(items, _PA["__d_items"])]


def _text_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole text."""
    found = [(chunk.hashes(chunk.offsets[:-1], chunk.offsets[1:]), scan.Chunk(scan.LOWER[::-1][chunk.data], chunk.offsets, 0).hashes(chunk.offsets[:-1], chunk.offsets[1:])) for chunk in scan.chunks(column)]
    return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for i in (0, 1))


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``__d_n_words``, ``__d_ranges`` (merged hit ranges of words) and ``__d_items``."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    docs = docs.select(*[c for c in docs.columns if keep is None or c in {*keep, text}])
    names = [c for c in docs.columns if keep is None or c in keep]
    fields = T.StructType([docs.schema[c] for c in names] + [T.StructField(k, v) for k, v in EMPTY.items()])

    def prepared(items: list[tuple[int, str]]):
        block = Windows(items)
        shingles = sc.broadcast(block.all_shingles())
        frequency = _frequencies(docs, text, shingles) if block.words else {}
        shingles.unpersist()
        return sc.broadcast((block, block.prefix(frequency)))

    def scanner(one, by_text: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(batch.schema.names.index(text))
                n, ranges, items = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
                for row, words, hit, ids in find(column, *one.value):
                    n[row], ranges[row], items[row] = words, hit, ids
                if by_text:
                    at = np.flatnonzero([bool(x) for x in items])
                    a, b = _text_keys(column)
                    yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), *_arrays([ranges[i] for i in at], [items[i] for i in at])], ["a", "b", "__d_ranges", "__d_items"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in names] + [pa.array(n), *_arrays(ranges, items)], [*names, *_PA])

        return run

    blocks = _blocks(benchmark, item_id, item_text, block_windows)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.mapInArrow(scanner(prepared(first), False), fields)

    space, found, hits = Workspace(docs.sparkSession, "decontam"), None, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), *fields.fields[-2:]])
    for i, items in enumerate(itertools.chain((first, second), blocks)):
        one = prepared(items)
        # equal texts have equal hits
        rows = docs.select(text).mapInArrow(scanner(one, True), hits).groupBy("a", "b").agg(F.first("__d_ranges").alias("__d_ranges"), F.first("__d_items").alias("__d_items"))
        rows = space.keep(rows, f"block{i}")
        found = rows if found is None else found.union(rows)
        one.unpersist()
    found = found.groupBy("a", "b").agg(F.flatten(F.collect_list("__d_ranges")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__d_items")))).alias("items"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            n = [np.diff(words_of(chunk.fold())[3]) for chunk in scan.chunks(column)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in names] + [pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()), *map(pa.array, _text_keys(column))], [*names, "__d_n_words", "__d_a", "__d_b"])

    keys = T.StructType([*fields.fields[:-2], T.StructField("__d_a", T.LongType()), T.StructField("__d_b", T.LongType())])
    rows = docs.mapInArrow(keyed, keys).join(found, (F.col("__d_a") == F.col("a")) & (F.col("__d_b") == F.col("b")), "left")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [merged([(x["lo"], x["hi"]) for x in r or []]) for r in batch.column(batch.schema.names.index("r")).to_pylist()]
            items = [x or [] for x in batch.column(batch.schema.names.index("items")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in [*names, "__d_n_words"]] + _arrays(ranges, items), [*names, *_PA])

    return rows.drop("__d_a", "__d_b", "a", "b").mapInArrow(joined, fields)


def decontam_table(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    rows = with_hits(docs.select(F.col(doc_id), F.col(text)), benchmark, text, keep=[doc_id], block_windows=block_windows)
    hit = F.aggregate("__d_ranges", F.lit(0).cast("long"), lambda a, r: a + r.hi - r.lo)
    ids = F.array_join(F.array_sort(F.transform("__d_items", lambda i: i.cast("string"))), ",")
    return rows.select(doc_id, F.col("__d_n_words").alias("n_words"), hit.alias("n_hit"), F.size("__d_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without hits."""
    own = docs.columns
    # under names that no internal column has
    plain = docs.select([F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(own)])
    rows = with_hits(plain, benchmark, f"c{own.index(text)}", block_windows=block_windows).where(F.size("__d_items") == 0)
    return rows.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
