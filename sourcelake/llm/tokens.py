"""Token ids in a bit-packed file format, written in ascending order of documents.

A shard holds consecutive documents with up to ``SHARD_TOKENS`` ids (one longer document is a shard alone) as
one self-describing image; images are rows of Parquet files, so any file system that Spark reaches can hold
them and Spark's commit protocol covers lost executors. ``export`` writes them as plain files.

    image  := magic "SLTK" | u16 version | u16 width | u32 block | u64 n_docs | u64 n_tokens
              | i64 doc_id[n_docs] | u8 null[n_docs] | u64 doc_end[n_docs] | u64 block_offset[n_blocks + 1] | payload

Each id takes ``width`` bits, the least that hold the vocabulary, little end first; each block of ``block`` ids
starts at a byte of its own, so any range of ids is read from its blocks alone.

Tokenising: a text is cut at ASCII white space and between ASCII letters or digits and ASCII punctuation
other than the apostrophe, if a trial text shows that the tokenizer gives the ids of the lower-cased pieces in a row;
each worker keeps the ids of pieces that it has met. Texts that contain ``<|``, and all texts for a tokenizer
that fails the trial, go to the tokenizer whole.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that repeat a doc_id
are ordered by text and each have their entry; an empty table writes no image; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sourcelake.llm import scan
from sourcelake.llm.shared import Workspace

MAGIC, VERSION, BLOCK = b"SLTK", 1, 4096
SHARD_TOKENS = 1 << 20
#: Pieces whose ids a worker keeps before it starts anew: about 40 bytes each.
KEPT_PIECES = 400_000
#: Characters of a text that help to place the ranges of documents.
RANGE_CHARS = 32


def bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """One block of ids."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if width in (8, 16, 32):
        return data[: n * width // 8].view(f"<u{width // 8}").astype(np.uint32)
    planes = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def image(doc_ids: list, ends: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    n_blocks = -(-len(ids) // block)
    packed = [pack(ids[i * block : (i + 1) * block], width) for i in range(n_blocks)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in packed]))).astype("<u8")
    head = MAGIC + np.array([VERSION, width], "<u2").tobytes() + np.array([block], "<u4").tobytes() + np.array([len(doc_ids), len(ids)], "<u8").tobytes()
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *packed])


class Image:
    """Random access to an image: ``doc_ids``, ``ends`` and ``read(start, stop)``."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not an image of token ids")
        self.raw = np.frombuffer(data, np.uint8)
        version, self.width = np.frombuffer(data, "<u2", 2, 4)
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        self.width, self.block = int(self.width), int(np.frombuffer(data, "<u4", 1, 8)[0])
        n, self.n_tokens = map(int, np.frombuffer(data, "<u8", 2, 12))
        at = 28
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, "u1", n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        n_blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n).astype(np.int64)
        self.payload = at + 17 * n + 8 * (n_blocks + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        out = []
        for b in range(start // self.block, -(-stop // self.block) if stop > start else start // self.block):
            lo, n = b * self.block, min(self.block, self.n_tokens - b * self.block)
            ids = unpack(self.raw[self.payload + self.offsets[b] : self.payload + self.offsets[b + 1]], n, self.width)
            out.append(ids[max(0, start - lo) : min(n, stop - lo)])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(97, 123)]] = True
_punct = np.zeros(256, bool)
_punct[[c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 39)]] = True


TRIAL = "The  Quick\tbrown fox, it's (12.50) a-b_c\nÉtudes \u0301x x\u00a0y! don't 'quoted' AbC12d e.g. [INST]"
TRIAL_PIECES = "the quick brown fox , it's ( 12 . 50 ) a - b _ c Études \u0301x x\u00a0y ! don't 'quoted' abc12d e . g . [ inst ]".split(" ")


class Encoder:
    """Encodes columns of texts with a tokenizer file, keeping the ids of pieces between batches."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Whether texts may be encoded by pieces.
        self.by_pieces = plain(TRIAL) == [x for p in TRIAL_PIECES for x in plain(p)]
        self._empty()

    def _empty(self) -> None:
        self.keys, self.starts, self.lengths, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.hits = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Keeps the pieces that most chunks had, half as many as may be held; a piece of one chunk alone is not kept."""
        least = 2
        if np.count_nonzero(self.hits >= least) > KEPT_PIECES // 2:
            least = max(least, int(np.partition(self.hits, -(KEPT_PIECES // 2))[-(KEPT_PIECES // 2)]) + 1)
        keep = np.flatnonzero(self.hits >= least)
        lengths = self.lengths[keep]
        starts = np.cumsum(lengths) - lengths
        self.flat = self.flat[np.repeat(self.starts[keep] - starts, lengths) + np.arange(lengths.sum())]
        self.keys, self.starts, self.lengths, self.hits = self.keys[keep], starts, lengths, self.hits[keep] // 2 + 1

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for f in found for x in f), np.uint32, int(lengths.sum()))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        keys, starts, lengths = np.concatenate((self.keys, keys)), np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))
        order = np.argsort(keys, kind="stable")
        self.hits = np.concatenate((self.hits, np.zeros(len(found), np.int32)))[order]
        self.keys, self.starts, self.lengths, self.flat = keys[order], starts[order], lengths[order], np.concatenate((self.flat, flat))

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return ~((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else np.ones(len(keys), bool)

    def encode(self, column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every text, in order."""
        for chunk in scan.chunks(column):
            chunk = chunk.fold()
            data, n = chunk.data, len(chunk.data)
            word = ~scan.SPACE[data]
            starts, ends = chunk.runs(word)
            if n:
                alnum, punct = _alnum[data], _punct[data]
                inner = np.flatnonzero((alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])) + 1
                inner = np.setdiff1d(inner, starts, assume_unique=True)  # the first byte of the next text
                starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
            h, bounds = chunk.hashes(starts, ends), chunk.bounds(starts)
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            new = np.flatnonzero(self._unknown(keys))
            if len(new):
                if len(self.keys) + len(new) > KEPT_PIECES:
                    self._shrink()
                    new = np.flatnonzero(self._unknown(keys))
                if len(self.keys) + len(new) > KEPT_PIECES:
                    self._empty()
                    new = np.arange(len(keys))
                self._learn(keys[new], [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.keys, keys)
            self.hits[at] += 1
            lengths = self.lengths[at][inverse]
            total = np.concatenate(([0], np.cumsum(lengths)))
            index = np.repeat(self.starts[at][inverse] - total[:-1], lengths) + np.arange(total[-1])
            ids = self.flat[index]
            for i in range(len(chunk)):
                yield chunk.first + i, ids[total[bounds[i]] : total[bounds[i + 1]]]


def encode_column(encoder: Encoder, column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    import pyarrow.compute as pc

    if not encoder.by_pieces:
        for row, text in enumerate(column):
            yield row, np.array(encoder.tokenizer.encode(text.as_py() or "", add_special_tokens=False).ids, np.uint32)
        return
    special = set(np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False)).tolist()) if len(column) else set()
    for row, ids in encoder.encode(column):
        yield row, np.array(encoder.tokenizer.encode(column[row].as_py(), add_special_tokens=False).ids, np.uint32) if row in special else ids


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the images of all documents to ``path``, a folder of Parquet files with (part, shard, n_docs, n_tokens, image)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # ranges of doc_id and, for a doc_id that very many rows repeat, of the beginnings of their texts; the whole texts order the rows of a range
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS).asc_nulls_first()).withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width, end = bits(max(encoder.vocabulary, end_id + 1)), np.array([end_id], np.uint32)
        docs_, ids_, held, part, shard = [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(ids_)
            made = image(docs_, np.cumsum([len(x) for x in ids_]), ids, width)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(docs_), "n_tokens": len(ids), "image": made}], schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if len(batch) else part
            for row, ids in encode_column(encoder, batch.column(1)):
                if docs_ and held + len(ids) + 1 > shard_tokens:
                    yield out()
                    docs_, ids_, held, shard = [], [], 0, shard + 1
                docs_.append(names[row])
                ids_.append(np.concatenate((ids, end)))
                held += len(ids) + 1
        if docs_:
            yield out()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
    rows.mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, image binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    files = spark.read.schema("part int, shard int, n_docs long, n_tokens long, image binary").parquet(path)
    # the running sum over parts is the only step in one task: a row per part
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = sizes.withColumn("inside", inside).join(base, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x = Image(batch.column(2)[k].as_py())
                begins = np.concatenate(([0], x.ends[:-1])).astype(np.int64)
                crcs = np.zeros(len(x.ends), np.int64)
                for lo in range(0, max(len(x.ends), 1), 4096):  # some thousand documents at a time, or one long one
                    a, b = begins[lo : lo + 4096], x.ends[lo : lo + 4096]
                    if len(a):
                        ids = x.read(int(a[0]), int(b[-1])).astype("<u4")
                        for i in range(len(a)):
                            crcs[lo + i] = zlib.crc32(ids[a[i] - a[0] : b[i] - a[0]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(crcs), batch.column(0)[k].as_py()), pa.int32()), pa.array(np.full(len(crcs), batch.column(1)[k].as_py()), pa.int32()), pa.array(x.doc_ids, mask=x.null), pa.array(begins), pa.array(x.ends - begins), pa.array(crcs)],
                    ["part", "shard", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    docs = files.select("part", "shard", "image").mapInArrow(run, "part int, shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes every image as ``folder/part-shard.sltk`` on a file system that pyarrow reaches; gives the names and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for batch in batches:
            for part, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                name, temp = f"{root}/{part:06d}-{shard:06d}.sltk", f"{root}/.{part:06d}-{shard:06d}.{np.random.default_rng().integers(1 << 62):x}"
                with where.open_output_stream(temp) as f:
                    f.write(data)
                where.move(temp, name)
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": [len(data)]})

    return spark.read.parquet(path).select("part", "shard", "image").mapInArrow(run, "name string, bytes long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back."""
    space = Workspace(docs.sparkSession, "tokens")
    write(docs, f"{space.root}/ids", tokenizer, end_id, doc_id, text)
    return read(docs.sparkSession, f"{space.root}/ids")
