"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles (64-bit hashes). Two sets of similarity t share t of the
larger one, so, in one global order of shingles, their prefixes of n - ceil(t n) + m shingles share at least
m. The order is by rarity, from a sketch of all shingle counts; each document picks the m (and so the
length) that an estimate of its candidates' cost favours, and a pair needs the lesser of its two m. Of the
two prefixes one ends first in the order; the rest of that document alone can add to the shared prefix
shingles, which bounds the overlap from above and spares most pairs the comparison of their whole sets.

1. One pass over the texts gives set sizes, 128-bit fingerprints of the sets and the sketch. Documents of equal
   sets are one class, and only its least doc_id goes on.
2. A second pass gives prefixes. In each list of documents with a common prefix shingle all are linked to the
   list's least document; each document verifies the one of these that it shares most shingles with, if enough. This
   finds groups of near copies with as many candidates as documents.
3. Documents of one list that are then still in different components meet in that of their first common shingle.
   What stands before it in the order is in one of them alone, so a shingle far back in a set admits only much smaller
   partners or none: each entry has a largest partner, and entries join within bands of set sizes. This keeps
   a shingle that very many documents have, which is last in the order of each, from making pairs of all of them.
   Pairs that share as many prefix shingles as both need are verified. No pair that could join two components is
   left out: others are passed over only where a parity bitmap of each whole set (an element in one set
   alone flips at most one bit) shows that the sets differ in more elements than similar sets can.

Lists of shingles that the sketch calls hot are dealt out by a salt and joined by their least documents.
Components are exact; links inside a component are not all counted.

Defined cases: null or empty texts have no shingles and are linked with nothing, each with its own doc_id
as component; fewer than five words are one shingle; rows that repeat a doc_id are one node (it links if any
of its texts does) and each gets a row; null doc_ids are linked with nothing and get a null component; empty
tables give empty results; other columns are ignored by ``similarity_table`` and pass through
``deduplicate``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sourcelake.llm import scan
from sourcelake.llm.components import components
from sourcelake.llm.shared import Workspace, fresh

SHINGLE, PERCENT = 5, 75
#: The sketch has 2**20 counters of 4 bytes, whatever the size of the corpus.
SKETCH_BITS, SLICE_BITS = 20, 14
MAX_MATCHES = 4
#: Cost of reading one entry of a list, and of comparing one shingle when a candidate is verified.
SCAN_COST, VERIFY_COST = 1.0, 0.05
#: Count from which a shingle's list is salted, into parts of about half as many.
HOT = 20_000
#: Largest table of ids (8 bytes each) that is broadcast to choose documents; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: 64-bit words of a set's parity bitmap.
MAP_WORDS = 8
#: Sets of similar sizes lie in one band or in bands side by side.
BAND = 100 / PERCENT
MAP = [f"m{i}" for i in range(MAP_WORDS)]
_SIGNED = np.int64


def prefix_base(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def choose_prefix(shingles: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(prefix, its estimated counts, matches needed) of a sorted set."""
    counts = sketch[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    n = len(shingles)
    base = prefix_base(n)
    longest = min(n, base + MAX_MATCHES - 1)
    order = np.lexsort((shingles, counts))[:longest]
    entries = np.cumsum(np.maximum(counts[order] - noise, 1.0))
    matches = np.arange(1, longest - base + 2)
    read = entries[base - 1 : longest]
    need = int(matches[np.argmin(SCAN_COST * read + VERIFY_COST * n * read / matches)])
    chosen = order[: base + need - 1]
    return shingles[chosen], counts[chosen], need


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Per bit whether an odd number of the set's shingles fall on it."""
    bits = np.bincount(((shingles >> np.uint64(8)) % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(_SIGNED)


def _first_pass(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, n, a, b, parity map) of each document and (slice, counts) of each partition's sketch."""
    schema = f"doc_id long, n long, a long, b long, {', '.join(f'{m} long' for m in MAP)}, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, per = np.zeros(1 << SKETCH_BITS, np.int64), 1 << SLICE_BITS
        names = ["doc_id", "n", "a", "b", *MAP, "slice", "counts"]
        held, pending = [], 0

        def count() -> None:
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            np.add(sketch, np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS), out=sketch)

        for batch in batches:
            sizes, a, b, maps = [], [], [], []
            for chunk in scan.chunks(batch.column(1)):
                for _, s in scan.shingle_sets(chunk.fold(), SHINGLE):
                    sizes.append(len(s))
                    a.append(s.sum(dtype=np.uint64))
                    b.append(scan.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    maps.append(parity_map(s))
                    held.append(s)
                    pending += len(s)
                if pending > 1 << SKETCH_BITS:
                    count()
                    held, pending = [], 0
            k = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(a, np.uint64).view(_SIGNED)), pa.array(np.array(b, np.uint64).view(_SIGNED)), *[pa.array(c) for c in np.array(maps, _SIGNED).reshape(k, MAP_WORDS).T], pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        count()
        if sketch.any():
            parts = [sketch[i : i + per].astype("<u4").tobytes() for i in range(0, len(sketch), per)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * (4 + MAP_WORDS) + [pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, schema)


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all partitions' sketches, added slice by slice without holding a slice's rows together."""
    per, slices = 1 << SLICE_BITS, 1 << (SKETCH_BITS - SLICE_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.setdefault(s, np.zeros(per, np.int64))
                total[s] += np.frombuffer(c.as_py(), "<u4")
        if total:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()), "counts": [np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in total.values()]})

    added = rows.where("slice is not null").select("slice", "counts").repartition(slices, "slice").mapInArrow(add, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in added.collect():
        out[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(bytes(r["counts"]), "<u4")
    return out


def _chosen(docs: DataFrame, ids: DataFrame, doc_id: str, how: str, count: int) -> DataFrame:
    return docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, doc_id, how)


def _prefixes(docs: DataFrame, doc_id: str, text: str, sketch) -> DataFrame:
    """(token, salt, doc, n, need, pos) for every prefix shingle; pos counts the set's shingles before it in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        noise = float(counts.mean())
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in scan.chunks(batch.column(1)):
                tokens, seen, sizes, rows, needs = [], [], [], [], []
                for row, s in scan.shingle_sets(chunk.fold(), SHINGLE):
                    if len(s):
                        p, c, need = choose_prefix(s, counts, noise)
                        tokens.append(p), seen.append(c), rows.append(row), sizes.append(len(s)), needs.append(need)
                if not rows:
                    continue
                lengths = [len(t) for t in tokens]
                doc, seen = np.repeat(ids[rows], lengths), np.concatenate(seen).astype(np.int64)
                ways = np.where(seen >= HOT, seen // (HOT // 2), 1).astype(np.uint64)
                salt = (scan.mix(doc.astype(np.int64).view(np.uint64)) % ways + (ways > 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(_SIGNED)), pa.array(salt), pa.array(doc.astype(np.int64)), pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(np.repeat(needs, lengths).astype(np.int8)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths]))], ["token", "salt", "doc", "n", "need", "pos"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "token long, salt int, doc long, n int, need byte, pos int")


def _sets(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in scan.chunks(batch.column(1)):
                sets = [s.view(_SIGNED) for _, s in scan.shingle_sets(chunk.fold(), SHINGLE)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, _SIGNED))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc", "shingles"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc long, shingles array<long>")


def _enough(shared, n, need, m, other):
    """Whether two sets of n and m shingles can be similar, by sizes and by the number of shared prefix shingles."""
    overlap = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    rest = F.greatest(F.ceil(PERCENT * n / 100) - need, F.ceil(PERCENT * m / 100) - other)
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (shared >= F.greatest(F.least(need, other).cast("long"), overlap - rest))


def _band(n):
    return F.floor(F.log(n) / math.log(BAND) + 1e-9).cast("int")


def _verified(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, space: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = space.keep(pairs, f"{name}_pairs")
    ids = space.keep(pairs.select(F.explode(F.array("a", "b")).alias(doc_id)).distinct(), f"{name}_ids")
    count = ids.count()
    if not count:
        return pairs.select("a", "b").limit(0)
    sets = _sets(_chosen(docs, ids, doc_id, "left_semi", count), doc_id, text)
    sets = space.keep(sets, f"{name}_sets")
    left, right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    similar = joined.where(100 * F.col("both") >= PERCENT * (F.size("x") + F.size("y") - F.col("both")))
    out = space.keep(similar.select("a", "b").distinct(), f"{name}_links")
    space.drop(f"{name}_sets")
    return out


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sizes, nodes): (doc_id, n) per row of ``docs``, with the class's fingerprint as a and b, and (a, b, n, component) per class."""
    spark: SparkSession = docs.sparkSession
    space = Workspace(spark, "jaccard")
    docs = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).alias(text))
    first = space.keep(_first_pass(docs, doc_id, text), "first")
    sizes = first.where("slice is null").select("doc_id", "n", "a", "b")
    sketch = spark.sparkContext.broadcast(_sketch(first))
    least = F.min(F.struct("doc_id", *MAP))
    classes = first.where("slice is null and n > 0 and doc_id is not null").groupBy("a", "b", "n").agg(least.alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = space.keep(classes.select("a", "b", "n", F.col("least.doc_id").alias("node"), "copies", *[f"least.{m}" for m in MAP]), "classes")
    # whoever is not the least of its class is left out; such rows are few beside the texts, or joined by a shuffle
    copies = sizes.where("n > 0").join(classes.where("copies > 1"), ["a", "b", "n"]).where("doc_id <> node").select(F.col("doc_id").alias(doc_id)).distinct()
    copies = space.keep(copies.join(classes.select(F.col("node").alias(doc_id)).distinct(), doc_id, "left_anti"), "copies")
    own = _chosen(docs.where(F.col(doc_id).isNotNull()), copies, doc_id, "left_anti", copies.count())

    listed = _prefixes(own, doc_id, text, sketch)
    around = Window.partitionBy("token", "salt")
    me = F.struct("doc", "n", "need")
    listed = listed.withColumn("least", F.min(me).over(around)).withColumn("most", F.max("doc").over(around))
    listed = space.keep(listed.where("least.doc <> most or salt > 0"), "listed")
    tops = listed.where("salt > 0").groupBy("token", "least").agg(F.count(F.lit(1)).alias("c"))
    roots = tops.groupBy("token").agg(F.min("least").alias("root"))
    across = tops.join(roots, "token").where("least.doc <> root.doc").select(F.col("root").alias("x"), F.col("least").alias("y"))
    stars = listed.where("doc <> least.doc").select(F.col("least").alias("x"), me.alias("y")).union(across).groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"))
    stars = stars.where(_enough(F.col("shared"), F.col("x.n"), F.col("x.need"), F.col("y.n"), F.col("y.need")))
    best = stars.groupBy(F.col("y.doc").alias("b")).agg(F.max(F.struct("shared", (-F.col("x.doc")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    links = _verified(best, docs, doc_id, text, space, "stars")
    near = components(links, space, "near").select(F.col("node").alias("doc"), "component")

    # lists that still meet several components: pairs across them by the first shingle that they share
    placed = listed.select("token", "doc", "n", "need", "pos").join(near, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = space.keep(placed, "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    # the overlap is at most n - pos, and similar sets of n and m share PERCENT (n + m) / (100 + PERCENT)
    most = F.floor((100 + PERCENT) * (F.col("n") - F.col("pos")) / F.lit(PERCENT) - F.col("n")).cast("int")
    entries = placed.withColumn("most", most).where(100 * F.col("most") >= PERCENT * F.col("n"))
    open_ = entries.join(mixed, "token", "left_semi").join(classes.select(F.col("node").alias("doc"), *MAP), "doc")
    open_ = space.keep(open_.withColumn("band", _band(F.col("n"))), "open")
    # x is the larger set, and the later doc among sets of one size
    reach = F.sequence(_band(F.ceil(PERCENT * F.col("n") / 100)), F.greatest(_band(F.ceil(PERCENT * F.col("n") / 100)), _band(F.least("n", "most"))))
    x, y = open_.drop("band").withColumn("band", F.explode(reach)).alias("x"), open_.where("most >= n").alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.doc") > F.col("y.doc")))
    alike = larger & (F.col("x.component") != F.col("y.component")) & (100 * F.col("y.n") >= PERCENT * F.col("x.n")) & (F.col("y.n") <= F.col("x.most")) & (F.col("x.n") <= F.col("y.most"))
    both, differ = F.col("x.n") + F.col("y.n"), F.lit(0)
    for m in MAP:
        differ = differ + F.bit_count(F.col(f"x.{m}").bitwiseXOR(F.col(f"y.{m}")))
    alike = alike & (differ <= both - 2 * F.ceil(PERCENT * both / (100 + PERCENT)))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & alike).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    met = space.keep(met.join(best.select("a", "b"), ["a", "b"], "left_anti"), "met")
    prefix = placed.join(met.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "doc", "left_semi").groupBy("doc").agg(F.collect_set("token").alias("tokens"), F.min("n").alias("n"), F.min("need").alias("need"))
    sides = [prefix.select(*[F.col(c).alias(f"{side}_{c}") for c in prefix.columns]).withColumnRenamed(f"{side}_doc", key) for side, key in (("x", "a"), ("y", "b"))]
    rest = met.join(sides[0], "a").join(sides[1], "b").withColumn("shared", F.size(F.array_intersect("x_tokens", "y_tokens")))
    rest = rest.where(_enough(F.col("shared"), F.col("x_n"), F.col("x_need"), F.col("y_n"), F.col("y_need"))).select("a", "b")
    more = _verified(rest, docs, doc_id, text, space, "rest")
    group = components(links.union(more), space, "group")
    nodes = classes.join(group, "node", "left").select("a", "b", "n", F.coalesce("component", "node").alias("component"))
    return sizes, space.keep(nodes, "nodes")


def similarity_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least doc_id that it reaches by links."""
    sizes, nodes = similarity_components(docs, doc_id, text)
    out = sizes.join(nodes.withColumnRenamed("component", "__j_component"), ["a", "b", "n"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("__j_component", "doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id; documents without shingles or doc_id stay.

    Rows that repeat a kept doc_id stay too; the join leaves the texts in place while the dropped ids are few.
    """
    space = Workspace(docs.sparkSession, "deduplicate")
    table = similarity_table(docs, doc_id, text)
    (key,) = fresh(docs.columns, "__j_id")
    gone = space.keep(table.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias(key)).distinct(), "gone")
    hinted = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(hinted, F.col(doc_id) == F.col(key), "left_anti")
