"""Language-model scoring: a unigram base, and a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the words of the text with A-Z lower-cased, known by 64-bit hashes, and one end token. One pass counts
the training documents' tokens. The words that occur ``LEAST_COUNT`` times or more, and the ``FEWEST_CLASSES`` most
frequent ones in any case, are classes of the neural model, at most ``MOST_CLASSES``; all others together are one
more. The model predicts a class from the two before it: the sum of an embedding per position, times the class's
output vector, plus its bias. Classes lie in groups by frequency, and the probability is that of the group times
that of the class in its group, both normalised, so a class costs about the root of their number.

A second pass writes every document's classes. The training documents are dealt by a hash of doc_id and classes
into shards of about ``SHARD_TOKENS`` tokens and ordered by it, so the model is a function of the rows and not of
files or partitions. The shards are trained in ``ROUNDS`` rounds, each shard once: those of a round start from the
same model, descend by noise-contrastive steps in numpy, and their results are averaged, each row by the steps
that moved it; sums are over whole numbers. Scoring takes matrix products over batches of contexts; a word of the
last class is divided further by its smoothed share in that class.

Counts of the at most ``FREQUENT`` most frequent tokens are broadcast (16 bytes each); the others' counts reach
the documents by a join on the token. A shard hands on some 200 bytes per class.

Defined cases: null and empty texts have the end token alone; a null doc_id counts as an empty text when
documents are dealt into training and held-out ones; repeated rows count and are scored as often as they
occur (they share a shard); without training documents every token has base probability one and the model is
uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sourcelake.llm import scan
from sourcelake.llm.shared import Workspace

#: Hash of the end token; no word has it, but for one chance in 2**64.
END = np.uint64(0x5EED0FEE)
#: Every word of at least this count is a class, and so are this many most frequent ones in any case. The bound on their number is that of the model's size.
LEAST_COUNT, FEWEST_CLASSES, MOST_CLASSES, WIDTH = 10, 255, 1 << 15, 16
#: Tokens, noise groups and step size of a descent step; they and the least count were chosen on fold 3 of the training documents of sf0.1, with the model trained on folds 0, 2 and 4.
BATCH, NOISE, RATE = 2048, 24, 0.2
#: Noise of each group of a batch within it, and contexts that are scored at once.
INNER, SCORED = 8, 4096
#: Groups as a multiple of the root of the number of classes.
SPLIT = 1.1
SHARD_TOKENS, ROUNDS = 1 << 21, 4
#: Tokens that are held at once, and rows of the model that travel together.
BUFFER, BLOCK = 1 << 16, 256
#: Values of the model travel as multiples of 2**-SCALE.
SCALE = 20
PARTS = ["near", "far", "out", "heads"]
FREQUENT = 1 << 18
#: Distinct tokens that a task counts before it hands the counts on.
HELD = 1 << 20


def fold(doc_id: str = "doc_id"):
    """The document's fold, 0 to 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id) == 1


def _tokens(column: pa.Array) -> Iterator[tuple[scan.Chunk, np.ndarray, np.ndarray]]:
    """(chunk, token hashes with ends, bounds per text)."""
    for chunk in scan.chunks(column):
        folded = chunk.fold()
        starts, ends = folded.runs(~scan.SPACE[folded.data])
        bounds = folded.bounds(starts)
        yield chunk, np.insert(folded.hashes(starts, ends), bounds[1:], END), bounds + np.arange(len(bounds))


def count_tokens(training: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): every token of the texts and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, size = [], [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(numbers), len(k)).astype(np.int64)

        for batch in batches:
            for _, h, _ in _tokens(batch.column(0)):
                k, n = np.unique(h, return_counts=True)
                keys.append(k), numbers.append(n)
                size += len(k)
                if size > 2 * HELD:
                    k, n = summed()
                    if len(k) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["h", "n"])
                        k, n = k[:0], n[:0]
                    keys, numbers, size = [k], [n], len(k)
        if size:
            k, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["h", "n"])

    return training.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Frequent tokens with counts, the classes among them, and the corpus totals."""

    def __init__(self, h: np.ndarray, n: np.ndarray, total: int, types: int):
        order = np.argsort(h)
        self.h, self.n, self.total, self.types = h[order], n[order], total, types
        top = np.lexsort((self.h, -self.n))
        top = top[: min(MOST_CLASSES, max(FEWEST_CLASSES, int((self.n >= LEAST_COUNT).sum())))]
        #: The class of all words that have none of their own.
        self.rest = len(top)
        self.kind = np.full(len(self.h), self.rest, np.int64)
        self.kind[top] = np.arange(len(top))
        self.class_counts = np.append(self.n[top], total - self.n[top].sum()).astype(float)
        self.rest_total, self.rest_types = total - int(self.n[top].sum()), types - len(top)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, class) of tokens; count 0 where a token is not among the frequent ones."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.full(len(h), self.rest)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.n[at], 0), np.where(hit, self.kind[at], self.rest)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class LogBilinear:
    """Two embeddings of a context class (by position), output vectors with biases, and the same for groups of classes.

    Classes are numbered by falling frequency; the last one, ``rest``, is a group of its own, and ``rest + 1`` as a context is the start of a text.
    """

    def __init__(self, class_counts: np.ndarray):
        n = self.rest = len(class_counts) - 1
        g = max(1, round(SPLIT * n**0.5))
        # groups of frequent classes are small, as they are looked into most
        self.bounds = np.unique(np.round(n * (np.arange(g + 1) / g) ** 3).astype(np.int64))
        self.sizes = np.append(np.diff(self.bounds), 1)
        self.group_of = np.append(np.repeat(np.arange(len(self.sizes) - 1), self.sizes[:-1]), len(self.sizes) - 1)
        p = (class_counts + 0.5) / (class_counts + 0.5).sum()
        self.group_p = np.bincount(self.group_of, p)
        rng = np.random.Generator(np.random.PCG64(7))
        self.near, self.far = (rng.normal(0, 0.1, (n + 2, WIDTH)).astype(np.float32) for _ in range(2))
        self.out, self.heads = (rng.normal(0, 0.1, (k, WIDTH + 1)).astype(np.float32) for k in (n + 2, len(self.sizes)))
        self.out[: n + 1, WIDTH] = np.log(p / self.group_p[self.group_of])
        self.heads[:, WIDTH] = np.log(self.group_p)
        #: Sums of squared gradients, a number per row, which the next round of training starts from.
        self._tables = None
        self.memory = {k: np.zeros(len(getattr(self, k)), np.float32) for k in PARTS}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def begin(self, seed: int) -> None:
        """What training needs besides the parameters."""
        self.log_noise = np.log(NOISE * self.group_p).astype(np.float32)
        self.inner_noise = np.log(INNER / self.sizes).astype(np.float32)
        self.noise_steps = np.cumsum(self.group_p)
        self.first = np.append(self.bounds[:-1], self.rest)
        #: Steps that moved a row.
        self.moved = {k: np.zeros(len(getattr(self, k)), np.int64) for k in PARTS}
        self.rng = np.random.Generator(np.random.PCG64([11, seed]))

    def _step(self, name: str, at: np.ndarray, g: np.ndarray, scale: float, rate: float) -> None:
        """AdaGrad on the rows that have a gradient."""
        order = np.argsort(at, kind="stable")
        run = at[order]
        first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        g, rows = np.add.reduceat(g[order], first, axis=0) * np.float32(scale), run[first]
        m = self.memory[name][rows] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        self.memory[name][rows] = m
        getattr(self, name)[rows] -= (np.float32(rate) / np.sqrt(m + 1e-6))[:, None] * g
        self.moved[name][rows] += 1

    def context(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        h = np.ones((len(near), WIDTH + 1), np.float32)
        h[:, :WIDTH] = self.near[near] + self.far[far]
        return h

    def train(self, near: np.ndarray, far: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One descent step on a batch: true groups against noise groups, true classes against noise of their group; a batch shares its noise."""
        order = np.argsort(self.group_of[word], kind="stable")
        near, far, word = near[order], far[order], word[order]
        h, group, scale = self.context(near, far), self.group_of[word], 100 / len(word)
        noise = np.minimum(np.searchsorted(self.noise_steps, self.rng.random(NOISE)), len(self.sizes) - 1)
        q, other = self.heads[group], self.heads[noise]
        true = _sigmoid(np.einsum("ij,ij->i", h, q) - self.log_noise[group]) - 1
        fake = _sigmoid(h @ other.T - self.log_noise[noise])
        dh = true[:, None] * q + fake @ other
        heads = np.concatenate((true[:, None] * h, fake.T @ h))
        at = np.flatnonzero(self.sizes[group] > 1)
        if len(at):
            g, w, hw = group[at], word[at], h[at]
            new = np.concatenate(([True], g[1:] != g[:-1]))
            starts, run = np.flatnonzero(new), np.cumsum(new) - 1
            present = g[starts]
            drawn = self.first[present][:, None] + (self.rng.random((len(present), INNER), np.float32) * self.sizes[present][:, None]).astype(np.int64)
            drawn = np.minimum(drawn, (self.first[present] + self.sizes[present] - 1)[:, None])
            q, other = self.out[w], self.out[drawn][run]
            true = _sigmoid(np.einsum("ij,ij->i", hw, q) - self.inner_noise[g]) - 1
            fake = _sigmoid(np.einsum("ikj,ij->ik", other, hw) - self.inner_noise[g][:, None])
            dh[at] += true[:, None] * q + np.einsum("ik,ikj->ij", fake, other)
            pushed = np.add.reduceat(fake[:, :, None] * hw[:, None, :], starts, axis=0)
            self._step("out", np.concatenate((w, drawn.ravel())), np.concatenate((true[:, None] * hw, pushed.reshape(-1, WIDTH + 1))), scale, rate)
        self._step("heads", np.concatenate((group, noise)), heads, scale, rate)
        self._step("near", near, dh[:, :WIDTH], scale, rate)
        self._step("far", far, dh[:, :WIDTH], scale, rate)

    def _exps(self) -> tuple[np.ndarray, np.ndarray]:
        """exp of what each near and each far class adds to each group's score; a context's sum over groups is a product of two rows."""
        if self._tables is None:
            limit = lambda x: np.exp(np.clip(x, -40, 40))
            self._tables = limit(self.near @ self.heads[:, :WIDTH].T), limit(self.far @ self.heads[:, :WIDTH].T + self.heads[:, WIDTH])
        return self._tables

    def log10(self, near: np.ndarray, far: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each class in its context."""
        a, b = self._exps()
        group, out = self.group_of[word], np.empty(len(word), np.float32)
        for lo in range(0, len(word), SCORED):
            n, f, g = near[lo : lo + SCORED], far[lo : lo + SCORED], group[lo : lo + SCORED]
            out[lo : lo + SCORED] = np.log(a[n, g] * b[f, g]) - np.log(np.einsum("ij,ij->i", a[n], b[f]))
        order = np.argsort(group, kind="stable")
        h = self.context(near[order], far[order])
        ends = np.searchsorted(group[order], np.arange(len(self.sizes) + 1))
        for g in np.flatnonzero((np.diff(ends) > 0) & (self.sizes > 1)):
            first = self.bounds[g]
            vectors = self.out[first : first + self.sizes[g]].T
            one = np.ones(vectors.shape[1], np.float32)
            for lo in range(ends[g], ends[g + 1], SCORED):
                hi = min(lo + SCORED, ends[g + 1])
                s = np.clip(h[lo:hi] @ vectors, -80, 80)
                at = order[lo:hi]
                true = s[np.arange(hi - lo), word[at] - first]
                out[at] += true - np.log(np.exp(s, out=s) @ one)
        return np.minimum(out, 0) / np.float32(np.log(10))

    def table(self) -> np.ndarray:
        """log10 probability of every class in every context, as (near, far, class): for small models."""
        c = self.rest + 1
        far, word = (x.ravel() for x in np.meshgrid(np.arange(c + 1), np.arange(c), indexing="ij"))
        return np.stack([self.log10(np.full(len(far), i), far, word).reshape(c + 1, c) for i in range(c + 1)])


def _contexts(kinds: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens before each token, the start class before a text's first."""
    near, far = np.empty_like(kinds), np.empty_like(kinds)
    near[1:], far[2:] = kinds[:-1], kinds[:-2]
    first = bounds[:-1][np.diff(bounds) > 0]
    near[first] = far[first] = start
    second = first + 1
    second = second[second < len(kinds)]
    far[second] = start
    return near, far


def fit(encoded: DataFrame, vocabulary, rate: float = RATE, size: int = BATCH) -> LogBilinear:
    """Trains on every token of the training rows of ``encoded``; the driver receives a few numbers per parameter and round."""
    spark = encoded.sparkSession
    voc = vocabulary.value
    shards = ROUNDS * max(1, -(-voc.total // (ROUNDS * SHARD_TOKENS)))
    rows = encoded.where(~F.col("held_out")).select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "kinds").alias("key"), "kinds")
    rows = rows.withColumn("shard", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    model = LogBilinear(voc.class_counts)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, shard, held, pending = None, None, [], 0

            def learn() -> None:
                nonlocal held, pending
                kinds = np.concatenate(held).astype(np.int64)
                near, far = _contexts(kinds, np.concatenate(([0], np.cumsum([len(x) for x in held]))), own.rest + 1)
                for lo in range(0, len(kinds), size):
                    cut = slice(lo, lo + size)
                    own.train(near[cut], far[cut], kinds[cut], rate)
                held, pending = [], 0

            for batch in batches:
                for s, k in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if s != shard:
                        if held:
                            learn()
                        if own is not None:
                            yield from _sent(own)
                        own, shard = pickle.loads(pickle.dumps(shared.value)), s
                        own.begin(s)
                    held.append(np.frombuffer(k.as_buffer(), np.uint16))
                    pending += len(held[-1])
                    if pending >= BUFFER:
                        learn()
            if held:
                learn()
            if own is not None:
                yield from _sent(own)

        # whichever task gets a shard, its documents come together and in order
        now = rows.where(F.col("shard") % ROUNDS == turn).repartition(max(1, shards // ROUNDS), "shard").sortWithinPartitions("shard", "key", "kinds").select("shard", "kinds")
        got = now.mapInArrow(run, SENT).repartition(max(1, min(shards // ROUNDS, 64)), "part", "block").mapInArrow(_averaged, MEAN).toArrow()
        for part, block, moved, values, memory in zip(*(c.to_pylist() for c in got.columns)):
            name = PARTS[part]
            at = np.flatnonzero(np.frombuffer(moved, bool))
            values = np.frombuffer(values, np.float32).reshape(len(np.frombuffer(moved, bool)), -1)
            getattr(model, name)[block * BLOCK + at] = values[at]
            model.memory[name][block * BLOCK + at] = np.frombuffer(memory, np.float32)[at]
        shared.unpersist()
    return model


SENT = "part int, block int, moved binary, quantised binary, memory binary"
MEAN = "part int, block int, moved binary, mean binary, memory binary"


def _sent(model: LogBilinear) -> Iterator[pa.RecordBatch]:
    """The rows of the model that a shard moved, in blocks, with their numbers of steps."""
    for part, name in enumerate(PARTS):
        values, moved, memory = getattr(model, name), model.moved[name], model.memory[name]
        found = []
        for lo in range(0, len(values), BLOCK):
            cut = slice(lo, lo + BLOCK)
            if moved[cut].any():
                found.append((lo // BLOCK, moved[cut].astype("<i4").tobytes(), np.round(values[cut].astype(np.float64) * (1 << SCALE)).astype("<i4").tobytes(), memory[cut].tobytes()))
        if found:
            block, *rest = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(block), pa.int32()), pa.array(block, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], ["part", "block", "moved", "quantised", "memory"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the mean of its rows by the steps that moved them, and of their memories by shard."""
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for part, block, moved, values, memory in zip(*(c.to_pylist() for c in batch.columns)):
            moved = np.frombuffer(moved, "<i4").astype(np.int64)
            values = np.frombuffer(values, "<i4").reshape(len(moved), -1)
            memory = np.round(np.frombuffer(memory, np.float32).astype(np.float64) * (1 << SCALE)).astype(np.int64)
            own = sums.setdefault((part, block), [np.zeros(len(moved), np.int64), np.zeros(values.shape, np.int64), np.zeros(len(moved), np.int64), np.zeros(len(moved), np.int64)])
            own[0] += moved
            own[1] += values * moved[:, None]
            own[2] += moved > 0
            own[3] += memory * (moved > 0)
    for (part, block), (moved, values, times, memory) in sums.items():
        mean = (values / np.maximum(moved, 1)[:, None] / (1 << SCALE)).astype(np.float32)
        memory = (memory / np.maximum(times, 1) / (1 << SCALE)).astype(np.float32)
        yield pa.RecordBatch.from_pylist([{"part": part, "block": block, "moved": (moved > 0).tobytes(), "mean": mean.tobytes(), "memory": memory.tobytes()}], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("moved", pa.binary()), ("mean", pa.binary()), ("memory", pa.binary())]))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The frequent tokens: all that occur at least as often as the least count of which there are no more than ``FREQUENT``."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("types")).first()
    # numbers of tokens by count, in powers of two: some forty rows
    bands = {r.b: r.c for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, held = None, 0
    for b in sorted(bands, reverse=True):
        if held + bands[b] > FREQUENT:
            break
        held, least = held + bands[b], 2**b
    if least is not None and least > 1:
        finer = counts.where((F.col("n") < least) & (F.col("n") >= least // 2)).groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).limit(4096).collect()
        for r in finer:
            if held + r.c > FREQUENT:
                break
            held, least = held + r.c, r.n
    got = counts.where(F.col("n") >= least).toArrow() if least is not None else pa.table({"h": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    return Vocabulary(got["h"].to_numpy().view(np.uint64), got["n"].to_numpy(), int(totals.total), int(totals.types))


def encode(docs: DataFrame, vocabulary) -> DataFrame:
    """From (doc_id, text, held_out): the classes of each text as 16-bit numbers, its counts and base score, and its tokens that are not among the frequent ones, with how often they occur; ``rest`` is the share of its words of the last class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        base_of = np.log10(v.total + 0.5 * (v.types + 1))
        rest_of = np.log10(v.rest_total + 0.5 * (v.rest_types + 1))
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk, h, bounds in _tokens(batch.column(1)):
                n, kinds = v.look(h)
                by = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))[bounds])
                share = np.where(n > 0, np.log10(n + 0.5), 0.0)
                rare = np.flatnonzero(n == 0)
                cut = np.searchsorted(rare, bounds)
                # distinct rare tokens of each text with their numbers
                owner = np.repeat(np.arange(len(chunk)), np.diff(cut))
                order = np.lexsort((h[rare], owner))
                rh, ro = h[rare][order], owner[order]
                new = np.ones(len(rh), bool)
                new[1:] = (rh[1:] != rh[:-1]) | (ro[1:] != ro[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(rh)))
                ends = pa.array(np.searchsorted(ro[at], np.arange(len(chunk) + 1)).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(kinds.astype(np.uint16))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, len(chunk)), batch.column(2).slice(chunk.first, len(chunk)), pa.array(uid + np.arange(len(chunk))), pa.array(np.diff(bounds).astype(np.int64)), pa.array(by(n > 0).astype(np.int64)),
                     pa.array(by(share - base_of)), pa.array(by(np.where(kinds == v.rest, share - rest_of, 0.0))), packed, pa.ListArray.from_arrays(ends, pa.array(rh[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))],
                    ["doc_id", "held_out", "uid", "n_tokens", "known", "base", "rest", "kinds", "rare", "times"],
                )
                uid += len(chunk)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, uid long, n_tokens long, known long, base double, rest double, kinds binary, rare array<long>, times array<int>")


def log_probabilities(encoded: DataFrame, model) -> DataFrame:
    """``encoded`` with ``score``, the model's log10 probability of each row's classes, in place of ``kinds``."""
    encoded = encoded.select("kinds", *[c for c in encoded.columns if c != "kinds"])
    names = encoded.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = [np.frombuffer(k.as_buffer(), np.uint16) for k in batch.column(0)]
            score, lo = np.zeros(len(texts)), 0
            ends = np.cumsum([len(x) for x in texts])
            while lo < len(texts):
                # some texts at a time, or one long one
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BUFFER, "right")))
                kinds = np.concatenate(texts[lo:hi]).astype(np.int64)
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts[lo:hi]])))
                near, far = _contexts(kinds, bounds, m.rest + 1)
                each = np.concatenate([np.zeros(1)] + [m.log10(near[a : a + BUFFER], far[a : a + BUFFER], kinds[a : a + BUFFER]) for a in range(0, len(kinds), BUFFER)])
                score[lo:hi] = np.diff(np.cumsum(each, dtype=np.float64)[bounds])
                lo = hi
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in names], pa.array(score)], [*names, "score"])

    return encoded.mapInArrow(run, ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in names) + ", score double")


def score_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held=None, rate: float = RATE, size: int = BATCH) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held`` tells the documents that are not learned from (a condition on doc_id), ``rate`` and ``size`` are the
    step size and the tokens of a descent step.
    """
    held = held_out() if held is None else held
    spark = docs.sparkSession
    space = Workspace(spark, "lm")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = space.keep(count_tokens(docs.where(~held).select("text")), "counts")
    voc = vocabulary_of(counts)
    vocabulary = spark.sparkContext.broadcast(voc)
    encoded = space.keep(encode(docs.withColumn("held_out", held), vocabulary), "encoded")
    model = spark.sparkContext.broadcast(fit(encoded, vocabulary, rate=rate, size=size))
    scored = log_probabilities(encoded.drop("rare", "times"), model)
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("h"), "r.times")
    # an unknown token's share is that of the count 0
    found = rare.join(counts, "h", "left").groupBy("uid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("share"))
    all_ = scored.join(found, "uid", "left")
    share = F.coalesce("share", F.lit(0.0))
    return all_.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"), (F.col("base") + share).alias("base_score"), (F.col("score") + F.col("rest") + share).alias("score"))
