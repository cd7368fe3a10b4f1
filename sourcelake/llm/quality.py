"""Quality rules: counts of each text, then robust multivariate outliers per language and source.

The base rule rejects texts of under 20 words and texts whose repeated 8-word windows hold over 30 % of the
words. Of the others each (language, source) group gets a minimum-covariance-determinant estimate of its
transformed statistics: from two starts, concentration steps re-estimate mean and covariance from the rows of
least distance, every step over all rows as one grouped aggregate; the estimate of the smaller determinant
stays. Documents beyond ``cutoff`` squared Mahalanobis distances go.

The quantile of each step is taken from a histogram of distances, and sums run over integers (statistics in
thousandths), so results do not depend on the order of rows. A group of under ``min_group`` rows is judged by the
estimate of its whole language, or if that has as few, of all rows, however many these are; ``FLOOR`` keeps
the covariance of few rows regular. Every row that passes the base rule is judged.

Defined cases: null or empty texts have no words and fail the base rule; null languages and sources are values
of their own; repeated rows count as often as they occur; an empty table gives an empty result; other
columns, whatever their names, pass through ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from sourcelake.llm import scan
from sourcelake.llm.shared import Workspace

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
FEATURES = 5
#: Share of a group's rows that the concentration steps keep, their number, and bins of a distance's logarithm.
KEEP_SHARE, STEPS, BINS = 0.75, 5, 400
#: Least standard deviation of each transformed statistic: most texts have no symbols or repeats at all.
FLOOR = (0.35, 0.08, 0.6, 0.8, 0.8)
#: Squared distances beyond the chi-square quantile of one in a million for five statistics are outliers.
MIN_GROUP, CUTOFF = 200, 36.0
BROADCAST_GROUPS = 50_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def counts(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The five counts of every text."""
    out = []
    for chunk in scan.chunks(column):
        data, offsets = chunk.data, chunk.offsets
        word = ~scan.SPACE[data]
        total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
        starts, ends = chunk.runs(word)
        bounds = chunk.bounds(starts)
        # lines: a text has one more line than newlines
        cuts = np.flatnonzero(data == 10)
        line_starts = np.sort(np.concatenate((offsets[:-1], cuts + 1)), kind="stable")
        line_ends = np.sort(np.concatenate((offsets[1:], cuts)), kind="stable")
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[has_word], line_ends[has_word]
        line_bounds = np.searchsorted(line_starts, offsets)
        earlier, _ = scan.seen_before(chunk.hashes(line_starts, line_ends), scan.owners(line_bounds))
        # words in repeated windows
        h, at = scan.windows(chunk.hashes(starts, ends), bounds, REPEAT_WINDOW)
        _, shared = scan.seen_before(h, np.searchsorted(bounds, at, "right") - 1)
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, at[shared], 1)
        np.add.at(cover, at[shared] + REPEAT_WINDOW, -1)
        repeated = np.cumsum(cover)[:-1] > 0
        by = lambda mask, b: np.diff(np.concatenate(([0], np.cumsum(mask)))[b])
        out.append([np.diff(bounds), total(word & ((data & 0xC0) != 0x80)), total(_SYMBOL[data]), by(earlier, line_bounds), by(repeated, bounds)])
    return [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts as columns ``__q_n_words`` and so on."""
    docs = docs.select(*[c for c in docs.columns if keep is None or c in {*keep, text}])
    names = [c for c in docs.columns if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts(batch.column(batch.schema.names.index(text)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(c)) for c in names] + [pa.array(x, pa.int64()) for x in found], [*names, *[f"__q_{c}" for c in COUNTS]])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(f"__q_{c}", T.LongType()) for c in COUNTS])
    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "__q_"):
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def _features():
    """Transformed statistics in thousandths, as integers."""
    n = F.greatest(F.col("__q_n_words"), F.lit(1)).cast("double")
    per_cent = lambda c: F.log1p(100 * F.col(f"__q_{c}") / n)
    values = [F.log(n), F.log(F.greatest(F.col("__q_word_chars"), F.lit(1)) / n), per_cent("n_symbols"), per_cent("n_dup_lines"), per_cent("n_repeat_words")]
    return [F.round(1000 * v).cast("long").alias(f"__q_x{i}") for i, v in enumerate(values)]


PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
SUMS = ["n", *[f"s{i}" for i in range(FEATURES)], *[f"s{i}_{j}" for i, j in PAIRS]]
ESTIMATE = [*[f"m{i}" for i in range(FEATURES)], *[f"p{i}_{j}" for i, j in PAIRS], "log_det"]


def _estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, precision and log determinant from the sums of each row."""
    for frame in batches:
        n = frame["n"].to_numpy(float)
        mean = np.stack([frame[f"s{i}"].to_numpy(float) for i in range(FEATURES)], 1) / n[:, None] / 1000
        cov = np.empty((len(frame), FEATURES, FEATURES))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = frame[f"s{i}_{j}"].to_numpy(float) / n / 1e6 - mean[:, i] * mean[:, j]
        cov += np.diag(np.square(FLOOR))
        precision = np.linalg.inv(cov) if len(frame) else cov
        out = frame[["__q_lang", "__q_source", "start"]].copy()
        for i in range(FEATURES):
            out[f"m{i}"] = mean[:, i]
        for i, j in PAIRS:
            out[f"p{i}_{j}"] = precision[:, i, j]
        out["log_det"] = np.linalg.slogdet(cov)[1] if len(frame) else 0.0
        yield out


def _distance():
    """Squared Mahalanobis distance of a row's statistics from its joined estimate."""
    x = [F.col(f"__q_x{i}") / 1000 - F.col(f"m{i}") for i in range(FEATURES)]
    terms = [F.col(f"p{i}_{j}") * x[i] * x[j] * (1 if i == j else 2) for i, j in PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _key(*parts) -> F.Column:
    """A text that tells nulls from all other values."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("+"), p), F.lit("-")) for p in parts])


def levels(sizes: DataFrame, min_group: int) -> DataFrame:
    """From (lang, source, count): (lang, source, key, own) with the key of the rows that judge the group and whether these are its own."""
    by_lang = Window.partitionBy("lang")
    own, language = F.col("count") >= min_group, F.sum("count").over(by_lang) >= min_group
    key = F.when(own, F.concat(F.lit("own "), _key(F.col("lang"), F.col("source")))).when(language, F.concat(F.lit("language "), _key(F.col("lang")))).otherwise("all")
    return sizes.select("lang", "source", key.alias("key"), F.concat(F.lit("own "), _key(F.col("lang"), F.col("source"))).alias("own_key"), F.concat(F.lit("language "), _key(F.col("lang"))).alias("lang_key"))


def _joined(df: DataFrame, groups: DataFrame, lang: str, source: str, column: str) -> DataFrame:
    """``df`` with ``column`` of its group; null where the group has no row that passes the base rule."""
    g = groups.select(F.col("lang").alias("__q_gl"), F.col("source").alias("__q_gs"), F.col(column).alias("__q_key"))
    return df.join(g, F.col(lang).eqNullSafe(F.col("__q_gl")) & F.col(source).eqNullSafe(F.col("__q_gs")), "left").drop("__q_gl", "__q_gs")


def fit(stats: DataFrame, space: Workspace, lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP) -> tuple[DataFrame, DataFrame]:
    """(groups, estimates): each group with the key of its estimate; per key the estimate and the scale of its distances."""
    passed = stats.where(~base_failed()).select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), *_features())
    groups = levels(space.keep(passed.groupBy("lang", "source").count(), "sizes"), min_group)
    # the estimates that a group's rows take part in: of the keys that any group is judged by
    used = groups.select("key").distinct()
    parts = groups.select("lang", "source", F.explode(F.array("own_key", "lang_key", F.lit("all"))).alias("key")).join(used, "key", "left_semi").groupBy("lang", "source").agg(F.collect_set("key").alias("keys"))
    groups = space.keep(groups.select("lang", "source", "key").join(parts.withColumnsRenamed({"lang": "__q_gl", "source": "__q_gs"}), F.col("lang").eqNullSafe(F.col("__q_gl")) & F.col("source").eqNullSafe(F.col("__q_gs"))).drop("__q_gl", "__q_gs"), "groups")
    hint = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda df: df)
    rows = _joined(passed, hint(groups), "lang", "source", "keys").select(F.explode("__q_key").alias("__q_key"), *[f"__q_x{i}" for i in range(FEATURES)])
    rows = space.keep(rows, "rows")

    sums = [F.sum("c").alias("n")] + [F.sum(f"s{i}").alias(f"s{i}") for i in range(FEATURES)] + [F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in PAIRS]
    part = [F.count(F.lit(1)).alias("c")] + [F.sum(f"__q_x{i}").alias(f"s{i}") for i in range(FEATURES)] + [F.sum(F.col(f"__q_x{i}") * F.col(f"__q_x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    schema = f"__q_lang string, __q_source string, start int, {', '.join(f'{c} double' for c in ESTIMATE)}"
    estimate = lambda df: df.select(F.col("__q_key").alias("__q_lang"), F.lit(None).cast("string").alias("__q_source"), "start", *SUMS).mapInPandas(_estimate, schema).drop("__q_source").withColumnRenamed("__q_lang", "__q_key")
    # start 0: all rows; start 1: the half of the rows that is nearest to the coordinate-wise medians
    first = rows.groupBy("__q_key").agg(*part).withColumnRenamed("c", "n").withColumn("start", F.lit(0))
    cells = rows.select("__q_key", F.posexplode(F.array(*[F.floor(F.col(f"__q_x{i}") / 20) for i in range(FEATURES)])).alias("dim", "cell")).groupBy("__q_key", "dim", "cell").count()
    run = Window.partitionBy("__q_key", "dim").orderBy("cell")
    place = cells.withColumn("up", F.sum("count").over(run)).withColumn("all", F.sum("count").over(Window.partitionBy("__q_key", "dim")))
    at = lambda q: F.min(F.when(F.col("up") >= q * F.col("all"), F.col("cell")))
    middle = place.groupBy("__q_key", "dim").agg(at(0.25).alias("lo"), at(0.5).alias("mid"), at(0.75).alias("hi"))
    floor = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("dim") + 1)
    spread = F.pow((F.col("hi") - F.col("lo")) * 0.02 / 1.349, 2) + floor * floor
    diagonal = [F.max(F.when(F.col("dim") == i, F.col("mid") * 0.02 + 0.01)).alias(f"m{i}") for i in range(FEATURES)] + [(F.max(F.when(F.col("dim") == i, 1 / spread)) if i == j else F.lit(0.0)).alias(f"p{i}_{j}") for i, j in PAIRS] + [F.sum(F.log(spread)).alias("log_det")]
    medians = middle.groupBy("__q_key").agg(*diagonal).withColumn("start", F.lit(1)).select("__q_key", "start", *ESTIMATE)
    now = space.keep(estimate(first).select("__q_key", "start", *ESTIMATE).unionByName(medians), "estimate0")

    def binned(now: DataFrame) -> DataFrame:
        bin_ = F.least(F.lit(BINS), F.floor(F.log1p(_distance()) * 40).cast("int"))
        return rows.join(hint(now), "__q_key").groupBy("__q_key", "start", bin_.alias("bin")).agg(*part)

    inside = Window.partitionBy("__q_key", "start")
    for step in range(1, STEPS + 1):
        low = binned(now).withColumn("up", F.sum("c").over(inside.orderBy("bin"))).withColumn("all", F.sum("c").over(inside)).where(F.col("up") - F.col("c") < KEEP_SHARE * F.col("all"))
        now = space.keep(estimate(low.groupBy("__q_key", "start").agg(*sums)), f"estimate{step}")
    best = now.withColumn("rank", F.row_number().over(Window.partitionBy("__q_key").orderBy(F.round("log_det", 6), "start"))).where("rank = 1").drop("rank")
    # the median distance of normal data is known; its ratio to the group's makes distances comparable
    half = binned(best).withColumn("up", F.sum("c").over(inside.orderBy("bin"))).withColumn("all", F.sum("c").over(inside))
    scale = half.groupBy("__q_key").agg(F.min(F.when(2 * F.col("up") >= F.col("all"), F.col("bin"))).alias("bin")).select("__q_key", (4.351 / F.greatest(F.expm1((F.col("bin") + 1) / 40), F.lit(4.351))).alias("scale"))
    return groups, space.keep(best.join(scale, "__q_key").drop("start"), "estimates")


def judged(stats: DataFrame, groups: DataFrame, estimates: DataFrame, lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with ``__q_base_failed``, ``__q_distance`` (null where no row of its group passes the base rule) and ``__q_kept``."""
    small = groups.count() <= BROADCAST_GROUPS
    hint = F.broadcast if small else (lambda df: df)
    rows = _joined(stats, hint(groups), lang, source, "key").withColumns({f"__q_x{i}": x for i, x in enumerate(_features())})
    rows = rows.join(hint(estimates), "__q_key", "left").withColumn("__q_distance", _distance() * F.col("scale")).withColumn("__q_base_failed", base_failed())
    kept = ~F.col("__q_base_failed") & (F.coalesce("__q_distance", F.lit(0.0)) <= cutoff)
    return rows.withColumn("__q_kept", kept).select(*stats.columns, "__q_base_failed", "__q_distance", "__q_kept")


def quality_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, distance and kept."""
    space = Workspace(docs.sparkSession, "quality")
    docs = docs.select(F.col(doc_id), F.col(text), F.col(lang), F.col(source))
    stats = space.keep(with_counts(docs, text, [doc_id, lang, source]), "stats")
    rows = judged(stats, *fit(stats, space, lang, source), lang, source)
    return rows.select(doc_id, *[F.col(f"__q_{c}").alias(c) for c in COUNTS], F.col("__q_base_failed").alias("base_failed"), F.col("__q_distance").alias("distance"), F.col("__q_kept").alias("kept"))


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept. The texts are counted twice rather than written or shuffled."""
    space = Workspace(docs.sparkSession, "quality")
    own = docs.columns
    # under names that no internal column has
    docs = docs.select([F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(own)])
    text, lang, source = (f"c{own.index(c)}" for c in (text, lang, source))
    stats = space.keep(with_counts(docs, text, [lang, source]), "stats")
    groups, estimates = fit(stats, space, lang, source)
    return judged(with_counts(docs, text), groups, estimates, lang, source).where("__q_kept").select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
