"""Personal data: wide candidates, gradient-boosted trees over their format and context, calibrated thresholds.

High-recall generators propose spans, which may overlap: the base patterns of e-mail addresses, IP addresses,
card and phone numbers before their checks, and looser forms of each (spelled-out or bracketed at signs and dots, other
separators, numbers without a country code). Nobody has labelled them, so each candidate carries a weak label by a
check of what it says: the card's checksum, the octets, a domain that ends in letters, digits of a phone number and
their numbering plan. What a check reads is no feature. A candidate is described by a few categories of its format
and what stands around it; the corpus is counted over this grid, of at most ``GRID`` cells. Boosted trees of depth
two are fitted to the counts of one half of the matches (by a hash, so equal ones are in one half). The other half
calibrates: per kind, the least score at which the smoothed precision of candidates beyond the base ones reaches
``PRECISION`` is the threshold; without enough evidence there is none. Base matches always stay; a further
candidate is redacted if it reaches its threshold, meets no base span and loses to no better candidate that it overlaps.

All of this is DataFrame functions; the driver sees only the counts of the grid. Offsets are code points.

Defined cases: null or empty texts have no spans; long runs of digits or letters are matched by possessive
patterns in one pass, and spans are compared within stretches of ``STRETCH`` characters, so time follows the length
of a text; repeated rows each get a result; a corpus without candidates (or an empty table) adds no spans; other
columns are ignored by ``pii_table`` and pass through ``redact``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sourcelake.llm.shared import Workspace, fresh

KINDS = ["email", "ip", "card", "phone"]
#: Per kind the base pattern, written so that a failing start is not tried again within its run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
DOT = r" ?(?:[\[(](?:dot|DOT)[\])]|\[\.\]|\(\.\)|\.) ?"
#: Looser forms.
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT|@)[\])] ?[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|[\[(](?:dot|DOT)[\])]) ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/]|[ ._/-]{2})[0-9]{4}(?:[._/]|[ ._/-]{2})[0-9]{4}(?:[._/]|[ ._/-]{2})[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:00 ?[0-9]{1,3}[ .-])?\(?[0-9]{3,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9.-]?[0-9])",
}
#: A text without one of these has no match; other kinds' texts are tried for digits: a looser form has three in a row, a card twelve with single separators.
NEEDS = {("email", 0): ["@"], ("ip", 0): ["."], ("phone", 0): ["+"], ("email", 1): ["[at]", "(at)", "[AT]", "(AT)", "[@]", "(@)"], ("ip", 1): ["[.]", "(.)", "[dot]", "(dot)", "[DOT]", "(DOT)"]}
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Words near a candidate, by what they speak for.
CONTEXTS = [r"mail|tel|phone|call|fax|contact|mobile|cell", r"card|visa|credit|account|payment", r"\bip\b|host|server|address", r"order|version|build|isbn|ref|invoice|serial|\bid\b"]
CONTEXT_CHARS = 24
#: Categories of each feature: kind, digits of a card, separators, left, right, context, form, looser or not.
SIZES = (4, 6, 5, 5, 5, 5, 4, 2)
GRID = math.prod(SIZES)
ROUNDS, RATE, PRECISION = 24, 0.4, 0.95
FEATURES = [f"f{i}" for i in range(len(SIZES))]
#: Matches whose places are summed at once; characters within which spans are compared; texts whose spans are broadcast.
BLOCK, STRETCH, BROADCAST_TEXTS = 256, 64, 100_000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    d = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(OCTETS)
    return luhn(digits) if kind == "card" else F.length(digits).between(9, 15)


def _code(tests: list[Column], other: int) -> Column:
    """Number of the first test that holds."""
    out = F.when(tests[0], 0)
    for i, t in enumerate(tests[1:], 1):
        out = out.when(t, i)
    return out.otherwise(other)


def _label(kind: str, wide: bool, match: Column) -> Column:
    """What the candidate says, checked."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return match.rlike("[^A-Za-z0-9-][A-Za-z]{2,}$")
    if kind == "ip" and wide:
        return F.regexp_replace(match, "[^0-9]+", ".").rlike(OCTETS)
    if kind == "phone" and wide:
        # area code and exchange of the North American plan, or a country code behind 00
        return digits.rlike("^(?:1?[2-9][0-9]{2}[2-9][0-9]{6}|00[1-9][0-9]{7,12})$")
    return _valid(kind, match)


def _candidate(kind: str, wide: bool, match: Column, left: Column, right: Column, start: Column) -> Column:
    """A struct of kind number, start, end, base (a base span), label, half of the matches and features."""
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    separators = F.regexp_replace(match, "[A-Za-z0-9@+]", "")
    one = lambda cls: separators.rlike(f"^{cls}+$")
    before, after, near = F.right(left, F.lit(1)), F.left(right, F.lit(1)), F.lower(F.right(left, F.lit(CONTEXT_CHARS)))
    side = lambda c, marks: _code([(c == "") | c.rlike(r"^\s$"), c.rlike(r"^\p{L}$"), c.rlike("^[0-9]$"), c.rlike(marks)], 4)
    length = _code([n <= 13, n == 14, n == 15, n == 16], 4) if kind == "card" else F.lit(5)
    form = _code([match.startswith("+"), match.rlike("^[3-6]"), match.rlike(r"^\(|^00?")], 3) if kind in ("card", "phone") else F.lit(0)
    values = [F.lit(KINDS.index(kind)), length, _code([separators == "", one(" "), one("-"), one(r"\.")], 4), side(before, r"^[(\"'<:=\[]$"), side(after, r"^[.,;:!?)\"'\]>]$"), _code([near.rlike(c) for c in CONTEXTS], 4), form, F.lit(int(wide))]
    return F.struct(
        start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(match)).cast("long").alias("end"), (F.lit(False) if wide else _valid(kind, match)).alias("base"),
        _label(kind, wide, match).alias("label"), (F.crc32(match.cast("binary")) % 2).cast("int").alias("half"), *[v.cast("int").alias(f) for f, v in zip(FEATURES, values)],
    )


CANDIDATE = f"array<struct<start:bigint,kind:int,end:bigint,base:boolean,label:boolean,half:int,{','.join(f'{f}:int' for f in FEATURES)}>>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _starts(pieces: Column, matches: Column) -> Column:
    """Where each match begins, from the lengths of what stands before, between and after the matches: sums within blocks, then over blocks."""
    lengths = F.zip_with(F.transform(pieces, lambda p: F.length(p)), F.transform(matches, lambda m: F.length(m)), lambda p, m: F.struct(p.alias("p"), F.coalesce(m, F.lit(0)).alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a.at + x.p + x.m).alias("at"), F.concat(a.starts, F.array(a.at + x.p)).alias("starts"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("parts"))
    join = lambda a, x: F.struct((a.at + x.at).alias("at"), F.concat(a.parts, F.array(F.transform(x.starts, lambda s: s + a.at))).alias("parts"))
    blocks = lambda whole: F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(whole, b * BLOCK + 1, F.lit(BLOCK)), begin, step))
    return _bound(lengths, lambda whole: F.aggregate(blocks(whole), first, join, lambda a: F.flatten(a.parts)))


def _found(text: Column, kind: str, wide: bool) -> Column:
    pattern = (WIDE if wide else BASE)[kind]

    def rows(x: Column) -> Column:
        n = F.size(x.m)
        parts = F.arrays_zip(x.m.alias("m"), F.slice(x.p, F.lit(1), n).alias("l"), F.slice(x.p, F.lit(2), n).alias("r"), F.slice(_starts(x.p, x.m), F.lit(1), n).alias("s"))
        return F.transform(parts, lambda y: _candidate(kind, wide, y.m, y.l, y.r, y.s)).cast(CANDIDATE)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    needs = NEEDS.get((kind, int(wide)))
    test = F.lit(False)
    for mark in needs or []:
        test = test | text.contains(mark)
    return F.when(test if needs else text.rlike("[0-9]{3}" if wide else r"[0-9](?:[ -]?[0-9]){11}"), _bound(both, rows)).otherwise(F.array().cast(CANDIDATE))


def candidates(docs: DataFrame, text: str = "text", name: str = "__p_candidates") -> DataFrame:
    """``docs`` with the array of candidates of each text, by start, kind and end."""
    t = F.coalesce(F.col(text), F.lit(""))
    arrays = [_found(t, k, False) for k in KINDS] + [_found(t, k, True) for k in WIDE]
    return docs.withColumn(name, F.sort_array(F.concat(*arrays)))


# ---- boosting over counted cells


class Model:
    """Trees as ((feature, value), yes branch, no branch), branches being ((feature, value), yes, no) or numbers; thresholds by kind."""

    def __init__(self, prior: float, trees: list, thresholds: dict[int, float]):
        self.prior, self.trees, self.thresholds = prior, trees, thresholds

    def score(self, cell: tuple[int, ...]) -> float:
        def walk(node):
            while isinstance(node, tuple):
                (f, v), yes, no = node
                node = yes if cell[f] == v else no
            return node

        return self.prior + sum(map(walk, self.trees))

    def expression(self, feature: Callable[[int], Column]) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            (f, v), yes, no = node
            return F.when(feature(f) == v, walk(yes)).otherwise(walk(no))

        out = F.lit(self.prior)
        for tree in self.trees:
            out = out + walk(tree)
        return out


def boost(cells: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Logistic boosting on cells (a row of categories each) with counts; Newton steps with one unit of regularisation."""
    if not len(cells):
        return Model(0.0, [], {})
    prior = math.log((positive.sum() + 1) / (negative.sum() + 1))
    score, trees = np.full(len(cells), prior), []
    marks = {(f, v): cells[:, f] == v for f in range(len(SIZES)) for v in range(SIZES[f])}

    def grow(own: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total_g, total_h = g[own].sum(), h[own].sum()
        top, at = 1e-6, None
        for split, mark in marks.items() if depth else ():
            yes = own & mark
            if yes.any() and yes.sum() < own.sum():
                yg, yh = g[yes].sum(), h[yes].sum()
                gain = yg * yg / (yh + 1) + (total_g - yg) ** 2 / (total_h - yh + 1) - total_g**2 / (total_h + 1)
                if gain > top:
                    top, at = gain, split
        if at is None:
            leaf = float(RATE * total_g / (total_h + 1))
            score[own] += leaf
            return leaf
        return at, grow(own & marks[at], g, h, depth - 1), grow(own & ~marks[at], g, h, depth - 1)

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        trees.append(grow(np.ones(len(cells), bool), positive * (1 - q) - negative * q, (positive + negative) * q * (1 - q), 2))
    return Model(prior, trees, {})


def calibrate(model: Model, cells: list[tuple[int, ...]], positive: list[int], negative: list[int]) -> Model:
    """``model`` with, per kind, the least score of the given cells from which on the smoothed precision reaches ``PRECISION``."""
    for kind in range(len(KINDS)):
        ranked = sorted(((model.score(c), p, n) for c, p, n in zip(cells, positive, negative) if c[0] == kind), reverse=True)
        p = n = 0
        for i, (s, a, b) in enumerate(ranked):
            p, n = p + a, n + b
            if p + 1 >= PRECISION * (p + n + 2) and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
                model.thresholds[kind] = s
    return model


def fit(found: DataFrame, name: str = "__p_candidates") -> Model:
    """Counts candidates over the grid, boosts on one half and calibrates on the other; at most six rows a cell reach the driver."""
    rows = found.select(F.explode(name).alias("c")).groupBy("c.half", "c.base", *[F.col(f"c.{f}") for f in FEATURES])
    counted = rows.agg(F.count_if("c.label").alias("p"), F.count_if(~F.col("c.label")).alias("n")).collect()
    learned: dict[tuple, list[int]] = {}
    for r in counted:
        if r.half == 0:
            own = learned.setdefault(tuple(r[f] for f in FEATURES), [0, 0])
            own[0] += r.p
            own[1] += r.n
    cells = sorted(learned)
    model = boost(np.array(cells, np.int64).reshape(len(cells), len(SIZES)), *(np.array([learned[c][i] for c in cells], float) for i in (0, 1)))
    other = [r for r in counted if r.half == 1 and not r.base]
    return calibrate(model, [tuple(r[f] for f in FEATURES) for r in other], [r.p for r in other], [r.n for r in other])


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def select_spans(found: DataFrame, model: Model, space: Workspace) -> DataFrame:
    """From (uid, __p_candidates, others): ``__p_base`` and ``__p_spans``, arrays of (start, kind, end), in place of the candidates."""
    plain = lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))
    df = found.withColumn("__p_base", F.transform(F.filter("__p_candidates", lambda x: x.base), plain).cast(SPANS))
    if not model.thresholds:
        return df.drop("__p_candidates").withColumn("__p_spans", F.col("__p_base"))

    def reaches(x: Column) -> Column:
        limit = F.lit(math.inf)
        for kind, t in model.thresholds.items():
            limit = F.when(x.kind == kind, F.lit(t)).otherwise(limit)
        return model.expression(lambda i: x[FEATURES[i]]) >= limit - 1e-9

    more = found.select("uid", F.explode(F.filter("__p_candidates", lambda x: ~x.base & reaches(x))).alias("x"))
    score = F.round(model.expression(lambda i: F.col(f"x.{FEATURES[i]}")), 9)
    more = space.keep(more.groupBy("uid", "x.start", "x.kind", "x.end").agg(F.max(score).alias("score")), "more")
    # spans that overlap share a stretch; a stretch holds a bounded number of each pattern's matches
    every = df.select("uid", F.explode("__p_base").alias("x")).join(more.select("uid").distinct(), "uid", "left_semi").select("uid", "x.start", "x.kind", "x.end", F.lit(math.inf).alias("score")).unionByName(more)
    stretches = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((F.col("end") - 1) / STRETCH)))
    x, y = more.withColumn("stretch", stretches).alias("x"), every.withColumn("stretch", stretches).alias("y")
    meets = (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    better = F.expr("y.score > x.score or (y.score = x.score and (y.start < x.start or (y.start = x.start and (y.end > x.end or (y.end = x.end and y.kind < x.kind)))))")
    lost = x.join(y, (F.col("x.uid") == F.col("y.uid")) & (F.col("x.stretch") == F.col("y.stretch")) & meets & better).select("x.uid", "x.start", "x.kind", "x.end").distinct()
    kept = more.join(lost, ["uid", "start", "kind", "end"], "left_anti").groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__p_more"))
    df = df.drop("__p_candidates").join(space.keep(kept, "kept"), "uid", "left")
    return df.withColumn("__p_spans", F.sort_array(F.concat("__p_base", F.coalesce("__p_more", F.array().cast(SPANS))))).drop("__p_more")


def _told(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def pii_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, the base counts by kind, base_sha256 and spans, each span as kind:start:end."""
    space = Workspace(docs.sparkSession, "pii")
    found = candidates(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    found = space.keep(found.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "__p_candidates"), "candidates")
    rows = select_spans(found, fit(found), space)
    of = lambda k: F.filter("__p_base", lambda x: x.kind == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_told("__p_base").cast("binary"), 256).alias("base_sha256"), _told("__p_spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind."""
    space = Workspace(docs.sparkSession, "pii")
    # spans follow from the text, so equal texts are looked at once
    uid = F.sha2(F.col(text).cast("binary"), 256)
    found = candidates(docs.select(uid.alias("uid"), F.col(text).alias("text")), "text").where(F.size("__p_candidates") > 0)
    every = space.keep(found.select("uid", "__p_candidates"), "candidates")
    model = fit(every)
    spans = select_spans(every.groupBy("uid").agg(F.first("__p_candidates").alias("__p_candidates")), model, space).where(F.size("__p_spans") > 0)
    key, own = fresh(docs.columns, "__p_uid", "__p_spans")
    spans = space.keep(spans.select(F.col("uid").alias(key), F.col("__p_spans").alias(own)), "spans")
    rows = docs.join(F.broadcast(spans) if spans.count() <= BROADCAST_TEXTS else spans, uid == F.col(key), "left")
    marks = F.array(*[F.lit(mark.format(k)) for k in KINDS])
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda at, n: F.substring(F.col(text), (at + 1).cast("int"), n.cast("int"))
    # overlapping base spans are cut out together under the first one's kind
    step = lambda a, x: F.when(x.end <= a.at, a).otherwise(F.struct(x.end.alias("at"), F.concat(a.out, F.array(piece(a.at, F.greatest(x.start - a.at, F.lit(0))), F.when(x.start >= a.at, F.element_at(marks, x.kind + 1)).otherwise(F.lit("")))).alias("out")))
    out = F.aggregate(own, begin, step, lambda a: F.concat(F.array_join(a.out, ""), piece(a.at, F.length(text))))
    return rows.withColumn(text, F.when(F.col(own).isNull(), F.col(text)).otherwise(out)).select(*docs.columns)
