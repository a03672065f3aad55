"""PII: candidate gradient boosting.

Generators with high recall propose spans of a text; a boosted ensemble of small
trees scores each from its format and context; calibrated thresholds select the
redactions. Spans of the base kinds (email, ip, card, phone), which a format
check settles, always stay; the ensemble adds looser ones (numbers and spelt-out
addresses that look and stand like personal data). The loose generators run over
the text with its base spans masked, so what they propose is something else.

Labels. A positive example is a base span in disguise: an email with its ``@``
spelt out, a phone number without its country code, a card as it is, each where it
stands. A negative one is a loose candidate that a check refutes: a long number
that fails the Luhn check, a quad with a part over 255, a date or time, an address
without a domain, or a number called an order, a version and the like (a cue that
no feature shows). All other candidates have no label; they are what is scored. A
fifth of the documents by a hash of the id is held out: it calibrates the
thresholds for a precision of ``PRECISION``, and is not learned from.

All of it is DataFrame functions. A generator's positions come from the text
between its matches: the lengths of what ``split`` leaves and of what
``regexp_extract_all`` finds are summed up in blocks of the square root of their
number, in code points. The ensemble is fitted on counts: all examples of the
corpus are grouped by their (bounded) features, and that table, whose size
doesn't grow with the corpus, is what the driver sees.

Null text is empty, and has no span. Rows that share an id, repeated rows
included, are separate rows with equal spans. Rules look back no further than a
run, so a very long text is taken whole in about linear time. With no examples, or
labels of one kind only, nothing is added; an empty table gives no row. Only the id
and text are read, so further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch

BASE = ("email", "ip", "card", "phone")
LOOSE = ("number", "address")
KINDS = (*BASE, *LOOSE)

#: The generators. Possessive runs and the lookbehind find the same leftmost matches as the plain
#: forms, but take linear time on long runs and no stack: a match can only start where a run does,
#: or where the match before it ended.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
}
#: What a text must hold, one of them at least, for a generator to be run.
NEEDS = {"email": ("@",), "phone": ("+",), "address": ("@", "at"), "ip": (".",), "card": (), "number": ()}

#: Features of a candidate and the number of values of each.
FEATURES = {"kind": 2, "digits": 6, "separators": 4, "groups": 4, "cue": 4, "lead": 4, "tail": 3}
CONTEXT = 24

ROUNDS, DEPTH, RATE, PRECISION = 24, 2, 0.3, 0.95


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


MATCH = "array<struct<start:int,end:int,word:string,before:string,after:string>>"


def _placed(pairs: Column) -> Column:
    """``pairs`` (gap, n, word, before, after) with their places: gaps and words are summed up block by block, so that
    arrays are grown in steps of the square root of the number of pairs."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def within(block: Column) -> Column:
        return F.aggregate(block, zero, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out")))

    def starts_of(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, offsets, lambda x, by: F.transform(x["out"], lambda start: start + by)))

    def blocks_of(held: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(held))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), size), lambda i: within(F.slice(held, i, size)))

    def placed(held: Column) -> Column:
        own = lambda x, start: F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["word"].alias("word"), x["before"].alias("before"), x["after"].alias("after"))
        return F.zip_with(held, let(blocks_of(held), starts_of), own)

    return let(pairs, placed)


def needed(text: Column, kind: str) -> Column:
    """Whether the text holds what a match of the kind must hold; cheaper than the rule."""
    there = text.rlike("[0-9]") if not NEEDS[kind] else reduce(or_, (F.instr(text, need) > 0 for need in NEEDS[kind]))
    return there & text.rlike("[0-9]") if kind in ("ip", "phone") else there


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, word, before, after>> of a generator's matches, in code points, with the CONTEXT before each (back
    to the match before it) and the character after it; empty where the text lacks what it needs."""
    rule = RULES[kind]

    def found(gaps: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
        nexts = F.slice(gaps, 2, F.size(gaps))
        around = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), nexts, lambda g, x: F.struct(F.length(g).alias("gap"), F.lower(F.substring(g, -CONTEXT, CONTEXT)).alias("before"), F.substring(x, 1, 1).alias("after")))
        return _placed(F.zip_with(around, words, lambda g, w: F.struct(g["gap"].alias("gap"), F.length(w).alias("n"), w.alias("word"), g["before"].alias("before"), g["after"].alias("after"))))

    return F.when(needed(text, kind) & text.rlike(rule), let(F.split(text, rule, -1), found)).otherwise(F.array().cast(MATCH))


#: Stands for every character of a base span in the text that the loose generators see.
MASK = "\u0001"


def masked(text: Column, kind: str) -> Column:
    """The text with each valid match of a base kind replaced by as many masks."""
    rule = RULES[kind]

    def rebuilt(gaps: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
        hidden = F.transform(words, lambda w: F.when(valid(kind, w), F.repeat(F.lit(MASK), F.length(w))).otherwise(w))
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), hidden, lambda g, w: F.concat(g, w)), ""), F.element_at(gaps, -1))

    return F.when(needed(text, kind) & text.rlike(rule), let(F.split(text, rule, -1), rebuilt)).otherwise(text)


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, word: Column) -> Column:
    if kind == "ip":
        # Leading zeros don't count; what is left has three digits at most and isn't over 255.
        parts = F.transform(F.split(word, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    n = F.length(_digits(word))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(word))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def checked(text: Column, kind: str) -> Column:
    """The matches of a base kind that its format check accepts."""
    return F.filter(matches(text, kind), lambda m: valid(kind, m["word"]))


def base_spans(found: dict[str, Column]) -> Column:
    """array<struct<start, kind number, end>> of the base kinds' checked matches, by start and then kind."""

    def of_kind(k: int, kind: str) -> Column:
        return F.transform(found[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.concat(*[of_kind(k, kind) for k, kind in enumerate(BASE)]))


def _binned(x: Column, *edges: int) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def features(m: Column, kind: int, word: Column) -> Column:
    """The features of a match as a struct of small numbers; ``word`` is how it is spelt."""
    before, after = m["before"], m["after"]
    last = F.substring(before, -1, 1)
    values = {
        "kind": F.lit(kind),
        "digits": _binned(F.length(_digits(word)), 1, 7, 9, 12, 16),
        "separators": _binned(F.length(F.regexp_replace(word, "[0-9A-Za-z]", "")), 1, 3, 5),
        "groups": _binned(F.size(F.split(word, r"[^0-9A-Za-z]+", -1)), 2, 3, 5),
        "cue": F.when(before.rlike("(phone|tel|call|mobile|fax)"), 1).when(before.rlike("(mail|contact|write|reach)"), 2).when(before.rlike("(card|visa|iban|account|ssn)"), 3).otherwise(0),
        "lead": F.when((last == "") & (m["start"] == 0), 0).when(last.rlike(r"[\s]"), 1).when(last.rlike(r"[:=(\[<\"']"), 2).otherwise(3),
        "tail": F.when(after == "", 0).when(after.rlike(r"[\s.,;:!?)\]>\"']"), 1).otherwise(2),
    }
    return F.struct(*[v.cast("int").alias(f) for f, v in values.items()])


def disguised(found: dict[str, Column]) -> Column:
    """array<struct<x, label 1>>: the base spans that have a loose form, in that form."""

    def shown(kind: str, loose: int, spelt: Callable[[Column], Column]) -> Column:
        return F.transform(found[kind], lambda m: let(spelt(m["word"]), lambda w: F.struct(features(m, loose, w).alias("x"), F.lit(1).alias("label"))))

    email = shown("email", 1, lambda w: F.regexp_replace(F.regexp_replace(w, "@", " (at) "), r"\.", " (dot) "))
    return F.concat(email, shown("phone", 0, lambda w: F.regexp_replace(w, r"^\+[0-9]+\x20*", "")), shown("card", 0, lambda w: w))


#: What makes a number something else, in the context before it; no feature shows it.
OTHER_NUMBERS = r"(order|invoice|version|isbn|serial|build|page|item|part|model|ref|no\.|nr\.|#)[\s:#]*$"
DATE = r"^\(?(?:(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?:[ ./-]*+[0-9]{1,2}+)*+$"


def refuted(m: Column, kind: int) -> Column:
    """Whether a check says that a loose match is nothing personal."""
    word = m["word"]
    if kind == 1:
        return ~word.rlike(r"(?:@|at[)\]]).*(?:\.|dot[)\]])")
    n = F.length(_digits(word))
    long_number = n.between(12, 19) & word.rlike(r"^[0-9](?:[\x20-]?[0-9])++$")
    quad = word.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    # Words of more digits, which may be very long, are settled first.
    return F.when(n > 19, True).when(long_number, ~luhn(_digits(word))).when(quad, ~valid("ip", word)).otherwise(word.rlike(DATE) | m["before"].rlike(OTHER_NUMBERS))


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, x: features, label>> of the loose generators; the label is 0 where a check refutes one, else null."""

    def of_kind(k: int, kind: str) -> Column:
        label = lambda m: F.when(F.coalesce(refuted(m, k), F.lit(False)), F.lit(0))
        return F.transform(matches(text, kind), lambda m: F.struct(m["start"].alias("start"), F.lit(len(BASE) + k).alias("kind"), m["end"].alias("end"), features(m, k, m["word"]).alias("x"), label(m).alias("label")))

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(LOOSE)])


@dataclass
class Tree:
    """A split (feature, threshold: left where value < threshold) of two subtrees, or a leaf's value."""

    feature: str = ""
    threshold: int = 0
    left: Tree | None = None
    right: Tree | None = None
    value: float = 0.0

    def of(self, x: dict[str, int]) -> float:
        node = self
        while node.left:
            node = node.left if x[node.feature] < node.threshold else node.right
        return node.value

    def column(self, x: Column) -> Column:
        if not self.left:
            return F.lit(self.value)
        return F.when(x[self.feature] < self.threshold, self.left.column(x)).otherwise(self.right.column(x))


@dataclass
class Ensemble:
    """Boosted trees over the log-odds ``start``, and the least score that selects a candidate of each loose kind."""

    start: float
    trees: list[Tree]
    thresholds: dict[int, float]

    def of(self, x: dict[str, int]) -> float:
        return self.start + sum(t.of(x) for t in self.trees)

    def column(self, x: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.column(x)
        return out


def _grow(cells: list[tuple[dict[str, int], float, float]], depth: int) -> Tree:
    """The tree of least loss over cells (features, gradient, curvature), by Newton steps."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best: tuple[float, str, int] = (1e-9, "", 0)
    if depth:
        for feature, values in FEATURES.items():
            for threshold in range(1, values):
                gl = sum(c[1] for c in cells if c[0][feature] < threshold)
                hl = sum(c[2] for c in cells if c[0][feature] < threshold)
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                best = max(best, (gain, feature, threshold))
    if not best[1]:
        return Tree(value=RATE * g / (h + 1))
    _, feature, threshold = best
    return Tree(feature, threshold, _grow([c for c in cells if c[0][feature] < threshold], depth - 1), _grow([c for c in cells if c[0][feature] >= threshold], depth - 1))


def fit(cells: list[tuple[dict[str, int], bool, int, int]]) -> Ensemble | None:
    """Fits on cells (features, held for calibration, candidates, labelled ones)."""
    learn = [c for c in cells if not c[1]]
    n, p = sum(c[2] for c in learn), sum(c[3] for c in learn)
    if not 0 < p < n:
        return None
    ensemble = Ensemble(math.log(p / (n - p)), [], {})
    scores = [ensemble.start] * len(learn)
    for _ in range(ROUNDS):
        odds = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _grow([(c[0], c[3] - c[2] * q, c[2] * q * (1 - q)) for c, q in zip(learn, odds, strict=True)], DEPTH)
        ensemble.trees.append(tree)
        scores = [s + tree.of(c[0]) for s, c in zip(scores, learn, strict=True)]
    for k in range(len(LOOSE)):
        ranked = sorted(((ensemble.of(x), m, q) for x, held, m, q in cells if held and x["kind"] == k), key=lambda c: -c[0])
        chosen, right = 0, 0
        for i, (score, m, q) in enumerate(ranked):
            chosen, right = chosen + m, right + q
            # Cells of one score stand or fall together.
            if right >= PRECISION * chosen and (i + 1 == len(ranked) or ranked[i + 1][0] < score):
                ensemble.thresholds[k] = score
    return ensemble


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, loose, shown) of every row: base spans, loose candidates and the base spans in disguise."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.select("doc_id", "__text", *[checked(F.col("__text"), kind).alias(f"__{kind}") for kind in BASE])
    found = {kind: F.col(f"__{kind}") for kind in BASE}
    for kind in BASE:
        rows = rows.withColumn("__text", F.when(F.size(found[kind]) > 0, masked(F.col("__text"), kind)).otherwise(F.col("__text")))
    return rows.select("doc_id", base_spans(found).alias("base"), candidates(F.col("__text")).alias("loose"), disguised(found).alias("shown"))


def learn(found: DataFrame) -> Ensemble | None:
    """Fits on the examples of ``propose``'s rows, grouped by their features."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held")
    refused = F.transform(F.filter("loose", lambda c: c["label"] == 0), lambda c: F.struct(c["x"].alias("x"), c["label"].alias("label")))
    counted = found.select(held, F.explode(F.concat("shown", refused)).alias("c")).groupBy("held", "c.x").agg(F.count("*").alias("n"), F.sum("c.label").alias("p"))
    # At most 2 * 2 * 6 * 4 * 4 * 4 * 4 * 3 rows: one for each value of the features.
    return fit(sorted(((r["x"].asDict(), r["held"], r["n"], r["p"]) for r in counted.collect()), key=lambda c: (sorted(c[0].items()), c[1])))


def find(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added) of every row, each an array<struct<start, kind number, end>> by start and then kind."""
    found = scratch.table(propose(docs, id_col, text_col), "candidates")
    ensemble = learn(found)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if ensemble is None or not ensemble.thresholds:
        return found.select("doc_id", "base", none.alias("added"))

    def chosen(c: Column) -> Column:
        enough = F.lit(False)
        for k, t in ensemble.thresholds.items():
            enough = F.when(c["x"]["kind"] == k, ensemble.column(c["x"]) >= F.lit(t - 1e-9)).otherwise(enough)
        return enough & c["label"].isNull()

    added = F.transform(F.filter("loose", chosen), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    return found.select("doc_id", "base", F.array_sort(added).cast("array<struct<start:int,kind:int,end:int>>").alias("added"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (by start) replaced by its kind in brackets; of overlapping spans the first names the mask."""
    names = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    count = lambda k, kind: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k, kind) for k, kind in enumerate(BASE)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
