"""Language ID: string-kernel classification.

A text is the set of its byte n-grams, n = 1 to 3, after letters are lower-cased
and everything that is no letter byte becomes a blank. The blended-spectrum
presence kernel of two texts is the mean over n of |A_n & B_n| / sqrt(|A_n| |B_n|).
Landmarks drawn from the training texts give the Nyström features
K(x, Z) K(Z, Z)^(-1/2); one ridge regression a language (one against the rest)
is fitted on them. A batch is scored by matrix products: presence rows times
landmark rows for each n, then times the folded coefficients.

The model is fitted on a bounded sample, ``PER_LANG`` training texts a language
(a documented parameter), chosen by a hash of the id; every text is scored
whole, a very long one in parts that change nothing. A null or empty text, or one without a letter, is ``und`` with
score 0. Where there is nothing to learn from, every text is ``und``; an empty table gives no row. Rows that share an id
are separate rows, and repeated texts have equal results. Ties between languages go to the first by name. Columns
named ``lang_pred``, ``score`` (and ``held_out`` in ``identify``) are replaced, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import slices, small_batches

#: Training texts a language at most, landmarks in all, and the ridge.
PER_LANG, LANDMARKS, RIDGE = 200, 128, 1e-2
#: n-grams are hashed into so many cells for each n; 1-grams have a cell a byte.
CELLS = {1: 256, 2: 4096, 3: 8192}
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

#: Bytes of text whose n-grams are held at once.
CHUNK = 1 << 20


def _fold_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for i in range(256):
        if 97 <= i <= 122 or i >= 128:
            table[i] = i
        elif 65 <= i <= 90:
            table[i] = i + 32
    return table


FOLD = _fold_table()
BLANKS = re.compile(rb" +")


def folded(text: bytes, chunk: int = 0) -> Iterator[bytes]:
    """The folded text between single blanks, cut into parts that overlap by two bytes: together the parts hold the
    n-grams (n up to 3) of the whole and no others, wherever the cuts are."""
    step, tail = chunk or CHUNK, b" "
    for at in range(0, len(text), step):
        part = BLANKS.sub(b" ", FOLD[np.frombuffer(text[at : at + step], np.uint8)].tobytes())
        if tail.endswith(b" ") and part.startswith(b" "):
            part = part[1:]
        if part:
            yield tail + part
            tail = (tail + part)[-2:]
    yield tail if tail.endswith(b" ") else tail + b" "


def presence(texts: list[bytes]) -> dict[int, np.ndarray]:
    """For each n a 0/1 matrix (texts, cells) of the n-grams that each whole text holds, its rows scaled to length 1."""
    out = {n: np.zeros((len(texts), cells), np.float32) for n, cells in CELLS.items()}
    for row, text in enumerate(texts):
        for part in folded(text):
            a = np.frombuffer(part, np.uint8).astype(np.uint32)
            out[1][row, a] = 1
            two = a[:-1] * np.uint32(256) + a[1:]
            out[2][row, two * np.uint32(2654435761) >> np.uint32(20)] = 1
            if len(a) > 2:
                out[3][row, (two[:-1] * np.uint32(256) + a[2:]) * np.uint32(2654435761) >> np.uint32(19)] = 1
    for m in out.values():
        m /= np.sqrt(np.maximum(m.sum(axis=1, keepdims=True), 1))
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    landmarks: dict[int, np.ndarray]
    weights: np.ndarray  # (landmarks + 1, languages): Nyström projection and ridge coefficients, folded

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        rows = presence(texts)
        return sum(rows[n] @ self.landmarks[n].T for n in CELLS) / len(CELLS)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        return self.kernel(texts) @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The language number and the score, a softmax of the one-against-rest margins."""
        m = self.margins(texts) * 6
        e = np.exp(m - m.max(axis=1, keepdims=True))
        best = e.argmax(axis=1)
        return best, e[np.arange(len(best)), best] / e.sum(axis=1)


def fit(texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fits on texts in the order given; landmarks are spread evenly over the languages."""
    names = sorted(set(langs))
    number = np.array([names.index(x) for x in langs])
    rank = np.zeros(len(langs), np.int64)
    for k in range(len(names)):
        rank[number == k] = np.arange((number == k).sum())
    chosen = np.lexsort((number, rank))[:landmarks]
    rows = presence(texts)
    z = {n: m[chosen] for n, m in rows.items()}
    k_xz = sum(rows[n] @ z[n].T for n in CELLS) / len(CELLS)
    value, vector = np.linalg.eigh(k_xz[chosen].astype(np.float64))
    keep = value > 1e-6 * value.max()
    project = vector[:, keep] / np.sqrt(value[keep])
    x = np.hstack([k_xz @ project, np.ones((len(langs), 1))])
    y = np.where(number[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Each class weighs the same, so that a common language isn't the default.
    weight = (1 / np.bincount(number))[number][:, None] * len(langs) / len(names)
    beta = np.linalg.solve(x.T @ (weight * x) + ridge * len(langs) * np.diag([1.0] * (x.shape[1] - 1) + [1e-6]), x.T @ (weight * y))
    return LanguageModel(names, z, np.vstack([project @ beta[:-1], beta[-1:]]).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    """The fixed fold: crc32 of the id as text is divisible by 5; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """Fits on ``per_lang`` texts of each language in ``docs`` (doc_id, text, lang) that aren't held out.

    The driver sees the number of rows of each language and the sample, no more.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # About twice the sample passes by a hash of the id, then the first of each language by hash are taken.
    draw = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("draw")
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * per_lang / n))).otherwise(rate)
    sample = usable.select("doc_id", "lang", "text", draw).filter(F.col("draw") < rate)
    rows = sorted(((r["lang"], r["draw"], r["doc_id"], r["text"]) for r in sample.toLocalIterator() if LETTER.search(r["text"])))
    kept: dict[str, int] = {}
    texts, langs = [], []
    for lang, _, _, text in rows:
        kept[lang] = kept.get(lang, 0) + 1
        if kept[lang] <= per_lang:
            texts.append(text.encode())
            langs.append(lang)
    return fit(texts, langs) if texts else None


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row, computed from the text alone; such columns of ``docs`` are replaced."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_col)
    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], at, 1 << 20):
                yield from _score(part)

    def _score(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for start in range(0, part.num_rows, 256):
            piece = part.slice(start, 256)
            texts = piece.column(at).to_pylist()
            langs: list[str] = [UNKNOWN] * len(texts)
            scores = [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if m and t and LETTER.search(t)]
            if rows:
                best, sure = m.predict([texts[i].encode() for i in rows])
                for i, k, s in zip(rows, best.tolist(), sure.tolist(), strict=True):
                    langs[i], scores[i] = m.langs[k], min(max(s, 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, schema)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Trains on ``docs`` and predicts all of them: their columns, then held_out, lang_pred and score."""
    model = train(docs, per_lang)
    return predict(docs.withColumn("held_out", held_out()), model)
