"""Language identification: averaged hashed subword embeddings and a linear softmax.

Every n-gram of one to three characters (letters in lower case, anything else as a boundary) is hashed to
a row of an embedding table; a text is the mean of its rows, and a linear softmax over it gives the
languages. Table and softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows. A second part of the sample calibrates a temperature and the score
below which a prediction is rejected. The model is one table of hash rows by languages, which is
broadcast; texts are scored whole where they lie, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from siteframe.llm.common import map_texts

BUCKET_BITS, WIDTH = 13, 16
BUCKETS = 1 << BUCKET_BITS
#: Bound of the training sample: labelled rows for a language, of all languages, and characters of such a row.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_CHARS, MAX_LANGUAGES = 600, 4_000, 20_000, 200
EPOCHS, BATCH, RATE, EMBEDDING_RATE = 8, 32, 1.0, 200.0
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
#: Share of calibration rows that may be rejected, and the range of the rejection score.
REJECT_SHARE, REJECT_FROM, REJECT_TO = 0.001, 0.35, 0.8
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True for the code points that are letters; made once in a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a text in lower case, and which of them are letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return codes, letter_table()[codes]


def subwords(codes: np.ndarray, is_letter: np.ndarray) -> np.ndarray:
    """Hash rows of all n-grams of a text."""
    # A run of other characters is one boundary.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    space = np.array([32], np.uint32)
    codes = np.concatenate((space, np.where(is_letter, codes, space)[keep], space))
    one = codes * _MULTIPLIERS[0]
    two = (one[:-1] ^ (codes[1:] * _MULTIPLIERS[1])) * _MULTIPLIERS[2]
    three = (two[:-1] ^ (codes[2:] * _MULTIPLIERS[0])) * _MULTIPLIERS[1]
    return np.concatenate([x >> np.uint32(32 - BUCKET_BITS) for x in (one, two, three)])


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Hash rows that a text has, the share of each, and its different letters; None without letters."""
    codes, is_letter = letters(text)
    if not is_letter.any():
        return None
    rows = subwords(codes, is_letter)
    counts = np.bincount(rows, minlength=BUCKETS)
    used = np.nonzero(counts)[0].astype(np.uint16)
    return used, (counts[used] / len(rows)).astype(np.float32), np.unique(codes[is_letter])


def dense(parts: list[tuple]) -> np.ndarray:
    out = np.zeros((len(parts), BUCKETS), np.float32)
    for row, (used, share, _) in zip(out, parts, strict=True):
        row[used] = share
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights over the temperature
    bias: np.ndarray
    letters: np.ndarray  # True for code points that training texts have
    reject_below: float

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score, rejected. The score is the probability times the share of the letters that training texts have."""
        codes, is_letter = letters((text or b"").decode("utf-8", "replace"))
        if not is_letter.any() or not self.languages:
            return UNKNOWN, 0.0, True
        rows = subwords(codes, is_letter)
        p = softmax((np.bincount(rows, minlength=BUCKETS) @ self.table / len(rows) + self.bias)[None])[0]
        best = int(p.argmax())
        score = float(p[best] * self.letters[codes[is_letter]].mean())
        return self.languages[best], score, score < self.reject_below


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Train on (text, language) rows; every fifth row calibrates. Equal rows in equal order give an equal model."""
    made = [(f, lang) for f, lang in ((features(t), lang) for t, lang in rows) if f is not None]
    languages = sorted({lang for _, lang in made})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(0x110000, bool), 1.0)
    x = [f for f, _ in made]
    y = np.array([languages.index(lang) for _, lang in made])
    held = np.arange(len(y)) % 5 == 4
    train = np.nonzero(~held)[0]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    weight = (len(train) / (len(languages) * np.maximum(np.bincount(y[train], minlength=len(languages)), 1))).astype(np.float32)
    batches = -(-len(train) // BATCH)
    for step in range(EPOCHS * batches):
        if step % batches == 0:
            order = rng.permutation(train)
        part = order[step % batches::batches]
        rate = np.float32(RATE * (1 - step / (EPOCHS * batches)))
        rows = dense([x[i] for i in part])
        hidden = rows @ emb
        gap = softmax(hidden @ out + bias)
        gap[np.arange(len(part)), y[part]] -= 1
        gap *= weight[y[part]][:, None] / len(part)
        back = gap @ out.T
        out -= rate * hidden.T @ gap
        bias -= rate * gap.sum(axis=0)
        # The share of one n-gram is small: its row moves by a larger rate.
        emb -= rate * EMBEDDING_RATE * rows.T @ back
    table = emb @ out
    tuned = np.nonzero(held)[0] if held.any() else train
    z, labels = np.concatenate([dense([x[i]]) @ table for i in tuned]) + bias, y[tuned]
    temperature = min(TEMPERATURES, key=lambda t: -np.log(softmax(z / t)[np.arange(len(labels)), labels] + 1e-9).mean())
    scores = np.sort(softmax(z / temperature).max(axis=1))
    below = float(np.clip(scores[int(REJECT_SHARE * len(scores))], REJECT_FROM, REJECT_TO))
    seen = np.zeros(0x110000, bool)
    for _, _, own in x:
        seen[own] = True
    return Model(languages, (table / temperature).astype(np.float64), (bias / temperature).astype(np.float64), seen, below)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that is never learnt from; rows without id are not held out and not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """Labelled rows in a fixed order, at most about SAMPLE_ROWS for each of the MAX_LANGUAGES most frequent languages."""
    labelled = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter(
        (F.crc32(F.col("i").cast("string")) % 4 != 2) & F.col("l").isNotNull() & F.col("t").isNotNull()
        & (F.length("t") <= SAMPLE_CHARS))
    counts = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    most = min(SAMPLE_ROWS, SAMPLE_TOTAL // len(counts))
    chance = F.create_map(*[v for r in counts for v in (F.lit(r["l"]), F.lit(min(1.0, most / r["count"])))])
    # The hash is uniform: the sample of a language has `most` rows but for a few.
    draw = F.pmod(F.xxhash64(F.lit("sample"), "i", "t"), F.lit(1_000_003)) / 1_000_003.0
    rows = labelled.filter(draw < F.try_element_at(chance, F.col("l"))).select("i", "t", "l").collect()
    return [(r["t"], r["l"]) for r in sorted(rows, key=lambda r: (str(r["i"]), r["l"], r["t"]))]


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("rejected", BooleanType())])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    return fit(sample(docs, doc_id, text, lang))


def predict(docs: DataFrame, model: Model, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected for every row.

    A null text, and one without letters, gets `und`, score 0, and is rejected, as is every
    text if nothing was learnt. A text counts whole. Equal texts get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list:
        return list(zip(*map(shared.value.predict, texts), strict=True)) or [[], [], []]

    return map_texts(docs, text, PREDICTION, run, keep)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, learnt from the labelled rows."""
    return predict(docs, train(docs, doc_id, text, lang),
                   [F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out")], text)


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is not rejected."""
    names = docs.columns
    keep = [F.struct(*[F.col(c) for c in names]).alias("__row")]
    out = predict(docs, train(docs, doc_id, text, lang), keep, text)
    return out.filter(~F.col("rejected")).select(*[F.col("__row")[c].alias(c) for c in names])
