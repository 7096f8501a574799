"""Quality rules: cross-document line frequency and repetition inside a text.

Lines are normalised (A-Z in lower case, digits as 0, white space as one space) and hashed.
Per host the different documents (by whole text) that hold a line are counted; a line is above the limit if they reach `min_docs` and
`min_share` of the documents of the host. Near copies would make every line of a copied document look frequent.
Each text therefore has a signature: SIGNS minima over its five-word shingles. Texts of similarity COPY have (1 - COPY) / (1 + COPY) of
their shingles for themselves, and as large a share of new minima; a line whose documents have no more than that is a
line of copies and stays. What a template leaves to its documents is more.
Lines above the limit are removed; a document is depleted, and rejected, if fewer than
`min_words` words or less than `min_rest` of its words remain.

Hot lines and hosts are combined before each shuffle. Texts are read once; only hashes of lines,
word counts and positions are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siteframe.core import cut_lineage
from siteframe.llm.common import LOWER, SPACES, map_texts, small_side

MIN_DOCS, MIN_SHARE = 10, 0.01
MIN_WORDS, MIN_REST = 10, 0.3
#: Minima of a signature, words of its shingles, and the similarity from which texts are copies.
SIGNS, SHINGLE, COPY = 16, 5, 0.8
#: Of the base rule.
BASE_WORDS, BASE_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

SYMBOLS = b"#*$%&|<>"
_NORMAL = bytes.maketrans(bytes(range(65, 91)) + b"123456789", bytes(range(97, 123)) + b"0" * 9)


def line_hash(line: bytes) -> int:
    """60 bits of the MD5 of a normalised line."""
    return int(hashlib.md5(b" ".join(line.translate(_NORMAL).split())).hexdigest()[:15], 16)


def repeated_words(texts: list[list[bytes]], window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each list of words, the words inside windows that it holds twice or more.

    Words become numbers; the number of a window of 2n words comes from those of its halves, so
    equal numbers mean equal windows. All texts are handled at once.
    """
    if window & (window - 1):
        raise ValueError("window is a power of two")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum())
    if total < window:
        return np.zeros(len(texts), np.int64)
    words = np.empty(total, object)
    words[:] = [w for t in texts for w in t]
    of = np.repeat(np.arange(len(texts)), lengths)
    codes = pd.factorize(words)[0].astype(np.int64)
    width = 1
    while width < window:
        codes = pd.factorize(codes[:-width] * (codes.max() + 1) + codes[width:])[0].astype(np.int64)
        width *= 2
    whole = of[:len(codes)] == of[window - 1:]
    begin = np.nonzero(whole)[0]
    if not len(begin):
        return np.zeros(len(texts), np.int64)
    group = pd.factorize(codes[begin] * len(texts) + of[begin])[0]
    begin = begin[np.bincount(group)[group] > 1]
    edge = np.zeros(total + 1, np.int64)
    edge[begin] += 1
    edge[begin + window] -= 1
    inside = np.cumsum(edge)[:total] > 0
    return np.bincount(of[inside], minlength=len(texts))


def factors(start: int, n: int) -> list[int]:
    """Powers of an odd number modulo 2^64."""
    return [pow(start, i + 1, 1 << 64) for i in range(n)]


WORD_FACTORS, SIGN_FACTORS = factors(0x9E3779B97F4A7C15, SHINGLE), factors(0xD1342543DE82EF95, SIGNS)


class WordCodes(dict):
    """60 bits of the MD5 of words, kept for a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        code = self[word] = int(hashlib.md5(word).hexdigest()[:15], 16)
        return code


def signatures(texts: list[list[bytes]], codes: dict[bytes, int]) -> list[list[int] | None]:
    """For each list of words SIGNS minima over its shingles (fewer words: over the whole list); None without words."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((codes[w] for t in texts for w in t), np.uint64, int(lengths.sum()))
    out: list[list[int] | None] = [None] * len(texts)
    if not len(words):
        return out
    of = np.repeat(np.arange(len(texts)), lengths)
    first = np.cumsum(lengths) - lengths
    sums = words * np.uint64(WORD_FACTORS[0])
    for i in range(1, min(SHINGLE, len(words))):
        sums[:-i] += np.where(of[i:] == of[:-i], words[i:], np.uint64(0)) * np.uint64(WORD_FACTORS[i])
    place = np.arange(len(words)) - first[of]
    whole = (place + SHINGLE <= lengths[of]) | (place == 0)
    sums, of = sums[whole] >> np.uint64(4), of[whole]
    at, begin = np.unique(of, return_index=True)
    least = np.stack([np.minimum.reduceat(sums * np.uint64(f), begin) >> np.uint64(1) for f in SIGN_FACTORS], axis=1)
    for i, row in zip(at.tolist(), least.astype(np.int64).tolist(), strict=True):
        out[i] = row
    return out


STATS = StructType([StructField(n, LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    StructField(n, ArrayType(LongType())) for n in ("line_no", "line_hash", "line_words", "signs")])
_codes = WordCodes()


def _measure(texts: list[bytes | None]) -> list:
    texts = [t or b"" for t in texts]
    words = [t.split() for t in texts]
    bare = [t.translate(None, SPACES) for t in texts]
    chars = [len(b.decode("utf-8", "replace")) for b in bare]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    duplicate, numbers, hashes, counts = [], [], [], []
    for t in texts:
        lines = [(i, x) for i, x in enumerate(t.split(b"\n")) if x.strip(SPACES)]
        duplicate.append(len(lines) - len({x for _, x in lines}))
        numbers.append([i for i, _ in lines])
        hashes.append([line_hash(x) for _, x in lines])
        counts.append([len(x.split()) for _, x in lines])
    return [[len(w) for w in words], chars, symbols, duplicate, repeated_words(words), numbers, hashes, counts,
            signatures(words, _codes)]


def host_key(host: Column) -> Column:
    """Rows without host share one of their own."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, text_hash, counts of the text, its lines) of every row. A null text has no words."""
    return map_texts(docs, text, STATS, _measure, [
        F.col(doc_id).alias("doc_id"), host_key(F.col(host)).alias("host"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_hash")])


def frequent_lines(measured: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h) of the lines above the limits of their host."""
    lines = measured.select("host", "text_hash", F.explode(F.array_distinct("line_hash")).alias("h"))
    held = lines.groupBy("host", "h", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("on_host"))
    likely = small_side(held.filter(F.col("docs") >= min_docs).join(hosts, "host").filter(F.col("docs") >= min_share * F.col("on_host"))
                        .select("host", "h", "docs"))
    signed = measured.select("host", "signs", F.explode(F.array_distinct("line_hash")).alias("h")).join(likely.drop("docs"), ["host", "h"], "left_semi")
    different = (signed.select("host", "h", F.posexplode("signs").alias("place", "sign")).distinct()
                 .groupBy("host", "h").agg(F.count(F.lit(1)).alias("signs")))
    # The first text gives SIGNS minima, each further one as many of its own as the share of its own shingles.
    own = (1 + COPY) * (F.col("signs") - SIGNS) > (1 - COPY) * SIGNS * (F.col("docs") - 1)
    return likely.join(different, ["host", "h"]).filter(own).select("host", "h")


def line_cuts(measured: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, text_hash, removed_words, cut): what the limits remove from each text of each host; cut has line numbers."""
    frequent = small_side(frequent_lines(measured, min_docs, min_share))
    lines = measured.select("host", "text_hash", F.explode(F.arrays_zip("line_no", "line_hash", "line_words")).alias("l"))
    hit = lines.join(frequent, (lines["host"] == frequent["host"]) & (F.col("l.line_hash") == F.col("h")), "left_semi")
    # Rows with the same text have the same lines; each number counts once.
    once = hit.groupBy("host", "text_hash", F.col("l.line_no").alias("no")).agg(F.first("l.line_words").alias("words"))
    return once.groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"),
                                                 F.sort_array(F.collect_list("no")).alias("cut"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))


def depleted(min_words: int = MIN_WORDS, min_rest: float = MIN_REST) -> Column:
    rest = F.col("n_words") - F.col("removed_words")
    return (F.col("removed_words") > 0) & ((rest < min_words) | (rest < min_rest * F.col("n_words")))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per row of `docs`: counts, base_failed, removed_words, depleted, kept, with (host, text_hash, cut).

    A null or empty text has no words and fails the base rule. Repeated rows and equal texts get equal
    verdicts, and count once for the line limits of their host. A null host is a host of its own. An
    empty table gives an empty result. Other columns are not read.
    """
    measured = cut_lineage(measure(docs, doc_id, text, host))
    cuts = small_side(line_cuts(measured))
    return (measured.drop("line_no", "line_hash", "line_words", "signs").join(cuts, ["host", "text_hash"], "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
            .withColumn("base_failed", base_failed()).withColumn("depleted", depleted())
            .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, without their lines above the limit.

    A column n_chars is counted anew where lines went. Rows that share host and text are treated alike.
    """
    judged = judge(docs, doc_id, text, host)
    changed = small_side(judged.filter(~F.col("kept") | F.col("cut").isNotNull()).groupBy("host", "text_hash").agg(
        F.first("kept").alias("__kept"), F.first("cut").alias("__cut"))
        .withColumnsRenamed({"host": "__host", "text_hash": "__hash"}))
    joined = docs.join(changed, (host_key(F.col(host)) == F.col("__host")) &
                       (F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))) == F.col("__hash")), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col("__cut"), i.cast("long"))), "\n")
    kept = (joined.filter(F.coalesce(F.col("__kept"), F.lit(True)))
            .withColumn(text, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(rest)))
    if "n_chars" in docs.columns:
        fresh = F.length(F.col(text)).cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(fresh))
    return kept.select(*[F.col(c) for c in docs.columns])
