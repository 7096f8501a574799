"""Benchmark decontamination with a broadcast hash set of test n-grams.

The windows of the test items (13 words, or the whole item if it is shorter) become keys of a hash table,
a key being the exact sequence of word numbers, so that a hit needs no further verification. The table is broadcast; a
scan maps the words of a document to numbers, skips to the runs of words that items know, and looks
up the windows there. Items are put into tables of at most `part_words` words; if there is more than one
table, each is broadcast for a scan of its own over the distinct texts and the hits of a text are united. The table
size is thus bounded whatever the number of items.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from siteframe.core import cut_lineage
from siteframe.llm.common import lower_az, map_texts, small_side

WINDOW = 13
#: Words of one broadcast table.
PART_WORDS = 1_000_000
#: A document is contaminated if so many times its hit words reach its words.
MIN_SHARE = 20

# Bytes of words: digits, lower-case letters and all of a code point from U+0080 on; anything else separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Windows:
    """Hash table of the windows of test items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, tuple[str, ...]]] = {}
        found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)], np.int32)
            length = min(size, len(ids))
            for i in range(len(ids) - length + 1 if length else 0):
                found[length][ids[i:i + length].tobytes()].add(item)
        self.items = {n: {k: tuple(sorted(v)) for k, v in w.items()} for n, w in sorted(found.items())}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [begin, end) of the words that are hit, in order and apart, and the items found."""
        known = self.numbers.get
        ids = np.fromiter((known(w, -1) for w in words), np.int32, len(words))
        unknown = np.concatenate(([-1], np.nonzero(ids < 0)[0], [len(ids)]))
        gaps = np.diff(unknown) - 1
        hit, items = [], set()
        for length, table in self.items.items():
            for at in np.nonzero(gaps >= length)[0]:
                first, last = int(unknown[at]) + 1, int(unknown[at + 1])
                raw = ids[first:last].tobytes()
                for i in range(last - first - length + 1):
                    names = table.get(raw[4 * i:4 * (i + length)])
                    if names:
                        hit.append((first + i, first + i + length))
                        items.update(names)
        return union(hit), items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(ArrayType(IntegerType()))),
                   StructField("items", ArrayType(StringType()))])


def _count(text: Column) -> Column:
    return F.regexp_count(lower_az(F.coalesce(text, F.lit(""))), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")).cast("long")


def _parts(benchmark: DataFrame, item_id: str, text: str, part_words: int) -> list[int]:
    """Number of tables that the items need; an item is in one."""
    words = F.coalesce(F.sum(_count(F.col(text))), F.lit(0))
    total = benchmark.agg(words.alias("w")).first()["w"]
    return list(range(max(1, -(-total // max(1, part_words // 2)))))


def _table(benchmark: DataFrame, item_id: str, text: str, part: int, parts: int, size: int) -> Windows:
    rows = (benchmark.filter(F.pmod(F.xxhash64(F.col(item_id), F.col(text)), F.lit(parts)) == part)
            .filter(F.col(text).isNotNull())
            .select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).collect())
    return Windows([(r["i"], _lower(r["t"])) for r in rows], size)


def _lower(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _scan(docs: DataFrame, text: str, windows: Windows, keep: list[Column]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(texts: list) -> list:
        counts, spans, items = [], [], []
        for t in texts:
            words = words_of(t)
            hit, found = shared.value.scan(words)
            counts.append(len(words))
            spans.append([list(s) for s in hit])
            items.append(sorted(found))
        return [counts, spans, items]

    return map_texts(docs, text, HITS, run, keep)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[Column], text: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The columns `keep` with n_words, spans (word ranges that are hit), items (ids found, sorted) for every row.

    A null text has no words; null items and those without words have no window; an item without id is
    listed as an empty string. Repeated items count once by id, repeated rows each get their result. Empty tables give
    an empty result or no hits.
    """
    parts = _parts(benchmark, item_id, item_text, part_words)
    if len(parts) == 1:
        return _scan(docs, text, _table(benchmark, item_id, item_text, 0, 1, size), keep)
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = cut_lineage(docs.select(key.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["key"]))
    found = None
    for part in parts:
        windows = _table(benchmark, item_id, item_text, part, len(parts), size)
        one = cut_lineage(_scan(texts, "t", windows, [F.col("key").alias("key")]).filter(F.size("items") > 0))
        found = one if found is None else found.unionByName(one)
    # A text has at most as many rows here as there are tables.
    lists = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merge = F.udf(lambda spans: [list(s) for s in union([tuple(s) for s in spans])], ArrayType(ArrayType(IntegerType())))
    lists = lists.withColumn("spans", merge("spans"))
    rows = docs.select(*keep, key.alias("__key"), _count(F.col(text)).alias("n_words"))
    joined = rows.join(small_side(lists.withColumnRenamed("key", "__k")), F.col("__key") == F.col("__k"), "left")
    return joined.drop("__key", "__k").withColumns({
        "spans": F.coalesce("spans", F.array().cast("array<array<int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(n_words: Column, hit: Column) -> Column:
    return (hit > 0) & (MIN_SHARE * hit >= n_words)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row."""
    found = find(docs, benchmark, [F.col(doc_id).alias("doc_id")], **names)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), "items",
                        contaminated(F.col("n_words"), n_hit()).alias("contaminated"), "spans")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **names) -> DataFrame:
    """The rows of `docs` without contamination.

    remove="documents" drops contaminated documents and leaves the others as they are; "spans" keeps
    every document and cuts the words that are hit, with what separates them, out of its text.
    """
    columns = docs.columns
    row = F.struct(*[F.col(c) for c in columns]).alias("__row")
    found = find(docs, benchmark, [row], text=text, **names)
    if remove == "documents":
        found = found.filter(~contaminated(F.col("n_words"), n_hit()))
        return found.select(*[F.col("__row")[c].alias(c) for c in columns])
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    cut = F.udf(cut_spans, StringType())
    value = F.when(F.size("spans") > 0, cut(F.col("__row")[text], "spans")).otherwise(F.col("__row")[text])
    return found.select(*[(value if c == text else F.col("__row")[c]).alias(c) for c in columns])


def cut_spans(text: str | None, spans: list[list[int]]) -> str | None:
    """A text without the words in `spans`, each span cut from its first word to the word behind it."""
    if not text:
        return text
    raw = text.encode("utf-8")
    plain, begin, at = raw.translate(_WORDS), [], 0
    for word in plain.split():
        at = plain.index(word, at)
        begin.append(at)
        at += len(word)
    begin.append(len(raw))
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:begin[a]])
        last = begin[b]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")
