"""Ranked lexical search over bit-sliced Bloom signatures.

A block holds documents of similar size. Its signature has one slice for each bit position: a bitmap of the documents, one bit
a document. A term sets a few bits of its document, and more of them for each power of two that its occurrences
reach (tiers), so that the AND of the slices of a term and tier shows at least the documents in which it occurs so often. The
slices, weighted and summed, bound the score of every document from above. The best bounds are rescored from their texts, which gives each
item a score that its last rank has at least; every document whose bound reaches it is rescored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType

from siteframe.core import cut_lineage, discard
from siteframe.llm.common import BATCH_ROWS, lower_az, prepare, text_chunks

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Bits that a term and tier sets, signature bits for each of them, and bits of a block.
HASHES, ROOM, BLOCK_BITS = 4, 16, 1 << 26
#: Documents of a block at most.
BLOCK_DOCS = 4096
#: Different terms of the items that are searched together.
PART_TERMS = 200_000
#: Terms whose hashes a worker remembers.
REMEMBERED = 1 << 18


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, lower-cased."""
    return text.translate(_TERMS).split() if text else []


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term)
        return value


def positions(hashes: np.ndarray, tiers: np.ndarray, bits: int) -> np.ndarray:
    """Slices of each pair of term and tier, HASHES each; `bits` is a power of two."""
    z = hashes + tiers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    first, step = z >> np.uint64(32), (z & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((first[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What `tf` occurrences in a document of length factor `m` count, in millionths."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factor(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    return 75 + (25 * n * documents) // all_terms


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Block:
    """Signature of the documents of one size class while it is filled."""

    def __init__(self, size: int) -> None:
        self.bits = ROOM << size
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BITS // self.bits))
        self.slices = np.zeros((self.bits, self.room // 8), np.uint8)
        self.docs, self.n, self.most = [], [], []

    def add(self, doc, n: int, most: int, hashes: np.ndarray, tiers: np.ndarray) -> bool:
        at = len(self.docs)
        self.slices[positions(hashes, tiers, self.bits).ravel(), at >> 3] |= np.uint8(128 >> (at & 7))
        self.docs.append(doc)
        self.n.append(n)
        self.most.append(most)
        return len(self.docs) == self.room

    def row(self) -> tuple:
        used = -(-len(self.docs) // 8)
        return self.bits, self.docs, self.n, self.most, np.ascontiguousarray(self.slices[:, :used]).tobytes(), None, None


def _index(watched: frozenset, signatures: bool, doc_type: pa.DataType):
    """Blocks of a partition, and one row with the documents of each watched term."""
    types = [pa.int64(), pa.list_(doc_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(("bits", "docs", "n", "most", "slices", "terms", "df"), types)))

    def batch(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, blocks, df = _Hashes(), {}, Counter()
        for piece, texts in text_chunks(batches):
            for doc, text in zip(piece.column(0).to_pylist(), texts):
                terms = terms_of(text)
                if not terms:
                    continue
                counts = Counter(terms)
                df.update(watched & counts.keys())
                if not signatures:
                    continue
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
                tiers = np.frexp(tf)[1]
                entries = int(tiers.sum())
                size = max(4, (entries - 1).bit_length())
                place = np.repeat(np.arange(len(tf)), tiers)
                tier = np.arange(entries) - np.repeat(np.cumsum(tiers) - tiers, tiers)
                block = blocks.get(size) or blocks.setdefault(size, _Block(size))
                if block.add(doc, len(terms), int(tf.max()), hashes[place], tier):
                    yield batch(blocks.pop(size).row())
        for size in sorted(blocks):
            yield batch(blocks[size].row())
        if df:
            yield batch((None, None, None, None, None, list(df), list(df.values())))

    return run


class Items:
    """Items that are searched together: their terms with weights and repeats, in lists one after another."""

    def __init__(self, rows: list[tuple[int, bytes, int]], df: dict[bytes, int], documents: int, all_terms: int) -> None:
        self.documents, self.all_terms = documents, all_terms
        held = sorted((i, t, c) for i, t, c in rows if df.get(t))
        self.terms = sorted({t for _, t, _ in held})
        number = {t: k for k, t in enumerate(self.terms)}
        self.names = sorted({i for i, _, _ in held})
        place = {i: k for k, i in enumerate(self.names)}
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.terms], np.uint64)
        self.item = np.array([place[i] for i, _, _ in held], np.int64)
        self.term = np.array([number[t] for _, t, _ in held], np.int64)
        self.weight = np.array([c * weight(documents, df[t]) for _, t, c in held], np.int64)
        self.upto = np.searchsorted(self.item, np.arange(len(self.names) + 1))

    def lookup(self) -> dict[int, dict[bytes, int]]:
        out: dict[int, dict[bytes, int]] = {i: {} for i in self.names}
        for i, t, w in zip(self.item.tolist(), self.term.tolist(), self.weight.tolist()):
            out[self.names[i]][self.terms[t]] = w
        return out


def bounds(items: Items, bits: int, n: np.ndarray, most: np.ndarray, slices: bytes) -> np.ndarray:
    """Upper bounds of the scores, items by documents.

    The slices of a tier add, for each term, what the occurrences that the tier allows count more than those of the tier below.
    """
    s = np.frombuffer(slices, np.uint8).reshape(bits, -1)
    m = length_factor(n, items.documents, items.all_terms)
    out = np.zeros((len(items.names), len(n)), np.int64)
    before = np.zeros(len(n), np.int64)
    for tier in range(int(most.max()).bit_length()):
        upper = saturation(np.minimum((2 << tier) - 1, most), m)
        where = positions(items.hashes, np.full(len(items.hashes), tier), bits)
        packed = s[where[:, 0]]
        for h in range(1, HASHES):
            packed &= s[where[:, h]]
        present = np.nonzero(packed.any(1))[0]
        if len(present):
            number = np.full(len(items.terms), -1, np.int64)
            number[present] = np.arange(len(present))
            shown = np.unpackbits(packed[present], axis=1)[:, :len(n)].astype(np.float64)
            used = number[items.term]
            for i in range(len(items.names)):
                own = slice(items.upto[i], items.upto[i + 1])
                ok = used[own] >= 0
                if ok.any():
                    # Sums of whole numbers below 2 ** 53 are exact.
                    out[i] += (items.weight[own][ok].astype(np.float64) @ shown[used[own][ok]]).astype(np.int64) * (upper - before)
        before = upper
    return out


def _bound_pieces(batches: Iterable[pa.RecordBatch], items: Items) -> Iterator[tuple[list, np.ndarray]]:
    """Documents and their bounds, a few hundred documents at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            bits, docs, n, most, slices = (batch.column(c)[i].as_py() for c in range(5))
            n, most = np.array(n, np.int64), np.array(most, np.int64)
            width = -(-len(docs) // 8)
            grid = np.frombuffer(slices, np.uint8).reshape(bits, width)
            for a in range(0, len(docs), 512):
                part = np.ascontiguousarray(grid[:, a // 8:a // 8 + 64]) if width > 64 else grid
                yield docs[a:a + 512], bounds(items, bits, n[a:a + 512], most[a:a + 512], part)


def _best_bounds(shared, k: int, doc_type: pa.DataType):
    """The documents of the `k` largest bounds of each item, over the blocks of a partition."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = shared.value, {}
        for docs, upper in _bound_pieces(batches, items):
            for i, row in enumerate(upper):
                top = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                found = [(int(row[j]), docs[j]) for j in top if row[j] > 0]
                best[i] = sorted(best.get(i, []) + found, key=lambda f: -f[0])[:k]
        rows = [(items.names[i], doc, upper) for i, found in best.items() for upper, doc in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), doc_type, pa.int64()))],
                                         ["item", "doc", "upper"])
    return run


def _not_excluded(shared, limits, doc_type: pa.DataType):
    """(doc, items): documents with the items whose limit their bound reaches."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        least = np.array([max(1, limits.value.get(i, 1)) for i in items.names], np.int64)
        names = np.array(items.names, np.int64)
        for docs, upper in _bound_pieces(batches, items):
            reach = upper >= least[:, None]
            rows = [(docs[j], names[reach[:, j]]) for j in np.nonzero(reach.any(0))[0]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], doc_type), pa.array([w for _, w in rows], pa.list_(pa.int64()))], ["doc", "items"])
    return run


def _rescore(shared, doc_type: pa.DataType):
    """Exact scores of the documents for the items they are given with."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        lookup = items.lookup()
        for piece, texts in text_chunks(batches):
            rows = []
            for doc, wanted, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts):
                terms = terms_of(text)
                if not terms:
                    continue
                counts, m = Counter(terms), 75 + (25 * len(terms) * items.documents) // items.all_terms
                for item in wanted:
                    own = lookup[item]
                    score = sum(own[t] * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in own.keys() & counts.keys())
                    if score > 0:
                        rows.append((item, doc, score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), doc_type, pa.int64()))], ["item", "doc", "score"])
    return run


def item_terms(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, term, times): the terms of every item with their repeats; `item` is a number for the id."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("t")).distinct()
    terms = rows.select("item_id", F.explode(F.regexp_extract_all(lower_az(F.coalesce("t", F.lit(""))), F.lit(PATTERN), 0)).alias("term"))
    return terms.groupBy(F.xxhash64(F.col("item_id").cast("string")).alias("item"), "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def rank(docs: DataFrame, benchmark: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", part_terms: int = PART_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` documents of highest score above zero for each item, equal scores by ascending id.

    Null and empty texts have no terms and no rank. Rows of one document id are ranked each on its own; documents
    without id come last among equals. Equal rows of the benchmark count once, different texts of one item id make one item. Items
    without a term that some document has, and empty tables, give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind: DataType = docs.schema[doc_id].dataType
    doc_type, name = to_arrow_type(kind), kind.simpleString()
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("__text"))
    asked = cut_lineage(item_terms(benchmark, item_id, item_text))
    parts = max(1, -(-asked.count() // part_terms))
    signatures, answers = None, None
    for part in range(parts):
        rows = [(r["item"], r["term"].encode(), r["times"]) for r in asked.filter(F.pmod("item", F.lit(parts)) == part).select("item", "term", "times").collect()]
        watched = frozenset(t for _, t, _ in rows)
        made = source.mapInArrow(_index(watched, signatures is None, doc_type),
                                 f"bits long, docs array<{name}>, n array<long>, most array<long>, slices binary, terms array<binary>, df array<long>")
        made = cut_lineage(made)
        if signatures is None:
            signatures = made
            one = made.agg(F.sum(F.size(F.coalesce("n", F.array().cast("array<long>")))).alias("d"),
                           F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("t")).first()
            documents, all_terms = one["d"] or 0, one["t"] or 0
        counts = made.filter("terms is not null").select(F.explode(F.map_from_arrays("terms", "df")).alias("term", "df"))
        df = {bytes(r["term"]): r["df"] for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        if not df:
            continue
        answers_part = _search(spark, source, signatures, Items(rows, df, documents, all_terms), k, doc_type, name)
        answers = answers_part if answers is None else answers.unionByName(answers_part)
    if answers is None:
        return spark.createDataFrame([], f"item_id {benchmark.schema[item_id].dataType.simpleString()}, rank int, doc_id {name}, score long")
    names = asked.select("item", "item_id").distinct()
    return answers.join(names, "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def _search(spark, source: DataFrame, signatures: DataFrame, items: Items, k: int, doc_type: pa.DataType, name: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)
    blocks = signatures.filter("slices is not null").select("bits", "docs", "n", "most", "slices")
    by_bound = Window.partitionBy("item").orderBy(F.desc("upper"), F.asc("doc"))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))

    def scores(wanted: DataFrame) -> DataFrame:
        few = cut_lineage(wanted)
        found = source.join(few.withColumnRenamed("doc", "__doc"), F.col("doc").eqNullSafe(F.col("__doc")))
        return found.select("doc", "items", "__text").mapInArrow(_rescore(shared, doc_type), f"item long, doc {name}, score long")

    best = blocks.mapInArrow(_best_bounds(shared, k, doc_type), f"item long, doc {name}, upper long")
    best = best.withColumn("place", F.row_number().over(by_bound)).filter(F.col("place") <= k)
    first = scores(best.groupBy("doc").agg(F.collect_set("item").alias("items")))
    first = first.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k)
    limits = {r["item"]: r["score"] for r in first.select("item", "score").collect()}
    reach = blocks.mapInArrow(_not_excluded(shared, spark.sparkContext.broadcast(limits), doc_type), f"doc {name}, items array<long>")
    pairs = reach.select("doc", F.explode("items").alias("item")).distinct()
    exact = scores(pairs.groupBy("doc").agg(F.collect_list("item").alias("items")))
    ranked = exact.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return cut_lineage(ranked.select("item", "rank", "doc", "score"))
