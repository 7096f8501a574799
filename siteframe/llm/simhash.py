"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked if at most `bits` bits differ. One of the two
halves then differs in at most bits // 2 bits. In each half the anchors are the
words of a covering code: the perfect Hamming code of 31 bits and one free bit,
covering radius 1. Two values that differ in t bits have a middle that is within
(t + 1) // 2 bits of both, and the anchor that covers the middle is within the
covering radius plus (t + 1) // 2 of both. Every fingerprint is handed to all
anchors within that distance (17 for a half when bits is 4) and compared there;
no link is lost. Replicating to the full covering radius plus threshold would
find the same links with ten times the rows.

A crowded anchor (more than CROWD members) is not compared pair by pair. Its
members are handed to all points within (bits + 1) // 2 bits instead: two of them
that meet at a point differ in at most `bits` bits if `bits` is even, and two that
are linked meet at their middle. Each is tied to the smallest at the point, so that
the rows grow with the members and not with their pairs.

Equal texts and equal fingerprints are one node. Links and components stay
distributed.

Four of 64 bits find few copies of a similarity near 0.8 (shingle sets, intersection over union): there a seventh of the
bits differs. `similar` therefore takes WIDE bits in blocks of 32 and covers each block by the same
code. Two texts meet if a block differs in at most 2 bits: of pairs with similarity 0.8, 0.85 and 0.9 some 0.87, 0.97 and 0.999 do so,
and texts that are linked through a third one need not. The distance over all bits then says which pairs are surely similar;
those within 2.5 deviations of the limit are compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from siteframe.core import cut_lineage, discard
from siteframe.llm.common import LOWER, map_texts, small_side
from siteframe.llm.graph import smallest_reachable

SEED = 42
COVERING_RADIUS = 1
CROWD = 64
_BLOCK = 1 << 15
#: Bits of a wide fingerprint, in blocks of 32, and those that may differ in a block that texts meet by.
WIDE, WIDE_BITS = 512, 2
#: Bits of two other blocks in which two texts that alone share an anchor may differ: chance 32, similarity 0.8 ten.
BESIDE = 22
#: Members that are compared together; PIVOTS of a larger anchor are members of all its parts, and what they leave apart meets all members.
TOGETHER, PIVOTS = 2048, 64


def _shingles(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, in pieces."""
    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(length + 1) - 1
    k = min(words, len(tokens))
    begin, end = (ends - length)[:len(tokens) - k + 1], ends[k - 1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(begin), _BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in
                        zip(begin[i:i + _BLOCK].tolist(), end[i:i + _BLOCK].tolist())], np.uint64)


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for part in _shingles(text, words):
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def wide_fingerprint(text: bytes | None, words: int = 5) -> np.ndarray:
    """WIDE bits as 32-bit numbers: those set in over half of the shingles, whose hashes are stretched to as many bits."""
    ones, n = np.zeros(WIDE, np.int64), 0
    steps = (np.arange(WIDE // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for part in _shingles(text, words):
        for i in range(0, len(part), 4096):
            x = part[i:i + 4096, None] + steps
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)
            for j in range(0, len(bits), 255):
                ones += bits[j:j + 255].sum(axis=0, dtype=np.uint8)
        n += len(part)
    return np.packbits(2 * ones > n).view(np.int32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row. A null or empty text has the fingerprint zero."""
    schema = StructType([StructField("fp", LongType())])
    return map_texts(docs, text, schema, lambda texts: [[fingerprint(t, words) for t in texts]],
                     [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")])


def anchor_masks(spark: SparkSession, reach: int) -> DataFrame:
    """(syndrome, mask): XOR with these masks gives the anchors within `reach` of a half with that syndrome.

    Bits 0 to 30 are the positions 1 to 31 of the Hamming code, bit 31 is free.
    """
    rows = []
    for weight in range(reach + 1):
        for bits in combinations(range(32), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= (b + 1) % 32
            rows.append((syndrome, sum(1 << b for b in bits)))
    return spark.createDataFrame(rows, "syndrome int, mask long")


def _syndrome(half: Column) -> Column:
    """XOR of the positions whose bit is set: five parities."""
    parts = None
    for b in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)
        parity = F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask))) % 2, b)
        parts = parity if parts is None else parts.bitwiseOR(parity)
    return parts.cast("int")


def at_anchors(nodes: DataFrame, bits: int) -> DataFrame:
    """(anchor, fp): every fingerprint at all anchors of both halves within its reach."""
    reach = COVERING_RADIUS + (bits // 2 + 1) // 2
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = nodes.select("fp", F.explode(F.array(
        F.struct(low.alias("v"), F.lit(0).cast("long").alias("side")),
        F.struct(high.alias("v"), F.lit(1 << 32).cast("long").alias("side")))).alias("h"))
    keyed = halves.select("fp", "h.v", "h.side", _syndrome(F.col("h.v")).alias("syndrome"))
    masks = F.broadcast(anchor_masks(nodes.sparkSession, reach))
    return keyed.join(masks, "syndrome").select(
        F.col("v").bitwiseXOR(F.col("mask")).bitwiseOR(F.col("side")).alias("anchor"), "fp")


def _points(members: DataFrame, radius: int) -> DataFrame:
    """(point, fp): every fingerprint at all 64-bit points within `radius` bits."""
    one = F.lit(1).cast("long")
    out = members.select("fp", F.col("fp").alias("point"), F.lit(-1).alias("last"))
    for _ in range(radius):
        flip = F.expr("transform(sequence(last + 1, 64), b -> b)")
        out = (out.withColumn("b", F.explode(flip))
               .withColumn("point", F.when(F.col("b") == 64, F.col("point")).otherwise(
                   F.col("point").bitwiseXOR(F.call_function("shiftleft", one, F.col("b")))))
               .withColumn("last", F.least(F.col("b"), F.lit(63))).drop("b"))
    return out.select("point", "fp")


def at_blocks(nodes: DataFrame) -> DataFrame:
    """(anchor, node, beside): every wide fingerprint (node, blocks) at all anchors of its blocks within reach, with the two blocks after that block."""
    masks = F.broadcast(anchor_masks(nodes.sparkSession, COVERING_RADIUS + (WIDE_BITS + 1) // 2))
    low = lambda i: F.get("blocks", i % (WIDE // 32)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    each = nodes.select("node", "blocks", F.explode(F.sequence(F.lit(0), F.lit(WIDE // 32 - 1))).alias("side")).select(
        "node", low(F.col("side")).alias("v"), F.shiftleft(F.col("side").cast("long"), 32).alias("side"),
        F.shiftleft(low(F.col("side") + 1), 32).bitwiseOR(low(F.col("side") + 2)).alias("beside"))
    return each.withColumn("syndrome", _syndrome(F.col("v"))).join(masks, "syndrome").select(
        F.col("v").bitwiseXOR(F.col("mask")).bitwiseOR(F.col("side")).alias("anchor"), "node", "beside")


def distances(similarity: float) -> tuple[int, int]:
    """Bits within which wide fingerprints are surely that similar, and beyond which they surely are not."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    spread = 2.5 * sqrt(WIDE * share * (1 - share))
    return int(WIDE * share - spread), int(WIDE * share + spread)


def tie(prints: np.ndarray, sure: int, most: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of rows that are surely similar, as many as connect them, and the nearest pairs of what they leave apart, within `most`.

    A row that is tied is not compared again, so that a group of copies costs little more than its number.
    """
    apart = lambda i, others: np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int64)
    of, rest, tied = np.full(len(prints), -1), np.arange(len(prints)), []
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        of[first] = first
        front = [first]
        while front and len(rest):
            i = front.pop()
            near = apart(i, rest) <= sure
            found, rest = rest[near].tolist(), rest[~near]
            of[found] = first
            tied += [(i, j) for j in found]
            front += found
    names, sizes = np.unique(of, return_counts=True)
    nearest: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in np.nonzero(of != names[np.argmax(sizes)])[0].tolist() if len(names) > 1 else ():
        away = apart(i, slice(None))
        for j in np.nonzero((away <= most) & (of != of[i]))[0].tolist():
            key = (min(of[i], of[j]), max(of[i], of[j]))
            nearest[key] = min(nearest.get(key, (WIDE + 1, 0, 0)), (int(away[j]), i, j))
    return tied, [(i, j) for _, i, j in nearest.values()]


def _tie_groups(sure: int, most: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, bool]] = []
            for members in batch.column(0):
                # Columns of the list of structs; members of a group are told by their order.
                rows = members.values
                nodes = rows.field("node").to_pylist()
                prints = np.array(rows.field("blocks").to_pylist(), np.int32).reshape(len(nodes), -1).view(np.uint64)
                for pairs, certain in zip(tie(prints, sure, most), (True, False), strict=True):
                    found += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), certain) for i, j in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True) if found else ([], [], []), schema, strict=True)],
                                             schema=schema)

    return run


def _tied(sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure): what `tie` finds in each of the sets of nodes (of, node), as a written table."""
    groups = (sets.join(nodes.select("node", "blocks"), "node").groupBy("of")
              .agg(F.collect_list(F.struct("node", "blocks")).alias("members")).select("members"))
    return cut_lineage(groups.mapInArrow(_tie_groups(*distances(similarity)), "a long, b long, sure boolean"))


def _sets(dealt: DataFrame, by: list[str]) -> DataFrame:
    """(of, node): the different sets of two or more nodes, as a written table."""
    sets = dealt.groupBy(*by).agg(F.sort_array(F.collect_set("node")).alias("nodes")).select("nodes").filter(F.size("nodes") > 1).distinct()
    return cut_lineage(sets.select(F.xxhash64("nodes").alias("of"), F.explode("nodes").alias("node")))


def _rest(crowd: DataFrame, pairs: DataFrame) -> DataFrame:
    """(anchor, part, slice, node): sets in which the members of crowds (anchor, node, parts) that `pairs` leave apart meet all others.

    What surely hangs together with the largest piece of a crowd need not meet again. Each slice of the other members, of
    bounded size, meets each part of the crowd.
    """
    roots = smallest_reachable(pairs.filter("sure").select("a", "b"))
    named = cut_lineage(crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    pieces = named.groupBy("anchor", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = pieces.groupBy("anchor").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("n"), F.max("size").alias("size"))
    slices = F.ceil((F.col("n") - F.col("size")) / TOGETHER).cast("int")
    open_ = named.join(largest.filter("n > size").select("anchor", "main", slices.alias("slices")), "anchor")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    turn = lambda c: F.pmod(F.xxhash64("anchor", "node"), F.col(c)).cast("int")
    members = open_.withColumn("part", turn("parts")).withColumn("slice", every("slices"))
    apart = open_.filter("root <> main").withColumn("slice", turn("slices")).withColumn("part", every("parts"))
    by = ["anchor", "part", "slice", "node"]
    return members.select(*by).unionByName(apart.select(*by))


def similar_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure): pairs of the wide fingerprints (node, blocks) that meet at an anchor and may be that similar."""
    placed = at_blocks(nodes).repartition("anchor")
    # Unrelated texts that alone share an anchor by chance differ in half of the bits beside it; they go no further.
    shared = (placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("beside").alias("apart"))
              .filter((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count("apart") <= BESIDE))).select("anchor", "n"))
    parts = F.ceil(F.col("n") / TOGETHER).cast("int")
    members = cut_lineage(placed.drop("beside").join(shared, "anchor").withColumn("parts", parts))
    turn = F.xxhash64("anchor", "node")
    own = members.withColumn("part", F.pmod(turn, F.col("parts")).cast("int"))
    # Members of a crowd are dealt out to parts of bounded size; the pivots, drawn by their hash, are in each of them.
    pivots = (members.filter("parts > 1").filter(F.pmod(F.xxhash64("node", "anchor"), F.col("n")) < PIVOTS)
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    listed = _sets(own.unionByName(pivots.select(*own.columns)), ["anchor", "part"])
    pairs = _tied(listed, nodes, similarity)
    discard(listed)
    crowd = members.filter("parts > 1").select("anchor", "node", "parts")
    if not crowd.isEmpty():
        listed = _sets(_rest(crowd, pairs), ["anchor", "part", "slice"])
        pairs = pairs.unionByName(_tied(listed, nodes, similarity))
        discard(listed)
    discard(members)
    return pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component, component_id) of every row; links join texts of at least that similarity.

    Similarity is that of the sets of word shingles (fewer words: the whole sequence), A-Z in lower case. Nulls, texts without words, repeated
    rows, null ids and empty tables are treated as by `components`.
    """
    schema = StructType([StructField("blocks", ArrayType(IntegerType()))])
    found = cut_lineage(map_texts(docs, text, schema, lambda texts: [[wide_fingerprint(t, words) for t in texts]],
                                  [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")])
                        .withColumn("node", F.xxhash64("blocks")))
    nodes = cut_lineage(found.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"),
                                                  F.first("blocks").alias("blocks")))
    links = cut_lineage(similar_links(nodes, similarity))
    doubt = links.filter("not sure").select("a", "b")
    asked = small_side(doubt.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "text_hash"))
    texts = (docs.select(F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("__words")).join(asked, "text_hash")
             .dropDuplicates(["node"]))
    sets = cut_lineage(map_texts(texts, "__words", StructType([StructField("hashes", ArrayType(LongType()))]), lambda rows: [[
        np.unique(np.concatenate([*_shingles(t, words), np.zeros(0, np.uint64)])).view(np.int64) for t in rows]], [F.col("node")]))
    side = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"{name}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    checked = (doubt.join(side("a"), "a").join(side("b"), "b")
               .filter(both >= similarity * (F.size("a_set") + F.size("b_set") - both)).select("a", "b"))
    roots = smallest_reachable(links.filter("sure").select("a", "b").unionByName(checked)).withColumnRenamed("root", "component")
    named = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    every = cut_lineage(named.join(firsts, "component").select("node", "component", "component_id"))
    for table in (nodes, links, sets):
        discard(table)
    return found.join(every, "node").select("doc_id", "text_hash", "component", "component_id")


def _compare(bits: int):
    """Compares the members of each anchor; of the links between them, so many are given as keep them connected."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for fps in batch.column(0).to_pylist():
                fps.sort()
                values = np.array(fps, np.int64).view(np.uint64)
                near = np.bitwise_count(values[:, None] ^ values[None]) <= bits
                group = np.arange(len(fps))
                for i, j in np.argwhere(np.triu(near, 1)):
                    if group[i] != group[j]:
                        group[group == group[j]] = group[i]
                        found.append((fps[i], fps[j]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=schema)

    return run


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) with a < b: links that connect all fingerprints which differ in at most `bits` bits.

    Of the links at an anchor, and of those of a crowd, so many are given as keep what is linked connected.
    """
    if bits % 2 or not 0 <= bits <= 6:
        raise ValueError("bits is an even number up to 6")
    placed = at_anchors(nodes, bits).repartition("anchor")
    shared = placed.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(placed.join(shared, "anchor"))
    few = members.filter(F.col("n") <= CROWD).groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    pairs = few.select("fps").mapInArrow(_compare(bits), "a long, b long")
    crowd = members.filter(F.col("n") > CROWD).select("fp").distinct()
    met = _points(crowd, bits // 2).withColumn("a", F.min("fp").over(Window.partitionBy("point")))
    stars = met.filter("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4,
               bits: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of every row.

    component is the smallest fingerprint reachable over links, component_id the smallest doc_id.
    Texts without words share the fingerprint zero and are linked. Rows that repeat a doc_id
    each keep their row. A null doc_id is never the smallest; the component_id of rows that all
    lack one is null. An empty table gives an empty result. Other columns are not read.
    """
    found = cut_lineage(fingerprints(docs, doc_id, text, words))
    nodes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = smallest_reachable(links(nodes, bits)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp")
    firsts = named.groupBy("root").agg(F.min("first").alias("over"))
    moved = small_side(named.select("fp", "root").join(firsts, "root"))
    every = nodes.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("component"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("over")).alias("component_id"))
    return found.join(every, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5,
                similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, one of each component of similar texts: that with the smallest doc_id.

    Of rows that share this doc_id, that with the smallest hash of its text stays, and of rows
    that share this as well, the first in the order of the other columns. Rows without doc_id
    stay only where nothing in their component has one.
    """
    each = cut_lineage(similar(docs, doc_id, text, words, similarity).groupBy("component", "component_id", "doc_id", "text_hash")
                       .agg(F.count(F.lit(1)).alias("n")))
    # Only rows with the smallest doc_id are compared: one or a few of each component, however large it is.
    is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = each.filter(is_first)
    best = cut_lineage(first.groupBy("component").agg(F.min(F.struct("text_hash", "n", "doc_id")).alias("b")).select("component", "b.*"))
    more = first.join(best.select("component", "text_hash"), ["component", "text_hash"], "left_anti")
    named = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    of_row = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    gone = small_side(each.filter(~is_first).select(*named).unionByName(more.select(*named)))
    kept = docs.join(gone, of_row, "left_anti")
    repeated = best.filter("n > 1").select(*named)
    if repeated.isEmpty():
        return kept
    repeated = small_side(repeated)
    order = Window.partitionBy(doc_id, F.xxhash64(F.col(text))).orderBy(
        *[F.to_json(F.struct(F.col(c))) for c in docs.columns if c not in (doc_id, text)] or [F.col(doc_id)])
    once = (kept.join(repeated, of_row, "left_semi").withColumn("__row", F.row_number().over(order))
            .filter(F.col("__row") == 1).drop("__row"))
    return kept.join(repeated, of_row, "left_anti").unionByName(once)
