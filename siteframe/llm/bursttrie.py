"""Prefix trie of conversations, built as a burst trie.

A turn is known by a 128-bit id. Equal conversations are one sequence of ids with a count. All sequences start in the
container of the root. A container that is too large bursts: its head becomes a node, and the next turn id of each sequence names the container
in which the rest of it, its suffix, goes on. What remains are containers of bounded size; each is sorted, and one sweep over its
sorted suffixes opens and closes nodes on a stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, discard
from siteframe.llm.common import prepare, small_side

#: A container bursts if it has more turns, and more different suffixes.
CONTAINER_TURNS, CONTAINER_SUFFIXES = 2048, 64
#: A digest lists the members of a node in pieces; a piece covers so many numbers.
PIECE = 1024


def _id(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns) of every conversation; turns are (id, n), n the code points of the text, in order.

    Null roles and texts are empty, a null turn number comes first, and rows of the same number go by the id of
    their turn. Repeated rows are turns of their own. Rows without conversation belong to none.
    """
    said, words = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("at"),
                        _id(F.length(said).cast("string"), F.lit(":"), said, words).alias("id"), F.length(words).alias("n"))
    rows = rows.filter(F.col("conv").isNotNull())
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "id", "n"))).alias("turns")).select(
        "conv", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations (conv, turns) that begin with the first h turns of conversation conv - conv % every and go on with
    their own turns after their first h; h is the CRC-32 of the decimal conv modulo `most`."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("int")
    firsts = conversations.filter(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("first"))
    joined = conversations.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % every}).join(firsts, "base", "left")
    begin = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv", F.concat(begin, rest).alias("turns"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of keys whose pieces come one after another, in order; holds one piece."""
    at, digest = None, None
    for batch in batches:
        keys, done = batch.column(0).to_pylist(), []
        for key, text in zip(keys, batch.column(1).to_pylist()):
            if key != at:
                if at is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "ends"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends"])


def _members(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, lens, n, conv, ends) of every different sequence: its turns, its number of conversations, the smallest of
    them and the digest of all of them; and the table of pieces behind it."""
    ids, lens = F.transform("turns", lambda t: t["id"]), F.transform("turns", lambda t: t["n"])
    key = F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""), 256))
    rows = conversations.select(key.alias("key"), "conv", ids.alias("ids"), lens.alias("lens"), F.floor(F.col("conv") / PIECE).alias("piece"))
    pieces = rows.groupBy("key", "piece").agg(F.sort_array(F.collect_list("conv")).alias("convs"), F.first("ids").alias("ids"), F.first("lens").alias("lens"))
    pieces = cut_lineage(pieces.select("key", "piece", "ids", "lens", F.size("convs").cast("long").alias("n"), F.col("convs")[0].alias("conv"),
                                       F.array_join(F.col("convs").cast("array<string>"), ",").alias("text")))
    one = pieces.groupBy("key").agg(F.first("ids").alias("ids"), F.first("lens").alias("lens"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
                                    F.count(F.lit(1)).alias("pieces"), F.min("text").alias("text"))
    many = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    streams = pieces.select("key", "text", "piece").join(many, "key", "left_semi").repartition("key").sortWithinPartitions("key", "piece")
    digests = streams.select("key", "text").mapInArrow(_digests, "key binary, ends string")
    return one.join(small_side(digests), "key", "left").select(
        "ids", "lens", "n", "conv", F.coalesce("ends", F.sha2("text", 256)).alias("ends")), pieces


SWEPT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, path array<binary>")
ARROW = pa.schema([(c.split()[0], pa.list_(pa.binary()) if "array" in c else pa.string() if "string" in c else pa.int64()) for c in SWEPT.split(", ")])
#: Digest of the node at which no conversation ends.
NOBODY = hashlib.sha256(b"").hexdigest()


class _Node:
    __slots__ = ("depth", "conv", "n", "chars", "ends", "children", "leaves", "saved")

    def __init__(self, depth: int, chars: int) -> None:
        self.depth, self.chars = depth, chars
        self.conv, self.n, self.ends, self.children, self.leaves, self.saved = None, 0, NOBODY, [], 0, 0

    def meet(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n

    def row(self, parent: int | None, path: list | None = None) -> tuple:
        return (self.conv, self.depth, parent, self.n, len(self.children), self.leaves, self.saved, self.ends, path)


def _close(stack: list[_Node], out: list[tuple]) -> None:
    """Finish the node on top: its children are written, for they know their parent now, and it joins its own parent."""
    node = stack.pop()
    node.leaves = sum(c.leaves for c in node.children) or 1
    node.saved = (node.n - 1) * node.chars + sum(c.saved for c in node.children)
    out.extend(c.row(node.conv) for c in node.children)
    node.children = [None] * len(node.children)
    if stack:
        stack[-1].meet(node.conv, node.n)
        stack[-1].children.append(node)


def sweep(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Nodes of containers whose suffixes come sorted, container by container.

    Rows are (head, depth, parent, path, ids, lens, n, conv, ends). The stack holds the open nodes from the head down, and closed
    ones whose parent is open; the head itself is written with its path.
    """
    at, stack, before, out, above = None, [], [], [], None

    def end() -> None:
        while len(stack) > 1:
            _close(stack, out)
        node = stack[0]
        _close(stack, out)
        out.append(node.row(*above))

    for head, depth, parent, path, ids, lens, n, conv, ends in rows:
        if head != at:
            if at is not None:
                end()
            at, above, before = head, (parent, path), []
            stack.append(_Node(depth, lens[depth - 1] if depth else 0))
        suffix, shared = ids[depth:], 0
        for a, b in zip(before, suffix):
            if a != b:
                break
            shared += 1
        while len(stack) > shared + 1:
            _close(stack, out)
        for d in range(depth + shared, len(ids)):
            stack.append(_Node(d + 1, lens[d]))
        stack[-1].meet(conv, n)
        stack[-1].ends = ends
        before = suffix
        if len(out) > 10_000:
            yield out
            out = []
    if at is not None:
        end()
        yield out


COLUMNS = ("head", "depth", "parent", "path", "ids", "lens", "n", "conv", "ends")


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in COLUMNS]))
    for out in sweep(rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)


def trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS, container_suffixes: int = CONTAINER_SUFFIXES) -> DataFrame:
    """All nodes of the prefix trie of `conversations` (conv, turns), whose conv is unique.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. Conversations
    without turns are members of the root; no conversations give no nodes. A conversation is one row of 16 bytes a turn, its
    texts stay behind. Memory of a task: the suffixes of one container, which are few or short.
    """
    prepare(conversations.sparkSession)
    different, pieces = _members(conversations)
    members = cut_lineage(different.select(
        F.lit(b"").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<binary>").alias("path"), "*"))
    discard(pieces)
    small, bursts, tables = [], [], [members]
    while True:
        ended = F.size("ids") == F.col("depth")
        heads = members.groupBy("head", "depth").agg(
            F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.count(F.lit(1)).alias("suffixes"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"),
            F.max(F.when(ended, F.col("ends"))).alias("ended"), F.max(F.when(F.col("depth") > 0, F.get("lens", F.col("depth") - 1))).alias("chars"),
            F.min("parent").alias("parent_conv_id"), F.first("path").alias("path"))
        large = cut_lineage(heads.filter((F.col("turns") > container_turns) & (F.col("suffixes") > container_suffixes)))
        if large.isEmpty():
            small.append(members)
            break
        bursts.append(large)
        mark = small_side(large.select("head", F.col("conv_id").alias("above")))
        small.append(members.join(mark, "head", "left_anti"))
        following = F.get("ids", F.col("depth"))
        members = cut_lineage(members.join(mark, "head").filter(~ended).select(
            _id(F.col("head"), following).alias("head"), (F.col("depth") + 1).alias("depth"), F.col("above").alias("parent"),
            F.concat("path", F.array("head")).alias("path"), "ids", "lens", "n", "conv", "ends"))
        tables += [members, mark]
    rest = small[0]
    for part in small[1:]:
        rest = rest.unionByName(part)
    rest = rest.repartition("head").sortWithinPartitions("head", "ids")
    swept = rest.mapInArrow(_sweep, SWEPT)
    swept = cut_lineage(swept)
    for table in tables:
        discard(table)
    if not bursts:
        return swept.drop("path")
    burst = bursts[0]
    for part in bursts[1:]:
        burst = burst.unionByName(part)
    # Every head below a burst one adds to all burst heads above it, and is a child of the last of them.
    own = F.coalesce((F.col("n_convs") - 1) * F.col("chars"), F.lit(0))
    tops = swept.filter("path is not null").select("path", F.posexplode("path").alias("i", "head"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
                                                   F.lit(1).alias("child"))
    inner = burst.select(F.concat("path", F.array("head")).alias("path"), F.posexplode(F.concat("path", F.array("head"))).alias("i", "head"),
                         F.lit(0).cast("long").alias("leaves"), own.alias("saved"), F.lit(0).alias("child"))
    links = burst.select("path", F.posexplode("path").alias("i", "head"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.lit(1).alias("child"))
    sums = tops.unionByName(inner).unionByName(links).groupBy("head").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.sum(F.when(F.col("i") == F.size("path") - 1, F.col("child")).otherwise(0)).cast("long").alias("n_children"))
    upper = burst.join(sums, "head").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ended", F.lit(NOBODY)).alias("ends_sha256"))
    return swept.drop("path").unionByName(upper)
