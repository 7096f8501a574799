"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates r that are nearest to the prior rates q in entropy, over all words, and give every source its target T,
minimise sum size * (r log(r / q) - r) with sum size * r = T for each source and r <= cap. Its dual is convex, one
multiplier for a source, and has the tilted rates r = min(cap, q exp(m)). Newton steps on the
dual add up words, rates and slopes per source over cells of documents that agree in source, size
and prior. Rates become copies by systematic rounding in order of size: the number of extra
copies in front of any document is the rounded sum of the fractions in front of it, so that a
source misses its target by about one document at most. Order within a size is that of a hash.

Documents are numbered inside a cell by buckets of about BUCKET rows, and cells and buckets are added up
before they are ordered; a source with a third of all documents is spread over its sizes and buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteframe.core import cut_lineage, discard, range_index
from siteframe.llm.common import small_side

#: Fixed values of the mix: weights by rank of the source, words in all, words of a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BUCKET = 1024
#: Fractions are whole multiples of 1 / UNIT, so that sums of them do not depend on the order.
UNIT = 1 << 30
TOLERANCE, MAX_STEPS = 1e-9, 100
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    Sources in order of their code points, null last, have the weights in turn and share
    `share` times all words; a target stops at `cap` times its source, and what is above is shared by
    weight among the others until none is above.
    """
    ranked = range_index(sources, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranked.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")))
    total = share * (table.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * level > F.col("most") if held >= 0 else F.lit(False)
        row = table.agg(F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("words"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if row["n"] in (held, None) or not row["weight"]:
            break
        held, level = row["n"], (total - row["words"]) / row["weight"]
    return table.select("source", "source_size", "weight",
                        F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target"))


def newton_rates(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, m): the multipliers of the convex dual.

    `cells` has (source, size, prior, n), `targets` has (source, target). A step that passes the largest useful
    multiplier, or meets a source whose cells are all at the cap, ends there.
    """
    cells = cells.filter((F.col("size") > 0) & (F.col("prior") > 0))
    goal = targets.select("source", "target")
    state = cut_lineage(goal.withColumn("m", F.lit(0.0)))
    top = cells.groupBy("source").agg(F.log(F.lit(cap) / F.min("prior")).alias("top"))
    top = cut_lineage(top)
    for _ in range(MAX_STEPS):
        tilted = F.col("prior") * F.exp("m")
        words = F.col("n") * F.col("size")
        sums = (cells.join(state.select(F.col("source").alias("s"), "m"), F.col("source").eqNullSafe(F.col("s")))
                .groupBy("s").agg(F.sum(words * F.least(tilted, F.lit(cap))).alias("reached"),
                                  F.sum(F.when(tilted < cap, words * tilted).otherwise(0.0)).alias("slope")))
        joined = (state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").drop("s")
                  .join(top.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
        gap = F.col("target") - F.col("reached")
        # Far below the target the slope of the logarithm is the safe step; near it both agree.
        step = F.when(gap <= 0, gap / F.col("slope")).otherwise(F.least(gap / F.col("slope"), F.log(F.col("target") / F.col("reached"))))
        moved = F.when(F.col("slope") > 0, F.least(F.col("m") + F.greatest(step, F.lit(-5.0)), F.col("top"))).otherwise(
            F.when(gap < 0, F.col("m") - 1.0).otherwise(F.col("m")))
        done = F.col("reached").isNull() | (F.abs(gap) <= TOLERANCE * F.col("target")) | ((gap > 0) & (F.col("m") >= F.col("top")))
        new = cut_lineage(joined.select("source", "target", F.when(done | F.col("target").isNull() | (F.col("target") <= 0), F.col("m"))
                                        .otherwise(moved).alias("m"), (done | (F.col("target") <= 0)).alias("done")))
        open_left = not new.filter("not done").isEmpty()
        discard(state)
        state = new
        if not open_left:
            break
    return state.select("source", F.when(F.col("target") > 0, F.col("m")).alias("m"))


def _before(*group: str):
    return Window.partitionBy(*group).rowsBetween(Window.unboundedPreceding, -1)


def rounded_copies(docs: DataFrame) -> DataFrame:
    """Adds `copies` to (source, size, rate, tie): whole numbers whose sums follow those of the rates."""
    whole = F.floor(F.col("rate") + F.lit(0.5 / UNIT))
    docs = docs.withColumn("whole", whole).withColumn(
        "part", F.greatest(F.round((F.col("rate") - F.col("whole")) * UNIT), F.lit(0)).cast("long"))
    sizes = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("parts"))
    sizes = sizes.withColumn("ahead", F.coalesce(F.sum("parts").over(_before("source").orderBy("size")), F.lit(0)))
    sizes = cut_lineage(sizes.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "ahead",
                                     F.ceil(F.col("n") / BUCKET).alias("fan")))
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    dealt = docs.join(sizes, same).withColumn("bucket", F.pmod(F.shiftright("tie", 8), F.col("fan"))).drop("c_source", "c_size")
    buckets = dealt.groupBy("source", "size", "bucket").agg(F.sum("part").alias("parts"))
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"),
                             F.coalesce(F.sum("parts").over(_before("source", "size").orderBy("bucket")), F.lit(0)).alias("inner"))
    here = (F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
    order = _before("source", "size", "bucket").orderBy("tie", "doc_id", "text_hash")
    placed = (dealt.join(buckets, here)
              .withColumn("start", F.col("ahead") + F.col("inner") + F.coalesce(F.sum("part").over(order), F.lit(0))))
    half = F.lit(UNIT // 2)
    extra = F.floor((F.col("start") + F.col("part") + half) / UNIT) - F.floor((F.col("start") + half) / UNIT)
    return placed.withColumn("copies", (F.col("whole") + extra).cast("long")).drop(
        "whole", "part", "ahead", "inner", "start", "bucket", "fan", "b_source", "b_size", "b_bucket")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", prior: str | None = None,
        share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, rate, copies, taken) of every row.

    `prior` names a column of prior rates (null: 1). Null and empty texts have size 0 and take nothing,
    a null source is one of its own and comes last, a source without words has target 0. Repeated rows are rows of their own; rows
    equal in id and text may swap their copies, which leaves the result as it is. An empty table
    gives an empty result. Other columns are not read.
    """
    base = F.lit(1.0) if prior is None else F.greatest(F.coalesce(F.col(prior).cast("double"), F.lit(1.0)), F.lit(0.0))
    rows = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                   F.xxhash64(F.col(text)).alias("text_hash"), size_of(F.col(text)).alias("size"), base.alias("prior")))
    cells = cut_lineage(rows.groupBy("source", "size", "prior").agg(F.count(F.lit(1)).alias("n")))
    sums = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = cut_lineage(source_targets(sums, share, cap, weights))
    tilt = newton_rates(cells, targets, cap)
    plan = cut_lineage(targets.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
                       .select(F.col("source").alias("p_source"), "source_size", "target", "m"))
    rated = (rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
             .withColumn("rate", F.when(F.col("m").isNull() | (F.col("size") == 0), 0.0).otherwise(
                 F.least(F.col("prior") * F.exp("m"), F.lit(cap))))
             .withColumn("tie", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10)
                         .cast("long")))
    out = rounded_copies(rated)
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The rows of `docs` that the mix takes, with size, source_size, target, copies and taken.

    Rows equal in id and text are numbered, so that each gets copies of its own; other rows are not sorted.
    """
    planned = cut_lineage(mix(docs, doc_id, text, **names).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "size", "source_size", "target", "copies", "taken"))
    added = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*own)
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash"))
    repeated = cut_lineage(planned.groupBy("__id", "__hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if repeated.isEmpty():
        return rows.join(planned.filter("copies > 0"), same).select(*own, *added)
    key = repeated.select(F.col("__id").alias("r_id"), F.col("__hash").alias("r_hash"))
    is_repeated = F.col("__id").eqNullSafe(F.col("r_id")) & (F.col("__hash") == F.col("r_hash"))
    single = planned.join(key, is_repeated, "left_anti").filter("copies > 0")
    out = rows.join(single, same).select(*own, *added)
    others = [F.to_json(F.struct(F.col(c))) for c in own if c not in (doc_id, text)]
    some = rows.join(small_side(repeated), same, "left_semi").withColumn(
        "__k", F.row_number().over(Window.partitionBy(doc_id, F.xxhash64(F.col(text))).orderBy(*others, F.lit(0))))
    plans = planned.join(key, is_repeated, "left_semi").withColumn(
        "__n", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("copies")))
    return out.unionByName(some.join(plans.filter("copies > 0"), same & (F.col("__k") == F.col("__n"))).select(*own, *added))
