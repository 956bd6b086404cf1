"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. With ratio = target / words of the source, every document has floor(ratio)
certain copies; the rest is sampled without replacement with unequal probabilities. A document's inclusion probability is
its weight times a factor that the source has, at most 1; the factor is such that the words to be expected are those that
are left. Weights that reach 1 give one more certain copy. The others are ranked by their random odds u / (1 - u) over
their inclusion odds p / (1 - p), and the first ones are taken until the words are reached. One more document closes the
gap: the one whose size comes nearest to what is still missing.

The weight of a document, unless another one is given, is the number of binary digits of its size: of the documents that
a source may give, longer ones are likelier, by a factor of some two between a hundred words and ten thousand. Weights
must be few different numbers: a source's words are summed by weight, and these sums are looked at in one task.

The ranking needs no sorted source: ranks fall into cells, cells are summed, and only the cell in which the target is
reached is looked at row by row. So a source with a third of all rows is summed like any other.

Null texts have size 0 and null sources are one source, after all others. Repeated rows are rows of their own; equal
ones share their random number and are taken one after the other. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Saved

WEIGHTS = (5.0, 2.0, 1.0)
CELLS = 4096


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key alone; md5 makes it the same in any engine."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/" + seed)).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a level is found at which share * all words are dealt
    out as weight * level, where no target is above most * size of its source. There is a row for each source only."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("w"))
    order = W.orderBy(F.col("source_size") * most / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    s = s.select(
        "*",
        (F.col("source_size") * most / F.col("w")).alias("full"),
        ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most) / F.sum("w").over(after)).alias("level"),
    )
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.least(F.col("source_size") * most, F.coalesce(F.col("w") * F.col("level"), F.col("source_size") * most)).alias("target"))


def factors(classes: DataFrame) -> DataFrame:
    """(source, v, p, sure) from (source, rest, v, words): v is a weight, sure the words of certain documents, p is the inclusion probability of a
    source's documents of a weight. Weights from the largest one on are certain as long as the factor that the rest
    would need takes them to 1 or more."""
    down = W.partitionBy("source").orderBy(F.col("v").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(F.col("words") * F.col("v")).over(down.rowsBetween(0, W.unboundedFollowing))
    steps = classes.select("*", before.alias("before"), ((F.col("rest") - before) / after).alias("factor"))
    fits = F.when(F.col("factor") * F.col("v") <= 1, F.struct((-F.col("v")).alias("k"), F.greatest("factor", F.lit(0.0)).alias("factor"), F.col("v").alias("top"), "before"))
    chosen = F.min(fits).over(W.partitionBy("source"))
    steps = steps.select("source", "v", "rest", chosen.alias("x"))
    p = F.when(F.col("rest") <= 0, 0.0).when(F.col("x").isNull() | (F.col("v") > F.col("x.top")), 1.0).otherwise(F.col("x.factor") * F.col("v"))
    return steps.select("source", "v", p.alias("p"), F.coalesce(F.col("x.before"), F.lit(0)).alias("sure"))


def mix(docs: DataFrame, saved: Saved, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", odds_weight: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target and taken (words the mix takes), and ``keep``.

    ``odds_weight``: what inclusion probabilities are in proportion to within a source, in place of the digits of the size.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    plain = docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"), (odds_weight if odds_weight is not None else F.length(F.bin(size))).cast("double").alias("_v"), uniform(F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary"))), seed).alias("_u"), F.monotonically_increasing_id().alias("_row"), *keep)
    plain = saved.put(plain, "sizes")  # counted once; the row numbers stay
    kept = plain.select("_row", *keep)  # what is kept waits here until the copies are known
    plain = plain.select(F.col(id_col), "source", "size", "_v", "_u", "_row")
    wanted = saved.put(targets(plain.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights), "targets")
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.select("*", F.least(copies, F.lit(int(most))).alias("_copies")).select("*", (F.col("target") - F.col("_copies") * F.col("source_size")).alias("_rest"))
    sums = plain.where("size > 0 and _v > 0").groupBy(F.col("source").alias("_source"), F.col("_v").alias("v")).agg(F.sum("size").alias("words"))
    classes = sums.join(wanted.select("source", F.col("_rest").alias("rest")), F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    chances = saved.put(factors(classes), "factors").select(F.col("source").alias("_s"), F.col("v").alias("_w"), F.col("p").alias("_p"), "sure")
    rows = plain.withColumnRenamed("source", "_source").join(wanted, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    rows = rows.join(chances, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_v") == F.col("_w")) & (F.col("size") > 0), "left").drop("_s", "_w")
    # What is certain needs no rank; the rest of the words is what the others are ranked for
    rows = rows.withColumn("_rest", F.col("_rest") - F.coalesce("sure", F.lit(0))).withColumn("_copies", F.col("_copies") + (F.coalesce("_p", F.lit(0.0)) >= 1).cast("int"))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rows = rows.withColumn("_q", F.when((F.col("_p") > 0) & (F.col("_p") < 1), odds))
    rows = rows.withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS))

    cells = rows.where("_q is not null").groupBy("source", "_rest", "_cell").agg(F.sum("size").alias("words"))
    cells = cells.select("*", F.sum("words").over(W.partitionBy("source").orderBy("_cell")).alias("upto"))
    cut = cells.where("upto > _rest").groupBy("source").agg(F.min(F.struct("_cell", (F.col("upto") - F.col("words")).alias("had"))).alias("x"))
    cut = saved.put(cut.select(F.col("source").alias("_source"), F.col("x._cell").alias("_cut"), F.col("x.had").alias("_had")), "cut")
    rows = rows.join(cut, F.col("_source").eqNullSafe(F.col("source")), "left").drop("_source")

    inside = rows.where("_cell = _cut")
    upto = F.sum("size").over(W.partitionBy("source").orderBy("_q", id_col, "_row")) + F.col("_had")
    inside = inside.withColumn("_extra", (upto <= F.col("_rest")).cast("int"))
    outside = rows.where("_q is null or _cut is null or _cell <> _cut")
    outside = outside.withColumn("_extra", F.when(F.col("_q").isNotNull() & (F.col("_cut").isNull() | (F.col("_cell") < F.col("_cut"))), 1).otherwise(0))
    rows = saved.put(inside.unionByName(outside).select(id_col, "source", "size", "source_size", "target", "_copies", "_rest", "_q", "_row", "_extra"), "ranked")

    gaps = rows.where("_q is not null").groupBy("source").agg((F.max("_rest") - F.sum(F.col("size") * F.col("_extra"))).alias("_gap"))
    near = rows.where("_q is not null and _extra = 0").withColumnRenamed("source", "_source").join(gaps, F.col("_source").eqNullSafe(F.col("source"))).where(F.abs(F.col("size") - F.col("_gap")) < F.col("_gap"))
    last = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("off"), "_q", F.col(id_col).alias("_id"), "_row")).alias("x"))
    last = saved.put(last.select(F.col("source").alias("_source"), F.col("x._row").alias("_last")), "last")
    rows = rows.join(last, F.col("_source").eqNullSafe(F.col("source")), "left")
    extra = F.when(F.col("_row") == F.col("_last"), 1).otherwise(F.col("_extra"))
    rows = rows.select(id_col, "source", "size", "source_size", "target", (F.col("size") * (F.col("_copies") + extra)).cast("long").alias("taken"), "_row")
    return rows.join(kept, "_row").drop("_row") if keep else rows.drop("_row")
