"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the whole token budget, the sum of all
sizes. A source's target stops at ``max_epochs`` times its own size; what is cut off goes to the others by weight until
no target is above (the level ``budget left / weight left`` of the sources that are not capped).

Every document is taken floor(target / source size) times, and some documents once more: those whose hash is below the
source's threshold. The threshold comes from histograms: tokens are summed by source and hash bucket, the bucket in
which the running sum crosses the remaining budget is split into finer buckets, and so on until all hash bits are
used. No document is sorted. The boundary hash itself is taken if that brings the sum nearer to the budget.

The hash is the first 60 bits of md5 over id, source and text, so reruns agree and partitioning doesn't matter. Rows
that repeat exactly share a hash and are taken together. A null text has size 0 and takes nothing; a null source is a
source of its own; a caller's columns may have any names. An empty table gives an empty table. Sizes must fit a long.
Targets are found by windows over one row a source, in one task: sources must be fewer than some ten million.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, packed, stored, text_of, unpacked

BITS, LEVELS = 12, 5  # 60 bits of hash; 4,096 buckets a source and level
MAX_EPOCHS, WEIGHT_CYCLE = 3, 3


def row_hash() -> Column:
    text = text_of(F.col("text"))
    key = F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("source").cast("string"), F.lit("-")), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Id, source, size and hash of every row."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words_of(text_of(F.col("text"))).alias("size"), row_hash().alias("h"))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source; the windows here order sources, not documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(order) - 1) % WEIGHT_CYCLE + 1).cast("long"))
    per = per.withColumn("cap", max_epochs * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # by cap/weight the capped sources come first: source k is capped if even it, at its level, would be above its cap
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("capped", left.cast("double") * F.col("weight") > F.col("cap").cast("double") * weight_left)
    per = per.withColumn("free", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
    per = per.withColumn("free_weight", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every))
    share = F.col("free").cast("double") * F.col("weight") / F.col("free_weight")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def thresholds(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """from_source, source_size, target, whole (times that all its rows are taken), lo and edge (which once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = per_source.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumn("lo", F.lit(0).cast("long"))
    for level in range(LEVELS):  # lo: the first hash of the boundary bucket; rest: the budget left when it begins
        shift = BITS * (LEVELS - 1 - level)
        at = state.withColumnRenamed("source", "from_source")
        inside = F.col("source").eqNullSafe(F.col("from_source")) & (F.shiftright(F.col("h"), shift + BITS) == F.shiftright(F.col("lo"), shift + BITS))
        same = [F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")]
        buckets = sizes.join(at, inside).groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), *same)
        run = Window.partitionBy("source").orderBy("b")
        buckets = buckets.withColumn("upto", F.sum("n").over(run)).withColumn("last", F.lead("b").over(run).isNull())
        # the bucket that crosses, or the last one where the budget holds them all
        crosses = (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest"))
        edge = buckets.where(crosses | (F.col("last") & (F.col("upto") <= F.col("rest"))))
        left = (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest")
        edge = edge.groupBy("source").agg(F.min(F.struct("b", left, "n", "source_size", "target", "whole")).alias("e"))
        state = edge.select("source", "e.source_size", "e.target", "e.whole", "e.rest", "e.n", F.shiftleft("e.b", shift).alias("lo"))
    edge_too = 2 * F.col("rest") >= F.col("n")
    return state.select(F.col("source").alias("from_source"), "source_size", "target", "whole", "lo", ((F.col("rest") > 0) & edge_too).alias("edge"))


def times(h: Column) -> Column:
    return F.col("whole") + ((h < F.col("lo")) | ((h == F.col("lo")) & F.col("edge"))).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and times for every row of docs."""
    sizes = stored(sized(docs))
    state = thresholds(sizes, targets(sizes))
    return sizes.join(state, F.col("source").eqNullSafe(F.col("from_source"))).select("doc_id", "source", "size", "source_size", "target", times(F.col("h")).alias("times"))


def repeated(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row 0 to 3 times, with its own columns, whatever their names.

    Thresholds are one stored row a source, so Spark knows their size: it sends them to the tasks while they are below its
    broadcast limit, and joins by source (splitting hot sources) beyond it. A row's own hash decides.
    """
    sizes = stored(sized(docs))
    state = stored(thresholds(sizes, targets(sizes)))
    df = packed(docs, row_hash().alias("h"), F.col("source").cast("string").alias("source"))
    df = df.join(state, F.col("source").eqNullSafe(F.col("from_source"))).select("row", times(F.col("h")).cast("int").alias("n"))
    return unpacked(df.select("row", F.explode(F.expr("array_repeat(0, n)"))), docs)
