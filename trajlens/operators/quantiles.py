"""Exact percentiles and ranks of keyed values, however many values one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

DIRECT = 100_000  # values of a key that one aggregation buffer holds
BUCKETS, SMALL = 4096, 4096


def percentiles(values: DataFrame, by: list[str], column: str, probabilities: list[float]) -> DataFrame:
    """by, n, q: the linearly interpolated percentiles of each key's finite values, nulls left out; keys aren't null.

    Keys with up to DIRECT values keep them in one buffer. For all others the wanted ranks are found by histograms of all such keys
    at once: values are counted by bucket where they lie, the bucket that holds a rank becomes that rank's new range, and so on
    until a range is one value or holds at most SMALL values, which are sorted. values is read once a level: store it if it is dear.
    """
    values = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("_x"))
    sizes = stored(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    many = sizes.where(F.col("n") > DIRECT)
    some = bool(many.take(1))
    few = values.join(sizes.where(F.col("n") <= DIRECT).select(*by), by) if some else values
    direct = few.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_x", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    return direct.unionByName(_selected(values, stored(many), by, probabilities)) if some else direct


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("n") - 1)


def _selected(values: DataFrame, many: DataFrame, by: list[str], probabilities: list[float]) -> DataFrame:
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_position(p)), F.ceil(_position(p))) for p in probabilities])))
    state = many.select(*by, F.explode(ranks).alias("_r"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside"))
    done, cell = [], [*by, "_lo", "_hi"]
    while True:
        state = stored(state)
        done.append(state.where(F.col("_lo") == F.col("_hi")).select(*by, "_r", F.col("_lo").alias("_x")))
        small = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_inside") <= SMALL))
        own = _inside(values, small.select(*cell).distinct(), by).groupBy(*cell).agg(F.sort_array(F.collect_list("_x")).alias("_xs"))  # at most SMALL each
        done.append(small.join(own, cell).select(*by, "_r", F.get("_xs", (F.col("_r") - F.col("_below")).cast("int")).alias("_x")))
        wide = state.where((F.col("_lo") < F.col("_hi")) & (F.col("_inside") > SMALL))
        if not wide.take(1):
            break
        # the least value has a bucket of its own, so every level parts what is left; halves keep the widest range finite
        share = F.coalesce(F.try_divide(F.col("_x") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2), F.lit(0.0))
        bucket = F.when(F.col("_x") == F.col("_lo"), 0).otherwise(1 + F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))).cast("int")
        counts = _inside(values, wide.select(*cell).distinct(), by).groupBy(*cell, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_k"), F.min("_x").alias("_new_lo"), F.max("_x").alias("_new_hi"))
        counts = counts.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*cell).orderBy("_b")))  # at most BUCKETS + 1 rows
        held = wide.join(counts, cell).where((F.col("_r") - F.col("_below") >= F.col("_upto") - F.col("_k")) & (F.col("_r") - F.col("_below") < F.col("_upto")))
        state = held.select(*by, "_r", F.col("_new_lo").alias("_lo"), F.col("_new_hi").alias("_hi"), (F.col("_below") + F.col("_upto") - F.col("_k")).alias("_below"), F.col("_k").alias("_inside"))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_x"))).alias("_at")).join(many, by)

    def interpolated(p: float) -> Column:
        at, low, high = _position(p), F.floor(_position(p)), F.ceil(_position(p))
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return found.select(*by, "n", F.array(*[interpolated(p) for p in probabilities]).alias("q"))


def _inside(values: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """values with every range of cells that holds them; a key has as many ranges as it has wanted ranks at most."""
    return values.join(cells, by).where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))


def running_sums(df: DataFrame, by: list[str], order: str, amount: str) -> DataFrame:
    """df with upto, the sum of amount over its key's rows up to this one by order, without one task for a key.

    Rows are dealt out by range, summed within each range, and the few sums of a key's ranges are added up before them.
    A key and order must not repeat.
    """
    dealt = stored(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "_part").agg(F.sum(amount).alias("_own"))
    ahead = parts.withColumn("_ahead", F.coalesce(F.sum("_own").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range of a key
    within = dealt.withColumn("_within", F.sum(amount).over(Window.partitionBy(*by, "_part").orderBy(order)))
    return within.join(ahead.drop("_own"), [*by, "_part"]).withColumn("upto", F.col("_ahead") + F.col("_within")).drop("_ahead", "_within", "_part")


def mean_ranks(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, column, rank: for each distinct value of a key the mean rank (from 1) of the rows that have it."""
    counts = values.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_k"))
    df = running_sums(counts, by, column, "_k")
    return df.select(*by, column, (F.col("upto") - (F.col("_k") - 1) / 2).alias("rank"))
