"""Exact quantiles of groups of any size.

A group of up to HELD values is one aggregate.  Where a group is larger, the values of
the ranks asked for are found by refinement: a round counts the values of a rank's range
in bins, before the shuffle, and goes on with the range of the bin that has the rank,
until it is a single value.  All groups and ranks go through the same rounds, a few of
them; no task gathers the values of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, drop

#: Values of a group that one aggregate may hold, bins of a round, and ranks that are sent to every task.
HELD, BINS, SENT = 1_000_000, 1024, 100_000


def with_quantiles(df: DataFrame, by: tuple[str, ...], value: Column, ps: dict[str, float], *others: Column) -> DataFrame:
    """Per group of df: by, the quantiles of value by their names, interpolated between neighbouring ranks, and other aggregates.

    Null values don't count; a group of null values alone has null quantiles, a null key
    is a group.  Without `by` there is one row.
    """
    table = cut(df.withColumn("_value", value.cast("double")), "values")
    largest = table.groupBy(*by).agg(F.count("_value").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    if largest <= HELD:
        return table.groupBy(*by).agg(*[F.percentile("_value", F.lit(p)).alias(k) for k, p in ps.items()], *others)
    group = F.struct(*(by or [F.lit(0).alias("all")])).alias("g")
    found = selected(table.where("_value is not null").select(group, F.col("_value").alias("v")), ps)
    whole = table.groupBy(*by).agg(*others, F.lit(0).alias("_one")).withColumn("_g", group).drop("_one")
    return whole.join(found, whole["_g"].eqNullSafe(found["g"]), "left").select(*by, *ps, *[c for c in whole.columns if c not in (*by, "_g")])


def _bin(v: Column, lo: Column, hi: Column, by_size: bool) -> Column:
    """A number from 0 to BINS - 1 that never falls as v rises from lo to hi, and differs for these two.

    by_size parts by the logarithm (and by sign first), so that values of very different
    size part as fast as others.
    """
    part = lambda x, a, b: F.least(F.floor((x - a) / (b - a) * BINS), F.lit(BINS - 1))
    # ranges without a width (infinite or not a number) part into their ends and the rest
    out = F.when(~(hi - lo < F.lit(float("inf"))), F.when(v == lo, 0).when(v == hi, BINS - 1).otherwise(BINS // 2))
    if by_size:
        out = out.when((lo <= 0) & (hi >= 0), F.when(v < 0, 0).when(v == 0, 1).otherwise(2))
        out = out.when((lo > 0) & (F.ln(lo) < F.ln(hi)), part(F.ln(v), F.ln(lo), F.ln(hi)))
        out = out.when((hi < 0) & (F.ln(-hi) < F.ln(-lo)), part(-F.ln(-v), -F.ln(-lo), -F.ln(-hi)))
    return out.otherwise(part(v, lo, hi))


def selected(rows: DataFrame, ps: dict[str, float]) -> DataFrame:
    """(g, and the quantiles by name) of rows (g, v), by refinement."""
    sizes = cut(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    place = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in ps.items()}
    ranks = F.explode(F.array_distinct(F.array(*[f(x) for x in place.values() for f in (F.floor, F.ceil)])))
    open_ = cut(sizes.select("g", ranks.alias("r"), "lo", "hi", F.lit(0).cast("long").alias("less")), "ranks")
    done = []
    while True:
        done.append(open_.where(F.col("lo") == F.col("hi")))
        left = open_.where(F.col("lo") != F.col("hi"))
        n = left.count()
        if not n:
            break
        sent = (F.broadcast(left) if n <= SENT else left).withColumnRenamed("g", "_g")
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        number = _bin(v, lo, hi, len(done) % 2 == 0)
        near = rows.join(sent, F.col("g").eqNullSafe(F.col("_g")) & (v >= lo) & (v <= hi)).select("g", "r", "less", "v", number.alias("bin"))
        bins = near.groupBy("g", "r", "less", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("g", "r").orderBy("bin")) - F.col("n") + F.col("less")  # BINS rows at most
        bins = bins.withColumn("before", before).where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
        open_ = cut(bins.select("g", "r", "lo", "hi", F.col("before").alias("less")), "ranks")
    values = done[0]
    for x in done[1:]:
        values = values.union(x)
    at = lambda x: F.max(F.when(F.col("r") == x, F.col("lo")))
    ends = values.join(sizes.select(F.col("g").alias("_g"), "n"), F.col("g").eqNullSafe(F.col("_g"))).groupBy("g", "n").agg(
        *[at(f(x)).alias(f"{name}{i}") for i, x in enumerate(place.values()) for name, f in (("low", F.floor), ("high", F.ceil))]
    )
    between = lambda i, x: F.when(F.floor(x) == F.ceil(x), F.col(f"low{i}")).otherwise((F.ceil(x) - x) * F.col(f"low{i}") + (x - F.floor(x)) * F.col(f"high{i}"))
    out = cut(ends.select("g", *[between(i, x).alias(k) for i, (k, x) in enumerate(place.items())]), "quantiles")
    drop(sizes)
    return out
