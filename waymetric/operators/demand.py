"""Demand points: population spread over places, urban flag, weighted sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P


def apportion_population(places: DataFrame, population: DataFrame) -> DataFrame:
    """Adds population_est: the district's population by the place's share of weight; 0 where the code has none.

    Of repeated codes the largest figure counts.

    Weights are summed by an aggregate that joins back, not by a window, so that a
    capital with most of all places does not meet in one task.
    """
    table = F.create_map(*[F.lit(x) for kv in P.CAPITAL_WEIGHTS.items() for x in kv])
    weighted = places.withColumn("_w", F.coalesce(F.element_at(table, F.col("is_capital")), F.lit(1)))
    sums = weighted.groupBy("ubigeo").agg(F.sum("_w").alias("_sum"))
    known = population.where(F.col("ubigeo").isNotNull() & (F.trim("ubigeo") != "")).groupBy("ubigeo").agg(F.max("poblacion_2017").alias("_pop"))
    shares = sums.join(known, "ubigeo")
    return weighted.join(shares, "ubigeo", "left").withColumn("population_est", F.coalesce(F.col("_w") / F.col("_sum") * F.col("_pop"), F.lit(0.0))).drop("_w", "_sum", "_pop")


def classify_urban(df: DataFrame, threshold: float = P.URBAN_POPULATION) -> DataFrame:
    return df.withColumn("is_urban", (F.col("population_est") >= threshold) | ~F.coalesce(F.col("is_capital") == "0", F.lit(False)))


def sample_demand(df: DataFrame, max_points: int = P.MAX_POINTS, seed: int = P.SEED, key: str = "demand_id") -> DataFrame:
    """All rows if there are at most max_points; else a draw without replacement by population, with a quota per department.

    The draw ranks -ln(u) / weight with u from md5(seed:key), so that it is the same
    everywhere.  Each of many parts of a department ranks on its own first, and
    only quota rows of each part meet in the final ranking.
    """
    n = df.count()
    if n <= max_points:
        return df
    quotas = df.groupBy("department").agg(F.sum("population_est").alias("p"), F.count(F.lit(1)).alias("n"))
    total = quotas.agg(F.sum("p").alias("t"))
    quota = F.least(F.bround(F.col("p") / F.col("t") * max_points, 0).cast("long"), F.col("n"))
    quotas = quotas.join(F.broadcast(total)).select(F.col("department").alias("_dep"), quota.alias("_quota")).where("_quota > 0")  # one row
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    drawn = df.join(quotas, df["department"].eqNullSafe(quotas["_dep"])).withColumn("_draw", -F.log(u) / F.greatest("population_est", F.lit(0.01)))
    parts = max(1, n // 100_000)
    local = Window.partitionBy("department", "_part").orderBy("_draw", key)
    whole = Window.partitionBy("department").orderBy("_draw", key)
    first = drawn.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("_k", F.row_number().over(local)).where("_k <= _quota")
    return first.withColumn("_k", F.row_number().over(whole)).where("_k <= _quota").select(*df.columns)


def prepare_demand(places: DataFrame, population: DataFrame, max_points: int | None = P.MAX_POINTS, threshold: float = P.URBAN_POPULATION) -> DataFrame:
    """Places with valid coordinates, wherever they lie, as demand points: a sample of at most max_points, or all of them if it is None."""
    points = classify_urban(apportion_population(places.where("has_valid_coords"), population), threshold)
    return points if max_points is None else sample_demand(points, max_points)
