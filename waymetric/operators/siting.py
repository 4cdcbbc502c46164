"""Where to upgrade facilities, and what an upgrade would change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..checkpoints import cut, drop


def greedy_siting(matrix: DataFrame, demand: DataFrame, threshold: float = P.THRESHOLD_MIN, k: int = P.MAX_SITES) -> DataFrame:
    """Greedy maximal covering, for all departments at once.

    matrix rows belong to the department of their demand point (demand_id,
    department, population_est).  Covered is who reaches a resolutive facility within
    the threshold.  Each round takes per department the candidate with the largest
    new population, above 0, of equal ones the least facility_id.  The driver only
    counts rounds.

    Pairs are written once.  A round sums anew the gains of those candidates alone that
    share newly covered points; the others keep theirs.
    """
    people = demand.select("demand_id", "department", F.coalesce("population_est", F.lit(0.0)).alias("pop"))
    near = matrix.where(F.col("routable") & (F.col("duration_min") <= threshold))
    covered = near.where("facility_is_resolutive").select("demand_id").distinct()
    base = people.join(covered, "demand_id", "left_semi").groupBy("department").agg(F.sum("pop").alias("base"))
    pairs = near.where("not facility_is_resolutive").select("facility_id", "demand_id").distinct().join(covered, "demand_id", "left_anti").join(people, "demand_id")
    pairs = cut(pairs, "siting")
    key = ["department", "facility_id"]
    summed = lambda p: p.groupBy(*key).agg(F.sum("pop").alias("gain"))
    gains = cut(summed(pairs), "gains")
    best_first = Window.partitionBy("department").orderBy(F.desc("gain"), "facility_id")
    picks, taken = [], None
    for rank in range(1, k + 1):
        pick = cut(gains.where("gain > 0").withColumn("n", F.row_number().over(best_first)).where("n = 1").select(*key, "gain"), "pick")
        if pick.isEmpty():
            break
        picks.append(pick.withColumn("rank", F.lit(rank)))
        if rank == k:
            break
        own = pairs.join(pick.select(*key), key, "left_semi").select("demand_id")
        new = cut(own if taken is None else own.join(taken, "demand_id", "left_anti"), "taken")
        taken = new if taken is None else cut(taken.union(new), "taken")
        touched = cut(pairs.join(new, "demand_id", "left_semi").select(*key).distinct(), "touched")
        again = summed(pairs.join(touched, key, "left_semi").join(taken, "demand_id", "left_anti"))
        gains = cut(gains.join(touched, key, "left_anti").unionByName(again), "gains")
    drop(pairs)
    schema = "department string, facility_id long, gain double, rank int"
    all_picks = matrix.sparkSession.createDataFrame([], schema).select("department", F.col("facility_id").cast(matrix.schema["facility_id"].dataType), "gain", "rank")
    for p in picks:
        all_picks = all_picks.unionByName(p)
    upto = Window.partitionBy("department").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.sum("gain").over(upto)
    return all_picks.join(base, "department", "left").select(
        "department", "rank", "facility_id", F.col("gain").alias("marginal_population_gained"), (F.coalesce("base", F.lit(0.0)) + gain).alias("cumulative_population_covered"),
        gain.alias("cumulative_gain_over_baseline"),
    )


def enrich_siting(picks: DataFrame, facilities: DataFrame) -> DataFrame:
    return picks.join(facilities.select("facility_id", "facility_name", "category", "district", "institution"), "facility_id", "left")


def simulate_upgrade(matrix: DataFrame, demand: DataFrame, upgraded: list, threshold: float = P.THRESHOLD_MIN) -> DataFrame:
    """Population within the threshold before and after the upgrade, in one pass; no row when no upgraded facility is in the matrix."""
    chosen = F.col("facility_id").isin(*upgraded)
    ok = F.col("routable") & (F.col("duration_min") <= threshold)
    per = matrix.groupBy("demand_id").agg(
        F.max(F.when(ok & F.col("facility_is_resolutive"), 1).otherwise(0)).alias("b"), F.max(F.when(ok & (F.col("facility_is_resolutive") | chosen), 1).otherwise(0)).alias("a"),
        F.max(F.when(chosen, 1).otherwise(0)).alias("seen"),
    )
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("population_est"))), F.lit(0.0))
    out = per.join(demand.select("demand_id", "population_est"), "demand_id").agg(total("b").alias("covered_before"), total("a").alias("covered_after"), F.max("seen").alias("seen"))
    return out.where("seen = 1").select("covered_before", "covered_after", (F.col("covered_after") - F.col("covered_before")).alias("gain"))
