"""Population-weighted access metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..checkpoints import cut
from ..functions.scalars import haversine_m
from .quantiles import with_quantiles


def access_time_by_point(nearest: DataFrame) -> DataFrame:
    return nearest.withColumn("t_min", F.when(F.col("routable"), F.col("duration_min")))


def build_access_dataset(demand: DataFrame, nearest: DataFrame) -> DataFrame:
    """Demand with its nearest facility, for departments that have any result.

    The nearest facilities, a row per point, are written once, so that the travel
    matrix that they come from is not made again for each use of them.
    """
    nearest = cut(nearest, "nearest")
    ready = demand.join(nearest.select("demand_id"), "demand_id", "left_semi").select("department").distinct()
    return access_time_by_point(demand.join(ready, "department", "left_semi").join(nearest, "demand_id", "left"))


def coverage_bands(access: DataFrame, edges: tuple[int, ...] = P.BANDS, include_zero: bool = False) -> DataFrame:
    """Population and share per band (lo, hi], over the last edge, and unroutable.  A time of 0 is in no band unless include_zero."""
    t, total = F.col("t_min"), F.sum("population_est")
    lows = (0, *edges[:-1])
    bands = [(f"{lo}-{hi}", ((t > lo) | (F.lit(include_zero) & (t == 0) & F.lit(lo == 0))) & (t <= hi)) for lo, hi in zip(lows, edges, strict=True)]
    bands += [(f">{edges[-1]}", t > edges[-1]), ("unroutable", t.isNull())]
    row = access.agg(total.alias("total"), *[F.coalesce(F.sum(F.when(c, F.col("population_est"))), F.lit(0.0)).alias(f"b{i}") for i, (_, c) in enumerate(bands)])
    each = F.array(*[F.struct(F.lit(i).alias("band_no"), F.lit(n).alias("band"), F.col(f"b{i}").cast("double").alias("population")) for i, (n, _) in enumerate(bands)])
    return row.select("total", F.explode(each).alias("b")).select("b.*", F.try_divide("b.population", "total").alias("share"))


def weighted_mean_access(access: DataFrame, *by: str) -> DataFrame:
    """Per group: population-weighted mean time over routable rows, population, rows, percent of people without a route; null keys drop."""
    pop, routed = F.col("population_est"), F.col("t_min").isNotNull()
    routable = F.coalesce(F.sum(F.when(routed, pop)), F.lit(0.0))
    known = access
    for c in by:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*by).agg(
        F.when(routable > 0, F.sum(F.when(routed, F.col("t_min") * pop)) / routable).alias("mean_access_min"), F.sum(pop).alias("population"), F.count(F.lit(1)).alias("n_points"),
        (100 * (F.sum(pop) - routable) / F.nullif(F.sum(pop), F.lit(0))).alias("pct_unroutable"),
    )


def name_districts(district_access: DataFrame, access: DataFrame, ordinal: str = "demand_id") -> DataFrame:
    names = access.groupBy("ubigeo").agg(F.min_by(F.struct("department", "province"), ordinal).alias("n")).select("ubigeo", "n.*")
    return district_access.join(names, "ubigeo", "left")


def critical_gap_ranking(table: DataFrame, top_n: int = P.TOP_N) -> DataFrame:
    return table.where("mean_access_min is not null").orderBy(F.desc("mean_access_min"), "ubigeo").limit(top_n)


def _running(access: DataFrame) -> DataFrame:
    """t_min, people p and their time pt, the sums of both up to the time, and of all: one row per time.

    Sums run within ranges of t_min, and the ranges' own sums (one row each) shift
    them, so that no task needs all points.
    """
    points = access.where("t_min is not null").groupBy("t_min").agg(F.sum("population_est").alias("p"), F.sum(F.col("population_est") * F.col("t_min")).alias("pt"))
    n = int(access.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(points.repartitionByRange(n, "t_min").withColumn("part", F.spark_partition_id()), "lorenz")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges' totals: one row each
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    totals = dealt.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("pt").alias("st")).select(
        "part", zero(F.sum("sp").over(before)).alias("p0"), zero(F.sum("st").over(before)).alias("t0"), F.sum("sp").over(everything).alias("pn"), F.sum("st").over(everything).alias("tn")
    )
    own = Window.partitionBy("part").orderBy("t_min").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(totals, "part").select("t_min", "p", "pt", (F.col("p0") + F.sum("p").over(own)).alias("p_upto"), (F.col("t0") + F.sum("pt").over(own)).alias("pt_upto"), "pn", "tn")


def lorenz_curve(access: DataFrame) -> DataFrame:
    """t_min, cum_population_share, cum_access_share, with a point at (0, 0).  Equal times are one point."""
    curve = _running(access).select("t_min", F.try_divide("p_upto", "pn").alias("cum_population_share"), F.try_divide("pt_upto", "tn").alias("cum_access_share"))
    start = curve.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(None).cast("double").alias("t_min"), F.lit(0.0).alias("cum_population_share"), F.lit(0.0).alias("cum_access_share"))
    return start.union(curve)


def gini(access: DataFrame) -> DataFrame:
    """1 - 2 x area under the Lorenz curve: one row; null without routable people.

    Twice the area is the sum over times of their share of people times the access
    shares before and after them, which the running sums give.
    """
    twice = F.sum(F.try_divide("p", "pn") * F.try_divide(2 * F.col("pt_upto") - F.col("pt"), "tn"))
    return _running(access).agg((1 - twice).alias("gini"))


def urban_rural_contrast(access: DataFrame) -> DataFrame:
    return weighted_mean_access(access, "is_urban")


def district_rurality(access: DataFrame) -> DataFrame:
    pop = F.sum("population_est")
    urban = F.coalesce(F.sum(F.when(F.col("is_urban"), F.col("population_est"))), F.lit(0.0))
    return access.where("ubigeo is not null").groupBy("ubigeo").agg((100 * (pop - urban) / F.nullif(pop, F.lit(0))).alias("pct_rural"))


def access_vs_secondary(table: DataFrame, secondary: DataFrame) -> DataFrame:
    return table.join(secondary, "ubigeo")


def access_secondary_corr(table: DataFrame, column: str = "pct_rural") -> DataFrame:
    return table.where(F.col("mean_access_min").isNotNull() & F.col(column).isNotNull()).agg(F.corr("mean_access_min", column).alias("pearson_r"), F.count(F.lit(1)).alias("n"))


def straight_line_vs_network(nearest: DataFrame, demand: DataFrame, facilities: DataFrame) -> DataFrame:
    """Routable rows with the straight line and the detour factor; a straight line of 0 gives none."""
    d = demand.select("demand_id", "department", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    f = facilities.select("facility_id", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    line = haversine_m(F.col("d_lat"), F.col("d_lon"), F.col("f_lat"), F.col("f_lon"))
    out = nearest.where("routable").join(d, "demand_id").join(f, "facility_id").withColumn("straight_m", line)
    return out.select("demand_id", "facility_id", "department", "distance_m", "straight_m", (F.col("distance_m") / F.nullif("straight_m", F.lit(0.0))).alias("detour"))


def detour_quantiles(table: DataFrame, *by: str) -> DataFrame:
    """Median and 90th percentile, exact."""
    return with_quantiles(table, by, F.col("detour"), {"median_detour": 0.5, "p90_detour": 0.9}, F.count("detour").alias("n"))


def cross_mode(car: DataFrame, foot: DataFrame, bike: DataFrame, demand: DataFrame) -> DataFrame:
    """Times and routability of three modes side by side, for departments that have all three; one shuffle by demand point."""
    modes = {"car": car, "foot": foot, "bike": bike}
    rows = None
    for m, t in modes.items():
        part = t.select("demand_id", F.lit(m).alias("mode"), F.when(F.col("routable"), F.col("duration_min")).alias("t"), "routable")
        rows = part if rows is None else rows.unionByName(part)
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c))).alias(f"{c}_{m}")
    wide = rows.groupBy("demand_id").agg(*[pick(m, c) for m in modes for c in ("t", "routable")]).join(demand.select("demand_id", "department"), "demand_id")
    has = lambda m: F.max(F.col(f"routable_{m}").isNotNull())
    ready = wide.groupBy("department").agg((has("car") & has("foot") & has("bike")).alias("ok")).where("ok").select("department")
    return wide.join(ready, "department", "left_semi")


def cross_mode_ratio(table: DataFrame, *by: str) -> DataFrame:
    """Median of foot over car where both have a route (a car time of 0 gives none), and how many have both."""
    both = F.col("t_car").isNotNull() & F.col("t_foot").isNotNull()
    ratio = F.when(both, F.col("t_foot") / F.nullif("t_car", F.lit(0.0)))
    return with_quantiles(table, by, ratio, {"median_ratio": 0.5}, F.count_if(both).alias("n_both"), (100 * F.count_if(both) / F.count(F.lit(1))).alias("pct_both"))


