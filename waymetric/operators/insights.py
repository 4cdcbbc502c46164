"""Queries behind the dashboard and the figures of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from .quantiles import with_quantiles


def filter_facilities(
    df: DataFrame, departments: list[str], provinces: list[str] = (), categories: list[str] = (), institutions: list[str] = (), resolutive: bool = True, others: bool = True
) -> DataFrame:
    """Facilities with valid coordinates that the filters leave; an empty list of provinces, categories or institutions means all."""
    out = df.where(F.col("has_valid_coords") & F.upper("department").isin(*[d.upper() for d in departments]))
    for column, values in (("province", provinces), ("category", categories), ("institution", institutions)):
        if values:
            out = out.where(F.col(column).isin(*values))
    return out.where((F.col("is_resolutive") & F.lit(resolutive)) | (~F.col("is_resolutive") & F.lit(others)))


def kpis(access: DataFrame, by_district: DataFrame, districts: DataFrame, threshold: float = P.THRESHOLD_MIN) -> DataFrame:
    """One row: population, population beyond the threshold or without a route and its percent, median time, worst district."""
    far = F.coalesce(F.sum(F.when(F.col("t_min").isNull() | (F.col("t_min") > threshold), F.col("population_est"))), F.lit(0.0))
    whole = with_quantiles(access, (), F.col("t_min"), {"median_min": 0.5}, F.sum("population_est").alias("population"), far.alias("beyond"))
    worst = by_district.where("mean_access_min is not null").orderBy(F.desc("mean_access_min"), "ubigeo").limit(1)
    named = worst.join(districts.select("ubigeo", "district"), "ubigeo", "left").select(F.col("district").alias("worst_district"), F.col("mean_access_min").alias("worst_minutes"))
    return whole.join(named, F.lit(True), "left").select("population", "beyond", (100 * F.try_divide("beyond", "population")).alias("pct_beyond"), "median_min", "worst_district", "worst_minutes")  # one row each


def map_table(districts: DataFrame, by_district: DataFrame) -> DataFrame:
    """Districts with their access and the extent of their polygons."""
    points = F.flatten(F.flatten("polygons"))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    out = districts.withColumns({"min_x": F.array_min(xs), "max_x": F.array_max(xs), "min_y": F.array_min(ys), "max_y": F.array_max(ys)})
    return out.join(by_district.select("ubigeo", "mean_access_min", "population"), "ubigeo", "left").drop("polygons")


def access_histogram(access: DataFrame, by: str, bins: int = 40) -> DataFrame:
    """Points per group and bin of equal width from the least to the largest time."""
    t = access.where("t_min is not null")
    span = t.agg(F.min("t_min").alias("lo"), F.max("t_min").alias("hi"))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col("t_min") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return t.join(F.broadcast(span)).groupBy(by, number.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_quartiles(access: DataFrame, by: str) -> DataFrame:
    return with_quantiles(access.where("t_min is not null"), (by,), F.col("t_min"), {"q1": 0.25, "median": 0.5, "q3": 0.75})


def ready_departments(by_district: DataFrame, districts: DataFrame) -> DataFrame:
    return districts.join(by_district.where("mean_access_min is not null").select("ubigeo"), "ubigeo", "left_semi").select("department").distinct()


def filtered_ranking(by_district: DataFrame, districts: DataFrame) -> DataFrame:
    return by_district.where("mean_access_min is not null").join(districts.select("ubigeo"), "ubigeo", "left_semi").orderBy(F.desc("mean_access_min"), "ubigeo")


def resolutive_extent(departments: DataFrame, facilities: DataFrame) -> DataFrame:
    """Resolutive facilities per listed department, with the least and largest number over all."""
    n = facilities.where("is_resolutive").groupBy("department").agg(F.count(F.lit(1)).alias("n"))
    per = departments.join(n, "department", "left").select("department", F.coalesce("n", F.lit(0)).alias("n_resolutive"))
    return per.join(F.broadcast(per.agg(F.min("n_resolutive").alias("least"), F.max("n_resolutive").alias("most"))))  # one row


def best_worst_department(table: DataFrame) -> DataFrame:
    key = F.struct("mean_access_min", "department")
    return table.where("mean_access_min is not null").agg(
        F.min_by("department", key).alias("best"), F.min("mean_access_min").alias("best_min"), F.max_by("department", key).alias("worst"), F.max("mean_access_min").alias("worst_min")
    )


def top_gap_mode(ranking: DataFrame, full: DataFrame, districts: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent department of the top n (of equal ones the first by name), its count, and its 3 worst districts of the full ranking."""
    top = ranking.orderBy(F.desc("mean_access_min"), "ubigeo").limit(n)
    mode = top.groupBy("department").agg(F.count(F.lit(1)).alias("n_top")).orderBy(F.desc("n_top"), "department").limit(1)
    worst = Window.partitionBy("department").orderBy(F.desc("mean_access_min"), "ubigeo")
    own = full.where("mean_access_min is not null").join(mode, "department").withColumn("place", F.row_number().over(worst)).where("place <= 3")
    return own.join(districts.select("ubigeo", "district"), "ubigeo", "left").select("department", "n_top", "place", "ubigeo", "district", "mean_access_min")


def siting_top_vs_rest(picks: DataFrame) -> DataFrame:
    first = F.sum(F.when(F.col("rank") == 1, F.col("marginal_population_gained")))
    rest = F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("marginal_population_gained"))), F.lit(0.0))
    return picks.groupBy("department").agg(first.alias("top_gain"), rest.alias("rest_gain"), F.when(rest > 0, first / rest).alias("ratio"))


def containment_pct(report: DataFrame) -> DataFrame:
    rows = report.where((F.col("rule") == "district_containment") & (F.col("n_checkable") > 0))
    return rows.select("source", (100 * F.col("n_flagged") / F.col("n_checkable")).alias("pct_outside"))


def contrast_ratios(urban_rural: DataFrame, detour: DataFrame, higher: str, lower: str) -> DataFrame:
    """Rural over urban mean time, and by how many percent the detour of one department exceeds that of another."""
    pick = lambda df, cond, c, name: df.agg(F.max(F.when(cond, F.col(c))).alias(name))
    one = urban_rural.agg(
        F.max(F.when(~F.col("is_urban"), F.col("mean_access_min"))).alias("rural"), F.max(F.when(F.col("is_urban"), F.col("mean_access_min"))).alias("urban")
    )
    two = pick(detour, F.col("department") == higher, "median_detour", "a").join(pick(detour, F.col("department") == lower, "median_detour", "b"))  # one row each
    return one.join(two).select(F.try_divide("rural", "urban").alias("rural_urban_ratio"), (100 * F.try_divide(F.col("a") - F.col("b"), F.col("b"))).alias("detour_excess_pct"))


def band_shares(coverage: DataFrame) -> DataFrame:
    return coverage.where((F.col("band_no") == 0) | (F.col("band") == "unroutable")).select("band", (100 * F.col("share")).alias("pct"))
