"""Data-quality rules: row flags, and one report row per rule.

Every rule but the duplicate check keeps all rows.  Flags are column expressions
on the original values, so that a chain of rules is one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..checkpoints import cut
from ..functions.geometry import utm_project
from ..functions.scalars import is_resolutive, normalize_name
from .cover import contained, edges_of


def _pct(n: Column, total: Column) -> Column:
    return F.round(100.0 * n / F.nullif(total, F.lit(0)), 2)


def check_missing_coordinates(df: DataFrame) -> DataFrame:
    """Adds has_valid_coords: false when a coordinate is null or both are (almost) zero."""
    zero = (F.abs("lat") < 1e-4) & (F.abs("lon") < 1e-4)
    return df.withColumn("has_valid_coords", F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.coalesce(zero, F.lit(False)))


def _inside(lat: Column, lon: Column, box: P.BoundingBox) -> Column:
    return F.coalesce(lon.between(box.lon_min, box.lon_max) & lat.between(box.lat_min, box.lat_max), F.lit(False))


def _checkable(df: DataFrame) -> Column:
    return F.col("has_valid_coords") if "has_valid_coords" in df.columns else F.col("lat").isNotNull()


def check_out_of_bbox(df: DataFrame, box: P.BoundingBox = P.BBOX) -> DataFrame:
    """Adds in_bbox: inside (bounds included), or not checkable."""
    return df.withColumn("in_bbox", _inside(F.col("lat"), F.col("lon"), box) | ~_checkable(df))


def check_swapped_lat_lon(df: DataFrame, box: P.BoundingBox = P.BBOX) -> DataFrame:
    """Swaps coordinates that lie outside but would lie inside; adds was_coord_swapped."""
    outside = ~F.col("in_bbox") if "in_bbox" in df.columns else F.lit(False)
    swap = _checkable(df) & outside & _inside(F.col("lon"), F.col("lat"), box)
    new = {
        "lat": F.when(swap, F.col("lon")).otherwise(F.col("lat")), "lon": F.when(swap, F.col("lat")).otherwise(F.col("lon")), "was_coord_swapped": swap,
    }
    if "in_bbox" in df.columns:
        new["in_bbox"] = F.col("in_bbox") | swap
    return df.withColumns(new)


def check_district_containment(df: DataFrame, districts: DataFrame, tolerance_m: float = P.TOLERANCE_M, zone: int = P.UTM_ZONE) -> DataFrame:
    """Adds within_declared_district: in the polygon of its code or less than tolerance_m from it; null where it can't be checked.

    The different points of each code meet the covering index of its polygon; rows then join their point.
    """
    shapes = districts.where("polygons is not null").select(F.col("ubigeo").alias("shape"), "polygons")
    usable = _checkable(df) & (F.col("in_bbox") if "in_bbox" in df.columns else F.lit(True)) & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    points = df.where(usable).select(F.col("ubigeo").alias("shape"), F.col("lon").alias("px"), F.col("lat").alias("py")).distinct()
    x, y = utm_project(F.col("px"), F.col("py"), zone)
    edges = edges_of(shapes)
    ends = {f"{p}{c}": v for p in ("a", "b") for c, v in zip("xy", utm_project(F.col(f"{p}x"), F.col(f"{p}y"), zone), strict=True)}
    flags = contained(points.select("shape", "px", "py", x.alias("x"), y.alias("y")), edges.select("shape", *[v.alias(k) for k, v in ends.items()]), tolerance_m)
    # a shape whose rings have no edge holds no point
    hollow = points.join(shapes.select("shape"), "shape", "left_semi").join(edges.select("shape").distinct(), "shape", "left_anti")
    flags = flags.select("shape", "px", "py", "inside").union(hollow.select("shape", "px", "py", F.lit(False)))
    joined = df.join(flags, usable & (df["ubigeo"] == flags["shape"]) & (df["lon"] == flags["px"]) & (df["lat"] == flags["py"]), "left")
    return joined.withColumn("within_declared_district", F.col("inside")).drop("shape", "px", "py", "inside")


def check_duplicate_codes(df: DataFrame, code: str = "facility_code", ordinal: str = "ordinal") -> DataFrame:
    """Keeps the first row of each code; null codes are equal.  ordinal is the input order."""
    first = df.groupBy(F.col(code).alias("k")).agg(F.min(ordinal).alias("first"))
    return df.join(first, df[code].eqNullSafe(first["k"]) & (df[ordinal] == first["first"]), "left_semi")


def duplicate_report(df: DataFrame, code: str = "facility_code") -> DataFrame:
    per = df.groupBy(code).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per.agg(
        F.lit("duplicate_codes").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_flagged"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_involved_rows")
    )


def check_unclassified(df: DataFrame) -> DataFrame:
    """Report row: facilities without a known category."""
    n, total = F.count_if(F.col("category") == P.UNCLASSIFIED), F.count(F.lit(1))
    return df.agg(F.lit("unclassified_category").alias("rule"), n.alias("n_flagged"), _pct(n, total).alias("pct_flagged"))


def run_all_checks(df: DataFrame, districts: DataFrame, *, places: bool = False) -> DataFrame:
    """All rules in their order, since flags feed forward; registries also get is_resolutive."""
    out = check_swapped_lat_lon(check_out_of_bbox(check_missing_coordinates(df)))
    out = check_duplicate_codes(check_district_containment(out, districts))
    return out if places else out.withColumn("is_resolutive", is_resolutive(F.col("category"), F.col("status_raw")))


def encoding_report(lines: DataFrame, source: str, candidates: tuple[str, ...] = P.ENCODINGS) -> DataFrame:
    """Report row: the first candidate that reads all lines (content binary): UTF-8, or else Latin-1, which reads anything."""
    valid = F.coalesce(F.bool_and(F.is_valid_utf8("content")), F.lit(True))
    row = lines.agg(F.lit("encoding").alias("rule"), F.when(valid, F.lit(candidates[0])).otherwise(F.lit(candidates[1])).alias("encoding_used"))
    return row.withColumn("source", F.lit(source))


def rule_report(df: DataFrame, districts: DataFrame, source: str, *, places: bool = False) -> DataFrame:
    """One row per rule, from one aggregate over the flagged rows before the duplicate check, one over codes and one over districts."""
    flagged = check_district_containment(check_swapped_lat_lon(check_out_of_bbox(check_missing_coordinates(df))), districts)
    total = F.count(F.lit(1))
    counts = {
        "missing_coordinates": F.count_if(~F.col("has_valid_coords")),
        "out_of_bbox": F.count_if(~F.col("in_bbox") | F.col("was_coord_swapped")),
        "swapped_lat_lon": F.count_if("was_coord_swapped"),
        "district_containment": F.count_if(~F.col("within_declared_district")),
    }
    shapeless = districts.agg(F.count_if(F.col("polygons").isNull()).alias("shapeless"))
    row = flagged.agg(total.alias("total"), F.count("within_declared_district").alias("checkable"), *[v.alias(k) for k, v in counts.items()]).join(F.broadcast(shapeless))  # one row each
    rules = [
        F.struct(
            F.lit(k).alias("rule"), F.col(k).alias("n_flagged"), (_pct(F.col(k), F.col("total")) if k == "missing_coordinates" else F.lit(None).cast("double")).alias("pct_flagged"),
            (F.col("checkable") if k == "district_containment" else F.lit(None).cast("long")).alias("n_checkable"),
            (F.col("shapeless") if k == "district_containment" else F.lit(None).cast("long")).alias("n_districts_without_geometry"),
        )
        for k in counts
    ]
    out = row.select(F.explode(F.array(*rules)).alias("r")).select("r.*").unionByName(duplicate_report(df), allowMissingColumns=True)
    if not places:
        out = out.unionByName(check_unclassified(check_duplicate_codes(df)), allowMissingColumns=True)
    return out.withColumn("source", F.lit(source))


def population_report(population: DataFrame) -> DataFrame:
    n = F.count_if(F.col("ubigeo").isNull())
    return population.agg(F.lit("population_without_code").alias("rule"), n.alias("n_flagged"), _pct(n, F.count(F.lit(1))).alias("pct_flagged")).withColumn("source", F.lit("population"))


def quality_report(reports: list[DataFrame]) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def registry_summary(facilities: DataFrame, places: DataFrame) -> DataFrame:
    fac = facilities.groupBy("department").agg(F.count(F.lit(1)).alias("n_facilities"), F.count_if("is_resolutive").alias("n_resolutive"))
    pla = places.groupBy("department").agg(F.count(F.lit(1)).alias("n_places"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return fac.join(pla, "department", "full").select("department", zero("n_facilities"), zero("n_resolutive"), zero("n_places"))


def reconcile_totals(rows: DataFrame) -> DataFrame:
    """rows: department, level (DEPARTAMENTO, PROVINCIA, DISTRITO), province, value.  Per department: whether districts add up."""
    kind = lambda k: F.col("level") == k
    province = rows.groupBy("department", "province").agg(
        F.sum(F.when(kind("DISTRITO"), F.col("value"))).alias("s"), F.max(F.when(kind("PROVINCIA"), F.col("value"))).alias("d")
    )
    bad = province.where("province is not null").groupBy("department").agg(F.count_if(~F.col("s").eqNullSafe(F.col("d"))).alias("n_bad_provinces"))
    whole = rows.groupBy("department").agg(
        F.sum(F.when(kind("DISTRITO"), F.col("value"))).alias("sum_districts"), F.max(F.when(kind("DEPARTAMENTO"), F.col("value"))).alias("declared"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    return whole.join(bad, "department", "left").select(
        "department", "sum_districts", "declared", "n_missing", F.coalesce("n_bad_provinces", F.lit(0)).alias("n_bad_provinces"),
        (F.col("sum_districts").eqNullSafe(F.col("declared")) & (F.coalesce("n_bad_provinces", F.lit(0)) == 0)).alias("accepted"),
    )


def assign_codes_by_name(df: DataFrame, boundaries: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Adds the code of the district of the same normalised name in the same department; blank where none, the last of equal names."""
    codes = boundaries.groupBy(F.upper("department").alias("dep"), normalize_name(F.col("district")).alias("key")).agg(F.max_by("ubigeo", ordinal).alias("code"))
    key = df.withColumns({"_dep": F.upper("department"), "_key": normalize_name(F.col("district"))})
    return key.join(codes, (key["_dep"] == codes["dep"]) & (key["_key"] == codes["key"]), "left").withColumn("ubigeo", F.coalesce("code", F.lit(""))).drop("_dep", "_key", "dep", "key", "code")


def cluster_rows(words: DataFrame, tolerance: float = 4.0, page: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """Adds row_no: words by top, a new row where the gap to the one before is over tolerance.  A page fits a task."""
    order = Window.partitionBy(*page).orderBy("top", "x0", "text")
    gap = F.when(F.col("top") - F.lag("top").over(order) > tolerance, 1).otherwise(0)
    return words.withColumn("_gap", gap).withColumn("row_no", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def carried(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that is not null, up to and with the row, within its keys' group and order.

    Rows are dealt by ranges of keys and order, so that a group of any size spreads
    over many tasks; what a range ends with (one row per group and range) goes on to
    the ranges after it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "carried")
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn(name, F.last(value, ignorenulls=True).over(upto))
    ends = dealt.where(F.col(value).isNotNull()).groupBy("_part", *keys).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    every = dealt.select("_part", *keys).distinct().join(ends, ["_part", *keys], "left")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return local.join(every, ["_part", *keys]).withColumn(name, F.coalesce(name, "_before")).drop("_part", "_before")


# Words of age groups, which are no districts.
AGE_WORDS = ("ANO", "ANOS")


def words_to_entries(words: DataFrame) -> DataFrame:
    """Census entries (doc, page, level, label, value, province, digits) from positioned words (doc, page, text, x0, x1, top, bottom).

    The leftmost `Total` and `Hombres` bound the column of numbers; pages without
    them use the bounds of the page before.  Digits within the bounds are the value,
    words to the left the label; provinces carry down to their districts.  Digits that
    are no long (numbers of several columns run together) leave the value null and stay
    whole in the column digits, which is empty for a row without any.
    """
    left = lambda t: F.min_by(F.struct("x0", "x1"), F.when(F.col("text") == t, F.struct("x0", "x1")))
    heads = F.col("text").isin("Hombres", "Mujeres") & (F.col("top") < 130)
    pages = words.groupBy("doc", "page").agg(left("Total").alias("t"), left("Hombres").alias("h"), F.coalesce(F.max(F.when(heads, F.col("bottom"))), F.lit(120.0)).alias("head"))
    own = F.when(
        F.col("t").isNotNull() & F.col("h").isNotNull(),
        F.struct((F.col("t.x0") - (F.col("h.x0") - F.col("t.x1"))).alias("lo"), ((F.col("t.x1") + F.col("h.x0")) / 2).alias("hi")),
    )
    pages = carried(pages.select("doc", "page", "head", own.alias("own")), ["doc"], ["page"], "own", "b").where("b is not null").select("doc", "page", "head", "b")
    data = cluster_rows(words.join(pages, ["doc", "page"]).where(F.col("top") > F.col("head") + 3))
    digits = F.col("text").rlike("^[0-9]+$") & F.col("x0").between(F.col("b.lo") - 2, F.col("b.hi") + 2)
    joined = lambda cond, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("x0", "text")))), lambda x: x["text"]), sep)
    rows = data.groupBy("doc", "page", "row_no").agg(joined(F.col("x0") < F.col("b.lo"), " ").alias("label"), joined(digits, "").alias("digits"))
    name = normalize_name(F.col("label"))
    level = (
        F.when(name.startswith("DEPARTAMENTO "), "DEPARTAMENTO")
        .when(name.startswith("PROVINCIA "), "PROVINCIA")
        .when((name != "") & ~name.rlike("[0-9]") & ~F.arrays_overlap(F.split(name, " "), F.array(*[F.lit(w) for w in AGE_WORDS])), "DISTRITO")
    )
    rows = rows.select("doc", "page", "row_no", level.alias("level"), "label", F.col("digits").try_cast("long").alias("value"), "digits").where("level is not null")
    rows = rows.withColumn("section", F.when(F.col("level") != "DISTRITO", F.struct("level", "label")))
    return carried(rows, ["doc"], ["page", "row_no"], "section", "s").select("doc", "page", "row_no", "level", "label", "value", F.when(F.col("s.level") == "PROVINCIA", F.col("s.label")).alias("province"), "digits")
