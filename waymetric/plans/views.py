"""Views over the driver's tables that stand for the library's inputs.

The driver's tables hold no geography, so that points, districts, facilities,
travel times and roads derive from their keys by whole-number arithmetic, with the
defects that the rules look for.  The same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS: dict[str, str] = {
    "v_demand": """
        SELECT c_custkey AS demand_id, r_name AS department, n_name AS province, n_name || '-' || CAST(c_custkey % 4 AS STRING) AS district,
               lpad(CAST(c_nationkey * 100 + c_custkey % 4 AS STRING), 6, '0') AS ubigeo,
               CASE c_custkey % 20 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' ELSE '0' END AS is_capital,
               -80 + (c_nationkey % 5) * 2 + (c_custkey % 4) % 2 + (c_custkey * 7919 % 10200) / 1e4 AS lon,
               -15 + floor(c_nationkey / 5) * 2 + floor((c_custkey % 4) / 2) + (c_custkey * 104729 % 10200) / 1e4 AS lat,
               c_custkey % 13 <> 0 AS has_valid_coords
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_population": """
        SELECT min(department) AS departamento, min(province) AS provincia, min(district) AS distrito, CAST(count(*) * 10 AS BIGINT) AS poblacion_2017, ubigeo
        FROM v_demand JOIN orders ON o_custkey = demand_id WHERE ubigeo <> '000300' GROUP BY ubigeo
        UNION ALL SELECT 'X' AS departamento, 'X' AS provincia, 'X' AS distrito, CAST(count(*) AS BIGINT) AS poblacion_2017, '' AS ubigeo FROM nation""",
    "v_registry": """
        SELECT p_partkey AS ordinal, CAST(CASE WHEN p_partkey % 40 = 0 THEN p_partkey - 1 ELSE p_partkey END AS STRING) AS facility_code, p_name AS facility_name,
               p_brand AS institution, r_name AS department, n_name AS province, n_name || '-' || CAST(p_partkey % 4 AS STRING) AS district,
               CAST((p_partkey % 25) * 100 + p_partkey % 4 AS STRING) AS ubigeo,
               CASE p_partkey % 12 WHEN 0 THEN 'ii-1' WHEN 1 THEN 'II 2' WHEN 2 THEN 'I1' WHEN 3 THEN ' iii-e ' WHEN 4 THEN 'GARBAGE' WHEN 5 THEN '0' WHEN 6 THEN NULL
                    WHEN 7 THEN '' WHEN 8 THEN 'I - 4' WHEN 9 THEN 'II-E' WHEN 10 THEN 'I-3' ELSE 's/c' END AS category_raw,
               CASE p_size % 7 WHEN 0 THEN 'CIERRE TEMPORAL DE OFICIO' WHEN 1 THEN 'activo ' WHEN 2 THEN NULL WHEN 3 THEN 'BAJA DEFINITIVA' ELSE 'ACTIVO' END AS status_raw,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 0e0 WHEN p_partkey % 17 = 0 THEN lon0 WHEN p_partkey % 19 = 0 THEN 40e0 ELSE lat0 END AS lat,
               CASE WHEN p_partkey % 13 = 0 THEN 0e0 WHEN p_partkey % 17 = 0 AND p_partkey % 11 <> 0 THEN lat0 ELSE lon0 END AS lon
        FROM (SELECT *, -80 + ((p_partkey % 25) % 5) * 2 + (p_partkey % 4) % 2 + (p_partkey * 7919 % 10200) / 1e4 AS lon0,
                     -15 + floor((p_partkey % 25) / 5) * 2 + floor((p_partkey % 4) / 2) + (p_partkey * 104729 % 10200) / 1e4 AS lat0 FROM part) p
        JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_district": """
        SELECT DISTINCT ubigeo, department, province, district, CASE WHEN ubigeo = '000203' THEN 0 ELSE 1 END AS has_shape,
               -80 + (CAST(substr(ubigeo, 3, 2) AS INT) % 5) * 2 + (demand_id % 4) % 2 + 0e0 AS x0,
               -15 + floor(CAST(substr(ubigeo, 3, 2) AS INT) / 5) * 2 + floor((demand_id % 4) / 2) + 0e0 AS y0
        FROM v_demand""",
    "v_facility": """
        SELECT s_suppkey AS facility_id, s_name AS facility_name, 'inst' || CAST(s_suppkey % 3 AS STRING) AS institution, r_name AS department, n_name AS province,
               n_name || '-' || CAST(s_suppkey % 4 AS STRING) AS district,
               CASE s_suppkey % 5 WHEN 0 THEN 'II-1' WHEN 1 THEN 'I-3' WHEN 2 THEN 'I-4' WHEN 3 THEN 'I-1' ELSE 'SIN_CATEGORIA' END AS category,
               s_suppkey % 5 = 0 AS is_resolutive, s_suppkey % 9 <> 0 AS has_valid_coords,
               -80 + (s_nationkey % 5) * 2 + (s_suppkey * 7919 % 20000) / 1e4 AS lon, -15 + floor(s_nationkey / 5) * 2 + (s_suppkey * 104729 % 20000) / 1e4 AS lat
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_matrix": """
        SELECT demand_id, facility_id, CASE WHEN r = 1 THEN q END AS duration_min, CASE WHEN r = 1 THEN x END AS distance_m, r = 1 AS routable, facility_id % 5 = 0 AS facility_is_resolutive
        FROM (SELECT o_custkey AS demand_id, l_suppkey AS facility_id, min(CASE WHEN (o_custkey + l_suppkey) % 97 = 0 THEN 0e0 ELSE CAST(l_quantity AS DOUBLE) * 3 END) AS q,
                     min(CAST(l_extendedprice AS DOUBLE)) AS x, max(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS r
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey) m""",
    "v_foot": """
        SELECT o_custkey AS demand_id, min(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN CAST(l_quantity AS DOUBLE) * 9 END) AS duration_min,
               max(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 AS routable
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 <> 0 GROUP BY o_custkey""",
    "v_bike": """
        SELECT o_custkey AS demand_id, min(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN CAST(l_quantity AS DOUBLE) * 3 END) AS duration_min,
               max(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS routable
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 5 <> 0 GROUP BY o_custkey""",
    # a lattice of 40 columns: each customer is a way over three of its nodes
    "v_ways": """
        SELECT k AS way_id,
               CASE k % 29 WHEN 0 THEN 'footway' WHEN 1 THEN 'motorway' WHEN 2 THEN 'primary' WHEN 3 THEN 'track' WHEN 4 THEN NULL WHEN 5 THEN 'service' WHEN 6 THEN 'path' ELSE 'residential' END AS highway,
               CASE k % 17 WHEN 0 THEN '"oneway"=>"yes"' WHEN 1 THEN '"access"=>"private","name"=>"a ' || chr(92) || '"b' || chr(92) || '""' WHEN 2 THEN '"foot"=>"yes","foot"=>"no"' WHEN 3 THEN NULL
                    WHEN 4 THEN '"motor_vehicle"=>"no"' WHEN 5 THEN '"oneway"=>"-1"' ELSE '"surface"=>"dirt","lanes"=>"2"' END AS other_tags,
               -77 + i / 1e2 AS lon1, -12 + j / 1e2 AS lat1, -77 + (i + 1) / 1e2 AS lon2, -12 + j / 1e2 AS lat2, -77 + (i + 1) / 1e2 AS lon3, -12 + (j + 1) / 1e2 AS lat3
        FROM (SELECT c_custkey - 1 AS k, (c_custkey - 1) % 40 AS i, CAST(floor((c_custkey - 1) / 40) AS BIGINT) AS j FROM customer) c""",
    "v_words": """
        SELECT 'doc' || CAST(user_id % 3 AS STRING) AS doc, user_id AS page,
               CASE WHEN event_id % 10 = 0 THEN 'Total' WHEN event_id % 10 = 1 THEN 'Hombres' WHEN event_id % 10 < 5 THEN CAST(event_id % 1000 AS STRING)
                    WHEN event_id % 10 = 5 THEN 'PROVINCIA' WHEN event_id % 10 = 6 THEN 'años' ELSE event_type END AS text,
               CASE WHEN event_id % 10 = 0 THEN 100e0 WHEN event_id % 10 = 1 THEN 140e0 WHEN event_id % 10 < 5 THEN 70 + event_id % 60 + 0e0 ELSE event_id % 60 + 0e0 END AS x0,
               CASE WHEN event_id % 10 = 0 THEN 120e0 WHEN event_id % 10 = 1 THEN 160e0 WHEN event_id % 10 < 5 THEN 75 + event_id % 60 + 0e0 ELSE event_id % 60 + 5e0 END AS x1,
               event_id * 37 % 700 + 0e0 AS top, event_id * 37 % 700 + 3e0 AS bottom
        FROM events""",
    "v_files": """
        SELECT CASE WHEN event_id % 3 = 0 THEN 'CSV' WHEN event_id % 3 = 1 THEN 'csv' ELSE 'pdf' END AS format,
               'http://x/' || CASE WHEN event_id % 2 = 0 THEN 'registry_' ELSE 'REGISTRY_' END || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || '-'
               || lpad(CAST(1 + event_id % 12 AS STRING), 2, '0') || '-' || CAST(2015 + event_id % 10 AS STRING) || '.csv' AS url
        FROM events""",
}
#: Recursive tables keep one row per key.
HEADS = {
    f"{name}{at}": f"{name}{at}({columns}"
    for at in ("", "_foot", "_bike")
    for name, columns in {"o_part": "node, c) USING KEY (node)", **dict.fromkeys(("o_walk", "o_reach", "o_fast", "o_short"), "f, node, dist) USING KEY (f, node)")}.items()
}
#: What each view reads, views first.
NEEDS = {"v_population": ["v_demand"], "v_district": ["v_demand"]}


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views, and the common tables of oracles.py, in front."""
    from .oracles import COMMON

    out: dict[str, str] = {}

    def add(name: str) -> None:
        body = VIEWS.get(name) or COMMON[name][0]
        for n in NEEDS.get(name, []) if name in VIEWS else COMMON[name][1]:
            add(n)
        out.setdefault(name, body)

    for n in names:
        add(n)
    if not out:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{HEADS.get(k, k)} AS ({v})" for k, v in out.items()) + "\n" + sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are resolved when it is made."""
    for n in NEEDS.get(name, []):
        view(spark, sf_dir, n).createOrReplaceTempView(n)
    for t in TABLES:
        if re.search(rf"\b{t}\b", VIEWS[name]):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts with polygons: squares of one degree, one without a shape."""
    x, y = F.col("x0"), F.col("y0")
    corner = lambda a, b: F.array(x + a, y + b)
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    return view(spark, sf_dir, "v_district").withColumn("polygons", F.when(F.col("has_shape") == 1, F.array(F.array(ring)))).drop("x0", "y0", "has_shape")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda i: F.struct(F.col(f"lon{i}").cast("double").alias("lon"), F.col(f"lat{i}").cast("double").alias("lat"))
    w = view(spark, sf_dir, "v_ways").withColumn("coords", F.array(point(1), point(2), point(3)))
    return w.select("way_id", "highway", "other_tags", "coords", F.least("lon1", "lon3").alias("minx"), F.greatest("lon1", "lon3").alias("maxx"), F.least("lat1", "lat3").alias("miny"), F.greatest("lat1", "lat3").alias("maxy"))
