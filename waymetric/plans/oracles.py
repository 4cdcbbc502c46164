"""DuckDB SQL of the registered queries.  COMMON has tables that several share."""

from __future__ import annotations

from .. import params as P
from .views import with_views

_IN = lambda values: ", ".join(f"'{v}'" for v in values)
_BODY = P.CATEGORY_PATTERN.replace("{", "{{").replace("}", "}}")
_CATEGORY = (
    "CASE WHEN upper(trim(coalesce({0}, ''), ' \t\n\r')) IN (" + _IN(P.EMPTY_CATEGORIES) + ") THEN 'SIN_CATEGORIA' "
    f"WHEN regexp_matches(upper(trim({{0}}, ' \t\n\r')), '{_BODY}') "
    f"THEN regexp_replace(upper(trim({{0}}, ' \t\n\r')), '{_BODY}', '\\1-\\2') ELSE 'SIN_CATEGORIA' END"
)
CATEGORY = _CATEGORY.format("category_raw")
RESOLUTIVE = f"({CATEGORY}) IN ({_IN(P.RESOLUTIVE_CATEGORIES)}) AND coalesce(upper(trim(status_raw)), '') IN ({_IN(P.ACTIVE_STATUS)})"
_B = P.BBOX
INSIDE = f"coalesce(lon BETWEEN {_B.lon_min} AND {_B.lon_max} AND lat BETWEEN {_B.lat_min} AND {_B.lat_max}, false)"
SWAPPED = f"coalesce(lat BETWEEN {_B.lon_min} AND {_B.lon_max} AND lon BETWEEN {_B.lat_min} AND {_B.lat_max}, false)"
VALID = "lat IS NOT NULL AND lon IS NOT NULL AND NOT coalesce(abs(lat) < 1e-4 AND abs(lon) < 1e-4, false)"
PLAIN = "translate({0}, '" + "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ" + "', '" + "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy" + "')"
NAME = "trim(regexp_replace(regexp_replace(upper(replace(" + PLAIN + ", 'ß', 'SS')), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


TITLE_TEXT = "lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"
CAPITAL = "CASE WHEN {0}[1] = 'ß' THEN 'Ss' ELSE upper({0}[1]) END || substr({0}, 2)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * {P.EARTH_RADIUS_M} * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))"


def mean_access(by: str, source: str = "o_access") -> str:
    """The aggregate of weighted_mean_access."""
    return f"""SELECT {by}, CASE WHEN coalesce(sum(population_est) FILTER (WHERE t_min IS NOT NULL), 0) > 0
        THEN sum(t_min * population_est) / sum(population_est) FILTER (WHERE t_min IS NOT NULL) END AS mean_access_min,
        sum(population_est) AS population, count(*) AS n_points,
        100 * (sum(population_est) - coalesce(sum(population_est) FILTER (WHERE t_min IS NOT NULL), 0)) / nullif(sum(population_est), 0) AS pct_unroutable
        FROM {source} WHERE {by} IS NOT NULL GROUP BY {by}"""


def utm(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing of the projection, by its series to the third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    e = (f * (2 - f)) ** 0.5
    k = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    lam = f"radians({lon} - ({P.UTM_ZONE * 6 - 183}))"
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + pow({t}, 2)))"
    x = " + ".join([eta, *(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1))])
    y = " + ".join([xi, *(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1))])
    return f"(500000 + {k!r} * ({x}))", f"(10000000 + {k!r} * ({y}))"


def contained(source: str, key: str, usable: str) -> str:
    """The rows of source and within_declared_district, from crossings of and distances to the edges of the district."""
    along = "least(greatest(((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)), 0), 1)"
    return f"""SELECT s.*, w.within_declared_district FROM {source} s LEFT JOIN (
        SELECT {key}, sum(CASE WHEN (ay > py) <> (by_ > py) AND px < ax + (py - ay) * (bx - ax) / (by_ - ay) THEN 1 ELSE 0 END) % 2 = 1
               OR min(sqrt(pow(px - ax - {along} * (bx - ax), 2) + pow(py - ay - {along} * (by_ - ay), 2))) < 500 AS within_declared_district
        FROM (SELECT {key}, ubigeo, {utm("lon", "lat")[0]} AS px, {utm("lon", "lat")[1]} AS py FROM {source} WHERE {usable}) p JOIN o_edge USING (ubigeo) GROUP BY {key}) w USING ({key})"""


MEAN_COLUMNS = "round(mean_access_min, 5) AS mean_access_min, round(population, 3) AS population, n_points, round(pct_unroutable, 5) AS pct_unroutable"

#: name -> (SQL, what it reads)
COMMON: dict[str, tuple[str, list[str]]] = {
    "o_spread": (
        """SELECT d.*, coalesce(w / sum(w) OVER (PARTITION BY d.ubigeo) * p.poblacion_2017, 0.0) AS population_est
        FROM (SELECT *, CAST(CASE is_capital WHEN '1' THEN 100 WHEN '2' THEN 30 WHEN '3' THEN 10 ELSE 1 END AS DOUBLE) AS w FROM v_demand) d
        LEFT JOIN v_population p ON p.ubigeo = d.ubigeo AND trim(p.ubigeo) <> ''""",
        ["v_demand", "v_population"],
    ),
    "o_people": ("SELECT * EXCLUDE (w), population_est >= 2000 OR is_capital <> '0' AS is_urban FROM o_spread", ["o_spread"]),
    "o_nearest": (
        "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY duration_min, facility_id) AS k FROM v_matrix WHERE routable) WHERE k = 1",
        ["v_matrix"],
    ),
    "o_access": (
        """SELECT p.*, CASE WHEN n.routable THEN n.duration_min END AS t_min FROM o_people p LEFT JOIN o_nearest n ON p.demand_id = n.demand_id
        WHERE department IN (SELECT department FROM o_people JOIN o_nearest USING (demand_id))""",
        ["o_people", "o_nearest"],
    ),
    "o_by_district": (mean_access("ubigeo"), ["o_access"]),
    "o_by_department": (mean_access("department"), ["o_access"]),
    "o_urban_rural": (mean_access("is_urban"), ["o_access"]),
    "o_named": (
        """SELECT b.*, n.department, n.province FROM o_by_district b LEFT JOIN
        (SELECT ubigeo, arg_min(department, demand_id) AS department, arg_min(province, demand_id) AS province FROM o_access GROUP BY ubigeo) n USING (ubigeo)""",
        ["o_by_district", "o_access"],
    ),
    "o_rurality": (
        """SELECT ubigeo, 100 * (sum(population_est) - coalesce(sum(population_est) FILTER (WHERE is_urban), 0)) / nullif(sum(population_est), 0) AS pct_rural
        FROM o_access GROUP BY ubigeo""",
        ["o_access"],
    ),
    "o_lorenz": (
        """SELECT t_min, sum(sum(population_est)) OVER w / sum(sum(population_est)) OVER () AS cum_population_share,
        sum(sum(population_est * t_min)) OVER w / sum(sum(population_est * t_min)) OVER () AS cum_access_share
        FROM o_access WHERE t_min IS NOT NULL GROUP BY t_min WINDOW w AS (ORDER BY t_min) UNION ALL SELECT NULL, 0.0, 0.0""",
        ["o_access"],
    ),
    "o_bands": (
        """SELECT 0 AS band_no, '0-30' AS band, coalesce(sum(population_est) FILTER (WHERE t_min > 0 AND t_min <= 30), 0) AS population, sum(population_est) AS total FROM o_access
        UNION ALL SELECT 1, '30-60', coalesce(sum(population_est) FILTER (WHERE t_min > 30 AND t_min <= 60), 0), sum(population_est) FROM o_access
        UNION ALL SELECT 2, '60-120', coalesce(sum(population_est) FILTER (WHERE t_min > 60 AND t_min <= 120), 0), sum(population_est) FROM o_access
        UNION ALL SELECT 3, '>120', coalesce(sum(population_est) FILTER (WHERE t_min > 120), 0), sum(population_est) FROM o_access
        UNION ALL SELECT 4, 'unroutable', coalesce(sum(population_est) FILTER (WHERE t_min IS NULL), 0), sum(population_est) FROM o_access""",
        ["o_access"],
    ),
    "o_detour": (
        f"""SELECT n.demand_id, n.facility_id, d.department, n.distance_m, {haversine("d.lat", "d.lon", "f.lat", "f.lon")} AS straight_m,
        n.distance_m / nullif({haversine("d.lat", "d.lon", "f.lat", "f.lon")}, 0) AS detour
        FROM o_nearest n JOIN v_demand d USING (demand_id) JOIN v_facility f ON f.facility_id = n.facility_id""",
        ["o_nearest", "v_demand", "v_facility"],
    ),
    "o_cross": (
        """SELECT * FROM (SELECT demand_id, max(duration_min) FILTER (WHERE m = 'car' AND routable) AS t_car, bool_or(routable) FILTER (WHERE m = 'car') AS routable_car,
        max(duration_min) FILTER (WHERE m = 'foot' AND routable) AS t_foot, bool_or(routable) FILTER (WHERE m = 'foot') AS routable_foot,
        max(duration_min) FILTER (WHERE m = 'bike' AND routable) AS t_bike, bool_or(routable) FILTER (WHERE m = 'bike') AS routable_bike
        FROM (SELECT demand_id, 'car' AS m, duration_min, routable FROM o_nearest UNION ALL SELECT demand_id, 'foot', duration_min, routable FROM v_foot
              UNION ALL SELECT demand_id, 'bike', duration_min, routable FROM v_bike) GROUP BY demand_id)
        JOIN (SELECT demand_id, department FROM v_demand) USING (demand_id)""",
        ["o_nearest", "v_foot", "v_bike", "v_demand"],
    ),
    "o_flags": (
        f"""SELECT *, {VALID} AS has_valid_coords, ({INSIDE}) OR NOT ({VALID}) AS in0, ({VALID}) AND NOT ({INSIDE}) AND ({SWAPPED}) AS was_coord_swapped FROM v_registry""",
        ["v_registry"],
    ),
    "o_fixed": (
        f"""SELECT * EXCLUDE (lat, lon, in0, ubigeo), CASE WHEN was_coord_swapped THEN lon ELSE lat END AS lat, CASE WHEN was_coord_swapped THEN lat ELSE lon END AS lon,
        in0 OR was_coord_swapped AS in_bbox, lpad(ubigeo, 6, '0') AS ubigeo, {CATEGORY} AS category, {RESOLUTIVE} AS is_resolutive FROM o_flags""",
        ["o_flags"],
    ),
    "o_edge": (
        f"""SELECT ubigeo, {utm("ax", "ay")[0]} AS ax, {utm("ax", "ay")[1]} AS ay, {utm("bx", "by_")[0]} AS bx, {utm("bx", "by_")[1]} AS by_ FROM (
        SELECT ubigeo, x0 AS ax, y0 AS ay, x0 + 1 AS bx, y0 AS by_ FROM v_district WHERE has_shape = 1 UNION ALL SELECT ubigeo, x0 + 1, y0, x0 + 1, y0 + 1 FROM v_district WHERE has_shape = 1
        UNION ALL SELECT ubigeo, x0 + 1, y0 + 1, x0, y0 + 1 FROM v_district WHERE has_shape = 1 UNION ALL SELECT ubigeo, x0, y0 + 1, x0, y0 FROM v_district WHERE has_shape = 1)""",
        ["v_district"],
    ),
    "o_contained": (contained("o_fixed", "ordinal", "has_valid_coords AND in_bbox"), ["o_fixed", "o_edge"]),
    "o_places": (contained("(SELECT demand_id AS ordinal, ubigeo, lon, lat FROM v_demand)", "ordinal", "true"), ["v_demand", "o_edge"]),
    "o_clean": ("SELECT * FROM o_contained QUALIFY row_number() OVER (PARTITION BY facility_code ORDER BY ordinal) = 1", ["o_contained"]),
    "o_segments": (
        """SELECT way_id, highway, other_tags, lon1, lat1, lon2, lat2 FROM v_ways UNION ALL SELECT way_id, highway, other_tags, lon2, lat2, lon3, lat3 FROM v_ways""",
        ["v_ways"],
    ),
    "o_road": (
        """SELECT DISTINCT CAST(round((y + 90) * 1e7) AS BIGINT) * 4000000000 + CAST(round((x + 180) * 1e7) AS BIGINT) AS node, round(x, 7) AS x, round(y, 7) AS y
        FROM (SELECT lon1 AS x, lat1 AS y FROM o_segments UNION SELECT lon2, lat2 FROM o_segments)""",
        ["o_segments"],
    ),
    "o_open": (
        """SELECT DISTINCT m.facility_id, m.demand_id, p.department, p.population_est AS pop FROM v_matrix m JOIN o_people p USING (demand_id)
        WHERE m.routable AND m.duration_min <= 60 AND NOT m.facility_is_resolutive
        AND m.demand_id NOT IN (SELECT demand_id FROM v_matrix WHERE routable AND duration_min <= 60 AND facility_is_resolutive)""",
        ["v_matrix", "o_people"],
    ),
    "o_base": (
        """SELECT department, sum(population_est) AS base FROM o_people WHERE demand_id IN
        (SELECT demand_id FROM v_matrix WHERE routable AND duration_min <= 60 AND facility_is_resolutive) GROUP BY department""",
        ["v_matrix", "o_people"],
    ),
}


def _network(profile: str, at: str) -> None:
    """The network of a profile and the walks over it; at is the ending of the tables' names."""
    speed = f"CASE highway {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.CAR_SPEEDS.items())} ELSE 40 END" if profile == "car" else str(P.FLAT_SPEEDS[profile])
    node = "CAST(round((lat{0} + 90) * 1e7) AS BIGINT) * 4000000000 + CAST(round((lon{0} + 180) * 1e7) AS BIGINT)"

    def walk(name: str, weight: str, sources: str) -> tuple[str, list[str]]:
        """Least sums of weights from each source f, by rounds."""
        return (
            f"""{sources} UNION
            SELECT a.f, h.v AS node, min(a.dist + h.{weight}) AS dist FROM {name} a JOIN o_hop{at} h ON a.node = h.u LEFT JOIN recurring.{name} r ON r.node = h.v AND r.f = a.f
            WHERE r.dist IS NULL OR a.dist + h.{weight} < r.dist GROUP BY a.f, h.v""",
            [f"o_snapped{at}", f"o_hop{at}", "v_facility"],
        )

    placed = f"SELECT DISTINCT {{0}} AS f, node, CAST(0 AS DOUBLE) AS dist FROM o_snapped{at} JOIN v_facility ON key = facility_id WHERE kind = 'facility' AND node IS NOT NULL"
    tables = {
        "o_arcs": (
            f"""SELECT highway, coalesce(other_tags LIKE '%"oneway"=>"yes"%', false) AS oneway, {haversine("lat1", "lon1", "lat2", "lon2")} AS length,
            {speed} AS speed, {node.format(1)} AS a, {node.format(2)} AS b FROM o_segments WHERE highway NOT IN ({_IN(P.EXCLUDED_HIGHWAYS[profile])})
            AND coalesce(other_tags NOT LIKE '%"access"=>"private"%' AND other_tags NOT LIKE '%"{P.ACCESS_TAGS[profile]}"=>"no"%', true)""",
            ["o_segments"],
        ),
        "o_edges": (
            f"""SELECT u, v, length, length / (speed / 3.6) AS travel_time, highway FROM (
            SELECT a AS u, b AS v, length, speed, highway FROM o_arcs{at} UNION ALL SELECT b, a, length, speed, highway FROM o_arcs{at} WHERE NOT oneway)""",
            [f"o_arcs{at}"],
        ),
        "o_both": (f"SELECT u, v FROM o_edges{at} UNION SELECT v, u FROM o_edges{at}", [f"o_edges{at}"]),
        # labels spread along the edges until each node has the least of its component
        "o_part": (
            f"""SELECT DISTINCT u AS node, u AS c FROM o_both{at} UNION
            SELECT b.v AS node, min(a.c) AS c FROM o_part{at} a JOIN o_both{at} b ON a.node = b.u JOIN recurring.o_part{at} r ON r.node = b.v WHERE a.c < r.c GROUP BY b.v""",
            [f"o_both{at}"],
        ),
        "o_largest": (
            f"SELECT node, x, y FROM o_road WHERE node IN (SELECT node FROM o_part{at} WHERE c = (SELECT c FROM o_part{at} GROUP BY c ORDER BY count(*) DESC, c LIMIT 1))",
            [f"o_part{at}", "o_road"],
        ),
        "o_snapped": (
            f"""SELECT key, kind, node, round(d, 9) AS d FROM (SELECT p.key, p.kind, n.node, sqrt(pow(p.x - n.x, 2) + pow(p.y - n.y, 2)) AS d FROM (
            SELECT demand_id AS key, 'demand' AS kind, CASE WHEN demand_id % 17 <> 0 THEN -77 + (demand_id * 31 % 4000) / 1e4 END AS x, -12 + (demand_id * 17 % 3700) / 1e4 AS y FROM v_demand UNION ALL
            SELECT facility_id, 'facility', CASE WHEN facility_id % 17 <> 0 THEN -77 + (facility_id * 31 % 4000) / 1e4 END, -12 + (facility_id * 17 % 3700) / 1e4 FROM v_facility) p
            LEFT JOIN o_largest{at} n ON p.x IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY d, node) = 1""",
            ["v_demand", "v_facility", f"o_largest{at}"],
        ),
        "o_hop": (
            f"SELECT u, v, min(travel_time) AS w, min(length) AS m FROM o_edges{at} WHERE u IN (SELECT node FROM o_largest{at}) GROUP BY u, v",
            [f"o_edges{at}", f"o_largest{at}"],
        ),
        "o_walk": walk(f"o_walk{at}", "w", placed.format("0")),
        "o_reach": walk(f"o_reach{at}", "w", placed.format("0") + " AND is_resolutive"),
        "o_fast": walk(f"o_fast{at}", "w", placed.format("facility_id")),
        "o_short": walk(f"o_short{at}", "m", placed.format("facility_id")),
    }
    for name, body in tables.items():
        COMMON[name + at] = body


for _profile, _at in (("car", ""), ("foot", "_foot"), ("bike", "_bike")):
    _network(_profile, _at)


def _rounds(k: int) -> None:
    """k rounds of the greedy siting, each a table on the one before."""
    for r in range(1, k + 1):
        rest = "o_open" if r == 1 else f"o_rest{r - 1}"
        COMMON[f"o_pick{r}"] = (
            f"""SELECT {r} AS rank, * FROM (SELECT department, facility_id, sum(pop) AS gain FROM {rest} GROUP BY department, facility_id HAVING sum(pop) > 0)
            QUALIFY row_number() OVER (PARTITION BY department ORDER BY round(gain, 6) DESC, facility_id) = 1""",
            [rest],
        )
        COMMON[f"o_rest{r}"] = (
            f"SELECT * FROM {rest} WHERE demand_id NOT IN (SELECT demand_id FROM {rest} JOIN o_pick{r} USING (department, facility_id))",
            [rest, f"o_pick{r}"],
        )
    COMMON["o_siting"] = (
        f"""SELECT department, CAST(rank AS INTEGER) AS rank, facility_id, gain AS marginal_population_gained, coalesce(base, 0) + sum(gain) OVER w AS cumulative_population_covered,
        sum(gain) OVER w AS cumulative_gain_over_baseline FROM ({" UNION ALL ".join(f"SELECT * FROM o_pick{r}" for r in range(1, k + 1))}) LEFT JOIN o_base USING (department)
        WINDOW w AS (PARTITION BY department ORDER BY rank)""",
        [*(f"o_pick{r}" for r in range(1, k + 1)), "o_base"],
    )


_rounds(P.MAX_SITES)

SITING = "round(marginal_population_gained, 4) AS marginal_population_gained, round(cumulative_population_covered, 4) AS cumulative_population_covered, round(cumulative_gain_over_baseline, 4) AS cumulative_gain_over_baseline"
_q = with_views

ORACLES: dict[str, str] = {
    "access_by_department": _q(f"SELECT department, {MEAN_COLUMNS} FROM o_by_department", "o_by_department"),
    "access_by_district": _q(f"SELECT ubigeo, {MEAN_COLUMNS} FROM o_by_district", "o_by_district"),
    "access_by_province": _q(f"SELECT province, {MEAN_COLUMNS} FROM ({mean_access('province')})", "o_access"),
    "access_by_district_named": _q(f"SELECT ubigeo, department, province, {MEAN_COLUMNS} FROM o_named", "o_named"),
    "urban_rural_contrast": _q(f"SELECT is_urban, {MEAN_COLUMNS} FROM o_urban_rural", "o_urban_rural"),
    "nearest_facility": _q("SELECT demand_id, facility_id, duration_min, distance_m, routable, facility_is_resolutive FROM o_nearest", "o_nearest"),
    "access_time": _q("SELECT demand_id, CASE WHEN routable THEN duration_min END AS t_min FROM v_foot", "v_foot"),
    "access_dataset": _q("SELECT demand_id, department, ubigeo, is_urban, round(population_est, 6) AS population_est, t_min FROM o_access", "o_access"),
    "reachability_count": _q(
        """SELECT department, count(*) FILTER (WHERE demand_id IN (SELECT demand_id FROM v_matrix WHERE facility_is_resolutive AND routable)) AS n_reachable, count(*) AS n_demand
        FROM v_demand GROUP BY department""", "v_matrix", "v_demand"),
    "coverage_bands": _q("SELECT CAST(band_no AS INTEGER) AS band_no, band, round(population, 4) AS population, round(population / total, 8) AS share FROM o_bands", "o_bands"),
    "band_shares": _q("SELECT band, round(100 * population / total, 6) AS pct FROM o_bands WHERE band_no IN (0, 4)", "o_bands"),
    "critical_gap_ranking": _q(f"SELECT ubigeo, {MEAN_COLUMNS} FROM o_by_district WHERE mean_access_min IS NOT NULL ORDER BY o_by_district.mean_access_min DESC, ubigeo LIMIT 20", "o_by_district"),
    "lorenz_curve": _q("SELECT t_min, round(cum_population_share, 8) AS cum_population_share, round(cum_access_share, 8) AS cum_access_share FROM o_lorenz", "o_lorenz"),
    "gini_access": _q(
        """SELECT round(1 - sum((x - px) * (y + py)), 8) AS gini FROM (SELECT cum_population_share AS x, cum_access_share AS y, lag(cum_population_share) OVER w AS px,
        lag(cum_access_share) OVER w AS py FROM o_lorenz WINDOW w AS (ORDER BY cum_population_share, cum_access_share))""", "o_lorenz"),
    "district_rurality": _q("SELECT ubigeo, round(pct_rural, 6) AS pct_rural FROM o_rurality", "o_rurality"),
    "access_vs_rurality": _q(f"SELECT ubigeo, {MEAN_COLUMNS}, round(pct_rural, 6) AS pct_rural FROM o_by_district JOIN o_rurality USING (ubigeo)", "o_by_district", "o_rurality"),
    "access_rurality_corr": _q(
        """SELECT round(corr(mean_access_min, pct_rural), 8) AS pearson_r, count(*) AS n FROM o_by_district JOIN o_rurality USING (ubigeo)
        WHERE mean_access_min IS NOT NULL AND pct_rural IS NOT NULL""", "o_by_district", "o_rurality"),
    "detour_factor": _q("SELECT demand_id, facility_id, department, distance_m, round(straight_m, 3) AS straight_m, round(detour, 6) AS detour FROM o_detour", "o_detour"),
    "detour_quantiles": _q("SELECT round(quantile_cont(detour, 0.5), 6) AS median_detour, round(quantile_cont(detour, 0.9), 6) AS p90_detour, count(detour) AS n FROM o_detour", "o_detour"),
    "detour_by_department": _q(
        "SELECT department, round(quantile_cont(detour, 0.5), 6) AS median_detour, round(quantile_cont(detour, 0.9), 6) AS p90_detour, count(detour) AS n FROM o_detour GROUP BY department", "o_detour"),
    "cross_mode_comparison": _q("SELECT * FROM o_cross", "o_cross"),
    "walk_car_ratio": _q(
        """SELECT department, round(quantile_cont(t_foot / nullif(t_car, 0), 0.5), 6) AS median_ratio, count(*) FILTER (WHERE t_car IS NOT NULL AND t_foot IS NOT NULL) AS n_both,
        round(100.0 * count(*) FILTER (WHERE t_car IS NOT NULL AND t_foot IS NOT NULL) / count(*), 6) AS pct_both FROM o_cross GROUP BY department""", "o_cross"),
    "haversine_distance": _q(f"SELECT d.demand_id, f.facility_id, round({haversine('d.lat', 'd.lon', 'f.lat', 'f.lon')}, 3) AS metres FROM v_demand d JOIN v_facility f ON d.demand_id % (SELECT count(*) FROM supplier) = f.facility_id", "v_demand", "v_facility"),
    "normalize_category": _q(f"SELECT ordinal, {CATEGORY} AS category FROM v_registry", "v_registry"),
    "is_resolutive": _q(f"SELECT ordinal, {RESOLUTIVE} AS is_resolutive FROM v_registry", "v_registry"),
    "pad_code": _q("SELECT ordinal, lpad(ubigeo, 6, '0') AS code, facility_code || '0000000' AS longer FROM v_registry", "v_registry"),
    "parse_tags": _q(
        """SELECT way_id, CASE WHEN other_tags LIKE '%"foot"=>"no"%' THEN 'no' END AS foot, CASE WHEN other_tags LIKE '%"name"%' THEN 'a ' || chr(92) || '"b' || chr(92) || '"' END AS name,
        CASE WHEN other_tags LIKE '%"lanes"%' THEN '2' END AS lanes, coalesce(len(list_distinct(regexp_extract_all(other_tags, '"([a-z_]+)"=>', 1))), 0) AS n_tags FROM v_ways""", "v_ways"),
    "access_excluded": _q(
        """SELECT way_id, coalesce(other_tags LIKE '%"access"=>"private"%' OR other_tags LIKE '%"motor_vehicle"=>"no"%', false) AS car,
        coalesce(other_tags LIKE '%"access"=>"private"%' OR other_tags LIKE '%"foot"=>"no"%', false) AS foot, coalesce(other_tags LIKE '%"access"=>"private"%', false) AS bike FROM v_ways""", "v_ways"),
    "ways_for_profile": _q(" UNION ALL ".join(
        f"""SELECT '{p}' AS profile, highway, count(*) AS n FROM v_ways WHERE highway NOT IN ({_IN(P.EXCLUDED_HIGHWAYS[p])})
        AND NOT coalesce(other_tags LIKE '%"access"=>"private"%' OR other_tags LIKE '%"{P.ACCESS_TAGS[p]}"=>"no"%', false) GROUP BY highway""" for p in P.ACCESS_TAGS), "v_ways"),
    "edge_speed": _q(f"SELECT way_id, CAST(CASE highway {' '.join(f"WHEN '{k}' THEN {v}" for k, v in P.CAR_SPEEDS.items())} ELSE 40 END AS DOUBLE) AS car, 4.5::DOUBLE AS foot, 12.0::DOUBLE AS bike FROM v_ways", "v_ways"),
    "title_es": f"""
        WITH w AS (SELECT doc_id, string_split_regex({TITLE_TEXT}, '\\s+') AS words FROM documents)
        SELECT doc_id, array_to_string(list_transform(words, lambda w: CASE WHEN w IN ('y', 'de', 'del', 'la', 'las', 'el', 'los') THEN w ELSE
                 array_to_string(list_transform(regexp_extract_all(w, '(\\p{{L}}+|\\P{{L}}+)'), lambda r: {CAPITAL.format("r")}), '') END), ' ') AS title,
               array_to_string(list_transform(words, lambda w, i: CASE WHEN i > 1 AND w IN ('y', 'de', 'del', 'la', 'las', 'los') THEN w ELSE {CAPITAL.format("w")} END), ' ') AS census_title
        FROM w""",
    "normalize_name": _q(f"SELECT doc_id, {NAME.format('text')} AS name FROM documents"),
    "scope_filter": _q("SELECT department, count(*) AS n FROM v_demand WHERE upper(department) IN ('ASIA', 'EUROPE') GROUP BY department", "v_demand"),
    "registry_standardize": _q(f"SELECT ordinal, facility_code, lpad(ubigeo, 6, '0') AS ubigeo, lat, lon, {CATEGORY} AS category FROM v_registry", "v_registry"),
    "places_standardize": _q("SELECT CAST(demand_id AS STRING) AS facility_code, department, ubigeo, lon, lat, is_capital FROM v_demand", "v_demand"),
    "population_union": _q("SELECT departamento, count(*) AS n, count(nullif(trim(ubigeo), '')) AS n_codes, CAST(sum(poblacion_2017) AS BIGINT) AS population FROM v_population GROUP BY departamento", "v_population"),
    "ways_in_bbox": _q("SELECT way_id FROM v_ways WHERE highway IS NOT NULL AND greatest(lon1, lon3) >= -76.9 AND least(lon1, lon3) <= -76.8 AND greatest(lat1, lat3) >= -11.9 AND least(lat1, lat3) <= -11.8", "v_ways"),
    "latest_snapshot": _q(
        """SELECT url, y AS year, m AS month, d AS day FROM (SELECT url, CAST(regexp_extract(url, '(\\d{2})-(\\d{2})-(\\d{4})\\.csv$', 3) AS INTEGER) AS y,
        CAST(regexp_extract(url, '(\\d{2})-(\\d{2})-(\\d{4})\\.csv$', 2) AS INTEGER) AS m, CAST(regexp_extract(url, '(\\d{2})-(\\d{2})-(\\d{4})\\.csv$', 1) AS INTEGER) AS d
        FROM v_files WHERE lower(format) = 'csv') ORDER BY y DESC, m DESC, d DESC, url DESC LIMIT 1""", "v_files"),
    "missing_partitions": _q("SELECT demand_id, province, department, ubigeo FROM v_demand", "v_demand"),
    "boundaries_flatten": _q("SELECT ubigeo, department, province, district, has_shape = 1 AS has_polygons, CASE WHEN has_shape = 1 THEN x0 END AS first_x FROM v_district", "v_district"),
    "boundaries_read": _q("SELECT ubigeo, department, province, district, has_shape = 1 AS has_polygons, CASE WHEN has_shape = 1 THEN x0 END AS first_x FROM v_district", "v_district"),
    "encoding_of_files": """
        SELECT written, lang, CASE WHEN written <> 'UTF-8' AND coalesce(bool_or(regexp_matches(text, '[\\x{80}-\\x{FF}]')), false) THEN 'latin-1' ELSE 'utf-8' END AS encoding
        FROM documents, (VALUES ('UTF-8'), ('ISO-8859-1')) w(written) GROUP BY written, lang""",
    "dq_missing_coordinates": _q("SELECT ordinal, has_valid_coords FROM o_flags", "o_flags"),
    "dq_out_of_bbox": _q("SELECT ordinal, in0 AS in_bbox FROM o_flags", "o_flags"),
    "dq_swapped_lat_lon": _q("SELECT ordinal, lat, lon, in_bbox, was_coord_swapped FROM o_fixed", "o_fixed"),
    "dq_district_containment": _q("SELECT ordinal, within_declared_district FROM o_contained", "o_contained"),
    "dq_duplicate_codes": _q("SELECT min(ordinal) AS ordinal, facility_code FROM v_registry GROUP BY facility_code", "v_registry"),
    "dq_unclassified_category": _q(
        "SELECT 'unclassified_category' AS rule, count(*) FILTER (WHERE category = 'SIN_CATEGORIA') AS n_flagged, round(100.0 * count(*) FILTER (WHERE category = 'SIN_CATEGORIA') / count(*), 2) AS pct_flagged FROM o_clean", "o_clean"),
    "clean_registry": _q("SELECT ordinal, facility_code, ubigeo, category, lat, lon, has_valid_coords, in_bbox, was_coord_swapped, within_declared_district, is_resolutive FROM o_clean", "o_clean"),
    "quality_report": _q(
        """SELECT 'missing_coordinates' AS rule, count(*) FILTER (WHERE NOT has_valid_coords) AS n_flagged, round(100.0 * count(*) FILTER (WHERE NOT has_valid_coords) / count(*), 2) AS pct_flagged,
        CAST(NULL AS BIGINT) AS n_checkable, CAST(NULL AS BIGINT) AS n_involved_rows, CAST(NULL AS BIGINT) AS n_districts_without_geometry, CAST(NULL AS VARCHAR) AS encoding_used, 'registry' AS source FROM o_flags
        UNION ALL SELECT 'out_of_bbox', count(*) FILTER (WHERE NOT in0), NULL, NULL, NULL, NULL, NULL, 'registry' FROM o_flags
        UNION ALL SELECT 'swapped_lat_lon', count(*) FILTER (WHERE was_coord_swapped), NULL, NULL, NULL, NULL, NULL, 'registry' FROM o_flags
        UNION ALL SELECT 'district_containment', count(*) FILTER (WHERE NOT within_declared_district), NULL, count(within_declared_district), NULL, (SELECT count(*) FROM v_district WHERE has_shape = 0), NULL, 'registry' FROM o_contained
        UNION ALL SELECT 'duplicate_codes', CAST(coalesce(sum(n - 1), 0) AS BIGINT), NULL, NULL, CAST(coalesce(sum(n), 0) AS BIGINT), NULL, NULL, 'registry' FROM (SELECT count(*) AS n FROM v_registry GROUP BY facility_code HAVING count(*) > 1)
        UNION ALL SELECT 'unclassified_category', count(*) FILTER (WHERE category = 'SIN_CATEGORIA'), round(100.0 * count(*) FILTER (WHERE category = 'SIN_CATEGORIA') / count(*), 2), NULL, NULL, NULL, NULL, 'registry' FROM o_clean
        UNION ALL SELECT 'population_without_code', count(*) FILTER (WHERE trim(ubigeo) = ''), round(100.0 * count(*) FILTER (WHERE trim(ubigeo) = '') / count(*), 2), NULL, NULL, NULL, NULL, 'population' FROM v_population
        UNION ALL SELECT 'encoding', NULL, NULL, NULL, NULL, NULL, 'utf-8', 'registry'
        UNION ALL SELECT 'missing_coordinates', 0, 0.0, NULL, NULL, NULL, NULL, 'places'
        UNION ALL SELECT 'out_of_bbox', 0, NULL, NULL, NULL, NULL, NULL, 'places'
        UNION ALL SELECT 'swapped_lat_lon', 0, NULL, NULL, NULL, NULL, NULL, 'places'
        UNION ALL SELECT 'duplicate_codes', 0, NULL, NULL, 0, NULL, NULL, 'places'
        UNION ALL SELECT 'district_containment', count(*) FILTER (WHERE NOT within_declared_district), NULL, count(within_declared_district), NULL, (SELECT count(*) FROM v_district WHERE has_shape = 0), NULL, 'places' FROM o_places""",
        "o_flags", "o_contained", "o_clean", "v_population", "o_places", "v_district"),
    "containment_pct": _q(
        " UNION ALL ".join(
            f"SELECT '{n}' AS source, round(100.0 * count(*) FILTER (WHERE NOT within_declared_district) / count(within_declared_district), 6) AS pct_outside FROM {t}"
            for n, t in (("registry", "o_contained"), ("places", "o_places"))
        ), "o_contained", "o_places"),
    "registry_summary": _q(
        """SELECT coalesce(a.department, b.department) AS department, coalesce(n_facilities, 0) AS n_facilities, coalesce(n_resolutive, 0) AS n_resolutive, coalesce(n_places, 0) AS n_places
        FROM (SELECT department, count(*) AS n_facilities, count(*) FILTER (WHERE is_resolutive) AS n_resolutive FROM o_clean GROUP BY department) a
        FULL JOIN (SELECT department, count(*) AS n_places FROM v_demand GROUP BY department) b ON a.department = b.department""", "o_clean", "v_demand"),
    "apportion_population": _q("SELECT demand_id, round(population_est, 6) AS population_est FROM o_spread", "o_spread"),
    "classify_urban": _q("SELECT demand_id, is_urban FROM o_people", "o_people"),
    "clean_places": _q(
        f"""SELECT ordinal, true AS has_valid_coords, true AS in_bbox, false AS was_coord_swapped, within_declared_district FROM (
        {contained("(SELECT demand_id AS ordinal, ubigeo, lon, lat FROM v_demand)", "ordinal", "true")})""", "v_demand", "o_edge"),
    "utm_projection": _q(f"SELECT demand_id, round({utm('lon', 'lat')[0]}, 3) AS x, round({utm('lon', 'lat')[1]}, 3) AS y FROM v_demand", "v_demand"),
    "reconcile_totals": _q(
        """SELECT departamento AS department, CAST(sum(poblacion_2017) AS BIGINT) AS sum_districts, CAST(sum(poblacion_2017) AS BIGINT) AS declared, 0 AS n_missing,
        count(DISTINCT provincia) FILTER (WHERE provincia = 'NATION_7') AS n_bad_provinces, count(*) FILTER (WHERE provincia = 'NATION_7') = 0 AS accepted
        FROM v_population WHERE ubigeo <> '' GROUP BY departamento""", "v_population"),
    "assign_codes_by_name": _q(
        """SELECT p.departamento AS department, lower(p.distrito) AS district, p.poblacion_2017, coalesce(d.ubigeo, '') AS ubigeo
        FROM v_population p LEFT JOIN v_district d ON d.department = p.departamento AND lower(d.district) = lower(p.distrito)""", "v_population", "v_district"),
    "prepare_demand": _q(
        """SELECT demand_id, round(population_est, 6) AS population_est, population_est >= 2000 OR is_capital <> '0' AS is_urban FROM (
        SELECT d.*, coalesce(w / sum(w) OVER (PARTITION BY d.ubigeo) * p.poblacion_2017, 0.0) AS population_est
        FROM (SELECT *, CAST(CASE is_capital WHEN '1' THEN 100 WHEN '2' THEN 30 WHEN '3' THEN 10 ELSE 1 END AS DOUBLE) AS w FROM v_demand WHERE has_valid_coords) d
        LEFT JOIN v_population p ON p.ubigeo = d.ubigeo AND trim(p.ubigeo) <> '')
        QUALIFY count(*) OVER () <= 5000 OR true""", "v_demand", "v_population"),
    "sample_demand_points": _q(
        """SELECT demand_id, department FROM (SELECT *, -ln((CAST(('0x' || substr(md5('42:' || demand_id), 1, 8)) AS BIGINT) + 1) / 4294967297.0) / greatest(population_est, 0.01) AS draw FROM o_people)
        JOIN (SELECT department, least(CAST(round_even(sum(population_est) / (SELECT sum(population_est) FROM o_people) * 500, 0) AS BIGINT), count(*)) AS quota FROM o_people GROUP BY department) USING (department)
        QUALIFY (SELECT count(*) FROM o_people) <= 500 OR row_number() OVER (PARTITION BY department ORDER BY draw, demand_id) <= quota""", "o_people"),
    "name_key": (
        "SELECT doc_id, array_to_string(list_transform(string_split_regex(regexp_replace(regexp_replace(" + PLAIN.format("text") + ", '[^\\x00-\\x7F]+', '', 'g'), '[^A-Za-z]+', ' ', 'g'), ' +'), "
        "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS key FROM documents"),
    "facility_slices": _q(
        """SELECT facility_code, slice FROM (SELECT facility_code, unnest([CASE WHEN is_resolutive THEN 'resolutive' END, 'any', CASE WHEN category IN ('I-3', 'I-4') THEN 'candidate' END,
        CASE WHEN is_resolutive OR category IN ('I-3', 'I-4') THEN 'car' END]) AS slice FROM o_clean WHERE upper(department) = 'ASIA' AND has_valid_coords) WHERE slice IS NOT NULL""", "o_clean"),
    "way_segments": _q("SELECT way_id, round(lon1, 7) AS lon1, round(lat1, 7) AS lat1, round(lon2, 7) AS lon2, round(lat2, 7) AS lat2 FROM o_segments", "o_segments"),
    "road_nodes": _q(
        "SELECT DISTINCT CAST(round((y + 90) * 1e7) AS BIGINT) * 4000000000 + CAST(round((x + 180) * 1e7) AS BIGINT) AS node, round(x, 7) AS x, round(y, 7) AS y FROM (SELECT lon1 AS x, lat1 AS y FROM o_segments UNION SELECT lon2, lat2 FROM o_segments)", "o_segments"),
    "road_edges": _q("SELECT u, v, round(length, 3) AS length, round(travel_time, 4) AS travel_time, highway FROM o_edges", "o_edges"),
    "largest_component": _q("SELECT node, x, y FROM o_largest", "o_largest"),
    "largest_component_by_profile": _q(
        " UNION ALL ".join(f"SELECT '{p}' AS profile, CAST(node AS STRING) AS node FROM o_largest{e}" for p, e in (("car", ""), ("foot", "_foot"), ("bike", "_bike"))),
        "o_largest", "o_largest_foot", "o_largest_bike"),
    "clip_ways": _q(
        "SELECT way_id FROM v_ways WHERE " + " OR ".join(f"(lon{i} BETWEEN -76.905 - 1e-9 AND -76.8 + 1e-9 AND lat{i} BETWEEN -11.905 - 1e-9 AND -11.8 + 1e-9)" for i in (1, 2, 3)), "v_ways"),
    "travel_matrix": _q(
        """SELECT p.key AS demand_id, f.facility_id, round(w.dist / 60, 6) AS duration_min, round(m.dist, 3) AS distance_m, w.dist IS NOT NULL AS routable, f.is_resolutive AS facility_is_resolutive
        FROM o_snapped p JOIN (SELECT facility_id, is_resolutive, node AS f_node FROM v_facility JOIN o_snapped ON kind = 'facility' AND key = facility_id) f
          ON p.kind = 'demand' AND (p.node IS NULL OR f.f_node IS NOT NULL)
        LEFT JOIN o_fast w ON w.f = f.facility_id AND w.node = p.node LEFT JOIN o_short m ON m.f = f.facility_id AND m.node = p.node""",
        "o_snapped", "v_facility", "o_fast", "o_short"),
    "nearest_by_profile": _q(
        """SELECT profile, key AS demand_id, round(dist / 60, 5) AS duration_min, dist IS NOT NULL AS routable FROM (
        SELECT 'car' AS profile, key, dist FROM o_snapped s LEFT JOIN o_reach r ON s.node = r.node WHERE kind = 'demand' UNION ALL
        SELECT 'foot', key, dist FROM o_snapped_foot s LEFT JOIN o_reach_foot r ON s.node = r.node WHERE kind = 'demand' UNION ALL
        SELECT 'bike', key, dist FROM o_snapped_bike s LEFT JOIN o_reach_bike r ON s.node = r.node WHERE kind = 'demand')""",
        "o_snapped", "o_reach", "o_snapped_foot", "o_reach_foot", "o_snapped_bike", "o_reach_bike"),
    "urban_walk_any": _q(
        """SELECT key AS demand_id, round(dist / 60, 5) AS duration_min, dist IS NOT NULL AS routable FROM o_snapped_foot s LEFT JOIN o_walk_foot w ON s.node = w.node
        WHERE kind = 'demand' AND key IN (SELECT demand_id FROM o_people WHERE is_urban)""",
        "o_snapped_foot", "o_walk_foot", "o_people"),
    "snap_points": _q("SELECT key AS demand_id, CAST(node AS STRING) AS node, d AS snap_dist_m FROM o_snapped WHERE kind = 'demand'", "o_snapped"),
    "snap_report": _q(
        """SELECT department, count(*) AS n_points, count(*) - count(node) AS n_failed, round(avg(d), 7) AS mean_snap_distance_m, max(d) AS max_snap_distance_m
        FROM o_snapped s JOIN v_demand v ON s.key = v.demand_id WHERE kind = 'demand' GROUP BY department""", "o_snapped", "v_demand"),
    "nearest_from_sources": _q("SELECT node, round(dist, 4) AS dist FROM o_walk", "o_walk"),
    "greedy_siting": _q(f"SELECT department, rank, facility_id, {SITING} FROM o_siting", "o_siting"),
    "siting_recommendations": _q(f"SELECT s.department, rank, facility_id, {SITING}, facility_name, category, district, institution FROM o_siting s LEFT JOIN (SELECT facility_id, facility_name, category, district, institution FROM v_facility) USING (facility_id)", "o_siting", "v_facility"),
    "siting_top_vs_rest": _q(
        """SELECT department, round(t, 4) AS top_gain, round(r, 4) AS rest_gain, round(CASE WHEN r > 0 THEN t / r END, 6) AS ratio FROM (SELECT department,
        sum(marginal_population_gained) FILTER (WHERE rank = 1) AS t, coalesce(sum(marginal_population_gained) FILTER (WHERE rank > 1), 0) AS r FROM o_siting GROUP BY department)""", "o_siting"),
    "simulate_upgrade": _q(
        """SELECT round(b, 4) AS covered_before, round(a, 4) AS covered_after, round(a - b, 4) AS gain FROM (SELECT
        coalesce(sum(population_est) FILTER (WHERE demand_id IN (SELECT demand_id FROM v_matrix WHERE routable AND duration_min <= 60 AND facility_is_resolutive)), 0) AS b,
        coalesce(sum(population_est) FILTER (WHERE demand_id IN (SELECT demand_id FROM v_matrix WHERE routable AND duration_min <= 60 AND (facility_is_resolutive OR facility_id IN (1, 2, 3)))), 0) AS a FROM o_people)""",
        "v_matrix", "o_people"),
    "filter_facilities": _q("SELECT facility_id FROM v_facility WHERE has_valid_coords AND department IN ('ASIA', 'EUROPE') AND category IN ('II-1', 'I-3') AND is_resolutive", "v_facility"),
    "kpi_header": _q(
        """SELECT round(population, 3) AS population, round(beyond, 3) AS beyond, round(100 * beyond / population, 6) AS pct_beyond, median_min, district AS worst_district, round(mean_access_min, 5) AS worst_minutes
        FROM (SELECT sum(population_est) AS population, coalesce(sum(population_est) FILTER (WHERE t_min IS NULL OR t_min > 60), 0) AS beyond, quantile_cont(t_min, 0.5) AS median_min FROM o_access),
        (SELECT ubigeo, mean_access_min FROM o_by_district WHERE mean_access_min IS NOT NULL ORDER BY mean_access_min DESC, ubigeo LIMIT 1) LEFT JOIN v_district USING (ubigeo)""",
        "o_access", "o_by_district", "v_district"),
    "district_map": _q(
        """SELECT d.ubigeo, department, province, district, CASE WHEN has_shape = 1 THEN x0 END AS min_x, CASE WHEN has_shape = 1 THEN x0 + 1 END AS max_x, CASE WHEN has_shape = 1 THEN y0 END AS min_y,
        CASE WHEN has_shape = 1 THEN y0 + 1 END AS max_y, round(mean_access_min, 5) AS mean_access_min, round(population, 3) AS population FROM v_district d LEFT JOIN o_by_district USING (ubigeo)""",
        "v_district", "o_by_district"),
    "access_histogram": _q(
        """SELECT department, CAST(CASE WHEN hi > lo THEN least(floor((t_min - lo) / ((hi - lo) / 40)), 39) ELSE 0 END AS BIGINT) AS bin, count(*) AS n
        FROM o_access, (SELECT min(t_min) AS lo, max(t_min) AS hi FROM o_access) WHERE t_min IS NOT NULL GROUP BY ALL""", "o_access"),
    "access_quartiles": _q("SELECT is_urban, quantile_cont(t_min, 0.25) AS q1, quantile_cont(t_min, 0.5) AS median, quantile_cont(t_min, 0.75) AS q3 FROM o_access WHERE t_min IS NOT NULL GROUP BY is_urban", "o_access"),
    "ready_departments": _q("SELECT DISTINCT department FROM v_district JOIN o_by_district USING (ubigeo) WHERE mean_access_min IS NOT NULL", "v_district", "o_by_district"),
    "filtered_ranking": _q(f"SELECT ubigeo, {MEAN_COLUMNS} FROM o_by_district WHERE mean_access_min IS NOT NULL AND ubigeo IN (SELECT ubigeo FROM v_district WHERE department = 'ASIA')", "o_by_district", "v_district"),
    "resolutive_per_department": _q(
        """SELECT *, min(n_resolutive) OVER () AS least, max(n_resolutive) OVER () AS most FROM (SELECT d.department, count(f.department) AS n_resolutive
        FROM (SELECT DISTINCT department FROM v_demand) d LEFT JOIN (SELECT department FROM v_facility WHERE is_resolutive) f ON d.department = f.department GROUP BY d.department)""", "v_demand", "v_facility"),
    "best_worst_department": _q("SELECT arg_min(department, mean_access_min) AS best, round(min(mean_access_min), 5) AS best_min, arg_max(department, mean_access_min) AS worst, round(max(mean_access_min), 5) AS worst_min FROM o_by_department", "o_by_department"),
    "top_gap_mode": _q(
        """SELECT department, n_top, CAST(place AS INTEGER) AS place, ubigeo, district, round(mean_access_min, 5) AS mean_access_min FROM (
        SELECT n.*, m.n_top, row_number() OVER (PARTITION BY n.department ORDER BY mean_access_min DESC, ubigeo) AS place FROM o_named n JOIN
        (SELECT department, count(*) AS n_top FROM (SELECT * FROM o_named WHERE mean_access_min IS NOT NULL ORDER BY mean_access_min DESC, ubigeo LIMIT 5) GROUP BY department ORDER BY n_top DESC, department LIMIT 1) m
        USING (department) WHERE mean_access_min IS NOT NULL) LEFT JOIN (SELECT ubigeo, district FROM v_district) USING (ubigeo) WHERE place <= 3""", "o_named", "v_district"),
    "contrast_ratios": _q(
        """SELECT round(max(mean_access_min) FILTER (WHERE NOT is_urban) / max(mean_access_min) FILTER (WHERE is_urban), 6) AS rural_urban_ratio,
        round((SELECT 100 * (quantile_cont(detour, 0.5) FILTER (WHERE department = 'ASIA') - quantile_cont(detour, 0.5) FILTER (WHERE department = 'EUROPE')) / quantile_cont(detour, 0.5) FILTER (WHERE department = 'EUROPE') FROM o_detour), 6) AS detour_excess_pct
        FROM o_urban_rural""", "o_urban_rural", "o_detour"),
    "detect_encoding": """
        SELECT doc_id AS path, CASE WHEN text IS NULL THEN NULL WHEN plain THEN 'utf-8' ELSE 'latin-1' END AS encoding,
               CASE WHEN text IS NULL THEN ['utf-8', 'latin-1', 'cp1252'] WHEN plain THEN [] ELSE ['utf-8'] END AS failed
        FROM (SELECT *, doc_id % 2 = 0 OR NOT regexp_matches(text, '[\\x{80}-\\x{FF}]') AS plain FROM documents)""",
    "words_to_entries": _q(
        f"""SELECT doc, page, row_no, level, label, value, CASE WHEN split_part(section, '|', 1) = 'PROVINCIA' THEN substr(section, 11) END AS province FROM (
        SELECT *, last_value(CASE WHEN level <> 'DISTRITO' THEN level || '|' || label END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, row_no) AS section FROM (
        SELECT doc, page, row_no, label, CASE WHEN digits <> '' THEN CAST(digits AS BIGINT) END AS value,
               CASE WHEN starts_with(name, 'DEPARTAMENTO ') THEN 'DEPARTAMENTO' WHEN starts_with(name, 'PROVINCIA ') THEN 'PROVINCIA'
                    WHEN name <> '' AND NOT regexp_matches(name, '[0-9]') AND NOT list_has_any(string_split(name, ' '), ['ANO', 'ANOS']) THEN 'DISTRITO' END AS level
        FROM (SELECT *, {NAME.format('label')} AS name FROM (
        SELECT doc, page, row_no, coalesce(string_agg(text, ' ' ORDER BY x0, text) FILTER (WHERE x0 < lo), '') AS label,
               coalesce(string_agg(text, '' ORDER BY x0, text) FILTER (WHERE regexp_matches(text, '^[0-9]+$') AND x0 BETWEEN lo - 2 AND hi + 2), '') AS digits
        FROM (SELECT *, CAST(sum(g) OVER (PARTITION BY doc, page ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no FROM (
        SELECT w.*, lo, hi, CASE WHEN top - lag(top) OVER (PARTITION BY w.doc, w.page ORDER BY top, x0, text) > 4 THEN 1 ELSE 0 END AS g
        FROM v_words w JOIN (SELECT doc, page, head, last_value(lo IGNORE NULLS) OVER p AS lo, last_value(hi IGNORE NULLS) OVER p AS hi FROM (
          SELECT doc, page, coalesce(max(bottom) FILTER (WHERE text IN ('Hombres', 'Mujeres') AND top < 130), 120) AS head,
                 min(x0) FILTER (WHERE text = 'Total') - (min(x0) FILTER (WHERE text = 'Hombres') - min(x1) FILTER (WHERE text = 'Total')) AS lo,
                 (min(x1) FILTER (WHERE text = 'Total') + min(x0) FILTER (WHERE text = 'Hombres')) / 2 AS hi
          FROM v_words GROUP BY doc, page) WINDOW p AS (PARTITION BY doc ORDER BY page)) b
        ON w.doc = b.doc AND w.page = b.page AND lo IS NOT NULL AND top > head + 3))
        GROUP BY doc, page, row_no))) WHERE level IS NOT NULL)""", "v_words"),
    "cluster_rows": _q(
        """SELECT doc, page, top, x0, text, CAST(sum(g) OVER (PARTITION BY doc, page ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no FROM (
        SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc, page ORDER BY top, x0, text) > 4 THEN 1 ELSE 0 END AS g FROM v_words)""", "v_words"),
}
