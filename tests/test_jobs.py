"""Quality rules, demand, metrics and siting on small frames."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from waymetric.operators import cover
from waymetric.operators import demand as D
from waymetric.operators import insights as I
from waymetric.operators import metrics as M
from waymetric.operators import quality as Q
from waymetric.operators import siting as O
from waymetric.sources import tables as T

POINTS = "facility_code long, lat double, lon double, ubigeo string, ordinal long"


def points(spark, *rows):
    return spark.createDataFrame([(c, lat, lon, "150101", i) for i, (c, lat, lon) in enumerate(rows)], POINTS)


def test_missing_and_zero_coordinates(spark):
    df = Q.check_missing_coordinates(points(spark, (1, -12.0, -76.0), (2, None, -76.0), (3, 0.0, 0.0), (4, -6e-8, -7e-7)))
    assert {r.facility_code: r.has_valid_coords for r in df.collect()} == {1: True, 2: False, 3: False, 4: False}


def test_bbox_and_swap(spark):
    df = Q.check_swapped_lat_lon(Q.check_out_of_bbox(Q.check_missing_coordinates(points(spark, (1, -76.0, -12.0), (2, 40.0, -3.0), (3, None, None)))))
    got = {r.facility_code: (r.lat, r.lon, r.in_bbox, r.was_coord_swapped) for r in df.collect()}
    assert got == {1: (-12.0, -76.0, True, True), 2: (40.0, -3.0, False, False), 3: (None, None, True, False)}


def test_duplicates_keep_the_first(spark):
    df = points(spark, (100, -12.0, -76.0), (100, -11.0, -76.0), (200, -12.0, -76.0), (None, -1.0, -76.0), (None, -2.0, -76.0))
    assert sorted((r.facility_code or 0, r.lat) for r in Q.check_duplicate_codes(df).collect()) == [(0, -1.0), (100, -12.0), (200, -12.0)]
    assert Q.duplicate_report(df).first().asDict() == {"rule": "duplicate_codes", "n_flagged": 2, "n_involved_rows": 4}


def box(x0, y0, x1, y1):
    return [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]]


def test_containment(spark):
    shapes = spark.createDataFrame(
        [("010101", box(-76.0, -12.0, -75.0, -11.0)), ("010102", box(-75.0, -12.0, -74.0, -11.0)), ("010103", None)], "ubigeo string, polygons array<array<array<array<double>>>>"
    )
    rows = [(1, -11.5, -75.5, "010101", 0), (2, -11.5, -74.5, "010101", 1), (3, -11.5, -75.5, "010103", 2), (4, -11.5, -74.997, "010101", 3), (5, None, None, "010101", 4)]
    df = Q.check_district_containment(Q.check_out_of_bbox(Q.check_missing_coordinates(spark.createDataFrame(rows, POINTS))), shapes)
    assert {r.facility_code: r.within_declared_district for r in df.collect()} == {1: True, 2: False, 3: None, 4: True, 5: None}


def test_census_words(spark):
    rows = [
        ("a", 1, "Total", 100.0, 120.0, 10.0, 14.0), ("a", 1, "Hombres", 140.0, 160.0, 10.0, 15.0),
        ("a", 1, "PROVINCIA", 5.0, 20.0, 30.0, 34.0), ("a", 1, "CUSCO", 25.0, 40.0, 31.0, 34.0), ("a", 1, "12", 100.0, 105.0, 30.0, 34.0), ("a", 1, "345", 108.0, 115.0, 30.0, 34.0),
        ("a", 1, "Wanchaq", 5.0, 20.0, 50.0, 54.0), ("a", 1, "7", 101.0, 103.0, 50.0, 54.0), ("a", 1, "5", 5.0, 8.0, 70.0, 74.0), ("a", 1, "años", 9.0, 12.0, 70.0, 74.0),
        ("a", 2, "San", 5.0, 9.0, 130.0, 134.0), ("a", 2, "Blas", 10.0, 14.0, 131.0, 135.0), ("a", 2, "9", 102.0, 104.0, 130.0, 134.0), ("b", 1, "Nada", 1.0, 2.0, 200.0, 204.0),
    ]
    df = Q.words_to_entries(spark.createDataFrame(rows, "doc string, page long, text string, x0 double, x1 double, top double, bottom double"))
    got = [(r.page, r.level, r.label, r.value, r.province) for r in df.orderBy("page", "row_no").collect()]
    assert got == [(1, "PROVINCIA", "PROVINCIA CUSCO", 12345, "PROVINCIA CUSCO"), (1, "DISTRITO", "Wanchaq", 7, "PROVINCIA CUSCO"), (2, "DISTRITO", "San Blas", 9, "PROVINCIA CUSCO")]


def test_census_digits_beyond_a_long(spark):
    """Numbers of several columns run together: no error, no value, and the digits stay whole."""
    rows = [("a", 1, "Total", 100.0, 120.0, 10.0, 14.0), ("a", 1, "Hombres", 140.0, 160.0, 10.0, 15.0)]
    for top, digits in ((50.0, ["16292417", "326274394313"]), (70.0, ["9223372036854775807"]), (90.0, [])):
        rows += [("a", 1, "Urcos", 5.0, 20.0, top, top + 4)] + [("a", 1, t, 100.0 + k, 105.0 + k, top, top + 4) for k, t in enumerate(digits)]
    df = Q.words_to_entries(spark.createDataFrame(rows, "doc string, page long, text string, x0 double, x1 double, top double, bottom double"))
    assert [(r.value, r.digits) for r in df.orderBy("row_no").collect()] == [(None, "16292417326274394313"), (2**63 - 1, "9223372036854775807"), (None, "")]


def test_tied_words_share_a_row(spark):
    """Words of equal place and text are in one row, the one after the gap, in whatever order they come."""
    rows = [(k, "p", "x" * (k == 0), 0.0, 10.0 * (k > 0)) for k in range(6)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k long, doc string, text string, x0 double, top double").repartition(3)
        assert {(r.k, r.row_no) for r in Q.cluster_rows(df, page=("doc",)).collect()} == {(k, int(k > 0)) for k in range(6)}


PLACES = [(1, "140101", "L", "1"), (2, "140101", "L", "0"), (3, "140101", "L", "0"), (4, "140102", "L", "3"), (5, "140102", "L", "0"), (6, "999999", "L", "0"), (7, None, "L", None)]


def demand(spark):
    places = spark.createDataFrame(PLACES, "demand_id long, ubigeo string, department string, is_capital string")
    return D.apportion_population(places, spark.createDataFrame([("140101", 1020), ("140102", 110), ("", 5), (None, 6)], "ubigeo string, poblacion_2017 long"))


def test_apportion_and_urban(spark):
    got = {r.demand_id: (r.population_est, r.is_urban) for r in D.classify_urban(demand(spark)).collect()}
    assert got == {1: (1000.0, True), 2: (10.0, False), 3: (10.0, False), 4: (100.0, True), 5: (10.0, False), 6: (0.0, False), 7: (0.0, True)}


def test_prepare_demand(spark):
    """Without a cap every place with coordinates comes out, with one a sample."""
    places = spark.range(60).selectExpr("id AS demand_id", "'140101' AS ubigeo", "'L' AS department", "'0' AS is_capital", "id % 6 <> 0 AS has_valid_coords")
    census = spark.createDataFrame([("140101", 1000)], "ubigeo string, poblacion_2017 long")
    assert {(r.demand_id, r.population_est, r.is_urban) for r in D.prepare_demand(places, census, None).collect()} == {(k, 20.0, False) for k in range(60) if k % 6}
    assert D.prepare_demand(places, census, 10).count() == 10


def test_nearest_is_made_once(spark):
    """Whatever reads the access dataset, and however often, the rows of the nearest facilities are made once."""
    from pyspark.sql import functions as F

    from waymetric.operators import metrics as M

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(t):
        made.add(1)
        return t

    points = spark.createDataFrame([(k, "A" if k < 6 else "B", 10.0) for k in range(8)], "demand_id long, department string, population_est double")
    near = spark.createDataFrame([(k, float(k), True) for k in range(5)], "demand_id long, t double, routable boolean").select("demand_id", counted("t").alias("duration_min"), "routable")
    access = M.build_access_dataset(points, near)
    assert {(r.demand_id, r.t_min) for r in access.collect()} == {(k, float(k) if k < 5 else None) for k in range(6)}
    assert [tuple(r) for r in access.groupBy("department").agg(F.max("t_min")).collect()] == [("A", 4.0)]
    assert made.value == 5


def test_sample(spark):
    df = demand(spark)
    assert D.sample_demand(df, 10).count() == 7
    first, again = (sorted(r.demand_id for r in D.sample_demand(df, 2).collect()) for _ in range(2))
    assert first == again and len(first) == 2
    assert 1 in [r.demand_id for r in D.sample_demand(df, 3).collect()]


ACCESS = "demand_id long, t_min double, population_est double, ubigeo string, is_urban boolean, department string, province string"


@pytest.fixture(scope="module")
def access(spark):
    rows = [(1, 10.0, 100.0, "A", True, "D", "P"), (2, 45.0, 50.0, "A", False, "D", "P"), (3, 90.0, 20.0, "B", False, "D", "P"), (4, None, 10.0, "B", False, "D", "Q")]
    return spark.createDataFrame(rows, ACCESS)


def test_bands_add_up(spark, access):
    rows = M.coverage_bands(access).collect()
    assert [r.population for r in sorted(rows)] == [100.0, 50.0, 20.0, 0.0, 10.0] and sum(r.share for r in rows) == pytest.approx(1)
    zero = spark.createDataFrame([(1, 0.0, 5.0, "A", True, "D", "P")], ACCESS)
    assert sum(r.population for r in M.coverage_bands(zero).collect()) == 0
    assert sum(r.population for r in M.coverage_bands(zero, include_zero=True).collect()) == 5


def test_means_and_ranking(access):
    t = M.weighted_mean_access(access, "ubigeo")
    got = {r.ubigeo: (r.mean_access_min, round(r.pct_unroutable, 2), r.n_points) for r in t.collect()}
    assert got["B"] == (90.0, 33.33, 2) and got["A"][0] == pytest.approx((1000 + 45 * 50) / 150)
    assert [r.ubigeo for r in M.critical_gap_ranking(t).collect()] == ["B", "A"]
    assert {r.ubigeo: r.pct_rural for r in M.district_rurality(access).collect()}["B"] == 100


def test_lorenz_and_gini(spark, access):
    curve = sorted((r.cum_population_share, r.cum_access_share) for r in M.lorenz_curve(access).collect())
    assert curve[0] == (0, 0) and curve[-1] == pytest.approx((1, 1)) and 0 < M.gini(access).first().gini < 1
    equal = spark.createDataFrame([(i, 20.0, 10.0 * i, "A", True, "D", "P") for i in (1, 2, 3)], ACCESS)
    assert M.gini(equal).first().gini == pytest.approx(0)
    assert M.gini(equal.where("false")).first().gini is None and M.lorenz_curve(equal.where("false")).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 50)), min_size=1, max_size=30))
def test_gini_is_a_share(spark, rows):
    df = spark.createDataFrame([(i, float(t), float(p), "A", True, "D", "P") for i, (t, p) in enumerate(rows)], ACCESS)
    g = M.gini(df).first().gini
    t = [(a, b) for a, b in rows]
    total = sum(a * b for a, b in t)
    if not total:
        assert g is None
        return
    pairs = sum(abs(a - c) * b * d for a, b in t for c, d in t) / (2 * sum(b for _, b in t) * total)
    assert g == pytest.approx(pairs, abs=1e-9) and 0 <= g + 1e-9 <= 1


MATRIX = "demand_id long, facility_id string, duration_min double, routable boolean, facility_is_resolutive boolean"
ROWS = [(1, "R1", 10.0, True, True), (2, "R1", 15.0, True, True), (3, "A", 20.0, True, False), (4, "A", 25.0, True, False), (3, "B", 22.0, True, False), (1, "C", 5.0, True, False)]


def test_siting(spark):
    matrix = spark.createDataFrame(ROWS, MATRIX)
    people = spark.createDataFrame([(1, "D", 100.0), (2, "D", 200.0), (3, "D", 50.0), (4, "D", 30.0)], "demand_id long, department string, population_est double")
    picks = O.greedy_siting(matrix, people, 30, 5).collect()
    assert [(p.rank, p.facility_id, p.marginal_population_gained, p.cumulative_population_covered) for p in picks] == [(1, "A", 80.0, 380.0)]
    assert O.greedy_siting(matrix, people, 30, 0).count() == 0
    up = O.simulate_upgrade(matrix, people, ["B"], 30).first()
    assert (up.covered_before, up.covered_after, up.gain) == (300.0, 350.0, 50.0) and O.simulate_upgrade(matrix, people, ["none"], 30).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿COD_IPRESS;NOMBRE;UBIGEO;CATEGORIA;ESTADO;NORTE;ESTE\n1;X;80101;ii-1;ACTIVO;-12.5;NaN\n".encode())
    row = T.read_registry(spark, str(tmp_path / "r.csv")).first()
    assert (row.facility_code, row.ubigeo, row.category, row.lat, row.lon, row.address) == ("1", "080101", "II-1", -12.5, None, None)
    geo = '{"type":"FeatureCollection","features":[{"properties":{"IDDIST":"1","NOMBDEP":"D"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"properties":{"IDDIST":"2"},"geometry":null}]}'
    (tmp_path / "g.json").write_text(geo)
    got = {r.ubigeo: r.polygons for r in T.read_boundaries(spark, str(tmp_path / "g.json")).collect()}
    assert got["1"] == [[[[0, 0], [1, 0], [1, 1], [0, 0]]]] and got["2"] is None
    files = spark.createDataFrame([("CSV", "x/REGISTRY_05-08-2026.csv"), ("csv", "x/registry_31-07-2026.csv"), ("pdf", "x/REGISTRY_09-09-2027.csv"), ("csv", "other.csv")], "format string, url string")
    assert T.latest_snapshot(files, "registry").first().url.endswith("05-08-2026.csv") and T.latest_snapshot(files, "none").count() == 0
    raw = spark.createDataFrame([(1, bytearray("añ".encode())), (2, bytearray("añ".encode("latin-1"))), (3, None)], "path long, content binary")
    assert {r.path: (r.encoding, r.failed) for r in T.detect_encoding(raw).collect() if r.path < 3} == {1: ("utf-8", []), 2: ("latin-1", ["utf-8"])}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    assert T.write_missing_partitions(df.where("k = 'a'"), f"file://{tmp_path}/p", ["k"]) == 1 and T.write_missing_partitions(df, f"file://{tmp_path}/p", ["k"]) == 1


def test_report_figures(spark):
    ranking = spark.createDataFrame([("1", "Z", 9.0), ("2", "Y", 8.0), ("3", "Z", 7.0), ("4", "Y", 6.0), ("5", "X", 5.0), ("6", "Y", 4.0)], "ubigeo string, department string, mean_access_min double")
    names = spark.createDataFrame([(str(i), f"d{i}") for i in range(1, 7)], "ubigeo string, district string")
    assert [(r.department, r.n_top, r.place, r.district) for r in I.top_gap_mode(ranking, ranking, names).orderBy("place").collect()] == [("Y", 2, 1, "d2"), ("Y", 2, 2, "d4"), ("Y", 2, 3, "d6")]


def test_missing_partitions_with_null_and_padded_keys(spark, tmp_path):

    path = f"file://{tmp_path}/parts"
    rows = [(1, "010101", "car"), (2, "010101", None), (3, None, "car"), (4, "000300", "foot")]
    first = spark.createDataFrame(rows[:3], "v long, code string, profile string")
    assert T.write_missing_partitions(first, path, ["code", "profile"]) == 3
    assert T.write_missing_partitions(first, path, ["code", "profile"]) == 0
    assert T.write_missing_partitions(spark.createDataFrame(rows, "v long, code string, profile string"), path, ["code", "profile"]) == 1
    assert sorted(tuple(r) for r in T.read_partitions(spark, path, first.schema, ["code", "profile"]).collect()) == sorted(rows, key=lambda r: r[0])
    blank = spark.createDataFrame([(9, "", "")], "v long, code string, profile string")
    assert T.write_missing_partitions(blank, path, ["code", "profile"]) == 1 and T.write_missing_partitions(blank, path, ["code", "profile"]) == 0


def test_partitions_of_a_call_that_died(spark, tmp_path):
    """Rows that a call left behind without publishing are not read, and are written by the next."""
    path, keys = f"file://{tmp_path}/parts", ["k"]
    table = spark.range(200).select("id", (F.col("id") % 5).cast("string").alias("k"))
    assert T.read_partitions(spark, path, table.schema, keys).count() == 0
    assert T.write_missing_partitions(table.where("k = '1'"), path, keys) == 40
    broken = table.withColumn("id", F.when(F.col("id") < 150, F.col("id")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        T.write_missing_partitions(broken, path, keys)
    table.where("id < 90").write.partitionBy("k").parquet(f"{path}/data/run=dead")  # files of a job that died before its manifest
    assert sorted(r.id for r in T.read_partitions(spark, path, table.schema, keys).collect()) == list(range(1, 200, 5))
    assert T.write_missing_partitions(table, path, keys) == 160
    assert sorted(tuple(r) for r in T.read_partitions(spark, path, table.schema, keys).collect()) == sorted(tuple(r) for r in table.collect())


def test_write_table(spark, tmp_path):

    df = spark.createDataFrame([(i, f"n,{i}") for i in range(20)], "i long, name string").repartition(3)
    for _ in range(2):  # again: replaces
        T.write_table(df, f"{tmp_path}/p")
        T.write_table(df, f"{tmp_path}/c", "csv", one_file=True)
    assert spark.read.parquet(f"{tmp_path}/p").count() == 20 and len(list((tmp_path / "c").glob("part-*"))) == 1
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/c").collect()) == sorted((str(i), f"n,{i}") for i in range(20))


def test_registry_reader_finds_the_encoding(spark, tmp_path):

    text = "COD_IPRESS;NOMBRE;UBIGEO;NORTE;ESTE;CATEGORIA\n7;Nu\u00f1oa;10101;-12.5;-76;II-1\n8;Lima;10102;;;0\n"
    for encoding, name in (("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("latin-1", "ISO-8859-1")):
        (tmp_path / encoding).write_bytes(text.encode(encoding))
        assert T.file_encoding(spark, f"file://{tmp_path}/{encoding}") == name
        rows = sorted((r.facility_code, r.facility_name, r.ubigeo, r.lat, r.category) for r in T.read_registry(spark, f"file://{tmp_path}/{encoding}").collect())
        assert rows == [("7", "Nu\u00f1oa", "010101", -12.5, "II-1"), ("8", "Lima", "010102", None, "SIN_CATEGORIA")]


def test_containment_whatever_the_grid(spark, monkeypatch):
    """The same flags on a fine and on a coarse grid; repeated and useless points too."""
    square = lambda x: [[[[x, -12.0], [x + 1, -12.0], [x + 1, -11.0], [x, -11.0], [x, -12.0]]]]
    districts = spark.createDataFrame([("010101", square(-76.0)), ("010102", square(-75.0)), ("010103", None)], "ubigeo string, polygons array<array<array<array<double>>>>")
    rows = [(i, "010101" if i % 3 else "010103", -11.5, -76.2 + i % 9 / 10) for i in range(40)] + [(90, None, -11.5, -75.5), (91, "010102", None, -75.5), (92, "010102", -11.5, None)]
    df = spark.createDataFrame(rows, "i long, ubigeo string, lat double, lon double")
    flags = lambda: {r.i: r.within_declared_district for r in Q.check_district_containment(df, districts).collect()}
    whole = flags()
    assert whole == {i: -76.0046 < lon < -74.99 if code == "010101" else None for i, code, lat, lon in rows}
    monkeypatch.setattr(cover, "EDGE_LENGTHS", 0.02)
    assert flags() == whole


def test_carried_values_across_ranges(spark):
    r = random.Random(3)
    rows = [(d, i, r.choice([None, None, None, i]) if i > 3 else None) for d in ("a", "b", None) for i in range(200)]
    got = {(x.d, x.i): x.c for x in Q.carried(spark.createDataFrame(rows, "d string, i long, v long").where("d is not null"), ["d"], ["i"], "v", "c").collect()}
    last: dict = {}
    for d, i, v in rows:
        last[d] = v if v is not None else last.get(d)
        assert d is None or got[d, i] == last[d]


def test_greedy_siting_of_many_rounds(spark):
    """Twenty rounds against sums from scratch, with people in several departments and ties."""
    r = random.Random(8)
    rows = [(p, f, float(r.randint(1, 90)), 0.0, r.random() < 0.9, f < 4) for p in range(250) for f in r.sample(range(60), r.randint(0, 9))]
    people = [(p, f"d{p % 3}", float(r.choice([0, 1, 5, 5, 8])) if p % 11 else None) for p in range(250)]
    matrix = spark.createDataFrame(rows, "demand_id long, facility_id long, duration_min double, distance_m double, routable boolean, facility_is_resolutive boolean")
    got = {(x.department, x["rank"]): (x.facility_id, x.marginal_population_gained) for x in O.greedy_siting(matrix, spark.createDataFrame(people, "demand_id long, department string, population_est double"), 60.0, 20).collect()}
    pop, home = {p: w or 0.0 for p, _, w in people}, {p: d for p, d, _ in people}
    near = [(p, f, res) for p, f, t, _, ok, res in rows if ok and t <= 60]
    want = {}
    for d in ("d0", "d1", "d2"):
        done = {p for p, _, res in near if res}
        for rank in range(1, 21):
            gain = {}
            for p, f in {(p, f) for p, f, res in near if not res and home[p] == d and p not in done}:
                gain[f] = gain.get(f, 0.0) + pop[p]
            best = min(((-g, f) for f, g in gain.items() if g > 0), default=None)
            if best is None:
                break
            want[d, rank] = (best[1], -best[0])
            done |= {p for p, f, _ in near if f == best[1] and home[p] == d}
    assert got == want and max(k for _, k in want) > 8
