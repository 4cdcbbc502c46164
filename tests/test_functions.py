"""Column functions and geometry."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymetric.functions import scalars as S
from waymetric.functions.geometry import utm_project
from waymetric.plans import queries as Q

from .plain_geometry import line_meets, utm_arrays, within


@pytest.fixture(scope="module")
def one(spark):
    def run(column, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        return [r[0] for r in spark.createDataFrame(rows, f"i int, x {kind}").select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]

    return run


def test_normalize_category(one):
    raw = ["I-1", "ii-1", "III-E", "II 2", "0", "", None, "GARBAGE", "I1", "IE", " i - 4\t", "IV-1", "S/C"]
    none = "SIN_CATEGORIA"
    assert one(S.normalize_category, raw) == ["I-1", "II-1", "III-E", "II-2", none, none, none, none, "I-1", "I-E", "I-4", none, none]


def test_pad_code_keeps_long_codes_and_null(one):
    assert one(S.pad_code, ["12", "123456", "1234567", None]) == ["000012", "123456", "1234567", None]


def test_parse_tags_last_value_wins(one):
    got = one(S.parse_tags, ['"a"=>"1","b"=>"x y","a"=>"2"', None, "", 'junk "k"=>"a \\"q\\""'])
    assert got == [{"a": "2", "b": "x y"}, {}, {}, {"k": 'a \\"q\\"'}]


def test_access_and_speed(spark):
    df = spark.createDataFrame([("primary", {"access": "private"}), ("track", {"foot": "no"}), ("odd", {})], "h string, t map<string,string>")
    got = df.select(S.access_excluded(F.col("t"), "car"), S.access_excluded(F.col("t"), "foot"), S.edge_speed_kmh(F.col("h"), "car"), S.highway_allowed(F.col("h"), "car")).collect()
    assert [tuple(r) for r in got] == [(True, True, 60.0, True), (False, True, 15.0, False), (False, False, 40.0, True)]


def plain(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def key(t):
    return re.sub("[^A-Za-z]", "", plain(t).encode("ascii", "ignore").decode().title())


def test_names_of_every_code_point(spark):
    """Each alone between letters, and all kinds of writing, against Python's decomposition."""
    texts = [f"a{chr(c)}b" for c in (*range(1, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200))]
    texts += ["Nguyễn Thị Hồng Nhung", "Příliš žluťoučký kůň", "ＦＵＬＬ ｗｉｄｔｈ　９", "cafe\u0301 n\u0303o", "½ ﬁn ㎏ Ⅳ ⑴ 한국어 ﷺ", "\U0001d400\U0001f600 straße", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: (r.n, r.k) for r in df.select("i", S.normalize_name(F.col("t")).alias("n"), S.name_key(F.col("t")).alias("k")).collect()}
    words = lambda t: re.sub(r"\s+", " ", re.sub("[^A-Z0-9 ]", " ", plain(t).upper())).strip()
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != ((words(t), key(t)) if t is not None else (None, None))]
    assert not wrong, wrong[:5]


def test_names(one):
    assert one(S.normalize_name, ["San Martín-de  Porres!"]) == ["SAN MARTIN DE PORRES"]
    assert one(S.title_es, ["CALIDAD Y SALUD", "PAUCARTAMBO", "EL ALTO DE LA PAZ"]) == ["Calidad y Salud", "Paucartambo", "el Alto de la Paz"]
    assert one(S.title_es, ["O'HIGGINS SAN-MARTIN", " dos   y 3º de ÁNCASH\t", "", None]) == ["O'Higgins San-Martin", "Dos y 3º de Áncash", "", None]
    assert one(lambda c: S.title_es(c, True), ["LA UNION DEL SUR", "EL ALTO", "SAN-MARTIN"]) == ["La Union del Sur", "El Alto", "San-martin"]
    assert one(S.name_key, ["San Martín", "Lambayeque"]) == ["SanMartin", "Lambayeque"]


def test_registered_names_read_whole_texts(spark, tmp_path):
    """Texts far longer than a line, against plain Python."""
    texts = ["San Martín-de  Porres!\n" * 300 + "EL Último, ß y 7", "de la UNIÓN\t" + "x" * 5000 + " del Señor", "corto", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda f: {r[0]: tuple(r[1:]) for r in f(spark, str(tmp_path)).collect()}
    names = [t if t is None else " ".join(re.sub("[^A-Z0-9 ]", " ", plain(t).upper()).split()) for t in texts]
    keys = [t if t is None else key(t) for t in texts]
    words = lambda t: t.lower().split()
    small = {"y", "de", "del", "la", "las", "los"}
    titles = [(t, t) if t is None else (" ".join(w if w in small | {"el"} else w.title() for w in words(t)), " ".join(w if i and w in small else w.capitalize() for i, w in enumerate(words(t)))) for t in texts]
    assert run(Q.normalize_name) == {i: (x,) for i, x in enumerate(names)} and len(names[0]) > 6000
    assert run(Q.name_key) == {i: (x,) for i, x in enumerate(keys)} and len(keys[0]) > 5000
    assert run(Q.title_es) == dict(enumerate(titles)) and len(titles[1][0]) > 5000


def test_haversine(spark):
    row = spark.range(1).select(S.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), S.haversine_m(F.lit(5.0), F.lit(7.0), F.lit(5.0), F.lit(7.0))).first()
    assert row[0] == pytest.approx(111194.93, abs=0.01) and row[1] == 0


def test_projection(spark):
    x, y = utm_project(F.lit(-75.0), F.lit(0.0), 18)
    row = spark.range(1).select(x, y).first()
    assert row[0] == pytest.approx(500000) and row[1] == pytest.approx(10000000)
    # the meridian from the equator to 45 degrees is 4,984,944.378 m long
    px, py = utm_arrays(np.array([-75.0, -74.0, -76.0]), np.array([45.0, 10.0, 10.0]), 18, south=False)
    assert py[0] == pytest.approx(4984944.378 * 0.9996, abs=0.001) and px[1] - 500000 == pytest.approx(500000 - px[2]) and py[1] == pytest.approx(py[2])


def test_polygon_helpers():
    square = [np.array([[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], float), np.array([[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]], float)]
    px, py = np.array([3.0, 1.5, 5.0, 4.4]), np.array([3.0, 1.5, 2.0, 2.0])
    assert within(px, py, square, 0.1).tolist() == [True, False, False, False]
    assert within(px, py, square, 0.5).tolist() == [True, False, False, True] or within(px, py, square, 0.5)[3]
    assert line_meets(np.array([[-1, 2], [5, 2]], float), square[:1]) and not line_meets(np.array([[-1, 5], [5, 5]], float), square[:1])
