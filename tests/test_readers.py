"""Files that several tasks read: JSON arrays cut at braces, encodings judged by line."""

import json
import random

import pytest

from waymetric.sources import tables as T


def odd(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "a", "ñ", " ", '"}', "\\\\", '":[{']) for _ in range(r.randint(0, 30)))


def collection(r, n, **members):
    features = [
        {
            "type": "Feature", "id": i, "properties": {"IDDIST": f"{i:06d}", "NOMBDEP": odd(r), "NOMBDIST": odd(r), "more": [{"x": [odd(r)]}]},
            "geometry": r.choice([None, {"type": "Polygon", "coordinates": [[[0.5, i], [1, 0], [1, 1], [0.5, i]]]}]),
        }
        for i in range(n)
    ]
    return {"type": "FeatureCollection", "bbox": [1, 2, 3, 4], "crs": {"type": "name", "properties": {"name": "urn:x"}}, "features": features, **members}


@pytest.mark.parametrize("split", [97, 1 << 20])
def test_features_of_files_cut_into_splits(spark, tmp_path, split):
    r = random.Random(split)
    whole = [collection(r, 60), collection(r, 0), collection(r, 1, notes=["a", {"type": "Note"}]), collection(r, 25)]
    for k, (c, style) in enumerate(zip(whole, ({}, {}, {"indent": 1}, {"indent": 2, "ensure_ascii": False}), strict=True)):
        (tmp_path / f"{k}.json").write_text(json.dumps(c, **style) + "\n" * (k % 2))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = T.array_objects(spark, str(tmp_path)).collect()
        flat = T.read_boundaries(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    for k, c in enumerate(whole):
        mine = sorted((x.number, json.loads(x.object)) for x in got if x.file.endswith(f"/{k}.json")) if k != 2 else []
        assert k == 2 or [o for _, o in mine] == c["features"], k
    want = [(f["properties"]["IDDIST"], f["properties"]["NOMBDEP"], f["geometry"] and [f["geometry"]["coordinates"]]) for c in whole for f in c["features"]]
    key = lambda x: (x[0], x[1])
    assert sorted(((x.ubigeo, x.department, x.polygons) for x in flat), key=key) == sorted(want, key=key)


def test_encodings_of_whole_files(spark, tmp_path):
    lines = ["plain text", "año niñez", "línea"] * 400
    for name, raw in {
        "a": "\n".join(lines).encode(), "b": "\r\n".join(lines).encode("latin-1"), "c": b"", "d": b"only ascii", "e": b"\x93quoted\x94\n", "f": b"\x81\n", "g": "\n".join(lines).encode()[:-1] + b"\xff",
    }.items():
        (tmp_path / name).write_bytes(raw)
    got = lambda *c: {r.path[-1]: (r.encoding, r.failed) for r in T.detect_file_encoding(spark, str(tmp_path), *c).collect()}
    first = ("utf-8", [])
    assert got() == {n: first for n in "ad"} | {n: ("latin-1", ["utf-8"]) for n in "befg"}
    strict = ("ascii", "utf-8", "cp1252")
    assert got(strict) == {
        "a": ("utf-8", ["ascii"]), "b": ("cp1252", ["ascii", "utf-8"]), "d": ("ascii", []), "e": ("cp1252", ["ascii", "utf-8"]), "f": (None, [*strict]),
        "g": ("cp1252", ["ascii", "utf-8"]),
    }
    with pytest.raises(ValueError):
        got(("utf-16",))


def test_a_required_snapshot_that_is_missing(spark):
    files = spark.createDataFrame([("csv", "x/registry_31-07-2026.csv")], "format string, url string")
    assert T.latest_snapshot(files, "registry", required=True).first().day == 31
    with pytest.raises(Exception, match="no file none_"):
        T.latest_snapshot(files, "none", required=True).collect()
