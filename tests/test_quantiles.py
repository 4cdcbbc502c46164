"""Quantiles by refinement equal the aggregate that holds all values."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from waymetric.operators import quantiles as Q

PS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "high": 0.9, "top": 1.0}


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(3)
    rows = [("a", r.random()) for _ in range(3000)] + [("b", 10.0 ** r.uniform(-300, 300)) for _ in range(500)] + [("c", float(r.choice([1, 2, 2, 2, 7]))) for _ in range(800)]
    rows += [(None, r.gauss(0, 1)) for _ in range(77)] + [("one", 4.0), ("none", None), ("two", -1.0), ("two", 5.0)] + [("inf", x) for x in (math.inf, -math.inf, 1.0, 2.0, 3.0, 1.0)]
    return spark.createDataFrame(rows, "k string, x double").repartition(6)


def test_refinement_equals_the_aggregate(table, monkeypatch):
    for by in (("k",), ()):
        got = []
        for held in (Q.HELD, 0):
            monkeypatch.setattr(Q, "HELD", held)
            for sent in (Q.SENT, 0) if by and not held else (Q.SENT,):
                monkeypatch.setattr(Q, "SENT", sent)
                df = table if by else table.where("k <> 'inf'")
                got.append({r["k"] if by else 0: r.asDict() for r in Q.with_quantiles(df, by, F.col("x"), PS, F.count("x").alias("n"), F.max("x").alias("m")).collect()})
        assert len(got) == 2 + len(by) and len(got[0]) == (8 if by else 1)
        for other in got[1:]:
            for k in got[0]:
                for name, x in got[0][k].items():
                    assert other[k][name] == (pytest.approx(x, rel=1e-12, nan_ok=True) if isinstance(x, float) else x), (k, name)


def test_no_task_gathers_a_group(table, monkeypatch):
    """Rounds count in bins before they shuffle."""
    monkeypatch.setattr(Q, "HELD", 0)
    rounds = []
    cut = Q.cut
    monkeypatch.setattr(Q, "cut", lambda df, name="": rounds.append((name, df._jdf.queryExecution().toString())) or cut(df, name))
    Q.with_quantiles(table.where("k = 'a'"), ("k",), F.col("x"), {"mid": 0.5}).collect()
    plans = [p for n, p in rounds if n == "ranks"]
    assert 2 <= len(plans) <= 5 and all("partial_count" in p and not re.search("percentile|collect_", p) for p in plans[1:])


def test_empty(spark, monkeypatch):
    empty = spark.createDataFrame([], "k string, x double")
    for held in (Q.HELD, -1):
        monkeypatch.setattr(Q, "HELD", held)
        assert Q.with_quantiles(empty, ("k",), F.col("x"), PS).count() == 0
        assert [r["mid"] for r in Q.with_quantiles(empty, (), F.col("x"), PS).collect()] == [None]
