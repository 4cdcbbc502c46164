"""The registered queries on the smallest tables, against their SQL."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from waymetric.plans.oracles import ORACLES
from waymetric.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: One of each family; the driver compares all of them.
CHECKED = ["access_by_department", "gini_access", "quality_report", "greedy_siting", "walk_car_ratio", "road_edges", "parse_tags", "kpi_header", "sample_demand_points", "latest_snapshot"]


def values(frame, columns):
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=lambda r: tuple(map(str, r)))


def test_names():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got, sorted(got.columns)) == values(want, sorted(got.columns))


LARGER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_prepare_demand_is_whole_beyond_the_cap(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("customer", "nation", "region", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    got, want = QUERIES["prepare_demand"](spark, LARGER).toPandas(), c.sql(ORACLES["prepare_demand"]).df()
    assert len(want) > 5000 and values(got, sorted(got.columns)) == values(want, sorted(got.columns))
