"""Values that lie on the edge of a rounding, or are zero, against SQL."""

import datetime

import duckdb
import pytest

from tidewright.plans import registry


def differing(spark, at, name, events):
    """Rows of a query over events (event_id, user_id, value) that its SQL has not, or has alone."""
    rows = [(e, datetime.datetime(2024, 1, 1), u, "view", v, "{}") for e, u, v in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{at}/events.parquet")
    df = registry.QUERIES[name](spark, str(at))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet/*.parquet')")
    cursor = con.execute(registry.ORACLES[name])
    want = [tuple(r) for r in cursor.fetchall()]
    got = [tuple(r) for r in df.select(*(f"`{d[0]}`" for d in cursor.description)).collect()]
    assert len(got) == len(want) == len(events)
    return set(got) ^ set(want)


#: Their indices are five hundredths exactly, before rounding to a tenth.
EDGES = [115231, 154015, 343359, 380051, 503335, 536299]


def test_sea_points_on_the_edge_of_a_tenth(spark, tmp_path):
    assert not differing(spark, tmp_path, "sea_points", [(e, e % 1500, 50.0) for e in EDGES])


def test_conditions_on_the_edge_of_a_tenth(spark, tmp_path):
    assert not differing(spark, tmp_path, "conditions_series", [(e, e % 1500, 50.0) for e in EDGES])


def test_directions_of_calms(spark, tmp_path):
    assert not differing(spark, tmp_path, "wind_components", [(e, e % 1500, v) for v in (0.0, 50.0) for e in range(360 * (v > 0), 360 + 360 * (v > 0))])
