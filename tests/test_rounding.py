"""Rounding as in SQL: the sign of a zero, and the logarithm of one."""

import math

from pyspark.sql import functions as F

from fathomry.functions import scalars as S


def test_rounding_keeps_the_sign_of_a_zero(spark):
    values = [-1e-9, -0.0, 0.0, 1e-9, -0.25, 0.35, -0.35, float("inf"), float("-inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.rounded("v", 1)).collect()]
    assert [repr(x) for x in got] == ["-0.0", "-0.0", "0.0", "0.0", "-0.3", "0.4", "-0.4", "inf", "-inf", "nan", "None"]


def test_queries_round_so(spark):
    from fathomry.plans import scalar_queries

    got = spark.range(1).select(scalar_queries.rs(F.array(F.lit(-1e-9), F.lit(1e-9)))).first()[0]
    assert [math.copysign(1, v) for v in got] == [-1, 1]


def test_decibels_of_zero(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (100.0,), (None,)], "v double").select(S.decibels(F.col("v"))).collect()]
    assert got == [float("-inf"), 20.0, None]


def test_decibels_of_less_than_zero(spark):
    got = [r[0] for r in spark.createDataFrame([(-1e-9,), (float("-inf"),), (float("nan"),), (-0.0,), (float("inf"),)], "v double").select(S.decibels(F.col("v"))).collect()]
    assert [repr(v) for v in got] == ["nan", "nan", "nan", "-inf", "inf"]


def test_bytes_of_what_is_no_number(spark):
    values = [float("nan"), None, float("inf"), float("-inf"), -0.6, 254.49, 254.5, 1e300]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.clip_uint8(F.col("v"))).collect()]
    assert got == [255, 255, 255, 0, 0, 254, 255, 255]


def test_decibels_of_odd_events_as_in_sql(spark, sf, tmp_path):
    import duckdb

    from fathomry.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"""CREATE TABLE events AS SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, user_id, event_type,
    CASE event_id % 7 WHEN 0 THEN -value WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE value END AS value, CASE WHEN event_id % 13 <> 0 THEN props END AS props FROM read_parquet('{sf}/events.parquet')""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = con.execute(ORACLES["f19_math"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in QUERIES["f19_math"](spark, str(tmp_path)).collect())
