"""End-to-end tables on small inputs, and the contracts that must fail a job."""

import pytest
from pyspark.sql import functions as F

from wayframe.functions.geo import tile_address
from wayframe.operators import attach, quality
from wayframe.operators.lines import sample_evenly
from wayframe.plans.overlays import elevation_profiles
from wayframe.sources import readers


def test_heights_bridge_water_and_carry_what_is_missing(spark):
    line = spark.createDataFrame([("a", i, 10.0 + i, 45.0) for i in range(6)], "k string, seq int, lon double, lat double")
    metres = {0: 100.0, 1: -5.0, 2: 300.0, 4: -1.0, 5: -1.0}
    points = sample_evenly(line, ["k"], 6).withColumn("t", tile_address(F.col("lon"), F.col("lat"), 9))
    known = spark.createDataFrame(list(metres.items()), "n bigint, metres double")
    pixels = points.join(known, "n").select("t.*", "metres")
    got = [r.ft for r in elevation_profiles(line, pixels, "k", samples=6).orderBy("n").collect()]
    # 100 m, water between 328 and 984 ft, 300 m, nothing there: as before, then water to the end, level with its one bank.
    assert got == [328.0, 656.0, 984.0, 984.0, 984.0, 984.0]


def test_missing_columns_fail(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="missing columns name"):
        readers.require_columns(df, ["id", "name"], "towns")
    assert readers.undocumented_columns(df.withColumn("x", F.lit(1)), ["id"]) == ["x"]


def test_unclaimed_headings_fail(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "k int, Foo double, Bar double")
    with pytest.raises(ValueError, match="without a highway"):
        readers.headed_columns(df, ["k"], {"Route One": "1", "Route Two": "2"})


def test_correction_of_a_changed_figure_fails(spark):
    listed = spark.createDataFrame([("9", 5.0)], "number string, mi double")
    fixes = spark.createDataFrame([("9", 4.0, 6.0)], "number string, published double, corrected double")
    with pytest.raises(Exception, match="published value changed"):
        attach.correct(listed, fixes, ["number"], "mi").collect()


def test_errors_stop_the_job_and_warnings_do_not(spark):
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    quality.require_none(quality.violation(rows, "odd", "k", severity="warning"))
    with pytest.raises(ValueError, match="odd a"):
        quality.require_none(quality.violation(rows, "odd", "k"))
