"""Chains of order-based steps that share the blocks of their rows shuffle them once."""

from pyspark.sql import functions as F

from wayframe.operators import lines as L
from wayframe.operators import measures as M
from wayframe.operators import ordered as O


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_evenly_spaced_points_take_the_length_from_the_blocks(spark):
    rows = [(k, i, 10 + 0.01 * i, 50.0 + k) for k in (1, 2) for i in range(6)]
    v = spark.createDataFrame(rows, "k int, seq int, lon double, lat double")
    along = L.chainage(v, ["k"])
    plain = along.groupBy("k").agg(F.max("to_km").alias("t"), F.max("seq").alias("s"))
    # The legs are not shuffled once more to meet their line's length.
    assert exchanges(L.sample_evenly(v, ["k"], 4)) == exchanges(along)
    got = {(r.k, r.n): (r.along, r.lon) for r in L.sample_evenly(v, ["k"], 4).collect()}
    for r in plain.collect():
        assert [got[r.k, n][0] for n in range(4)] == [n * (r.t / 3) for n in range(4)]
        assert abs(got[r.k, 3][1] - 10.05) < 1e-9 and got[r.k, 0][1] == 10


def test_gaps_are_filled_in_one_partitioning_and_over_blocks(spark):
    h = {0: 5.0, 9: 23.0, 20: 1.0}
    df = spark.createDataFrame([(k, i, h.get(i)) for k in (1, 2) for i in range(24)], "k int, seq int, h double")
    got = {(r.k, r.seq): r.filled for r in M.fill_gaps(df, "k", "seq", "h", block=8).collect()}
    assert [got[1, i] for i in (0, 4, 9, 12, 20, 23)] == [5, 13, 23, 17, 1, 1] and len(got) == 48
    blocked = df.withColumn("_block", F.floor(F.col("seq") / 8))
    one = O.carry(blocked, ["k"], "seq", "h", "a", block="_block")
    assert "_block" in one.columns
    assert exchanges(O.carry(one, ["k"], "seq", "h", "b", forward=False, block="_block")) < exchanges(
        O.carry(O.carry(df, ["k"], "seq", "h", "a"), ["k"], "seq", "h", "b", forward=False))
