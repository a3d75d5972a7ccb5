"""Order-based operators with tiny blocks and buckets, so that every seam is crossed, and hot keys."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayframe.operators import ordered as O
from wayframe.runtime import skew_join


def rows(n=4000, seed=5):
    r = random.Random(seed)
    # One key holds most rows, and values repeat.
    return [("hot" if r.random() < 0.7 else f"k{r.randrange(6)}", r.randrange(400), float(r.randrange(1, 9)), i) for i in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "k string, v int, w double, id int")


def test_quantiles_follow_each_rule(spark):
    data = rows()
    got = {r.k: r for r in O.quantiles(table(spark, data), ["k"], "v", {
        "mid": ("middle", 0.5), "low": ("index", 0.1), "high": ("index", 0.9), "up": ("upper", 0.5)}, buckets=4, levels=3).collect()}
    heavy = {r.k: r.m for r in O.quantiles(table(spark, data), ["k"], "v", {"m": ("weighted", 0.5)}, weight="w", buckets=8).collect()}
    for k in {d[0] for d in data}:
        v = sorted(d[1] for d in data if d[0] == k)
        n = len(v)
        assert got[k].mid == np.median(v)
        assert got[k].low == v[int((n - 1) * 0.1)] and got[k].high == v[int((n - 1) * 0.9)]
        assert got[k].up == v[n // 2]
        total, run = sum(d[2] for d in data if d[0] == k), 0.0
        for x in sorted(set(v)):
            run += sum(d[2] for d in data if d[0] == k and d[1] == x)
            if run >= total / 2:
                assert heavy[k] == x
                break


def test_quantiles_of_short_keys(spark):
    one = spark.createDataFrame([("a", 3), ("b", 1), ("b", 2)], "k string, v int")
    got = {r.k: (r.mid, r.up, r.p) for r in O.quantiles(one, ["k"], "v", {"mid": ("middle", 0.5), "up": ("upper", 0.5), "p": ("index", 0.9)}).collect()}
    assert got == {"a": (3.0, 3, 3), "b": (1.5, 2, 1)}


def test_positions_are_row_numbers(spark):
    data = rows()
    for down in (False, True):
        lead = F.col("v").desc() if down else F.col("v")
        got = {r.id: r.position for r in O.positions(table(spark, data), ["k"], [lead, F.col("id")], "v", descending=down, buckets=4, levels=1 + down).collect()}
        for k in {d[0] for d in data}:
            mine = sorted((d for d in data if d[0] == k), key=lambda d: (-d[1] if down else d[1], d[3]))
            assert [got[d[3]] for d in mine] == list(range(1, len(mine) + 1))


def test_running_sum_crosses_blocks(spark):
    data = rows(1000)
    got = {r.id: r.s for r in O.running_sum(table(spark, data), ["k"], "id", "w", "s", block=16).collect()}
    for k in {d[0] for d in data}:
        run = 0.0
        for d in sorted((d for d in data if d[0] == k), key=lambda d: d[3]):
            run += d[2]
            assert abs(got[d[3]] - run) < 1e-9


def test_carry_both_ways(spark):
    data = [("a", i, i if i % 37 == 5 else None) for i in range(300)]
    df = spark.createDataFrame(data, "k string, seq int, x int")
    back = {r.seq: r.c for r in O.carry(df, ["k"], "seq", "x", "c", block=8).collect()}
    ahead = {r.seq: r.c for r in O.carry(df, ["k"], "seq", "x", "c", forward=False, block=8).collect()}
    for i in range(300):
        before = [j for j in range(i + 1) if j % 37 == 5]
        after = [j for j in range(i, 300) if j % 37 == 5]
        assert (back[i].value if back[i] else None) == (before[-1] if before else None)
        assert (ahead[i].value if ahead[i] else None) == (after[0] if after else None)


def test_salted_join_gives_the_same_rows(spark):
    left = table(spark, rows())
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        cols = left.columns if "_" in how else [*left.columns, "y"]
        salted = skew_join(left, right, ["k"], how).select(*cols)
        plain = left.join(right, "k", how).select(*cols)
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_top_k_limits_before_the_shuffle(spark):
    df = O.top_k(table(spark, rows()), ["k"], [F.col("v"), F.col("id")], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.groupBy("k").count().filter("count > 3").isEmpty()


def test_intervals_merge_across_stretches(spark):
    r = random.Random(2)
    data = [("a", x := r.uniform(0, 4000), x + r.uniform(0, 30)) for _ in range(150)]
    got = sorted((x.a, x.b) for x in O.merge_intervals(spark.createDataFrame(data, "k string, a double, b double"), ["k"], "a", "b", 5).collect())
    want = []
    for _, a, b in sorted(data, key=lambda d: d[1]):
        if want and a - want[-1][1] < 5:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    assert got == [tuple(w) for w in want]
