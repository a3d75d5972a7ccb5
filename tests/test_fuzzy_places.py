"""Candidates of one name, and crossings of one town, are met once."""

from pyspark.sql import functions as F

from wayframe.operators import matching


def test_names_are_met_once(spark, monkeypatch):
    rows, join = [], matching.skew_join

    def counted(left, right, on, how="inner"):
        out = join(left, right, on, how)
        rows.append(out.count())
        return out
    monkeypatch.setattr(matching, "skew_join", counted)
    province = F.when(F.col("id") % 2 == 0, "p").otherwise("q")
    crossings = spark.range(100).select(F.col("id").alias("crossing"), province.alias("province"), F.when(F.col("id") % 20 < 10, "harbour").otherwise("oldtown").alias("town"))
    candidates = spark.range(200).select(F.col("id").alias("place"), province.alias("province"), F.when(F.col("id") % 3 == 0, "old harbour").otherwise("harbour bridge").alias("name"),
                                         F.when(F.col("id") < 50, 2).otherwise(1).alias("rank"), F.when(F.col("id") < 60, 9.0).otherwise(3.0).alias("km"))
    got = sorted(map(tuple, matching.fuzzy_places(crossings, candidates, "crossing", "province", "town", "name", "place", "rank", "km").collect()))
    assert got == [(k, 60 + k % 2, 1, 3.0) for k in range(100) if k % 20 < 10]
    assert max(rows) < 100  # before: each crossing with each candidate
