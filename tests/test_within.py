"""The neighbour test of lines sends the other points once, spread over few cells."""

from pyspark.sql import functions as F

from wayframe.operators import grid


def test_others_are_sent_once_over_few_cells(spark):
    place = lambda df: df.withColumn("k", F.col("id") % 3).withColumn("lon", F.col("id") * 0.0013 - 120).withColumn("lat", 26 + F.col("id") * 0.0007)
    samples = place(spark.range(2_000)).withColumn("at", F.col("id").cast("double"))
    others = samples.select("k", F.col("at").alias("oat"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    hit = grid.within(samples, others, 0.5, ["k"], also=F.abs(F.col("a.at") - F.col("b.oat")) >= 2)
    want = {a for a in range(2_000) for b in (a - 3, a + 3) if 0 <= b < 2_000}  # 0.46 km off; all others are beyond 0.9 km
    assert {r.id for r in hit.collect()} == want
    # One shuffle of each side; before, the others were also made distinct.
    plan = hit._jdf.queryExecution().sparkPlan().toString() + grid.within(samples, others, 0.5, ["k"], also=F.col("a.at") != F.col("b.oat"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
