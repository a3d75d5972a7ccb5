"""Names and titles that many roads bear are looked for once."""

from pyspark.sql import functions as F

from wayframe.operators import matching


def looked_for(monkeypatch):
    rows, join = [], matching.contains_join

    def counted(texts, text, needles, needle, on=(), letters=matching.LETTERS):
        rows.append((texts.count(), needles.count()))
        return join(texts, text, needles, needle, on, letters)
    monkeypatch.setattr(matching, "contains_join", counted)
    return rows


def test_ends_of_names_are_looked_for_once(spark, monkeypatch):
    rows = looked_for(monkeypatch)
    register = spark.range(120).select(F.lit("s").alias("st"), (F.col("id") % 4).alias("num"), F.when(F.col("id") % 2 == 0, "Alpha - Omega").otherwise("Omega - Gamma").alias("name"), F.col("id").alias("road"))
    ours = spark.range(90).select(F.lit("s").alias("st"), (F.col("id") % 3).alias("num"), F.lit("Omega to Alpha").alias("name"))
    got = sorted(map(tuple, matching.number_verdicts(register, ours, "st", "num", "name", "road").collect()))
    assert got == [("s", 0, "agree"), ("s", 1, "numberOnly"), ("s", 2, "agree"), ("s", 3, "notFound")]
    assert rows == [(1, 3)]  # before: 3 texts, 240 ends


def test_titles_of_one_text_are_met_once(spark, monkeypatch):
    rows = looked_for(monkeypatch)
    titles = spark.range(60).select(F.col("id").alias("title"), F.when(F.col("id") % 2 == 0, "Autopista Alpha-Omega y Norte").otherwise("Gamma Libre Real").alias("object"))
    titles = titles.union(spark.sql("SELECT 0L, 'Gamma Libre Real'"))
    states = spark.range(60).select(F.col("id").alias("title"), F.lit("s").alias("st")).union(spark.sql("SELECT 2L, 't'"))
    roads = spark.range(50).select(F.when(F.col("id") < 49, "s").otherwise("t").alias("st"), F.col("id").alias("road"), F.when(F.col("id") % 5 == 0, "Omega - Alpha").otherwise("Libre Real").alias("name"))
    points = spark.createDataFrame([("s", 5, "Alpha"), ("s", 5, "Omega"), ("s", 70, "Alpha"), ("s", 70, "Omega"), ("t", 71, "Alpha")], "st string, road bigint, place string")
    got = sorted(map(tuple, matching.propose(titles, states, roads, points, "title", "object", "st", "road", "name", "place").collect()))
    ends, real = [r for r in range(49) if r % 5 == 0], [r for r in range(49) if r % 5]
    want = [(t, r, "road") for t in range(60) for r in (ends if t % 2 == 0 else real)] + [(0, r, "road") for r in real] + [(t, 70, "points") for t in range(0, 60, 2)]
    assert got == sorted(want)
    assert rows == [(6, 3)]  # before: each title and each road
