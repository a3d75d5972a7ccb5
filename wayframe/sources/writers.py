"""Sinks (S-7..S-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lines import simplify, to_fragments
from ..operators.ordered import positions


def write_geometry(vertices: DataFrame, routes: DataFrame, path: str, key: str, tolerance_deg: float, decimals: int = 4) -> None:
    """S-8: simplified, rounded lines in one dataset partitioned by system and jurisdiction.

    ``vertices`` has key, line, main (true for driven lines), seq, lon, lat; ``routes`` has
    key, system, st.  A line is written as blocks of at most 1024 vertices, numbered in
    order, so a route of any size is written by many tasks.
    """
    lines = [key, "line"]
    kept = simplify(vertices, lines, tolerance_deg)
    # Blocks are cut by position, so what is kept is numbered again without holes.
    kept = positions(kept, lines, [F.col("seq")], "seq", name="_n").withColumn("seq", (F.col("_n") - 1).cast("int")).drop("_n")
    m = 10.0 ** decimals
    rounded = kept.withColumn("lon", F.floor(F.col("lon") * m + 0.5) / m).withColumn("lat", F.floor(F.col("lat") * m + 0.5) / m)
    blocks = to_fragments(rounded, lines)
    tagged = blocks.join(vertices.select(*lines, "main").distinct(), lines).join(routes.select(key, "system", "st"), key)
    tagged.write.mode("overwrite").partitionBy("system", "st").parquet(path)


def write_index(routes: DataFrame, path: str, fields: list[str], miles: str, key: str) -> None:
    """S-9: the lean index, longest first."""
    routes.select(*fields).orderBy(F.col(miles).desc(), F.col(key)).write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """S-7, S-10: the whole dataset is replaced, so partitions that are no longer produced go away."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def point_index(points: DataFrame, state: str) -> DataFrame:
    """S-11: count and bounding box of the points of each jurisdiction."""
    return points.groupBy(state).agg(F.count(F.lit(1)).alias("points"), F.round(F.min("lon"), 6).alias("x0"), F.round(F.min("lat"), 6).alias("y0"),
                                     F.round(F.max("lon"), 6).alias("x1"), F.round(F.max("lat"), 6).alias("y1"))


def geojson_lines(blocks: DataFrame, key: str) -> DataFrame:
    """S-8: written blocks as GeoJSON feature texts, one per block."""
    coords = F.transform("coords", lambda c: F.array(c["lon"], c["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col(key).alias("id")).alias("properties"),
                       F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))
    return blocks.select(key, F.to_json(feature).alias("feature"))
