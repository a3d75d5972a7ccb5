"""Lines as vertex rows: lengths, sampling, simplification, chaining (P-3, P-4, P-6, P-7, G-1..G-5, G-22, G-26).

A line is rows (keys, seq, lon, lat) with ``seq`` counting from 0 without holes.  Neighbours
are found within blocks of a line, so no line has to fit one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine, line_km, offset_deg, project, runs_forward
from ..runtime import cut, skew_join
from .grid import nearest_leg_in_rings, within_deg
from .ordered import running_sum

BLOCK_VERTICES = 1024


def to_vertices(lines: DataFrame, keys: list[str], coords: str) -> DataFrame:
    """Fragments with a coordinate array as vertex rows."""
    return (lines.select(*keys, F.posexplode(coords).alias("seq", "_c"))
            .select(*keys, F.col("seq"), F.col("_c.lon").alias("lon"), F.col("_c.lat").alias("lat")))


def to_fragments(vertices: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Vertex rows of source fragments as coordinate arrays.

    Long lines come out as several blocks of at most ``BLOCK_VERTICES`` vertices, each
    starting with the last vertex of the block before, so an array stays small.
    """
    here = F.floor(F.col(seq) / BLOCK_VERTICES).cast("int")
    # A block's first vertex is also the last of the block before, and goes to both in one reading.
    seam = (F.col(seq) % BLOCK_VERTICES == 0) & (F.col(seq) > 0)
    rows = vertices.withColumn("block", F.explode(F.when(seam, F.array(here - 1, here)).otherwise(F.array(here)))).groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_s"), "lon", "lat"))).alias("_v"))
    coords = F.transform("_v", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
    return rows.select(*keys, "block", coords.alias("coords")).filter((F.size("coords") > 1) | (F.col("block") == 0))


def legs(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Straight legs (keys, seq, ax, ay, bx, by, km); ``seq`` is that of the leg's second vertex."""
    return _legs_in_blocks(vertices, keys).drop("_block")


def _legs_in_blocks(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Legs with the block of their second vertex."""
    here = F.floor(F.col("seq") / BLOCK_VERTICES)
    # The last vertex of a block is also the one before the first of the next, so neighbours are found within blocks.
    last = F.col("seq") % BLOCK_VERTICES == BLOCK_VERTICES - 1
    blocks = (vertices.select(*keys, "seq", "lon", "lat", F.explode(F.when(last, F.array(here, here + 1)).otherwise(F.array(here))).alias("_block")))
    w = W.partitionBy(*keys, "_block").orderBy("seq")
    return (blocks.select(*keys, "_block", "seq", F.lag("seq").over(w).alias("_p"), F.lag("lon").over(w).alias("ax"), F.lag("lat").over(w).alias("ay"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
            .filter(F.col("_p") == F.col("seq") - 1).drop("_p").withColumn("km", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))))


def fragment_legs(lines: DataFrame, keys: list[str], coords: str) -> DataFrame:
    """Legs of fragments with coordinate arrays: one narrow pass, no join."""
    pairs = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords) - 1),
                       lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")))
    return (lines.filter(F.size(coords) >= 2).select(*keys, F.posexplode(pairs).alias("_p", "_l"))
            .select(*keys, (F.col("_p") + 1).alias("seq"), "_l.*")
            .withColumn("km", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))))


def lengths(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """P-3: length of each line in km."""
    return legs(vertices, keys).groupBy(*keys).agg(F.sum("km").alias("km"))


def chainage(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """P-4: legs with the distance along the line at which each starts and ends."""
    # A leg starts exactly where the one before ends.  Sums run in the blocks in which neighbours were found, so rows are shuffled once.
    return running_sum(_legs_in_blocks(vertices, keys), keys, "seq", "km", "to_km", before="from_km", block="_block")


def extents(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """P-7: bounding box of each line."""
    return vertices.groupBy(*keys).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))


def _on_leg(t: Column) -> list[Column]:
    return [(F.col("ax") + (F.col("bx") - F.col("ax")) * t).alias("lon"), (F.col("ay") + (F.col("by") - F.col("ay")) * t).alias("lat")]


def resample(vertices: DataFrame, keys: list[str], step_km: float) -> DataFrame:
    """G-2: a point every ``step_km`` from the start (keys, n, along, lon, lat).

    Each leg emits the points that fall on it, so no range join is needed.
    """
    return _points_at(chainage(vertices, keys), keys, F.lit(float(step_km)), None)


def sample_evenly(vertices: DataFrame, keys: list[str], n: int) -> DataFrame:
    """G-2: ``n`` evenly spaced points, ends included."""
    along = running_sum(_legs_in_blocks(vertices, keys), keys, "seq", "km", "to_km", before="from_km", block="_block", total="_total", last="_last")
    return _points_at(along.filter(F.col("_total") > 0), keys, F.col("_total") / (n - 1), n)


def _points_at(along: DataFrame, keys: list[str], step: Column, n: int | None) -> DataFrame:
    first = F.when(F.col("seq") == 1, F.lit(0)).otherwise(F.floor(F.col("from_km") / step) + 1)
    last = F.floor(F.col("to_km") / step)
    if n is not None:
        last = F.when(F.col("seq") == F.col("_last"), F.lit(n - 1)).otherwise(F.least(last, F.lit(n - 2)))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("n") * step - F.col("from_km")) / F.greatest(F.col("km"), F.lit(1e-9))))
    return (along.filter(first <= last).withColumn("n", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
            .select(*keys, "n", (F.col("n") * step).alias("along"), *_on_leg(t)))


def walk(along: DataFrame, keys: list[str], step_km: float, from_km: str = "from_km", to_km: str = "to_km") -> DataFrame:
    """G-3: points at whole multiples of ``step_km`` strictly inside the legs (keys, along, lon, lat)."""
    first = F.floor(F.col(from_km) / step_km) + 1
    last = F.ceil(F.col(to_km) / step_km) - 1
    t = (F.col("_n") * F.lit(float(step_km)) - F.col(from_km)) / F.col("km")
    return (along.filter((F.col("km") > 0) & (first <= last)).withColumn("_n", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
            .select(*keys, (F.col("_n") * F.lit(float(step_km))).alias("along"), *_on_leg(t)))


def _summed(lines: DataFrame, keys: list[str], coords: str) -> DataFrame:
    """Fragments (keys, _c: vertices, _cum: the distance at which each lies)."""
    kms = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords) - 1),
                     lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    cumulative = F.aggregate(kms, F.array(F.lit(0.0)), lambda acc, k: F.array_append(acc, F.element_at(acc, -1) + k))
    return lines.filter(F.size(coords) >= 2).select(*keys, F.col(coords).alias("_c"), cumulative.alias("_cum"))


def fragment_courses(lines: DataFrame, keys: list[str], coords: str) -> DataFrame:
    """P-4: legs of whole fragments with the distance along the fragment (keys, ax, ay, bx, by, from_km, to_km, km)."""
    return _courses(_summed(lines, keys, coords), keys)


def _courses(base: DataFrame, keys: list[str]) -> DataFrame:
    return (base.select(*keys, "_c", "_cum", F.explode(F.sequence(F.lit(1), F.size("_c") - 1)).alias("_i"))
            .select(*keys, F.get("_c", F.col("_i") - 1).alias("_a"), F.get("_c", F.col("_i")).alias("_b"),
                    F.get("_cum", F.col("_i") - 1).alias("from_km"), F.get("_cum", F.col("_i")).alias("to_km"))
            .select(*keys, F.col("_a.lon").alias("ax"), F.col("_a.lat").alias("ay"), F.col("_b.lon").alias("bx"), F.col("_b.lat").alias("by"),
                    "from_km", "to_km", (F.col("to_km") - F.col("from_km")).alias("km")))


def sample_fragments(lines: DataFrame, keys: list[str], coords: str, step_km: float) -> DataFrame:
    """G-3: sample whole fragments: multiples of the step, and the end vertex of each (keys, along, lon, lat).

    Distances are summed inside the row, so the pass is narrow.
    """
    base = _summed(lines, keys, coords)
    each = _courses(base, keys)
    ends = base.select(*keys, F.element_at("_cum", -1).alias("along"), F.element_at("_c", -1)["lon"].alias("lon"), F.element_at("_c", -1)["lat"].alias("lat"))
    return walk(each, keys, step_km).unionByName(ends)


def subdivide(vertices: DataFrame, keys: list[str], step_km: float) -> DataFrame:
    """G-3: every leg cut into equal parts no longer than ``step_km`` (keys, seq, part, lon, lat)."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("km") / step_km)).cast("int")
    cutup = legs(vertices, keys).withColumn("_parts", parts)
    return (cutup.withColumn("part", F.explode(F.sequence(F.when(F.col("seq") == 1, 0).otherwise(1), F.col("_parts"))))
            .select(*keys, "seq", "part", *_on_leg(F.col("part") / F.col("_parts"))))


def simplify(vertices: DataFrame, keys: list[str], tolerance_deg: float) -> DataFrame:
    """G-1: Douglas-Peucker over all lines at once, level by level.

    Every undecided vertex carries the ends of its interval.  A level finds the farthest
    vertex per interval by aggregation and hands it back by an equi-join; intervals within
    tolerance are dropped.  Levels grow with the logarithm of the line length.
    """
    ends = vertices.groupBy(*keys).agg(F.min_by(F.struct("seq", "lon", "lat"), "seq").alias("_a"), F.max_by(F.struct("seq", "lon", "lat"), "seq").alias("_b"))
    # Coordinates at both ends fix the longitude scale of the whole line.
    scale = F.cos(F.radians((F.col("_a.lat") + F.col("_b.lat")) / 2))
    state = skew_join(vertices, ends, keys).withColumn("_k", F.when(scale != 0, scale).otherwise(1.0))
    at_end = (F.col("seq") == F.col("_a.seq")) | (F.col("seq") == F.col("_b.seq"))
    kept = [state.filter(at_end).select(*keys, "seq", "lon", "lat")]
    state, n = cut(state.filter(~at_end), rows=F.count(F.lit(1)))
    interval = [*keys, "_lo"]
    while n["rows"]:
        d = offset_deg(F.col("lon"), F.col("lat"), F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"), F.col("_k"))
        state = state.withColumn("_lo", F.col("_a.seq")).withColumn("_d", d)
        # The first of equally far vertices is taken.
        far = (state.filter(F.col("_d") > tolerance_deg).groupBy(*interval)
               .agg(F.max_by(F.struct("seq", "lon", "lat"), F.struct(F.col("_d"), -F.col("seq"))).alias("_f")))
        split = skew_join(state, far, interval)
        table, n = cut(split, rows=F.count(F.when(F.col("seq") != F.col("_f.seq"), 1)))
        kept.append(table.filter(F.col("seq") == F.col("_f.seq")).select(*keys, "seq", "lon", "lat"))
        left = F.col("seq") < F.col("_f.seq")
        state = (table.filter(F.col("seq") != F.col("_f.seq"))
                 .withColumn("_b2", F.when(left, F.col("_f")).otherwise(F.col("_b"))).withColumn("_a", F.when(left, F.col("_a")).otherwise(F.col("_f")))
                 .withColumn("_b", F.col("_b2")).drop("_b2", "_f", "_lo", "_d"))
    return reduce(lambda a, b: a.unionByName(b), kept)


def distance_to_lines(points: DataFrame, line_legs: DataFrame, on: list[str], point_keys: list[str]) -> DataFrame:
    """P-6: least distance from each point to the legs of its own lines (``on``), looked for in widening rings."""
    places = points.select(*dict.fromkeys([*point_keys, *on]), "lon", "lat").distinct()
    found = nearest_leg_in_rings(places, line_legs.select(*on, "ax", "ay", "bx", "by"), [*point_keys], [], ["dist"], list(on))
    return found.select(*point_keys, F.col("dist").alias("km"))


def unfold(vertices: DataFrame, keys: list[str], out_deg: float = 0.027, near_deg: float = 0.0009, share: float = 0.8) -> DataFrame:
    """G-5: a line drawn out and back is cut at its farthest vertex (adds ``part`` 0 or 1).

    It is cut only if its ends lie closer together than half the way out, and at least
    ``share`` of the vertices on the way back run along the way out.
    """
    first = vertices.filter(F.col("seq") == 0).select(*keys, F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
    reach = F.sqrt(F.pow((F.col("lon") - F.col("_sx")) * F.cos(F.radians("_sy")), 2) + F.pow(F.col("lat") - F.col("_sy"), 2))
    measured = skew_join(vertices, first, keys).withColumn("_d", reach)
    tip = measured.groupBy(*keys).agg(
        F.max("seq").alias("_last"), F.max_by("_d", "seq").alias("_ends"),
        F.max(F.struct(F.col("_d"), (-F.col("seq")).alias("_s"))).alias("_far"))
    # Few lines are folded, so the candidates are written out and everything below starts from them.
    folded = cut(tip.filter((F.col("_far._d") >= out_deg) & (F.col("_ends") <= F.col("_far._d") / 2) & (F.col("_last") >= 3)
                            & (-F.col("_far._s") < F.col("_last"))).select(*keys, (-F.col("_far._s")).alias("_tip")))
    marked = skew_join(vertices, folded, keys)
    out_legs = legs(marked.select(*keys, "seq", "lon", "lat"), keys).join(folded, keys).filter(F.col("seq") <= F.col("_tip"))
    back = marked.filter(F.col("seq") >= F.col("_tip"))
    retraced = within_deg(back.select(*keys, "seq", "lon", "lat"), out_legs.select(*keys, "ax", "ay", "bx", "by"), keys, near_deg)
    shares = cut(back.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(retraced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hit")), keys)
              .filter(F.col("_hit") / F.col("_n") >= share).select(*keys))
    twice = marked.join(shares, keys, "left_semi")
    outward = twice.filter(F.col("seq") <= F.col("_tip")).withColumn("part", F.lit(0))
    homeward = twice.filter(F.col("seq") >= F.col("_tip")).withColumn("seq", F.col("seq") - F.col("_tip")).withColumn("part", F.lit(1))
    rest = vertices.join(shares, keys, "left_anti").withColumn("part", F.lit(0))
    cols = [*keys, "part", "seq", "lon", "lat"]
    return reduce(lambda a, b: a.unionByName(b), [d.select(*[F.col(c).cast("int") if c in ("part", "seq") else F.col(c) for c in cols])
                                                  for d in (outward, homeward, rest)])


def orient(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """G-22: lines turned to run south to north, or west to east; adds ``flipped``."""
    ends = vertices.groupBy(*keys).agg(F.min_by(F.struct("lon", "lat"), "seq").alias("_a"), F.max_by(F.struct("lon", "lat"), "seq").alias("_b"),
                                       F.max("seq").alias("_last"))
    forward = runs_forward(F.col("_a.lon"), F.col("_a.lat"), F.col("_b.lon"), F.col("_b.lat"))
    ends = ends.select(*keys, "_last", (~forward).alias("flipped"))
    return (skew_join(vertices, ends, keys).withColumn("seq", F.when(F.col("flipped"), F.col("_last") - F.col("seq")).otherwise(F.col("seq"))).drop("_last"))


def track(vertices: DataFrame, keys: list[str], gap_km: float) -> DataFrame:
    """G-26: distance-indexed vertices with the bearing of the leg that leads there and a gap flag."""
    along = chainage(vertices, keys)
    return along.select(*keys, "seq", F.col("bx").alias("lon"), F.col("by").alias("lat"), F.col("to_km").alias("along"),
                        bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("bearing"), (F.col("km") > gap_km).alias("gap"))


def point_at(vertices: DataFrame, keys: list[str], wanted: DataFrame, at: str) -> DataFrame:
    """G-26: the point at a distance along a line (``wanted`` has the keys and ``at``), with the bearing there.

    Legs and distances meet on whole kilometres of the line.
    """
    along = chainage(vertices, keys)
    cells = along.withColumn("_c", F.explode(F.sequence(F.floor("from_km"), F.floor("to_km"))))
    asked = wanted.withColumn("_c", F.floor(at))
    hit = cells.join(asked, [*keys, "_c"]).filter((F.col(at) >= F.col("from_km")) & ((F.col(at) < F.col("to_km"))))
    t = (F.col(at) - F.col("from_km")) / F.greatest(F.col("km"), F.lit(1e-9))
    return hit.select(*[F.col(c) for c in wanted.columns], *_on_leg(t), bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("bearing"))


def background(lines: DataFrame, coords: str, least_km: float = 2) -> DataFrame:
    """D-13: unnumbered lines long enough to be drawn."""
    return lines.withColumn("km", line_km(F.col(coords))).filter(F.col("km") >= least_km)

