"""Stitching of networks with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayframe.operators import lines as L
from wayframe.operators import stitch as S
from wayframe.plans import routes as B

DEG = 6371.0088 * math.pi / 180
SEGMENT = "seg_id bigint, g string, coords array<struct<lon:double,lat:double>>"


def network():
    rows, r = [], random.Random(3)

    def add(g, coords):
        rows.append((len(rows) + 1, g, [(float(x), float(y)) for x, y in coords]))

    fragments = [[(0, 40 + 0.05 * i + 0.025 * j) for j in range(3)] for i in range(10)]
    r.shuffle(fragments)
    for f in fragments:
        add("straight", f[::-1] if r.random() < 0.5 else f)
    add("gap", [(10, 40), (10, 40.2)])
    add("gap", [(10, 40.272), (10, 40.5)])
    add("far", [(12, 40), (12, 40.2)])
    add("far", [(12, 40.5), (12, 40.8)])
    circle = [(20 + 0.2 * math.cos(a * math.pi / 18), 40 + 0.15 * math.sin(a * math.pi / 18)) for a in range(36)]
    for a in range(0, 36, 4):
        add("ring", [circle[(a + j) % 36] for j in range(5)])
    add("stubbed", [(x + 5, y) for x, y in circle[:19]])
    add("stubbed", [(x + 5, y) for x, y in circle[18:] + circle[:1]])
    add("stubbed", [(25.2, 40), (25.215, 40)])
    add("dual", [(30, 40), (30, 40.3)])
    add("dual", [(30.0003, 40.3), (30.0003, 40.01)])
    add("joined", [(32, 40), (32, 40.15), (32, 40.3)])
    add("joined", [(32, 40), (32.0003, 40.001), (32.0003, 40.299), (32, 40.3)])
    add("tee", [(40, 40), (40, 40.3)])
    add("tee", [(40, 40.3), (40, 40.5)])
    add("tee", [(40, 40.3), (40.03, 40.3)])
    add("sliver", [(50, 40), (50, 40.2)])
    add("sliver", [(50.5, 40), (50.5, 40.002)])
    add("short", [(52, 40), (52, 40.002)])
    add("hook", [(60, 40), (60, 40.4)])
    add("hook", [(60, 40.4), (59.8, 40.38)])
    add("hook", [(59.8, 40.38), (59.75, 40.2)])
    add("twins", [(70, 40), (70, 40.3)])
    add("twins", [(70.0005, 40.02), (70.0005, 40.29)])
    add("twins", [(70.5, 40.0), (70.5, 40.2)])
    return rows


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame(network(), SEGMENT)
    out = S.stitch(df, "g", snap_deg=0.0002, bridge_km=15, min_km=1.2, dedupe_km=None)
    comps = {}
    for c in out.components.collect():
        comps.setdefault(c.g, []).append(c)
    return out, comps


def test_shuffled_and_turned_fragments_become_one_line(built):
    out, comps = built
    (c,) = comps["straight"]
    assert c.path_km == pytest.approx(0.5 * DEG, abs=1e-6) and c.gaps == 0 and c.pieces == 1
    v = out.pieces().filter(F.col("comp") == c.comp).orderBy("piece", "seq", "i").collect()
    lats = [x.lat for x in v]
    assert len(v) == 21 and (lats == sorted(lats) or lats == sorted(lats, reverse=True))


def test_gap_within_budget_is_bridged_and_not_counted(built):
    _, comps = built
    (c,) = comps["gap"]
    assert c.gaps == 1 and c.pieces == 2 and c.gap_km == pytest.approx(0.072 * DEG, abs=1e-3)
    assert c.km == pytest.approx(0.428 * DEG, abs=1e-6) == c.path_km


def test_gap_beyond_budget_stays_open(built):
    assert len(built[1]["far"]) == 2


def test_ring_is_one_lap(built):
    (c,) = built[1]["ring"]
    assert c.path_km == pytest.approx(c.km, abs=1e-6)


def test_stub_of_a_ring_is_a_branch(built):
    out, comps = built
    (c,) = comps["stubbed"]
    stub = out.branches().filter(F.col("comp") == c.comp).collect()
    assert len(stub) == 1 and c.km - c.path_km == pytest.approx(stub[0].km, abs=1e-6)


def test_two_carriageways_are_driven_once(built):
    (c,) = built[1]["joined"]
    assert c.path_km == pytest.approx(0.3 * DEG, abs=0.05)


def test_side_road_is_a_branch(built):
    out, comps = built
    (c,) = comps["tee"]
    assert c.path_km == pytest.approx(0.5 * DEG, abs=1e-6)
    assert out.branches().filter(F.col("comp") == c.comp).count() == 1


def test_slivers_go_unless_alone(built):
    _, comps = built
    assert [round(c.km, 1) for c in comps["sliver"]] == [round(0.2 * DEG, 1)]
    assert len(comps["short"]) == 1


def test_road_goes_on_past_the_farthest_point(built):
    (c,) = built[1]["hook"]
    assert c.path_km == pytest.approx(c.km, abs=1e-6)


def test_far_carriageway_is_counted_once(spark):
    df = spark.createDataFrame([x for x in network() if x[1] == "twins"], SEGMENT)
    plain = S.stitch(df, "g", 0.0002, bridge_km=0, min_km=1.2, dedupe_km=None)
    assert plain.components.count() == 3
    out = S.without_opposite_carriageways(plain)
    kept = sorted(c.km for c in out.components.collect())
    assert kept == pytest.approx([0.2 * DEG, 0.3 * DEG], abs=1e-6)
    # The other side is still drawn, with the one it lies on.
    assert out.edges.count() == 3 and out.branches().count() == 1


def test_line_drawn_out_and_back_counts_half(spark):
    n = 61
    out = [(10.0, 40 + 0.005 * i) for i in range(n)]
    back = [(10.0002, 40 + 0.005 * i) for i in range(n - 1, -1, -1)]
    edges = spark.createDataFrame([(1, out + back)], "edge_id bigint, coords array<struct<lon:double,lat:double>>")
    from wayframe.functions.geo import line_km
    path = edges.select(F.lit(1).alias("comp"), F.lit(0).alias("seq"), "edge_id", F.lit(True).alias("forward"), F.lit(False).alias("bridge"), line_km(F.col("coords")).alias("km"))
    row = S.driven_km(path, edges, "comp").first()
    # The last 1.6 km before the turn cannot be told from a switchback.
    assert row.km / 2 <= row.driven <= row.km / 2 + 1.7


def test_switchback_is_driven_whole(spark):
    zigzag = [(10.0 + (0.003 if i % 2 else 0), 40 + 0.0004 * i) for i in range(12)]
    edges = spark.createDataFrame([(1, zigzag)], "edge_id bigint, coords array<struct<lon:double,lat:double>>")
    from wayframe.functions.geo import line_km
    path = edges.select(F.lit(1).alias("comp"), F.lit(0).alias("seq"), "edge_id", F.lit(True).alias("forward"), F.lit(False).alias("bridge"), line_km(F.col("coords")).alias("km"))
    row = S.driven_km(path, edges, "comp", tol_km=0.03).first()
    assert row.driven == pytest.approx(row.km)


def test_flank_is_cut_where_another_road_ends(spark):
    parts = spark.createDataFrame([(1, "t", [(0.0, 40.0), (0.0, 40.2)]), (2, "t", [(0.001, 40.1), (0.3, 40.1)])], SEGMENT.replace("g string", "t string"))
    got = sorted((r.seg_id, r.sub, len(r.coords)) for r in S.node_parts(parts, "t").collect())
    assert got == [(1, 0, 2), (1, 1, 2), (2, 0, 2)]
    cut = S.node_parts(parts, "t").filter("seg_id = 1 AND sub = 0").first().coords[-1]
    assert cut.lat == pytest.approx(40.1, abs=1e-4) and cut.lon == pytest.approx(0, abs=1e-9)


def test_path_between_declared_places(spark):
    parts = spark.createDataFrame([(1, "t", [(0.0, 40.0), (0.0, 40.4)]), (2, "t", [(0.001, 40.1), (0.3, 40.1)]), (3, "u", [(5.0, 40.0), (5.0, 40.1)]), (4, "u", [(8.0, 40.0), (8.0, 40.1)])],
                                  SEGMENT.replace("g string", "t string"))
    ends = spark.createDataFrame([("t", 0.0, 40.3, 0.3, 40.1), ("u", 5.0, 40.0, 8.0, 40.1)], "t string, flon double, flat double, tlon double, tlat double")
    status, _ = S.stitch_between(parts, ends, "t", snap_deg=0.0025, bridge_km=20)
    got = {r.t: r for r in status.collect()}
    east = 0.3 * DEG * math.cos(math.radians(40.1))
    assert got["t"].status == "found" and got["t"].km == pytest.approx(0.2 * DEG + east, abs=0.3)
    assert got["u"].status == "disconnected" and got["u"].km is None


def test_folded_line_is_cut_at_its_tip(spark):
    out = [(0.0, 40 + 0.01 * i) for i in range(8)]
    back = [(0.0004, 40 + 0.01 * i) for i in range(6, -1, -1)]
    rows = [("fold", i, *c) for i, c in enumerate(out + back)] + [("plain", i, *c) for i, c in enumerate(out)]
    df = spark.createDataFrame([(k, i, float(x), float(y)) for k, i, x, y in rows], "k string, seq int, lon double, lat double")
    got = {(r.k, r.part): r.n for r in L.unfold(df, ["k"]).groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("fold", 0): 8, ("fold", 1): 8, ("plain", 0): 8}


def test_simplify_keeps_ends_and_tolerance(spark):
    r = random.Random(9)
    pts = [(i, 0.001 * i, 40 + r.uniform(-0.003, 0.003)) for i in range(300)]
    df = spark.createDataFrame([("a", *p) for p in pts], "k string, seq int, lon double, lat double")
    kept = sorted(x.seq for x in L.simplify(df, ["k"], 0.002).collect())
    assert kept[0] == 0 and kept[-1] == 299 and len(kept) < 300
    k = math.cos(math.radians((pts[0][2] + pts[-1][2]) / 2))
    for lo, hi in zip(kept, kept[1:]):
        (_, ax, ay), (_, bx, by) = pts[lo], pts[hi]
        for _, x, y in pts[lo + 1:hi]:
            dx, dy = (bx - ax) * k, by - ay
            t = max(0, min(1, ((x - ax) * k * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            assert math.hypot((x - ax) * k - t * dx, y - ay - t * dy) <= 0.002 + 1e-12


def test_long_lines_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_VERTICES", 4)
    df = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(10)], "k string, seq int, lon double, lat double")
    got = {r.block: [c.lon for c in r.coords] for r in L.to_fragments(df, ["k"]).collect()}
    assert got == {0: [0, 1, 2, 3, 4], 1: [4, 5, 6, 7, 8], 2: [8, 9]}


def test_flagged_stretch_takes_in_what_lies_between(spark):
    parts = [(i, "r", [(0.0, 40 + 0.1 * i), (0.0, 40.05 + 0.1 * i), (0.0, 40.1 + 0.1 * i)], i in (3, 4, 6)) for i in range(10)]
    df = spark.createDataFrame(parts, "seg_id bigint, key string, coords array<struct<lon:double,lat:double>>, named boolean")
    line = spark.createDataFrame([("r", 0, i, 0.0, 40 + 0.05 * i) for i in range(21)], "key string, line int, seq int, lon double, lat double")
    got = {r.seg_id for r in S.flag_stretches(df, L.chainage(line, ["key"]), F.col("named"), "key").filter("flagged").collect()}
    # 5 lies in a gap of 11 km; the start is 33 km off, the end as well.
    assert got == {3, 4, 5, 6}


def test_cut_between_points_is_checked_against_the_published_length(spark):
    line = spark.createDataFrame([("r", 7, i, 0.0, 40 + 0.05 * i) for i in range(21)], "key string, line bigint, seq int, lon double, lat double")
    along = L.chainage(line, ["key", "line"]).drop("km")
    want = 0.5 * DEG
    ends = spark.createDataFrame([("ok", "r", 0.001, 40.2, 0.0, 40.7, want * 1.05), ("no", "r", 0.0, 40.2, 0.0, 40.7, want * 2), ("off", "r", 3.0, 40.2, 0.0, 40.7, want)],
                                 "facility string, key string, flon double, flat double, tlon double, tlat double, km double")
    got = {r.facility: r for r in S.between_points(along, ends, "facility", "line", ["key"], 0.5, 0.1).collect()}
    assert got["ok"].drawn and got["ok"].km == pytest.approx(want, abs=0.01)
    assert not got["no"].drawn and not got["off"].drawn and got["off"].km is None


def test_cut_over_two_lines_that_meet_end_to_end(spark):
    rows = [("a", 1, i, 0.0, 40 + 0.05 * i) for i in range(5)]  # up to 40.2
    rows += [("b", 2, i, 0.0, 40.4 - 0.05 * i) for i in range(4)] + [("b", 2, 4, 0.0, 40.203)]  # down to 330 m beyond
    rows += [("b", 3, 0, 0.002, 40.21), ("b", 3, 1, 0.002, 40.5)]  # starts too far away
    along = L.chainage(spark.createDataFrame(rows, "key string, line bigint, seq int, lon double, lat double"), ["key", "line"]).drop("km")
    want = 0.3 * DEG
    ends = [(f, key, 0.0, 40.05, 0.0, 40.35, want * w) for f, w in (("two", 1.0), ("short", 2.0)) for key in "ab"]
    ends += [("far", key, 0.0, 40.05, 1.0, 40.35, want) for key in "ab"] + [("one", "a", 0.0, 40.05, 0.0, 40.15, 0.1 * DEG)]
    df = spark.createDataFrame(ends, "facility string, key string, flon double, flat double, tlon double, tlat double, km double")
    got = {r.facility: r for r in S.between_points(along, df, "facility", "line", ["key"], 0.5, 0.1).collect()}
    two = got["two"]
    assert two.drawn and (two.line, two.line2) == (1, 2) and two.km == pytest.approx(want, abs=0.02) and two.join_at == pytest.approx(0.2 * DEG, abs=0.02)
    assert two.join2_at == pytest.approx(0.197 * DEG, abs=0.02) and not got["short"].drawn and got["far"].km is None and not got["far"].drawn
    assert got["one"].drawn and got["one"].line2 is None


def test_route_build_end_to_end(spark):
    rows = []
    for i in range(6):
        rows.append((i, "US Hwy 12", "U", "OH" if i < 3 else "IN", [(0.0, 40 + 0.1 * i), (0.0, 40.1 + 0.1 * i)], "Primary" if i else "Freeway", None))
    rows.append((10, "US Hwy 12", "U", "CA", [(30.0, 40.0), (30.0, 40.2)], "Primary", True))
    rows.append((11, "State Rte 5/7", "S", "OH", [(2.0, 40.0), (2.0, 40.1)], "Primary", False))
    rows.append((12, "Main St", "M", "OH", [(2.0, 40.0), (2.0, 40.1)], "Primary", False))
    df = spark.createDataFrame(rows, "seg_id bigint, name string, road_type string, st string, coords array<struct<lon:double,lat:double>>, type string, divided boolean")
    beside = spark.createDataFrame([("OH", "IN"), ("IN", "OH")], "st string, beside string")
    routes, _ = B.build_routes(B.group_segments(df), B.Stitching(bridge_km=5), beside)
    got = {r.route_id: r for r in routes.collect()}
    assert set(got) == {"us-numbered-12-in", "us-numbered-12-ca", "us-state-5-oh", "us-state-7-oh"} or set(got) == {"us-numbered-12-oh", "us-numbered-12-ca", "us-state-5-oh", "us-state-7-oh"}
    long = [r for k, r in got.items() if k.startswith("us-numbered") and r.st != "CA"][0]
    assert long.mi == round(0.6 * DEG / 1.609344) and long.freeway == pytest.approx(16.7, abs=0.1) and long.label == "US 12"
    assert got["us-state-5-oh"].label == "OH 5"
