"""Flagged stretches and cuts between points: the road decides, and legs are looked at once."""

import math

from tests.conftest import FOLDER
from wayframe.checks.registry import QUERIES, Tables
from wayframe.operators import stitch as S

KM = 6371.0088


def hav(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * KM * math.asin(min(1.0, math.sqrt(h)))


def laid(p, legs):
    """Distance along a road at which a point lies on it, or None if it is 5 km off."""
    best = None
    for a, b, f, t in legs:
        k = math.cos(math.radians(p[1]))
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = (dx * k) ** 2 + dy ** 2
        u = max(0.0, min(1.0, ((p[0] - a[0]) * dx * k * k + (p[1] - a[1]) * dy) / n)) if n else 0.0
        x, y = a[0] + dx * u, a[1] + dy * u
        d = math.hypot((x - p[0]) * math.cos(math.radians((p[1] + y) / 2)) * 111.32, (y - p[1]) * 110.57)
        if d <= 5:
            best = min(best or (9e9, 0), (d, f + (t - f) * u))
    return None if best is None else best[1]


def test_flagged_stretches_reach_beyond_what_is_named(spark):
    t = Tables(spark, FOLDER)
    got = {r["seg_id"]: r["flagged"] for r in QUERIES["G24_flagged_stretches"](spark, FOLDER).collect()}
    named = {r["o_orderkey"]: r["o_orderpriority"] == "1-URGENT" for r in t.orders.collect()}
    roads = {}
    for r in t.vertices.collect():
        roads.setdefault(r["group_key"], {}).setdefault(r["seg_id"], {})[r["i"]] = (r["lon"], r["lat"])
    want = {}
    for segs in roads.values():
        spots = {}
        for s in sorted(segs):
            if (s // 13) % 6:
                for i, p in segs[s].items():
                    spots.setdefault(s % 13 * 5 + (4 - i if s % 2 else i), p)
        legs, at = [], 0.0
        for n in sorted(spots):
            if n - 1 in spots:
                d = hav(spots[n - 1], spots[n])
                legs.append((spots[n - 1], spots[n], at, at + d))
                at += d
        spans = []
        for s in segs:
            ends = [laid(segs[s][i], legs) for i in (0, 4)] if named[s] else [None]
            if None not in ends:
                spans.append((min(ends), max(ends)))
        merged = []
        for lo, hi in sorted(spans):
            if merged and lo - merged[-1][1] < 25:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        merged = [(0 if lo < 25 else lo, at if at - hi < 25 else hi) for lo, hi in merged]
        for s in segs:
            m = laid(segs[s][2], legs)
            want[s] = named[s] if m is None else any(lo - 0.05 <= m <= hi + 0.05 for lo, hi in merged)
    assert got == want
    assert any(got[s] and not named[s] for s in got)


def test_both_points_of_a_cut_meet_the_legs_in_one_join(spark, monkeypatch):
    calls, plain = [], S.near_legs
    monkeypatch.setattr(S, "near_legs", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = {r["facility"]: (r["published"], r["drawn"]) for r in QUERIES["G23_cut_between_points"](spark, FOLDER).collect()}
    assert len(calls) == 1 and got and all(d for _, d in got.values())
