"""Driven length against a plain count of samples, without a table of samples."""

import math

from wayframe.operators import stitch as S

KM = 6371.0088


def hav(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * KM * math.asin(min(1.0, math.sqrt(h)))


def test_driven_km_counts_what_is_laid_twice_and_writes_no_samples(spark, monkeypatch):
    # Out along 50 N, back beside it over several cells, and a second road far from the first.
    lines = {1: [(10 + 0.01 * i, 50 + 0.001 * (i % 2)) for i in range(12)], 2: [(10.115 - 0.01 * i, 50.0015) for i in range(9)], 3: [(11 + 0.02 * i, 40.0) for i in range(4)]}
    rows = [(7, k, k, True, False) for k in (1, 2)] + [(8, 1, 3, True, False)]
    length = {k: sum(hav(a, b) for a, b in zip(c, c[1:])) for k, c in lines.items()}
    path = spark.createDataFrame([(*r, length[r[2]]) for r in rows], "comp bigint, seq bigint, edge_id bigint, forward boolean, bridge boolean, km double")
    edges = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in c]) for k, c in lines.items()], "edge_id bigint, coords array<struct<lon: double, lat: double>>")
    monkeypatch.setattr(S, "cut", lambda *a, **k: (_ for _ in ()).throw(AssertionError("samples are written out")))
    got = {(r["comp"], r["edge_id"]): r["driven"] for r in S.driven_km(path, edges, "comp", tol_km=0.4).collect()}
    step, spots, off = 0.2, [], 0.0
    for k in (1, 2):
        at = 0.0
        for a, b in zip(lines[k], lines[k][1:]):
            d = hav(a, b)
            spots += [(k, off + n * step, tuple(p + (q - p) * (n * step - at) / d for p, q in zip(a, b))) for n in range(math.floor(at / step) + 1, math.ceil((at + d) / step))]
            at += d
        off += length[k]
    for k in (1, 2):
        twice = sum(any(abs(x - o) >= 1.6 and hav(p, q) <= 0.4 for _, o, q in spots) for e, x, p in spots if e == k)
        assert twice and abs(got[7, k] - (length[k] - twice * step / 2)) < 1e-6
    assert abs(got[8, 3] - length[3]) < 1e-9
