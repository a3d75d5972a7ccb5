"""Anchors meet the routes near them, not all of their designation."""

from wayframe.operators import grid, matching


def test_anchors_meet_few_routes(spark, monkeypatch):
    rows, join = [], grid.skew_join

    def counted(left, right, on, how="inner"):
        out = join(left, right, on, how)
        rows.append(out.count())
        return out
    monkeypatch.setattr(matching, "skew_join", counted)
    routes = [(k, 1, "a" if k < 100 else "b", -120 + k * 0.2, 30.0) for k in range(200)]
    routes += [(k, 2, "c", -100.0, 40.0) for k in (300, 301)] + [(400, 3, "a", None, None), (401, 3, "b", -100.0, 30.0)]
    entries = [(k, 1, "a", -120 + k * 0.2 + 0.01, 30.0) for k in range(0, 200, 2)]
    entries += [(900, 1, "x", -120 + 150 * 0.2, 30.01), (901, 1, None, -120 + 7 * 0.2, 30.01), (902, 2, "c", -100.0, 40.0), (903, 9, "a", -100.0, 40.0),
                (904, 3, "b", -100.0, 30.0), (905, 3, "z", -100.0, 30.0), (906, 1, "a", None, 30.0)]
    got = {r["entry"]: (r["route"], r["status"]) for r in matching.resolve_anchors(
        spark.createDataFrame(entries, "entry int, number int, hint string, lon double, lat double"),
        spark.createDataFrame(routes, "route int, number int, st string, olon double, olat double"), "entry", ["number"], "hint", "st", "route", 500).collect()}
    want = {k: (k, "found") if k < 100 else (99, "found") if (k - 99) * 19.3 < 500 else (None, "far") for k in range(0, 200, 2)}
    want |= {900: (150, "found"), 901: (7, "found"), 902: (None, "ambiguous"), 903: (None, "missing"), 904: (401, "found"), 905: (401, "found"), 906: (None, "ambiguous")}
    assert got == want
    assert max(rows) < 4_000  # before: all 20,600 pairs
