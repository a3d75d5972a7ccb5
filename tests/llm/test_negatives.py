"""Hard negatives against plain scores of all pairs."""

import math
import random

import numpy as np
import pytest

from wayframe.llm import negatives


def plain(rows, every=100):
    whole = {}
    for vec, label, v in rows:
        if vec is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * x) for x in v)
        if any(abs(x) >= math.isqrt(2 ** 62 // len(v)) for x in v):
            continue
        row = ((label + 1) % 10 if vec % 7 == 0 else label, v)
        whole[vec] = min(whole.get(vec, row), row)
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in whole.items() if b != a and len(w) == len(v))
        for score, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(n, b) for n, b, other in scored if other != label and 80 * -score <= 100 * -n <= 100 * -score][:5]
            out += [(a, p, k + 1, b, -score, -n) for k, (n, b) in enumerate(fits)]
    return sorted(out)


def mined(sent, rows, **how):
    df = sent.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, label int, embedding array<double>, ids string, block int").repartition(4)
    return sorted(map(tuple, negatives.mine(df.select("vec_id", "embedding", "label", "ids", "block"), **how).collect()))


@pytest.mark.parametrize("cells", [64, 1 << 20])
def test_same_as_all_pairs(sent, cells):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        # Few different components: many ties; half of all rows share a label.
        v = [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)] if k % 3 else [rng.gauss(0, 1) for _ in range(4)]
        rows.append((k * 5, rng.choice([1, 1, 1, 2, 3, 9, 0]), v))
    want = plain(rows)
    assert len(want) > 50 and mined(sent, rows, cells=cells, anchor_cells=cells) == want


def test_odd_rows(sent):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 2, [0.9, 5.0]), (3, 2, [0.9, 5.0]), (4, 3, [0.9, 4.0]), (5, None, [1.0, 0.0]), (6, 2, None),
            (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (11, 2, []), (None, 2, [1.0, 0.0]), (12, 2, [1e300, 0.0]), (13, 2, [1.0]), (200, 2, [0.0, 0.0]), (300, 5, [-1.0, -1.0]),
            (15, 5, [1.0, 1.0]), (16, 4, [0.9, 0.9]), (500, 7, [1.5]), (17, 7, [1e8]), (18, 8, [1e8]), (18, 7, [2e6]), (19, 8, [1.9e6]), (20, 8, [2e6])]
    want = plain(rows)
    assert {(a, p) for a, p, *_ in want} >= {(0, 2), (100, 1), (500, 18)} and mined(sent, rows) == want
    assert mined(sent, []) == []


def test_rounds_end_early_where_they_may():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(4_000, 4)) * 256).astype(np.int64)
    lists = negatives.Lists(np.arange(4_000), np.zeros(4_000, np.int64), rows)
    looked = []
    plain_scores = lists.scores
    lists.scores = lambda at, anchor: looked.append(len(at)) or plain_scores(at, anchor)
    for a in range(20):
        looked.clear()
        scores = rows @ rows[a]
        (ids, got), = negatives.best(lists, rows[a], np.ones(4_000, bool), [(-(1 << 63), 1 << 63)], 5)
        want = np.lexsort((np.arange(4_000), -scores))[:5]
        assert ids.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
        assert sum(looked) < 2_000
