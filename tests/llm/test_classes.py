"""Exchange of words between classes: gains against likelihoods counted anew, and sweeps over all dealt words."""

import numpy as np

from tests.llm.test_against_plain import FOLDER
from wayframe.llm import brown


def test_gains_are_differences_of_likelihoods():
    rng = np.random.default_rng(7)
    c = rng.integers(0, 4, (12, 12)).astype(float)
    of = np.arange(12) % 4
    counted = lambda of: np.array([[c[np.ix_(of == a, of == b)].sum() for b in range(4)] for a in range(4)])
    g = counted(of)
    one = np.eye(4)[of]
    left, right, own = np.array([c[:, w] @ one for w in range(12)]), np.array([c[w] @ one for w in range(12)]), np.diag(c).copy()
    k = np.arange(12)
    left[k, of] -= own
    right[k, of] -= own
    many = brown.gains_of_many(g, left, right, own, of)
    for w in range(12):
        moved = [brown.likelihood(counted(np.where(k == w, b, of))) for b in range(4)]
        assert np.allclose(many[w] - many[w, of[w]], np.array(moved) - moved[of[w]])
        out = g.copy()
        out[:, of[w]] -= left[w]
        out[of[w]] -= right[w]
        out[of[w], of[w]] -= own[w]
        assert np.allclose(brown.gains(out, left[w], right[w], own[w]), many[w])


def test_all_repeated_words_are_exchanged_and_no_sweep_loses(sent, monkeypatch):
    told, plain = [], brown.sweeps

    def seen(numbers, held, of, total, classes, *more):
        out = plain(numbers, held, of, total, classes, *more)
        told.append((held, of, out))
        return out

    monkeypatch.setattr(brown, "sweeps", seen)
    docs = sent.read.parquet(f"{FOLDER}/documents.parquet")
    score = {r.doc_id: r.score for r in brown.score(docs, exchanged=64).collect()}
    held, before, (after, t, likelihoods) = told[0]
    assert len(after) == (held.counts >= brown.LEAST).sum() > 64
    assert len(likelihoods) > 1 and all(b > a for a, b in zip(likelihoods, likelihoods[1:]))
    assert (before[64:] != after[64:]).any() and t.sum() == held.counts.sum() and len(score) == docs.count()
