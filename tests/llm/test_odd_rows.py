"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import math

import pytest

from wayframe.llm import brown, contamination, lines, mixing, neighbours, ngrams, quality, suffixes, templates, toxicity
from wayframe.llm.mixing import word_count
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
ROWS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, None), (3, ""), (4, "  \t\n "),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota"), (5, LONG, None), (6, "one"), (7, "ümläut ñ 漢字   x", None), (8, LONG)]


def labels(sent, rows):
    return sent.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_texts_of_pages(sent):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>T&amp;t</h1><p>a  b<br>c<p>d</article><footer>f</footer>"
    rows = [(1, "http://h/1", page, 1), (1, "http://h/1", page, 1), (2, None, None, 1), (3, "http://h/2", "", 1), (None, "x", "plain < text", 1), (4, "http://h/3", "<p>" + LONG, 1)]
    made = {(r.page_id, r.text, r.n_chars) for r in templates.extract(sent.createDataFrame(rows, "page_id bigint, url string, html string, host int")).collect()}
    assert made == {(1, "T&t\n\na b c\n\nd", 13), (2, "", 0), (3, "", 0), (None, "plain < text", 12), (4, LONG.strip(), len(LONG.strip()))}
    assert templates.extract(sent.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_benchmark_items(sent, documents):
    item = "alpha beta gamma delta epsilon"
    items = sent.createDataFrame([(1, item, 0), (2, item.upper(), 0), (3, None, 0), (4, "", 0), (5, "one", 0)], "item_id bigint, text string, doc_id int")
    found = contamination.matches(documents(ROWS), items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.edits) for r in found) == sorted([(d, i, 0) for d in (1, 1, 0) for i in (1, 2)])
    clean = contamination.clean(documents(ROWS), items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5, 6, 7, 8] and clean.columns == documents(ROWS).columns
    assert contamination.matches(documents(ROWS), items.limit(0)).count() == 0
    assert contamination.matches(documents([]), items).count() == 0


def test_repeated_passages(documents):
    a = "x" * 30 + "0123456789" * 9
    rows = [*ROWS, (10, a), (11, "y" * 7 + a[10:] + "zz"), (None, a), (12, a), (12, "other text of the same id " * 3)]
    out = suffixes.dedup(documents(rows)).collect()
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in out}
    assert len(out) == len(rows) and got[(10, 120)] == (0, 0) and got[(12, 120)] == (120, 1) and got[(None, 120)] == (0, 0)
    assert got[(11, 119)] == (110, 1) and got[(8, len(LONG))] == (len(LONG), 1) and got[(2, 0)] == (0, 0) and got[(12, 78)] == (0, 0)
    assert {r.kept_sha256 for r in out if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert suffixes.dedup(documents([])).count() == 0


def test_scores_by_classes(documents):
    rows = {(r.doc_id, r.n_tokens): r for r in brown.score(documents(ROWS)).collect()}
    assert brown.score(documents(ROWS)).count() == len(ROWS)
    assert rows[(2, 1)].n_tokens == rows[(3, 1)].n_tokens == rows[(4, 1)].n_tokens == 1 and (5, 120_001) in rows
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in rows.values())
    assert brown.score(documents([])).count() == 0
    alone = brown.score(documents([(4, "a b")]), fold=0, folds=1).first()  # no training rows
    assert (alone.n_known, alone.train_tokens, alone.base_score) == (0, 0, 0.0) and math.isfinite(alone.score)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers(sent, documents, operator):
    docs = documents([*ROWS, *[(100 + k, f"good words {k} here") for k in range(20)], *[(200 + k, f"bad awful {k} ### $$$") for k in range(20)]])
    known = labels(sent, [(100 + k, 1, 0) for k in range(20)] + [(200 + k, 0, 1) for k in range(20)] + [(None, 1, 1), (2, None, None), (100, 1, 0)])
    out = operator.score(docs, known).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    mean = {k: sum(r.score for r in out if r.doc_id and r.doc_id // 100 == k) / 20 for k in (1, 2)}
    assert (mean[1] > mean[2]) == (operator is quality)
    assert operator.score(docs, known.limit(0)).count() == docs.count()
    assert operator.score(documents([]), known).count() == 0


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_samples_are_bounded_by_rows(sent, documents, operator, monkeypatch):
    taken = []
    from wayframe.llm import features
    draw = features.sample_features
    monkeypatch.setattr(operator, "sample_features", lambda *a, **k: taken.append(draw(*a, **k)) or taken[-1])
    same = [(7, f"text {k} of one id") for k in range(400)] + [(7, "text 1 of one id")] * 5
    docs = documents([*same, *[(100 + k, f"other {k}") for k in range(10)]])
    out = operator.score(docs, labels(sent, [(7, 1, 1), *[(100 + k, k % 2, 0) for k in range(10)]]))
    assert out.count() == len(same) + 10 and len(taken[0]) <= 2 * 410
    assert len({(r["doc_id"], r["at"], r["x"], r["y"]) for r in taken[0]}) <= len(taken[0])


def test_mix(documents):
    sized = documents(ROWS).select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mixing.mix(sized).collect()
    assert len(out) == len(ROWS) and all(r.taken <= 2 * r.size for r in out) and {r.size for r in out if r.doc_id in (2, 3, 4)} == {0}
    assert sorted(map(str, mixing.mix(sized.repartition(3)).collect())) == sorted(map(str, out))
    assert mixing.mix(sized.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(sized.filter("size = 0")).collect()] == [0, 0, 0]


def test_lines(documents):
    near = "the first second third fourth fifth sixth seventh word"
    rows = [*ROWS, (20, f"{near}\nThe  FIRST second third fourth fifth sixth seventh word\nshort line"), (21, near.replace("third", "other") + "\nshort lines\n\nshort line"),
            (22, near + " more\n" + near.replace("sixth ", "")), (23, near.replace("third", "a").replace("fourth", "b"))]
    out = lines.dedup(documents(rows))
    got = {r.doc_id: (r.lines, r.exact, r.near, r.text) for r in out.filter("doc_id >= 20").collect()}
    assert got == {20: (3, 1, 0, f"{near}\nshort line"), 21: (4, 1, 1, "short lines\n"), 22: (2, 0, 2, ""), 23: (1, 0, 0, near.replace("third", "a").replace("fourth", "b"))}
    rest = {(r.doc_id, r.exact, r.text is None) for r in out.filter("doc_id IS NULL OR doc_id < 20").collect()}
    assert rest == {(1, 1, False), (2, 0, True), (3, 0, False), (4, 0, False), (None, 0, False), (5, 0, False), (6, 0, False), (7, 0, False), (8, 1, False)}
    assert out.count() == len(rows) and lines.dedup(documents([])).count() == 0


def test_classes(documents):
    out = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in ngrams.classes(documents(ROWS)).collect())
    assert out == [(0, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 6, 0), (7, 7, 0), (8, 5, 1)]
    first = ngrams.first_of_class(documents(ROWS))
    assert sorted(r.doc_id or 0 for r in first.collect()) == [0, 1, 1, 2, 3, 4, 5, 6, 7] and first.columns == documents(ROWS).columns
    assert ngrams.classes(documents([])).count() == 0


def test_neighbours(sent):
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1),
            (7, [3.0, 0.0], 1), (200, [1.0], 1), (None, [1.0, 0.0], 1), (300, [float("inf"), 0.0], 1), (8, [], 1)]
    vectors = sent.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    out = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(vectors).collect())
    assert out == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0), (0, 4, 100, 0.0), (0, 5, 7, 2.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0), (100, 4, 2, 0.0), (100, 5, 7, 2.0)]
    assert neighbours.search(vectors.limit(0)).count() == 0
    again = neighbours.search(vectors.unionByName(vectors.filter("vec_id = 100"))).filter("query_id = 100").collect()
    assert sorted((r.rank, r.vec_id) for r in again) == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 7)]
