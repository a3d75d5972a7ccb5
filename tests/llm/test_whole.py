"""Cases in which the operators on text once did less than the whole job."""

import random

from wayframe.llm import lines, ngrams


def test_isolated_pairs_are_all_linked(sent):
    rng = random.Random(5)
    rows = []
    for k in range(10_000):
        words = [f"w{rng.getrandbits(40):x}" for _ in range(60)]
        lost = rng.choice((3, 4, 5, 6))  # similarities of 53/59 to 50/62
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-lost] + [f"v{rng.getrandbits(40):x}" for _ in range(lost)]))]
    found = ngrams.classes(sent.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == len(rows)
    assert [r for r in found if r.class_id != r.doc_id // 2 * 2 or r.n_links != 1] == []


def test_lines_near_a_repeated_row_are_found(documents):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"first\n{line}"), (1, f"first\n{line}"), (2, f"second\n{line.replace('six', 'other')}")]
    got = sorted((r.doc_id, r.exact, r.near, r.text) for r in lines.dedup(documents(rows)).collect())
    assert got == [(1, 0, 0, rows[0][1]), (1, 0, 0, rows[1][1]), (2, 0, 1, "second")]


def test_texts_under_one_id_keep_what_stands_nowhere_else(documents):
    for doc in (None, 7):
        near = "one two three four five six seven eight nine ten"
        rows = [(doc, "foo\nfoo"), (doc, "bar\nbaz"), (doc, f"qux\n{near}"), (doc, f"quux\n{near.replace('two', 'other')}"), (9, "baz\nlast")]
        got = {tuple(r.text.split("\n")): (r.exact, r.near) for r in lines.dedup(documents(rows)).collect()}
        one = {("qux", near): (0, 0), ("quux",): (0, 1)}
        other = {("qux",): (0, 1), ("quux", near.replace("two", "other")): (0, 0)}
        rest = {("foo",): (1, 0), ("bar", "baz"): (0, 0), ("last",): (1, 0)}
        assert got in (rest | one, rest | other)
