"""Shards by a weighted hash tree: its law, its slots and what moves."""

import zlib
from collections import Counter

import pytest

from wayframe.llm import sharding
from wayframe.llm.sharding import TREE, Tree, descend, place
from pyspark.sql import functions as F

LONG = "lorem ipsum " * 20_000


def test_rows_go_into_the_new_shard_or_stay(sent):
    keys = sent.range(40_000).withColumnRenamed("id", "doc_id")
    trees = [TREE]
    for _ in range(3):
        trees.append(trees[-1].grown())
    out = keys
    for k, tree in enumerate(trees):
        out = descend(out, F.col("doc_id"), tree, (f"g{k}", f"r{k}", f"s{k}"))
    rows = out.collect()
    for k in range(1, len(trees)):
        new = 15 + k
        assert all(r[f"s{k}"] in (r[f"s{k - 1}"], new) for r in rows)
        assert abs(sum(r[f"s{k}"] == new for r in rows) - 40_000 / (16 + k)) < 400
    counts = Counter(r.s0 for r in rows)
    assert sorted(counts) == list(range(16)) and all(abs(n - 2_500) < 250 for n in counts.values())
    homes = {s: (g, r) for g, r, s, _ in TREE.leaves}
    assert all(homes[r.s0] == (r.g0, r.r0) for r in rows)


def test_changed_weights_move_rows_of_their_subtrees_only(sent):
    leaves = ((0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 2, 4.0), (1, 2, 3, 8.0))
    heavier = Tree((*leaves[:1], (0, 0, 1, 5.0), *leaves[2:]))
    keys = sent.range(32_000).withColumnRenamed("id", "doc_id")
    rows = descend(descend(keys, F.col("doc_id"), Tree(leaves), ("g", "r", "s")), F.col("doc_id"), heavier, ("g2", "r2", "s2")).collect()
    counts = Counter(r.s for r in rows)
    assert all(abs(counts[s] - 2_000 * w) < 400 for _, _, s, w in leaves)
    # Rows leave the other region for the heavier one and none go back; the same holds one level down.
    assert {(r.g, r.g2) for r in rows} == {(0, 0), (1, 0), (1, 1)}
    assert {(r.r, r.r2) for r in rows if r.g == r.g2 == 0} == {(0, 0), (1, 0), (1, 1)}
    assert {(r.s, r.s2) for r in rows if r.r == r.r2 == 0} == {(0, 0), (0, 1), (1, 1)}


@pytest.mark.parametrize("repeats", [2, 65_536])
def test_slots(documents, monkeypatch, repeats):
    monkeypatch.setattr(sharding, "REPEATS", repeats)
    rows = [*[(None, f"text {k}") for k in range(30)], *[(7, "same")] * 11, (7, None), (7, ""), (8, LONG), (9, "ümläut 漢"), *[(k, "copy") for k in range(100, 160)]]
    out = place(documents(rows), TREE).collect()
    texts = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts
    for shard in {r.shard for r in out}:
        held = sorted((r.slot, r.doc_id is None, r.doc_id or 0, r.text_crc32, r.size) for r in out if r.shard == shard)
        assert [h[0] for h in held] == list(range(len(held))) and [h[1:] for h in held] == sorted(h[1:] for h in held)
    assert len({r.shard for r in out if r.doc_id is None}) == len({r.shard for r in out if r.doc_id == 7}) == 1
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    assert place(documents([]), TREE).count() == 0


def test_no_python_and_no_text_in_the_shuffle(documents):
    plan = place(documents([(1, "a")]), TREE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
