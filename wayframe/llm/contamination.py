"""Benchmark passages in documents, by exact pieces and edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

# Edits allowed for each character of an item, and the shortest item that is looked for.
RATE = 0.08
SHORTEST = 16
# Characters of items that are looked for in one pass over the documents.
PASS_CHARS = 1_000_000


def plain(text: str | None) -> str:
    """Lower case, white space as one space."""
    return " ".join((text or "").lower().split())


class Items:
    """Items cut into one piece more than edits are allowed: one piece of a match is without edits."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE):
        by_text: dict[str, list] = {}
        for item_id, text in rows:
            text = plain(text)
            if len(text) >= SHORTEST:
                by_text.setdefault(text, []).append(item_id)
        self.texts = sorted(by_text)
        self.ids = [sorted(by_text[t]) for t in self.texts]
        self.edits = [int(len(t) * rate) for t in self.texts]
        pieces: dict[str, list] = {}
        for k, (t, edits) in enumerate(zip(self.texts, self.edits)):
            for p in range(edits + 1):
                lo, hi = p * len(t) // (edits + 1), (p + 1) * len(t) // (edits + 1)
                pieces.setdefault(t[lo:hi], []).append((k, hi))
        self.pieces = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.pieces.add_word(piece, where)
        if pieces:
            self.pieces.make_automaton()
        self.masks = [(_masks(t), _masks(t[::-1])) for t in self.texts]

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item found: the fewest edits, and the first such passage's begin and end in the plain text."""
        spans: dict[int, list[list[int]]] = {}
        if not len(self.pieces):
            return {}
        for end, where in self.pieces.iter(text):
            for k, hi in where:
                begin = end + 1 - hi
                spans.setdefault(k, []).append([begin - self.edits[k], begin + len(self.texts[k]) + self.edits[k]])
        out = {}
        for k, found in spans.items():
            best = None
            for lo, hi in _merged(found, len(text)):
                edits, end = nearest(self.masks[k][0], len(self.texts[k]), text[lo:hi])
                if edits <= self.edits[k] and (best is None or edits < best[0]):
                    best = edits, lo + end
            if best:
                edits, end = best
                back = text[max(0, end - len(self.texts[k]) - edits):end][::-1]
                out[k] = edits, end - nearest(self.masks[k][1], len(self.texts[k]), back)[1], end
        return out


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _merged(spans: list[list[int]], length: int) -> list[list[int]]:
    """Windows cut to the text, those that overlap as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        lo, hi = max(0, lo), min(length, hi)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def nearest(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Fewest edits between the pattern and any substring, and the first end of such a one.

    A column of the distance table is held as two bit vectors, of its steps up and down, and
    each character of the text updates them with a few operations on whole words.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, at = length, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | x
        plus = down | (full & ~(d | up))
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(d | plus))
        down = plus & d
        if score < best:
            best, at = score, i + 1
    return best, at


def passes(benchmark: DataFrame, chars: int = PASS_CHARS) -> list[list[tuple[int, str]]]:
    """The items in lists of about ``chars`` characters: each is small, and is looked for in a pass of its own."""
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-total // chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    return [[tuple(r) for r in items.filter(part == k).collect()] for k in range(count)]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, begin, end): the items found in each document, by its nearest passage.

    An item is found where a passage of the document, both in lower case with single spaces,
    can be made the item with at most ``rate`` edits for each of its characters.  Items of
    fewer than ``SHORTEST`` characters are not looked for, as they stand everywhere by chance.
    Items that are equal are found together.  Null and empty texts hold none.
    """
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    out = None
    for rows in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, rate)
            for batch in batches:
                found = [(row, i, *hit) for row, text in enumerate(batch.column(1)) for k, hit in items.find(plain(text.as_py())).items() for i in items.ids[k]]
                row, item, edits, begin, end = zip(*found) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64() if kinds[1] == "bigint" else None),
                                                  pa.array(edits, pa.int32()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "edits", "begin", "end"])

        one = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, begin bigint, end bigint")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled for it."""
    for rows in passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not items.find(plain(t.as_py())) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@query("op2_benchmark_passages")
def op2(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
