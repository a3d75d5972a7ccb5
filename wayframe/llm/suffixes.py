"""Repeated passages across documents by suffix arrays of the places where texts may meet.

A passage that repeats shares, wherever it stands, the least hash of its short strings (its
anchor).  Anchors that only one document holds cannot lie in a repeat.  The surroundings of
all others are dealt out by anchor, and a suffix array over each lot finds the strings that
really repeat and the first document that holds each.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut
from .blocks import mixed, pieces, token_hashes
from .registry import query, table

WINDOW, GRAM = 50, 24
# Places at which a string of GRAM bytes may lie in a window, and bytes around an anchor that windows over it reach.
PLACES = WINDOW - GRAM + 1
SPAN = WINDOW + PLACES - 1
# Bytes of text for each lot of anchors, and the documents that hold an anchor from which on
# its surroundings are dealt out window by window.
LOT_BYTES = 8_000_000
HOT = 4_096


def packed(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed, after their number."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The arrays of a column one after the other."""
    raw = [pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True) for b in column.to_pylist() if b]
    return np.frombuffer(b"".join(raw), kind)


def _least(h: np.ndarray, f=np.minimum) -> np.ndarray:
    """``f`` over every PLACES neighbours, at the first of them."""
    m, width = h, 1
    while 2 * width <= PLACES:
        m, width = f(m[:-width], m[width:]), 2 * width
    return f(m[:len(m) - (PLACES - width)], m[PLACES - width:]) if PLACES > width else m


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, row, hash) of the strings that are the least of some window of their text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, np.zeros(0, np.uint64)
    starts = np.arange(n - GRAM + 1)
    h = token_hashes(data, starts, starts + GRAM, final=False)
    # The order of the strings is that of half their hash; those that do not lie in one text come last.
    order = (h >> np.uint64(33)).astype(np.uint32)
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(offsets) >= WINDOW
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - WINDOW + 1, -1)
    begins = np.cumsum(inside[:n - WINDOW + 1], dtype=np.int8).astype(bool)  # places where a window begins
    least = np.where(begins, _least(order), np.uint32(0))
    pad = np.zeros(PLACES - 1, np.uint32)
    of_some = _least(np.concatenate([pad, least, pad]), np.maximum)
    # Where no window reaches, 0 stands; a string with that hash is then an anchor too, which does no harm.
    at = np.flatnonzero(of_some == order)
    row = np.searchsorted(offsets, at, "right") - 1
    there = (at + GRAM <= offsets[row + 1]) & (offsets[row + 1] - offsets[row] >= WINDOW)
    at, row = at[there], row[there]
    return at, row, mixed(h[at])


def _lots(h: np.ndarray, lots: int) -> np.ndarray:
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(lots) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _short(h: np.ndarray) -> bytes:
    """The upper six bytes of each."""
    return h.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _long(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    h = np.zeros((len(six), 8), np.uint8)
    h[:, 2:] = six
    return h.view(np.uint64).ravel()


# Values of many documents on their way back to them: a row for each part of the documents.
PARTS = "part int, docs binary, hashes binary, counts binary, items binary"


def to_parts(doc: np.ndarray, text_hash: np.ndarray, count: np.ndarray, items: np.ndarray, parts: int) -> pa.Table:
    """``count`` items for each document, packed by parts of the documents."""
    part = _lots(mixed(doc.view(np.uint64)), parts)
    order = np.argsort(part, kind="stable")
    first = np.cumsum(count) - count
    size = count[order]
    at = np.repeat(first[order], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    doc, text_hash, items, ends = doc[order], text_hash[order], items[at], np.concatenate([[0], np.cumsum(size)])
    cuts = _cuts(part[order])
    rows = [(int(part[order[a]]), packed(doc[a:b]), packed(text_hash[a:b]), packed(size[a:b].astype(np.uint32)), packed(items[ends[a]:ends[b]])) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int32()] + [pa.binary()] * 4)], ["part", "docs", "hashes", "counts", "items"])


def by_document(rows: DataFrame, kind: str) -> DataFrame:
    """(doc, text_hash, items): one row for each document, from rows by parts."""
    def gather(part: pa.Table) -> pa.Table:
        doc, text_hash, count, items = (unpacked(part.column(c), t) for c, t in (("docs", np.int64), ("hashes", np.int32), ("counts", np.uint32), ("items", kind)))
        owner = np.repeat(np.arange(len(doc)), count)
        order = np.lexsort((text_hash[owner], doc[owner]))
        doc, text_hash, items = doc[owner[order]], text_hash[owner[order]], items[order]
        runs = _cuts_of(doc, text_hash)
        return pa.table({"doc": pa.array(doc[runs[:-1]], pa.int64()), "text_hash": pa.array(text_hash[runs[:-1]], pa.int32()),
                         "items": pa.array([items[a:b].tobytes() for a, b in zip(runs[:-1], runs[1:])], pa.binary())})

    return rows.groupBy("part").applyInArrow(gather, "doc bigint, text_hash int, items binary")


def shared_anchors(docs: DataFrame, lots: int) -> DataFrame:
    """(doc, text_hash, items): for each document the hashes of anchors that other documents hold too, six bytes each; odd ones are hot."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(k).to_numpy() for k in (0, 1))
            for lo, hi, data, offsets in pieces(batch.column(2)):
                _, row, h = anchors(data, offsets)
                h &= ~np.uint64(0x1FFFF)  # 48 bits are sent, the lowest for a mark
                lot = _lots(h >> np.uint64(17), lots)
                order = np.lexsort((h, row, lot))
                lot, row, h = lot[order], row[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                lot, row, h = lot[new], row[new], h[new]
                out = []
                for a, b in zip((c := _cuts(lot))[:-1], c[1:]):
                    runs = _cuts(row[a:b])
                    who = row[a:b][runs[:-1]] + lo
                    out.append((int(lot[a]), packed(doc[who]), packed(text_hash[who]), packed(np.diff(runs).astype(np.uint32)), _short(h[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.int32()] + [pa.binary()] * 4)], ["lot", "docs", "hashes", "counts", "anchors"])

    def answer(lot: pa.Table) -> pa.Table:
        doc, text_hash, count = (unpacked(lot.column(c), t) for c, t in (("docs", np.int64), ("hashes", np.int32), ("counts", np.uint32)))
        h = _long(b"".join(lot.column("anchors").to_pylist()))
        owner = np.repeat(np.arange(len(doc)), count)
        order = np.lexsort((doc[owner], h))
        h, owner = h[order], owner[order]
        runs = _cuts(h)
        first, size = runs[:-1], np.diff(runs)
        # Held by more than one document: the ids at both ends of the run differ.
        many = doc[owner[first]] != doc[owner[runs[1:] - 1]] if len(h) else np.zeros(0, bool)
        keep = np.repeat(many, size)
        found = (h | np.repeat((size > HOT).astype(np.uint64) << np.uint64(16), size))[keep]
        owner = owner[keep]
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
        runs = _cuts(owner)
        who = owner[runs[:-1]]
        return to_parts(doc[who], text_hash[who], np.diff(runs), np.frombuffer(_short(found), "V6"), lots)

    sent = docs.mapInArrow(send, "lot int, docs binary, hashes binary, counts binary, anchors binary")
    return by_document(sent.groupBy("lot").applyInArrow(answer, PARTS), "V6")


def surroundings(docs: DataFrame, found: DataFrame, lots: int) -> DataFrame:
    """Rows (lot, docs, hashes, begins, parts) of the bytes around shared anchors, or with lot -1 of stretches that are already known to repeat.

    Of equal surroundings that one task sees only those in the first document are sent on; in
    the later ones they repeat.
    """
    both = docs.join(found, ["doc", "text_hash"]).select("doc", "text_hash", "text", "items")
    names = ["lot", "docs", "hashes", "begins", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(k).to_numpy() for k in (0, 1))
            answers = batch.column(3).to_pylist()
            for lo, hi, data, offsets in pieces(batch.column(2)):
                at, row, h = anchors(data, offsets)
                known = [_long(a) for a in answers[lo:hi]]
                owner = np.repeat(np.arange(hi - lo), [len(k) for k in known])
                known = np.concatenate(known) if known else np.zeros(0, np.uint64)
                hot = known & np.uint64(0x10000) > 0
                known = (known & ~np.uint64(0x1FFFF)) | owner.astype(np.uint64)
                order = np.argsort(known)
                known, hot = known[order], hot[order]
                mine = (h & ~np.uint64(0x1FFFF)) | row.astype(np.uint64)
                place = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
                is_shared = known[place] == mine if len(known) else np.zeros(len(mine), bool)
                at, row, h, hot = at[is_shared], row[is_shared], h[is_shared], hot[place[is_shared]]
                begin = np.maximum(offsets[row], at - PLACES + 1)
                end = np.minimum(offsets[row + 1], at + GRAM + PLACES - 1)
                lot = _lots((h & ~np.uint64(0x1FFFF)) >> np.uint64(17), lots)
                if hot.any():
                    # One window each, dealt out by the window itself.
                    windows = end[hot] - begin[hot] - WINDOW + 1
                    first = np.repeat(begin[hot], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                    first, index = np.unique(first, return_index=True)
                    its_row = np.repeat(row[hot], windows)[index]
                    w = mixed(token_hashes(data, first, first + WINDOW))
                    begin, end = np.concatenate([begin[~hot], first]), np.concatenate([end[~hot], first + WINDOW])
                    row, lot = np.concatenate([row[~hot], its_row]), np.concatenate([lot[~hot], _lots(w, lots)])
                if not len(begin):
                    continue
                size = end - begin
                parts = sliding_window_view(np.concatenate([data, np.zeros(SPAN, np.uint8)]), SPAN)[begin]
                parts = np.where(np.arange(SPAN) < size[:, None], parts, 0).astype(np.uint8)
                parts = np.concatenate([parts, size[:, None].astype(np.uint8)], axis=1)
                same = np.unique(parts.view(f"V{SPAN + 1}").ravel(), return_inverse=True)[1]
                least = np.full(same.max() + 1, np.iinfo(np.int64).max)
                who = doc[lo + row]
                np.minimum.at(least, same, who)
                later = who > least[same]
                lot = np.where(later, -1, lot)
                begins = begin - offsets[row]
                ends = np.concatenate([begins[:, None], (begins + size)[:, None]], axis=1).astype(np.uint32)
                order = np.lexsort((begins, row, lot))
                out = []
                for a, b in zip((c := _cuts(lot[order]))[:-1], c[1:]):
                    o = order[a:b]
                    known_ = lot[o[0]] < 0
                    out.append((int(lot[o[0]]), packed(who[o]), packed(text_hash[lo + row[o]]), packed(ends[o] if known_ else begins[o].astype(np.uint32)), b"" if known_ else packed(parts[o])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 4)], names)

    return both.mapInArrow(run, "lot int, docs binary, hashes binary, begins binary, parts binary")


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Places of ``wanted`` (flags) in the order of the ``depth`` bytes that begin there; ``text`` ends with that many bytes more.

    Only suffixes that are smaller than their successors are sorted by their bytes.  Every other
    one begins with a byte no smaller than the next, so it follows from its successor's rank:
    the buckets of first bytes are gone through upwards, and within a bucket these come before
    the sorted ones, those with a run of the bucket's byte in order of the run's length.
    """
    n = len(wanted)
    step = (text[1:n + 1] > text[:n]).astype(np.int8) - (text[1:n + 1] < text[:n])
    # A byte equal to the next is of the next one's kind.
    after = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    after = np.minimum.accumulate(after[::-1])[::-1]
    rising = (after == n) | (step[np.minimum(after, n - 1)] > 0)
    del after, step
    # A falling suffix needs its successor, down to the next rising one.
    need = wanted.copy()
    while True:
        more = np.zeros(n, bool)
        more[1:] = need[:-1] & ~rising[:-1] & ~need[1:]
        if not more.any():
            break
        need |= more
    direct = np.flatnonzero(need & rising)
    direct = direct[np.argsort(sliding_window_view(text, depth)[direct].copy().view(f"V{depth}").ravel(), kind="stable")] if len(direct) else direct
    falling = np.flatnonzero(need & ~rising)
    rank = np.full(n + 1, -1, np.int32)
    rank[n] = 0  # the end comes before all
    out, count = [], 1
    direct_edges = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    by_byte = falling[np.argsort(text[falling], kind="stable")]
    edges = np.searchsorted(text[by_byte], np.arange(257)) if len(by_byte) else np.zeros(257, np.int64)
    for c in range(256):
        left = by_byte[edges[c]:edges[c + 1]]
        while len(left):
            ready = rank[left + 1] >= 0
            now = left[ready]
            if not len(now):
                raise AssertionError("a falling suffix without its successor")
            now = now[np.argsort(rank[now + 1], kind="stable")]
            rank[now] = count + np.arange(len(now))
            count += len(now)
            out.append(now)
            left = left[~ready]
        here = direct[direct_edges[c]:direct_edges[c + 1]]
        rank[here] = count + np.arange(len(here))
        count += len(here)
        out.append(here)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WINDOW, step: int = 100_000) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in the order, ``depth`` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    view = sliding_window_view(text, depth)
    for k in range(1, len(order), step):
        now = order[k:k + step]
        differ = view[now] != view[order[k - 1:k - 1 + len(now)]]
        out[k:k + len(now)] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def repeats(lot: pa.Table, lots: int) -> pa.Table:
    """The stretches of one lot, by parts of the documents: where strings begin that also begin in an earlier document."""
    doc, text_hash, begin = (unpacked(lot.column(c), t) for c, t in (("docs", np.int64), ("hashes", np.int32), ("begins", np.uint32)))
    parts = unpacked(lot.column("parts"), f"V{SPAN + 1}")
    # Equal surroundings are looked at once, for the first document that holds them.
    distinct, of = np.unique(parts, return_inverse=True)
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, of, doc)
    parts = distinct.view(np.uint8).reshape(-1, SPAN + 1)
    size = parts[:, SPAN].astype(np.int64)
    text = np.concatenate([parts[:, :SPAN].ravel(), np.zeros(WINDOW + 1, np.uint8)])
    starts = np.arange(SPAN) + WINDOW <= size[:, None]
    order = suffix_order(text, starts.ravel())
    runs = _cuts(np.cumsum(common_prefixes(text, order) < WINDOW))
    least = np.minimum.reduceat(first[order // SPAN], runs[:-1]) if len(order) else first[:0]
    earliest = np.full(starts.size, np.iinfo(np.int64).max)
    earliest[order] = np.repeat(least, np.diff(runs))
    earliest = earliest.reshape(starts.shape)[:, :PLACES]
    out = []
    for k in range(0, len(doc), 50_000):
        flag = np.zeros((min(50_000, len(doc) - k), PLACES + 2), np.int8)
        flag[:, 1:-1] = earliest[of[k:k + 50_000]] < doc[k:k + 50_000, None]
        edge = np.diff(flag, axis=1)
        who, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1]
        out.append((who + k, begin[who + k] + a, begin[who + k] + b + WINDOW - 1))
    who, a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return _stretches(doc[who], text_hash[who], a, b, lots)


def _stretches(doc: np.ndarray, text_hash: np.ndarray, a: np.ndarray, b: np.ndarray, lots: int) -> pa.Table:
    """Stretches packed by parts of the documents; those of a document that meet are one."""
    order = np.lexsort((a, text_hash, doc))
    doc, text_hash, a, b = (x[order] for x in (doc, text_hash, a.astype(np.int64), b.astype(np.int64)))
    runs = _cuts_of(doc, text_hash)
    # All documents at once, each shifted to a place of its own.
    shift = np.repeat(np.arange(len(runs) - 1), np.diff(runs)) << np.int64(33)
    one = joined(np.stack([a + shift, b + shift], 1))
    count = np.bincount(one[:, 0] >> np.int64(33), minlength=len(runs) - 1)
    both = np.ascontiguousarray((one & np.int64((1 << 33) - 1)).astype(np.uint32))
    return to_parts(doc[runs[:-1]], text_hash[runs[:-1]], count, both.view("V8").ravel(), lots)


def _cuts_of(*columns: np.ndarray) -> np.ndarray:
    if not len(columns[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(columns[0])]])


def joined(stretches: np.ndarray) -> np.ndarray:
    """Stretches (begin, end) as the least number of them; those that touch are one."""
    if len(stretches) < 2:
        return stretches
    s = stretches[np.argsort(stretches[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([s[first, 0], reach[np.append(first[1:], len(s)) - 1]], 1)


def passed_on(lot: pa.Table, lots: int) -> pa.Table:
    doc, text_hash, ends = (unpacked(lot.column(c), t) for c, t in (("docs", np.int64), ("hashes", np.int32), ("begins", np.uint32)))
    ends = ends.reshape(-1, 2)
    return _stretches(doc, text_hash, ends[:, 0], ends[:, 1], lots)


def release(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written out and read back, with a hint to Spark's cleaner that the shuffles behind it are done with."""
    out = cut(build())
    for _ in range(2):  # Python lets go of the plan first, the driver's JVM of its shuffles after that
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    return out


def stretches(docs: DataFrame, lots: int) -> DataFrame:
    """(doc, text_hash, items) of all documents with repeats: their stretches."""
    found = release(docs.sparkSession, lambda: shared_anchors(docs, lots))

    def solve(lot: pa.Table) -> pa.Table:
        return passed_on(lot, lots) if lot.column("lot")[0].as_py() < 0 else repeats(lot, lots)

    # Stretches already known go along in lots of their own, dealt out by their documents.
    key = F.when(F.col("lot") >= 0, F.col("lot")).otherwise(-1 - F.pmod(F.xxhash64("docs"), F.lit(lots)).cast("int")).alias("lot")
    return release(docs.sparkSession, lambda: by_document(surroundings(docs, found, lots).withColumn("lot", key).groupBy("lot").applyInArrow(solve, PARTS), "V8"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of (doc_id, text).

    A byte is removed if a string of ``WINDOW`` bytes that covers it also begins in a document
    with a smaller id.  ``kept`` are the remaining bytes.

    Null texts are empty; texts shorter than the window lose nothing and give nothing to find.
    Repeated rows have the same id, so none is earlier than the other, and they lose the same
    bytes.  Texts of one id are told apart by a hash.  Rows with a null id are left whole.
    """
    text_hash = F.hash("text").alias("text_hash")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text_hash, "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lots = max(parts, -(-size // LOT_BYTES))
    found = stretches(keyed.filter("doc IS NOT NULL AND text IS NOT NULL"), lots)
    all_of = keyed.join(found, ["doc", "text_hash"], "left").select("doc", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found_ in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                data = text.as_py() or b""
                gone = joined(np.frombuffer(found_.as_py() or b"", np.uint32).reshape(-1, 2))
                kept, last = [], 0
                for a, b in gone.tolist():
                    kept.append(data[last:a])
                    last = b
                kept = b"".join([*kept, data[last:]])
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, sha, kept = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return all_of.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


@query("op3_repeated_passages")
def op3(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
