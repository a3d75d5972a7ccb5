"""Documents whose sets of word n-grams are alike, with pairs pruned by their MinHash values as they are compared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import connected
from ..runtime import cut
from .blocks import lowered, mixed, pieces, token_hashes, tokens
from .registry import query, table

WORDS = 5
# A pair is linked from this similarity on: a ratio of whole numbers, so that it is exact.
NUMERATOR, DENOMINATOR = 4, 5
# 128 values in 32 bands: a pair at 0.8 shares no band once in 20 million times.
HASHES, BAND = 128, 4
# Values are compared this many at a time; pairs less likely than this to reach the similarity are dropped.
STEP, TOLERANCE = 32, 1e-6
# Members of a group that are compared with each other in one task.
GROUP = 1_024

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1 << 31, size=HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)


def grams(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct n-grams as hashes, starts by row) in bounded pieces.

    A text of fewer words is one gram; a text without words has none.
    """
    for lo, hi, data, offsets in pieces(column):
        low = lowered(data)
        start, end, row = tokens(low, offsets, runs=False)
        h = token_hashes(low, start, end)
        count = np.bincount(row, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        at = np.arange(len(h)) - first[row]
        n = count[row]
        head = np.flatnonzero((at + words <= n) | ((n < words) & (at == 0)))
        g = np.zeros(len(head), np.uint64)
        for k in range(words):
            there = at[head] + k < n[head]
            g = np.where(there, mixed(g + np.uint64(k + 1) + h[np.minimum(head + k, len(h) - 1)]), g) if len(h) else g
        order = np.lexsort((g, row[head]))
        g, r = g[order], row[head][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]) if len(g) else np.zeros(0, bool)
        g, r = g[new], r[new]
        yield lo, hi, g, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=hi - lo))])


def sums(g: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set of grams."""
    a, b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (mixed(g), mixed(g ^ np.uint64(0x5851F42D4C957F2D))))
    return a[start[1:]] - a[start[:-1]], b[start[1:]] - b[start[:-1]]


def signatures(g: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least value of each hash function over each set, for rows that have grams (others get the largest value)."""
    out = np.full((len(start) - 1, HASHES), np.uint32(0xFFFFFFFF))
    x = (g >> np.uint64(32)).astype(np.uint32)
    rows = np.repeat(np.arange(len(start) - 1), np.diff(start))
    for lo in range(0, len(x), 2_048):
        v = x[lo:lo + 2_048, None] * _FACTORS + _SHIFTS
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        r = rows[lo:lo + 2_048]
        heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        np.minimum.at(out, r[heads], np.minimum.reduceat(v, heads, axis=0)) if len(heads) > 1 else np.minimum(out[r[0]], v.min(0), out=out[r[0]])
    return out


def signed_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b, n, sig, keys): the set's name and size, a byte of each MinHash value, and a key for each band."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, g, start in grams(batch.column(1)):
                a, b = sums(g, start)
                sig = signatures(g, start)
                wide = sig.astype(np.uint64).reshape(hi - lo, -1, BAND)
                key = np.zeros(wide.shape[:2], np.uint64) + np.arange(1, wide.shape[1] + 1, dtype=np.uint64)
                for k in range(BAND):
                    key = mixed(key + wide[:, :, k])
                low = (sig & np.uint32(255)).astype(np.uint8)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * key.shape[1]), pa.array(key.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.diff(start).astype(np.int32)),
                                                  pa.array([s.tobytes() for s in low], pa.binary()), keys], ["doc_id", "a", "b", "n", "sig", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a bigint, b bigint, n int, sig binary, keys array<bigint>")


@lru_cache
def least_matches(step: int = STEP, tolerance: float = TOLERANCE, hashes: int = HASHES) -> dict[int, int]:
    """After so many compared values, the fewest equal ones with which a pair is kept.

    With every similarity as likely before, the chance that a pair with m of n equal bytes
    reaches the similarity is the chance of at most m successes in n + 1 draws at it.
    """
    t = NUMERATOR / DENOMINATOR
    t += (1 - t) / 256  # bytes are equal by chance
    out = {}
    for n in range(step, hashes + 1, step):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                out[n] = m
                break
    return out


def likely(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows of bytes are kept to the end."""
    keep, equal = np.arange(len(x)), np.zeros(len(x), np.int32)
    for n, least in least_matches().items():
        equal += (x[keep, n - STEP:n] == y[keep, n - STEP:n]).sum(1, dtype=np.int32)
        held = equal >= least
        keep, equal = keep[held], equal[held]
    return keep


def forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``count`` members, the least member it is connected with by the pairs."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pairs_of(sizes: np.ndarray, first_side: np.ndarray | None = None, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members within consecutive groups of these sizes, a bounded number at a time."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    member_end = np.repeat(starts[1:], sizes)
    later = member_end - np.arange(len(member_end)) - 1  # partners that come after each member
    reach = np.cumsum(later)
    lo = 0
    while lo < len(later):
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + most, "right")))
        i = np.repeat(np.arange(lo, hi), later[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[lo:hi]) - later[lo:hi], later[lo:hi])
        yield i, j
        lo = hi


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 8_192) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by ``keys``, several small ones together."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < most:
            continue
        whole = pa.concat_tables(held)
        edge = int(_edges(whole, keys)[-1])
        if edge:
            yield whole.slice(0, edge).combine_chunks()
        held = [whole.slice(edge)]
    if held and sum(t.num_rows for t in held):
        yield pa.concat_tables(held).combine_chunks()


def _edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        v = rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def blocked(rows: DataFrame, key: str, size: DataFrame, member: str, most: int = GROUP) -> DataFrame:
    """Add ``x`` and ``y``: the pairs of blocks of its group that a member is compared in.

    A group of up to ``most`` members is one block.  A larger one is cut into blocks by a hash,
    and every two blocks meet in a task of their own.
    """
    blocks = F.ceil(F.col("size") / most).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    sized = rows.join(size, key).withColumn("_own", own)
    return (sized.withColumn("_other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / most).cast("int") - 1)))
            .withColumn("x", F.least("_own", "_other")).withColumn("y", F.greatest("_own", "_other")).drop("_other", "size"))


def candidates(sets: DataFrame) -> DataFrame:
    """(u, v): links that connect the members of each band's groups that are likely enough to be alike.

    A pair is looked at in every band that it shares.  Of each task's pairs that are left, a
    forest is given back, so a large group does not give all its pairs.
    """
    bands = sets.select("rep", F.explode("keys").alias("key"))
    # Partial counts are summed before they are shuffled, so a key that all share is no burden.
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = blocked(bands, "key", shared, "rep")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_sig = met.join(sets.select("rep", "sig"), "rep")
    dealt = with_sig.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["key", "x", "y"]):
            starts = _edges(rows, ["key", "x", "y"])
            rep, x, y, own = (rows.column(c).to_numpy() for c in ("rep", "x", "y", "_own"))
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            found = [np.zeros((2, 0), np.int64)]
            for i, j in pairs_of(np.diff(np.append(starts, rows.num_rows))):
                keep = (x[i] == y[i]) | (own[i] != own[j])  # pairs within a block meet where it meets itself
                i, j = i[keep], j[keep]
                held = likely(sig[i], sig[j])
                found.append(np.stack([i[held], j[held]]))
            i, j = np.concatenate(found, axis=1)
            least = forest(rows.num_rows, i, j)
            moved = np.flatnonzero(least != np.arange(rows.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[least[moved]])], ["u", "v"])

    return dealt.select("key", "x", "y", "_own", "rep", "sig").mapInArrow(run, "u bigint, v bigint")


def verified(docs: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """(rep, links, peer): exact links of each set within its candidates, counted with copies, in parts.

    Every member of a group of candidates is sent with its grams to the tasks of its blocks.
    ``peer`` is the least linked member of the task, for the groups of truly linked sets.
    """
    members = sets.join(comps.select(F.col("node").alias("rep"), "comp"), "rep").select("rep", "comp", "a", "b", "n", "sig", "copies")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(members, "rep")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, g, start in grams(batch.column(0)):
                a, b = sums(g, start)
                # A repeated id may stand for other texts too: only the set's own text gives its grams.
                keep = np.flatnonzero((a.view(np.int64) == batch.column(3)[lo:hi].to_numpy()) & (b.view(np.int64) == batch.column(4)[lo:hi].to_numpy()))
                rows = batch.slice(lo, hi - lo).take(pa.array(keep))
                packed = pa.array([g[start[k]:start[k + 1]].tobytes() for k in keep], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in (1, 2, 5, 6)), packed], ["rep", "comp", "sig", "copies", "grams"])

    built = texts.select("text", "rep", "comp", "a", "b", "sig", "copies").mapInArrow(build, "rep bigint, comp bigint, sig binary, copies bigint, grams binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (blocked(built, "comp", sizes, "rep").repartition(parts, "comp", "x", "y").sortWithinPartitions("comp", "x", "y", "rep")
             .select("comp", "x", "y", "_own", "rep", "sig", "copies", "grams"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["comp", "x", "y"], 2_048):
            names = ["comp", "x", "y", "rep"]
            rows = rows.take(pa.array(_edges(rows, names)))  # copies of a row are one member
            starts = _edges(rows, names[:3])
            ends = np.append(starts[1:], rows.num_rows)
            for lo, hi in zip(starts, ends):
                if hi - lo > 1:
                    yield links(rows.slice(int(lo), int(hi - lo)))

    return dealt.mapInArrow(run, "rep bigint, links bigint, peer bigint")


def links(rows: pa.Table) -> pa.RecordBatch:
    """Exact links among the members of one task."""
    rep, copies, own = (rows.column(c).to_numpy() for c in ("rep", "copies", "_own"))
    within = rows.column("x")[0].as_py() == rows.column("y")[0].as_py()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    sets = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
    size = np.array([len(s) for s in sets])
    count, linked, peer = np.zeros(len(rep), np.int64), [], rep.copy()
    left = []
    for i, j in pairs_of(np.array([len(rep)])):
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        keep = (small * DENOMINATOR >= large * NUMERATOR) & (within | (own[i] != own[j]))
        i, j = i[keep], j[keep]
        held = likely(sig[i], sig[j])
        left.append(np.stack([i[held], j[held]]))
    i, j = np.concatenate(left, axis=1)
    common = shared_counts(sets, i, j)
    held = common * DENOMINATOR >= NUMERATOR * (size[i] + size[j] - common)
    i, j = i[held], j[held]
    np.add.at(count, i, copies[j])
    np.add.at(count, j, copies[i])
    least = forest(len(rep), i, j)
    some = np.flatnonzero(count > 0)
    return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(count[some]), pa.array(rep[least[some]])], ["rep", "links", "peer"])


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, dense: int = 20_000) -> np.ndarray:
    """Number of common members of each pair of sorted sets: by merging, or for many pairs by products of 0/1 columns."""
    if len(i) < dense:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    sizes = [len(sets[k]) for k in used]
    row = np.repeat(np.arange(len(used)), sizes)
    _, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    often = times > 1
    column, row = (np.cumsum(often) - 1)[column[often[column]]], row[often[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(used), len(used)), np.float32)  # whole numbers below 2**24 are exact
    for lo in range(0, int(often.sum()), 4_096):
        a, b = np.searchsorted(column, (lo, lo + 4_096))
        part = np.zeros((len(used), 4_096), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total[place[i], place[j]].astype(np.int64)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    Documents are alike when their sets of five-word grams have a Jaccard similarity of at
    least 0.8, in lower case and however spaced; a class is what such links connect and is
    named by its least id.  ``n_links`` counts the other documents that one is alike with.

    Equal sets are one member from the start, so copies are never compared.  Members meet by
    bands of MinHash values; pairs whose values make the similarity unlikely are dropped, and
    what is left is compared exactly.  Groups of any size are dealt in blocks.

    Texts of fewer than five words have one gram.  Texts without words, null ones too, and rows
    with a null id are linked to nothing and are a class by themselves.  Repeated rows are
    copies and are returned each.  Of an id's several texts the others are linked to their
    copies only.
    """
    signed = cut(signed_docs(docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))))
    sets = cut(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b", "n")
               .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    # Where an id is repeated with other texts, several sets have the same least id; one of them goes by it.
    mine = F.min(F.struct("a", "b", "n", "copies", "sig", "keys")).alias("one")
    members = sets.groupBy("rep").agg(mine).select("rep", "one.*")
    comps = connected(candidates(members), "u", "v")
    exact = cut(verified(docs, members, comps))
    named = connected(exact.select("rep", "peer"), "rep", "peer").select(F.col("node").alias("rep"), F.col("comp").alias("class"))
    counts = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    found = members.select("a", "b", "n", "rep").join(counts, "rep").join(named, "rep", "left").drop("rep")
    # Written out, so that both sides of the last join are dealt anew and a set with many copies can be split.
    known = cut(sets.select("a", "b", "n", "rep", "copies").join(found, ["a", "b", "n"], "left")
             .select("a", "b", "n", F.coalesce("class", "rep").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    spread = signed.select("doc_id", *[F.when(some, F.col(c)).alias(c) for c in ("a", "b", "n")])
    return (spread.join(known, ["a", "b", "n"], "left")
            .select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links")))


def first_of_class(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that have the least id of their class.  Rows with a null id all stay."""
    kept = classes(docs).filter(F.col("class_id").eqNullSafe(F.col("doc_id"))).select("doc_id").filter("doc_id IS NOT NULL").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


@query("op9_ngram_classes")
def op9(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
