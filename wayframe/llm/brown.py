"""Language-model scores by word classes: class transitions and words within classes.

Words are known by 64-bit hashes of their lower-cased bytes.  The most frequent are held by
every task; the counts of all others stay in a table and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard
from .blocks import lowered, pieces, token_hashes, tokens
from .features import bucket_of
from .registry import query, table

FOLDS, HELD = 7, 2
# Words whose counts every task holds (sizes that do not depend on the input): the first
# EXCHANGED are dealt to classes by full exchange, those up to CLASSED by one step of it; then all of them
# are exchanged in at most SWEEPS sweeps, half of the words in each.
HELD_WORDS = 262_144
CLASSED = HELD_WORDS
EXCHANGED = 1_024
CLASSES = 64
ROUNDS = 12
SWEEPS = 4
# Words whose neighbours' classes a task counts in one pass.
COUNTED = 65_536
# The end of a text is a token; no word has this hash, as words' hashes are odd.
END = np.uint64(0)
# Words that occur less often are not dealt to a class of their neighbours.
LEAST = 2
# Weight of the classes' own frequencies in the transitions, and of the class model beside plain word frequencies.
BACK = 20.0
SHARE = 0.8


@dataclass
class Held:
    """What every task knows: sorted hashes of the frequent words, their counts and their ids by frequency."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    classes: np.ndarray | None = None  # by id

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index in ``hashes``, -1 for words that are not held."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of the tokens with each text's end, row of each) in bounded pieces."""
    for lo, hi, data, offsets in pieces(column):
        low = lowered(data)
        start, end, row = tokens(low, offsets, runs=False)
        out = np.full(len(start) + hi - lo, END, np.uint64)
        at = np.arange(len(start)) + row
        out[at] = token_hashes(low, start, end) | np.uint64(1)
        rows = np.repeat(np.arange(hi - lo), np.bincount(row, minlength=hi - lo) + 1)
        yield lo, hi, out, rows


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def word_counts(train: DataFrame, flush: int = 4_000_000) -> DataFrame:
    """(word, n) over all training tokens, summed in each task before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            if seen:
                h, n = (np.concatenate(x) for x in zip(*seen))
                u, at = np.unique(h, return_inverse=True)
                total = np.bincount(at, n).astype(np.int64)
                for k in range(0, len(u), 500_000):
                    yield pa.RecordBatch.from_arrays([signed(u[k:k + 500_000]), pa.array(total[k:k + 500_000])], ["word", "n"])
                seen.clear()

        for batch in batches:
            for _, _, h, _ in streams(batch.column(0)):
                seen.append(np.unique(h, return_counts=True))
                held += len(seen[-1][0])
                if held > flush:
                    yield from merged()
                    held = 0
        yield from merged()

    return train.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int = HELD_WORDS) -> Held:
    """The most frequent words, at most ``most``: those above a count that a histogram of counts gives."""
    step = F.floor(8 * F.log2("n"))
    bins = sorted(words.groupBy(step.alias("b")).count().collect(), key=lambda r: -r["b"])
    least, total = None, 0
    for r in bins:
        total += r["count"]
        if total > most:
            break
        least = r["b"]
    rows = words.filter(step >= least).collect() if least is not None else []
    h = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(h)
    h, n = h[order], n[order]
    ids = np.empty(len(h), np.int64)
    ids[np.lexsort((h, -n))] = np.arange(len(h))
    return Held(h, n, ids) if len(h) else Held(np.array([END]), np.zeros(1, np.int64), np.zeros(1, np.int64))


def _summed(parts: DataFrame, key: str, width: int) -> list[tuple[int, np.ndarray]]:
    rows = parts.groupBy(key).applyInArrow(lambda g: _add(g, key, width), f"{key} int, at binary, n binary").collect()
    return [(r[key], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int64)) for r in rows]


def _add(group: pa.Table, key: str, width: int) -> pa.Table:
    total = np.zeros(width, np.int64)
    for at, n in zip(group.column("at"), group.column("n")):
        total[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(n.as_py(), np.int64)
    at = np.flatnonzero(total)
    return pa.table({key: pa.array([group.column(key)[0].as_py()], pa.int32()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "n": pa.array([total[at].tobytes()], pa.binary())})


def _packed(key: str, rows: Iterator[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """Rows of counts as (key, columns that are not 0, their counts)."""
    found = [(k, np.flatnonzero(v), v) for k, v in rows]
    found = [(k, at, v) for k, at, v in found if len(at)]
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, _, _ in found], pa.int32()), pa.array([at.astype(np.int32).tobytes() for _, at, _ in found], pa.binary()),
        pa.array([v[at].astype(np.int64).tobytes() for _, at, v in found], pa.binary())], [key, "at", "n"])


def numbered(train: DataFrame, held: Held) -> DataFrame:
    """The tokens of the training texts as ids by frequency (-1: not held), a row for each piece; the passes after it read no text."""
    shared = train.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, _ in streams(batch.column(0)):
                at = shared.value.find(h)
                yield pa.RecordBatch.from_arrays([pa.array([np.where(at >= 0, shared.value.ids[at], -1).astype(np.int32).tobytes()], pa.binary())], ["ids"])

    return cut(train.select("text").mapInArrow(run, "ids binary"))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column(0):
            yield np.frombuffer(row.as_py(), np.int32)


def neighbour_counts(numbers: DataFrame, held: Held, size: int = EXCHANGED) -> np.ndarray:
    """How often each of the ``size`` most frequent words follows each; all others are one word more."""
    width, first = size + 1, _end(held, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for ids in _ids(batches):
            word = np.where(ids >= 0, np.minimum(ids, size), size).astype(np.int64)
            total += np.bincount(np.concatenate([[first], word[:-1]]) * width + word, minlength=width * width)
        yield _packed("word", ((k, total[k * width:(k + 1) * width]) for k in range(width)))

    out = np.zeros((width, width), np.int64)
    for k, at, n in _summed(numbers.mapInArrow(run, "word int, at binary, n binary"), "word", width):
        out[k, at] = n
    return out


def _end(held: Held, most: int) -> int:
    at = held.find(np.array([END]))[0]
    return int(min(held.ids[at], most)) if at >= 0 else most


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def gains(g: np.ndarray, left: np.ndarray, right: np.ndarray, own: float) -> np.ndarray:
    """Change of the class bigrams' log likelihood by adding a word to each class.

    ``g`` counts transitions between classes without the word's; ``left`` and ``right`` count the classes before
    and after the word, ``own`` the word after itself.
    """
    # What does not meet the word does not change; a rare word meets few classes.
    l, r = np.flatnonzero(left), np.flatnonzero(right)
    into = (_xlogx(g[l] + left[l, None]) - _xlogx(g[l])).sum(0)
    from_ = (_xlogx(g[:, r] + right[None, r]) - _xlogx(g[:, r])).sum(1)
    d = np.diag(g)
    same = _xlogx(d + left + right + own) + _xlogx(d) - _xlogx(d + left) - _xlogx(d + right)
    # What stands beside the word counts for its own class wherever the word goes.
    rows, cols = g.sum(1) + left, g.sum(0) + right
    return (into + from_ + same
            - _xlogx(rows + right.sum() + own) + _xlogx(rows) - _xlogx(cols + left.sum() + own) + _xlogx(cols))


def gains_of_many(g: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """:func:`gains` of several words at once, a row each; with ``of`` each is counted in ``g`` and first taken out of its class there."""
    k = np.arange(len(own))
    d, rows, cols = (np.tile(x, (len(own), 1)) for x in (np.diag(g), g.sum(1), g.sum(0)))
    before, after = left.sum(1), right.sum(1)
    if of is not None:
        d[k, of] -= left[k, of] + right[k, of] + own
        rows[k, of] -= after + own
        cols[k, of] -= before + own

    def side(n: np.ndarray, g: np.ndarray, other: np.ndarray) -> np.ndarray:
        w, c = np.nonzero(n)
        base, more = g[c], n[w, c]
        if of is not None:
            base[np.arange(len(w)), of[w]] -= more
            mine = np.flatnonzero(c == of[w])
            base[mine] -= other[w[mine]]
            base[mine, of[w[mine]]] -= own[w[mine]]
        out = np.zeros(n.shape)
        if len(w):
            starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            out[w[starts]] = np.add.reduceat(_xlogx(base + more[:, None]) - _xlogx(base), starts, axis=0)
        return out

    at = lambda x: x[:, None]
    return (side(left, g, right) + side(right, g.T, left) + _xlogx(d + left + right + at(own)) + _xlogx(d) - _xlogx(d + left) - _xlogx(d + right)
            - _xlogx(rows + at(after + own)) + _xlogx(rows) - _xlogx(cols + at(before + own)) + _xlogx(cols))


def likelihood(g: np.ndarray) -> float:
    """What of the class bigrams' log likelihood depends on the classes."""
    return float(_xlogx(g).sum() - _xlogx(g.sum(1)).sum() - _xlogx(g.sum(0)).sum())


def exchange(c: np.ndarray, fixed: set[int], classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word and the class transitions, by moving one word at a time to its best class.

    ``fixed`` words have a class each for themselves, after the others' classes.
    """
    size = len(c)
    total = classes + len(fixed)
    of = np.arange(size) % classes
    for k, w in enumerate(sorted(fixed)):
        of[w] = classes + k
    one = np.zeros((size, total))
    one[np.arange(size), of] = 1
    c = c.astype(float)
    g = one.T @ c @ one
    free = [w for w in range(size) if w not in fixed and c[w].sum() + c[:, w].sum() > 0]
    for _ in range(rounds):
        moved = 0
        for w in free:
            a, own = of[w], c[w, w]
            left, right = c[:, w] @ one, c[w] @ one
            left[a] -= own
            right[a] -= own
            g[:, a] -= left
            g[a] -= right
            g[a, a] -= own
            b = int(np.argmax(gains(g, left, right, own)[:classes]))
            g[:, b] += left
            g[b] += right
            g[b, b] += own
            if a != b:
                one[w, a], one[w, b], of[w] = 0, 1, b
                moved += 1
        if not moved:
            break
    return of, g


def one_step(numbers: DataFrame, held: Held, of: np.ndarray, g: np.ndarray, size: int, classed: int, classes: int) -> np.ndarray:
    """Classes of the words from rank ``size`` to ``classed``: the best one for each, the others staying as they are."""
    last = min(classed, int((held.counts >= LEAST).sum()))  # ids go by falling counts
    if last <= size:
        return of[:size].astype(np.int16)
    out = np.concatenate([of[:size], np.full(last - size, -1)]).astype(np.int16)
    for w, c in _moves(numbers, of[np.minimum(np.arange(last + 1), size)], g, np.arange(size, last), int(of[_end(held, size)]), classes, inside=False):
        out[w] = c
    return out


def sweeps(numbers: DataFrame, held: Held, of: np.ndarray, total: int, classes: int, most: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Exchange over all dealt words: their classes, the class transitions, and the likelihoods of the states that were taken.

    In a sweep every second word goes to its best class, the others staying as they are.  A sweep counts only if the
    likelihood grows by it, as words that go at the same time do not see each other; if it does not, only every second,
    fourth or eighth of them goes.  No word goes to a nearly empty class.  After two sweeps that do not count, it is done.
    """
    end = held.find(np.array([END]))[0]
    end = int(held.ids[end]) if end >= 0 else -1
    first = int(of[end]) if 0 <= end < len(of) else total - 1
    t = transitions(numbers, of, first, total)
    seen, idle = [likelihood(t)], 0
    for k in range(most if len(of) else 0):
        asked = np.arange(k % 2, len(of), 2)
        asked = asked[asked != end]
        tried = of.copy()
        for w, c in _moves(numbers, np.append(of, total - 1), t, asked, first, classes, inside=True) if len(asked) else []:
            tried[w] = c
        idle += 1
        for share in (1, 2, 4, 8):
            new = np.where((np.arange(len(of)) // 2 + k // 2) % share == 0, tried, of)
            now = transitions(numbers, new, first, total) if (new != of).any() else t
            if likelihood(now) > seen[-1]:
                of, t, idle = new, now, 0
                seen.append(likelihood(now))
                break
        if idle == 2:
            break
    return of, t, seen


def _moves(numbers: DataFrame, of: np.ndarray, g: np.ndarray, asked: np.ndarray, first: int, classes: int, inside: bool, group: int = 256) -> list[tuple[int, int]]:
    """The best class of each word that is asked for, where it is another than its own.

    ``of`` has the class of each word by id and, last, that of all others; ``first`` is the class before a text.  ``inside``
    tells that the words are counted in ``g``, where their classes then lose them before they choose.
    """
    if len(asked) > COUNTED:
        return [move for lo in range(0, len(asked), COUNTED) for move in _moves(numbers, of, g, asked[lo:lo + COUNTED], first, classes, inside, group)]
    total, most = len(g), len(of) - 1
    span = 2 * total + 1
    place = np.full(most + 1, -1)
    place[asked] = np.arange(len(asked))
    shared = numbers.sparkSession.sparkContext.broadcast((of.astype(np.int32), g, asked, place.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_, _, asked_, place_ = shared.value
        counts = np.zeros(len(asked_) * span, np.int32)
        for ids in _ids(batches):
            word = np.where(ids >= 0, np.minimum(ids, most), most)
            kind, at = of_[word], place_[word]
            alike = np.concatenate([[False], (word[1:] == word[:-1]) & (at[1:] >= 0)])  # a word after itself
            for near, skip, shift in ((np.concatenate([[first], kind[:-1]]), alike, 0), (np.concatenate([kind[1:], [first]]), np.append(alike[1:], False), total)):
                here = np.flatnonzero((at >= 0) & ~skip)
                np.add.at(counts, at[here].astype(np.int64) * span + shift + near[here], np.int32(1))
            np.add.at(counts, at[alike].astype(np.int64) * span + 2 * total, np.int32(1))
        yield _packed("part", ((k // group, counts[k * span:(k + group) * span]) for k in range(0, len(asked_), group)))

    def best(rows: pa.Table) -> pa.Table:
        of_, g_, asked_, _ = shared.value
        part = rows.column("part")[0].as_py()
        found = _add(rows, "part", group * span)
        n = np.zeros(group * span, np.int64)
        n[np.frombuffer(found.column("at")[0].as_py(), np.int32)] = np.frombuffer(found.column("n")[0].as_py(), np.int64)
        n = n.reshape(group, span).astype(float)
        words = asked_[part * group:(part + 1) * group]
        n = n[:len(words)]
        of_words = of_[words] if inside else None
        gain = gains_of_many(g_, n[:, :total], n[:, total:2 * total], n[:, 2 * total], of_words)[:, :classes]
        if inside:  # nearly empty classes would draw words that all count on being alone there
            stays = gain[np.arange(len(words)), of_words]
            gain[:, g_.sum(1)[:classes] < g_.sum() / classes ** 2] = -np.inf
        to = gain.argmax(1)
        new = gain.max(1) > stays + 1e-6 if inside else np.ones(len(words), bool)
        return pa.table({"word": pa.array(words[new].astype(np.int32)), "class": pa.array(to[new].astype(np.int32))})

    moved = numbers.mapInArrow(run, "part int, at binary, n binary").groupBy("part").applyInArrow(best, "word int, class int").collect()
    shared.unpersist()
    return [(r["word"], r["class"]) for r in moved]


def transitions(numbers: DataFrame, of: np.ndarray, first: int, total: int) -> np.ndarray:
    """How often each class follows each, over all training tokens; words past the end of ``of`` are of the last class."""
    shared = numbers.sparkSession.sparkContext.broadcast(np.append(of, total - 1).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_ = shared.value
        counts = np.zeros(total * total, np.int64)
        for ids in _ids(batches):
            kind = of_[np.where(ids >= 0, np.minimum(ids, len(of_) - 1), len(of_) - 1)]
            counts += np.bincount(np.concatenate([[first], kind[:-1]]) * total + kind, minlength=total * total)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(counts[at])], ["pair", "n"])

    out = np.zeros(total * total)
    for r in numbers.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(total, total)


def kinds(held: Held, at: np.ndarray, total: int) -> np.ndarray:
    """Class of each token; the last class is that of all words that were not dealt to one."""
    rank = np.where(at >= 0, held.ids[at], len(held.classes))
    return np.where(rank < len(held.classes), held.classes[np.minimum(rank, len(held.classes) - 1)], total - 1).astype(np.int64)


def _end_kind(held: Held, total: int) -> int:
    return int(kinds(held, held.find(np.array([END])), total)[0])


def score(docs: DataFrame, fold: int = HELD, folds: int = FOLDS, held_words: int = HELD_WORDS, classed: int = CLASSED, exchanged: int = EXCHANGED, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the log10 probability of the text's words and its end: for each token the
    smoothed probability of its class after the class before it, times the token's share of
    its class, mixed with the token's share of all.  Words that were not dealt to a class share the last one, where one more word
    stands for all that training did not see.  All words are counted; those beyond the held
    ones are joined with the table of counts.

    Null and empty texts have the end as their only token.  Repeated rows are scored each.
    Without training rows every token is unseen.
    """
    spark = docs.sparkSession
    out = (bucket_of(F.col("doc_id"), folds) == fold).alias("held_out")
    train = docs.filter(bucket_of(F.col("doc_id"), folds) != fold)
    words = cut(word_counts(train))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = sums["n"], sums["v"]
    held = frequent(words, held_words)
    size = max(1, min(exchanged, int((held.counts >= LEAST).sum())))
    end = _end(held, size)
    numbers = numbered(train, held)
    c = neighbour_counts(numbers, held, size)
    of, g = exchange(c, {end, size}, classes)
    total = classes + 3  # the end's class, that of the other words while exchanging, and that of words never dealt
    held.classes, t, _ = sweeps(numbers, held, one_step(numbers, held, of, g, size, classed, classes), total, classes)
    discard(numbers)
    own = np.bincount(np.where(held.ids < len(held.classes), held.classes[np.minimum(held.ids, len(held.classes) - 1)], total - 1), held.counts, total)
    dealt = held.ids < len(held.classes)
    rest_n, rest_v = n_all - held.counts[dealt].sum(), v_all - int((held.counts[dealt] > 0).sum())
    alone = (t.sum(0) + 1) / (t.sum() + total)
    step = (t + BACK * alone[None, :]) / (t.sum(1, keepdims=True) + BACK)
    kind = np.where(dealt, held.classes[np.minimum(held.ids, len(held.classes) - 1)], total - 1)
    below, base_below = float(rest_n + rest_v + 1), float(n_all + v_all + 1)
    inside = np.where(dealt, np.maximum(held.counts, 1) / np.maximum(own[kind], 1), (held.counts + 1) / below)
    base = (held.counts + 1) / base_below
    shared = spark.sparkContext.broadcast((held, step, inside, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, step_, inside_, base_ = shared.value
        row_id = np.int64(TaskContext.get().partitionId()) << np.int64(40)
        for batch in batches:
            for lo, hi, h, row in streams(batch.column(1)):
                at = known.find(h)
                rare = at < 0
                k = kinds(known, at, total)
                moves = step_[np.concatenate([[_end_kind(known, total)], k[:-1]]), k]
                n = hi - lo
                uid = row_id + np.arange(n, dtype=np.int64)
                row_id += n
                # A word to look up has one more than its count for a factor on both sides, which is put in later.
                model = np.bincount(row, np.log10(SHARE * moves * np.where(rare, 1 / below, inside_[at]) + (1 - SHARE) * np.where(rare, 1 / base_below, base_[at])), n)
                plain = np.bincount(row, np.where(rare, 0.0, np.log10(base_[at])), n)
                seen = np.bincount(row, (~rare) & (known.counts[at] > 0), n).astype(np.int64)
                # One row for the text, with a key that meets no word (words' hashes are odd), and one for each word to look up.
                yield pa.RecordBatch.from_arrays([
                    pa.array(uid), pa.array((uid << np.int64(1)) & np.int64(-2)), batch.column(0)[lo:hi], pa.array(np.bincount(row, minlength=n).astype(np.int64)),
                    pa.array(seen), pa.array(plain), pa.array(model)], names)
                if rare.any():
                    r, w = row[rare], h[rare]
                    order = np.lexsort((w, r))
                    r, w = r[order], w[order]
                    new = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
                    first = np.flatnonzero(new)
                    times = np.diff(np.append(first, len(r))).astype(np.int64)
                    none = len(first)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(uid[r[first]]), signed(w[first]), pa.nulls(none, batch.column(0).type), pa.array(times),
                        pa.nulls(none, pa.int64()), pa.nulls(none, pa.float64()), pa.nulls(none, pa.float64())], names)

    names = ["row_id", "word", "doc_id", "times", "seen", "plain", "model"]
    doc_type = dict(docs.dtypes)["doc_id"]
    spent = docs.select("doc_id", "text").mapInArrow(run, f"row_id bigint, word bigint, doc_id {doc_type}, times bigint, seen bigint, plain double, model double")
    looked = spent.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    text = F.col("seen").isNotNull()
    each = looked.groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.sum(F.when(text, F.col("times"))).alias("n_tokens"),
        F.sum(F.when(text, F.col("seen")).when(F.col("n") > 0, F.col("times")).otherwise(F.lit(0))).alias("n_known"),
        F.sum(F.when(text, F.col("plain")).otherwise(F.col("times") * F.log10((F.col("n") + 1) / F.lit(base_below)))).alias("base_score"),
        F.sum(F.when(text, F.col("model")).otherwise(F.col("times") * F.log10(F.col("n") + 1))).alias("score"))
    return each.select("doc_id", out, "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op4_class_bigrams")
def op4(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
