"""Conversations repaired by the lightest derivation over their rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .order import running
from .registry import query, table

BLANK = " \t\n\x0b\f\r"
# Rows of a conversation that are solved together.
BLOCK = 1_024
# The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# What has been put out so far: nothing, a system turn, a user turn last, an assistant turn last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NONE, ASSISTANT)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}

# The item that stands for a whole repaired conversation.
WHOLE = (-1,)

Weight = tuple[int, str]


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live) rows damaged by a hash of ``conv_id:turn``: lost, emptied, without end marks, repeated or with another role.

    Nulls are one space.  A lost row stays as one that is not ``live``, so that its conversation is not lost.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    marked = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                         (F.crc32(key.cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    text = F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    return marked.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("live"))


def lightest(axioms: Iterable[tuple[tuple, Weight]], rules: Callable[[tuple], Iterable[tuple[tuple, Weight]]], goals: set[tuple]) -> dict[tuple, Weight]:
    """The least (cost, audit) of each goal that can be derived.

    Items wait in an agenda by weight.  A rule concludes an item from a final item and an edit; its
    weight adds the costs and joins the audits, so it is never less than a premise's and grows with
    it, and the lightest item of the agenda is final when it is popped.  It ends once all goals are final.
    """
    agenda = [(cost, audit, item) for item, (cost, audit) in axioms]
    agenda.sort()
    final: dict[tuple, Weight] = {}
    left = set(goals)
    while agenda:
        cost, audit, item = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        left.discard(item)
        if not left:
            break
        for conclusion, (more, edit) in rules(item):
            if conclusion not in final:
                heappush(agenda, (cost + more, audit + edit, conclusion))
    return {g: final[g] for g in goals if g in final}


def edits(fault: str, initial: str, state: int) -> list[tuple[int, Weight]]:
    """(state after, weight) of what can be done with a row: kept, its role changed, or deleted."""
    out = [(state, (DELETE, "D"))]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        if (state, initial) in NEXT:
            out.append((NEXT[state, initial], (more, "K")))
        out += [(NEXT[state, to], (REROLE + more, "R")) for to in ROLES if (state, to) in NEXT]
    return out


def over(rows: list[tuple[str, str]]) -> Callable[[tuple], Iterator[tuple[tuple, Weight]]]:
    """Rules over (fault, initial) rows.

    Items are (rows done, state).  An item and an edit of the next row, or an item and an
    inserted turn, conclude an item; all rows done in a state to end in conclude ``WHOLE``.
    """
    def rules(item: tuple) -> Iterator[tuple[tuple, Weight]]:
        at, state = item
        for to in ROLES:
            if (state, to) in NEXT:
                yield (at, NEXT[state, to]), (INSERT, "I")
        if at < len(rows):
            for after, weight in edits(*rows[at], state):
                yield (at + 1, after), weight
        elif state in GOALS:
            yield WHOLE, (0, "")
    return rules


def whole(rows: list[tuple[str, str]]) -> Weight:
    """The lightest repair of a conversation."""
    return lightest([((0, NONE), (0, ""))], over(rows), {WHOLE})[WHOLE]


def spans(rows: list[tuple[str, str]]) -> dict[tuple[int, int], Weight]:
    """The lightest way over a block of rows from each state to each state."""
    def found(p: int) -> dict[tuple, Weight]:
        rules = over(rows)
        return lightest([((0, p), (0, ""))], lambda item: [x for x in rules(item) if x[0] != WHOLE], {(len(rows), q) for q in range(4)})
    return {(p, q): weight for p in range(4) for (_, q), weight in found(p).items()}


def onward(so_far: dict[int, Weight], block: dict[tuple[int, int], Weight]) -> dict[int, Weight]:
    """The lightest derivations of the states after a block: an item before it and a span over it conclude one."""
    def rules(item: tuple) -> list[tuple[tuple, Weight]]:
        return [((1, q), w) for (p, q), w in block.items() if item == (0, p)]
    found = lightest([((0, p), w) for p, w in so_far.items()], rules, {(1, q) for _, q in block})
    return {q: weight for (_, q), weight in found.items()}


def shared_out(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut after so many rows each; turns inserted after the last row go with the last part that has rows."""
    out, at = [], 0
    for n in sizes:
        start = at
        while n:
            n -= audit[at] != "I"
            at += 1
        out.append(audit[start:at])
    full = [k for k, n in enumerate(sizes) if n]
    if full:
        out[full[-1]] += audit[at:]
    return out


def repaired(rows: Iterable[tuple[str, str, str]]) -> Iterator[str]:
    """``role:text`` of what is put out, from (the audit's part for the row, role, text) in order."""
    state = NONE
    for part, role, text in rows:
        for edit in part:
            if edit != "D":
                to = role[:1] if edit == "K" else "a" if state == USER else "u"
                state = NEXT[state, to]
                yield f"{role}:{text}" if edit == "K" else f"{ROLES[to]}:{text if edit == 'R' else ''}"


def hashed(lines: Iterable[str]) -> str:
    out = hashlib.sha256()
    for k, line in enumerate(lines):
        out.update(("\n" * (k > 0) + line).encode())
    return out.hexdigest()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _sent(rows: Iterable[tuple], schema: pa.Schema, size: int = 2_048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


NUMBER, STRING = pa.int64(), pa.string()
SPANS = pa.list_(pa.struct([("p", NUMBER), ("q", NUMBER), ("cost", NUMBER), ("audit", STRING)]))
FACTS = {"blank": NUMBER, "duplicate": NUMBER, "truncated": NUMBER, "illegal": NUMBER}
SOLVED = {"block": NUMBER, "rows": NUMBER, **FACTS, "first": STRING, "last": STRING, "low": NUMBER, "high": NUMBER, "turns": NUMBER, "cost": NUMBER, "audit": STRING,
          "repaired_sha256": STRING, "spans": SPANS}
JOINED = {"gaps": NUMBER, **FACTS, "cost": NUMBER, "audit": STRING, "parts": pa.list_(STRING)}
DIGESTS = {"repaired_sha256": STRING}
DDL = {NUMBER: "bigint", STRING: "string", SPANS: "array<struct<p: bigint, q: bigint, cost: bigint, audit: string>>", pa.list_(STRING): "array<string>"}


def _through(df: DataFrame, step: Callable[[Iterator[tuple]], Iterator[tuple]], fields: dict[str, pa.DataType]) -> DataFrame:
    """``step`` over the rows of each task, in their order; the first column stays what it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            schema = pa.schema([("conv_id", first.schema.field(0).type), *fields.items()])
            yield from _sent(step(_rows(chain([first], batches))), schema)
    return df.mapInArrow(run, f"conv_id {df.schema[0].dataType.simpleString()}, " + ", ".join(f"{k} {DDL[t]}" for k, t in fields.items()))


def _solved(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row a block of (conv_id, block, turn, role, text, live, fault, again) rows in order; block -1 is a whole conversation."""
    for (conv, block), group in groupby(rows, lambda r: r[:2]):
        seen: set[tuple[str, str]] = set()
        kept, turns = [], []
        for _, _, turn, role, text, live, fault, again in group:
            if not live:
                continue
            if block < 0:
                again = (role, text) in seen
                seen.add((role, text))
            kept.append((role, text, fault if fault == "blank" or not again else "duplicate"))
            turns.append(turn)
        faults = [f for _, _, f in kept]
        initials = [r[:1] for r, _, _ in kept]
        known = [t for t in turns if t is not None]
        facts = [faults.count(f) for f in ("blank", "duplicate", "truncated")] + [sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))]
        ends = [initials[0], initials[-1], known[0] if known else None, known[-1] if known else None, len(set(known))] if kept else [None, None, None, None, 0]
        steps = list(zip(faults, initials))
        if block < 0:
            cost, audit = whole(steps)
            digest = hashed(repaired((part, role, text) for part, (role, text, _) in zip(shared_out(audit, [1] * len(kept)), kept)))
            yield (conv, block, len(kept), *facts, *ends, cost, audit, digest, None)
        else:
            yield (conv, block, len(kept), *facts, *ends, None, None, None, [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in spans(steps).items()])


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row a conversation from its blocks' rows in order: its facts, cost, audit, and the audit's part for each block."""
    for conv, group in groupby(rows, lambda r: r[0]):
        facts, last, low, high, turns = [0] * 4, None, None, None, 0
        sizes: list[int] = []
        so_far: dict[int, Weight] = {NONE: (0, "")}
        for _, _, n, *told in group:
            sizes.append(n)
            if not n:
                continue
            facts = [a + b for a, b in zip(facts, told[:4])]
            first, end, lo, hi, count = told[4:9]
            facts[3] += last is not None and last + first not in ("su", "ua", "au")
            last = end
            if lo is not None:
                turns += count - (lo == high)
                low, high = lo if low is None else low, hi
            so_far = onward(so_far, {(s["p"], s["q"]): (s["cost"], s["audit"]) for s in told[-1]})
        cost, audit = min(so_far[q] for q in GOALS if q in so_far)
        yield (conv, 0 if low is None else high - low + 1 - turns, *facts, cost, audit, shared_out(audit, sizes))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, hash) from (conv_id, block, part, role, text) rows in order; a block at a time is held."""
    def parts(group: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
        for _, block in groupby(group, lambda r: r[1]):
            held = list(block)
            yield from zip(shared_out(held[0][2], [1] * len(held)), [r[3] for r in held], [r[4] for r in held])
    for conv, group in groupby(rows, lambda r: r[0]):
        yield conv, hashed(repaired(parts(group)))


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """What is wrong in each conversation and its cheapest repair, from (conv_id, turn, role, text, live) rows.

    A conversation's rows are taken by turn (nulls first), those of one turn by role and the MD5
    of the text.  Conversations of up to ``block`` rows are solved as they stand, in sorted streams.
    Of longer ones, which may hold any share of all rows, the places of the rows come from one
    range sort, and blocks of ``block`` rows are solved apart: the lightest way over each from every state to
    every state.  These spans are premises of the derivation over the blocks, so the result is the same
    at every ``block``.  Only two steps follow a long conversation through one task, a row at a time: that over its
    blocks' spans (a few bytes a row) and that of its hash, which is one hash over all its texts in order.

    Null turns count for no gap.  Null ids are one conversation.  Rows that are the same are
    rows of their own (duplicates).  A conversation without a live row has zeros, an empty audit and the
    hash of nothing; an empty table gives no row.
    """
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    fault = F.when(F.btrim("text", F.lit(BLANK)) == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("conv_id", "turn", "role", "text", "live", fault.alias("fault"), F.md5("text").alias("_text"))
    long = cut(rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select("_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    taken = ["conv_id", "block", "turn", "role", "text", "live", "fault", "again"]
    order = [F.col("turn").asc_nulls_first(), "role", "_text", "live"]

    short = rows.join(long, same, "left_anti").withColumns({"block": F.lit(-1), "again": F.lit(False)})
    placed = running(rows.join(long, same, "left_semi"), [F.col("conv_id").asc_nulls_first(), *order], {}, position="_at")
    starts = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_at").alias("_start"))
    firsts = (placed.filter("live").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_text").alias("_same"))
              .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    blocks = placed.join(starts, same).drop("_conv").join(firsts, same & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_same")), "left")
    blocks = cut(blocks.select("conv_id", F.floor((F.col("_at") - F.col("_start")) / block).cast("int").alias("block"), "turn", "role", "text", "live", "fault",
                               (F.coalesce("_first", F.col("_at")) < F.col("_at")).alias("again"), "_text", "_at"))

    # Of rows that are the same, the one that is no repeat has to come first in its block too.
    groups = short.unionByName(blocks.drop("_at")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *order, "again")
    solved = cut(_through(groups.select(*taken), _solved, SOLVED))
    gaps = F.when(F.col("low").isNull(), F.lit(0).cast("bigint")).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    given = ["conv_id", "gaps", *FACTS, "cost", "audit", "repaired_sha256"]
    done = solved.filter("block < 0").withColumn("gaps", gaps).select(*given)

    spread = solved.filter("block >= 0").select("conv_id", "block", "rows", *FACTS, "first", "last", "low", "high", "turns", "spans")
    joined = cut(_through(spread.repartition("conv_id").sortWithinPartitions("conv_id", "block"), _joined, JOINED))
    parts = joined.select(F.col("conv_id").alias("_conv"), F.posexplode("parts").alias("_block", "part"))
    told = blocks.filter("live").join(parts, same & (F.col("block") == F.col("_block"))).select("conv_id", "block", "part", "role", "text", "_at")
    digests = _through(told.repartition("conv_id").sortWithinPartitions("conv_id", "_at").drop("_at"), _digests, DIGESTS).withColumnRenamed("conv_id", "_conv")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return done.unionByName(joined.join(digests, same, "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)).select(*given))


@query("op13_lightest_repair")
def op13(spark, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))
