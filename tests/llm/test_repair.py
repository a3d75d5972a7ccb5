"""Repaired conversations against every way through a small automaton, tried one after another."""

import hashlib
import itertools
import random
import zlib

from tests.conftest import FOLDER
from wayframe.llm import repair
from wayframe.llm.registry import QUERIES

WHITE = " \t\n\x0b\f\r"
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def cheapest(rows, faults):
    """(cost, audit, output) by all prefixes of edits, rows first to last, least for each (rows done, output's end)."""
    ways = {"": (0, "", [])}  # what was put out last, with "s" and nothing apart
    def put(ways, initial, turn, cost, letter):
        out = {}
        for end, (c, a, o) in ways.items():
            if (initial == "s" and end == "") or (initial == "u" and end != "u") or (initial == "a" and end == "u"):
                out[initial] = min(out.get(initial, (10 ** 9, "", [])), (c + cost, a + letter, [*o, turn]))
        return out
    def merged(*many):
        out = {}
        for ways in many:
            for end, way in ways.items():
                out[end] = min(out.get(end, (10 ** 9, "", [])), way)
        return out
    def inserted(ways):
        for _ in range(3):
            ways = merged(ways, put(ways, "u", "user:", 5, "I"), put(ways, "a", "assistant:", 5, "I"))
        return ways
    for (_, role, text), fault in zip(rows, faults):
        before = inserted(ways)
        ways = {end: (c + 2, a + "D", o) for end, (c, a, o) in before.items()}
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            ways = merged(ways, put(before, role[:1], f"{role}:{text}", more, "K"), put(before, "u", f"user:{text}", 1 + more, "R"), put(before, "a", f"assistant:{text}", 1 + more, "R"))
    return min(way for end, way in inserted(ways).items() if end in ("", "a"))


def plain(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for conv, of in convs.items():
        left = damaged(of)
        faults, seen = [], set()
        for _, role, text in left:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in left if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(left, left[1:])]
        cost, audit, out = cheapest(left, faults)
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
               sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def key(row):
    return (row[0] is not None, row[0] or 0)


def test_given_conversations(sent, con):
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = QUERIES["op13_lightest_repair"](sent, FOLDER).select(*FIELDS).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def odd_rows(rng, conv, n):
    texts = ["Yes.", "No", "Why? ", "", "  \t", "A\n", "Go!", None, "x" * 5_000 + "."]
    return [(conv, rng.choice([None, *range(n), 2 ** 40]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ubuntu", None]), rng.choice(texts)) for _ in range(n)]


def test_long_conversations_are_solved_in_blocks(sent):
    rng = random.Random(8)
    rows = [r for conv, n in [(None, 60), (1, 1), (2, 7), (3, 150), (4, 31), (5, 30), *[(6 + k, 12) for k in range(40)]] for r in odd_rows(rng, conv, n)]
    rows += rows[70:90]  # repeated rows
    rows += [(100, 9, "user", "lost"), *[(101, k, "user", "same.") for k in range(90)], *[(102, 3, "assistant", f"{k}") for k in range(50)]]
    df = sent.createDataFrame([(*r, 1, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, block int, fault string").repartition(5)
    want = sorted(plain(rows), key=key)
    for block in (1, 7, 30, 1_024):
        got = repair.repair(repair.damage(df), block=block).select(*FIELDS).collect()
        assert sorted(map(tuple, got), key=key) == want, block


def test_of_same_rows_the_first_is_kept_in_every_block(sent):
    rows = [(conv, turn, role, text, True) for conv in range(40) for turn, role, text in ((1, "user", "Why?"), (2, "assistant", "Yes.")) for _ in range(12)]
    df = sent.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, live boolean").repartition(5)
    for block in (5, 7, 1_024):
        assert {r["audit"] for r in repair.repair(df, block=block).collect()} == {2 * ("K" + 11 * "D")}, block


def test_lost_and_empty(sent):
    schema = "conv_id string, turn int, role string, text string"
    lost = next(k for k in itertools.count() if zlib.crc32(f"c:{k}".encode()) % 20 == 0)
    got = repair.repair(repair.damage(sent.createDataFrame([("c", lost, "user", "Hi.")], schema))).collect()
    assert [tuple(r[f] for f in FIELDS) for r in got] == [("c", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(repair.damage(sent.createDataFrame([], schema))).count() == 0


def test_equal_costs_take_the_least_audit():
    # A user's and an assistant's turn that no edit needs to touch, and a lone turn: deleting costs 2, any other way more.
    assert repair.whole([("", "u"), ("", "a")]) == (0, "KK")
    assert repair.whole([("", "a")]) == (2, "D")
    assert repair.whole([("", "u"), ("", "u")]) == (1, "KR")
    assert repair.whole([("truncated", "u"), ("", "a"), ("", "a")]) == (3, "DRK")
    assert repair.whole([]) == (0, "")
