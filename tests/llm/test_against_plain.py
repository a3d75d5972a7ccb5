"""The registered queries against plain algorithms on the smallest tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
import wayframe.llm.all  # noqa: F401
from tests.compare import database, difference
from tests.conftest import FOLDER
from wayframe.llm import contamination, neighbours, ngrams, suffixes
from wayframe.llm.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def texts(con):
    return con.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def rows(sent, name):
    return QUERIES[name](sent, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(sent, name, monkeypatch):
    monkeypatch.setattr("tests.compare.QUERIES", QUERIES)
    monkeypatch.setattr("tests.compare.ORACLES", ORACLES)
    assert difference(sent, database(FOLDER), name, FOLDER) is None


def test_page_text_is_the_article(sent, con):
    pages = {p: h for p, h in con.sql("SELECT page_id, html FROM pages").fetchall()}
    out = rows(sent, "op1_page_text")
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def plain_distance(p, t):
    last = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        now = [i + 1]
        for j, d in enumerate(t):
            now.append(min(last[j] + (c != d), last[j + 1] + 1, now[j] + 1))
        last = now
    return min(last), last.index(min(last))


def test_bit_vectors_give_the_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(1, 90))) for _ in "pt")
        if rng.random() < 0.5:
            t = t[:20] + "".join(c for c in p if rng.random() > 0.1) + t[20:]
        assert contamination.nearest(contamination._masks(p), len(p), t) == plain_distance(p, t)


def test_benchmark_passages(sent, texts, con):
    items = [(i, contamination.plain(t)) for i, t in con.sql("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(d, i): 0 for d, t in texts for i, x in items if x in contamination.plain(t)}
    got = {(r.doc_id, r.item_id): r.edits for r in rows(sent, "op2_benchmark_passages")}
    assert want and {k: got.get(k) for k in want} == want
    of = dict(items), dict(texts)
    for (d, i), edits in got.items():
        if (d, i) not in want:
            assert edits == plain_distance(of[0][i], contamination.plain(of[1][d]))[0] <= 0.08 * len(of[0][i])


@pytest.mark.parametrize("share", [0.02, 0.07])
def test_edited_passages_are_found(share, texts, con):
    rng = np.random.default_rng(4)
    items = con.sql("SELECT item_id, text FROM benchmark").fetchall()
    known = contamination.Items(items)
    for item_id, text in items:
        chars = list(contamination.plain(text))
        for k in rng.choice(len(chars), int(share * len(chars)), replace=False):
            chars[k] = "#" if rng.random() < 0.5 else ""
        found = known.find(contamination.plain(texts[0][1] + " " + "".join(chars) + " " + texts[1][1]))
        assert any(item_id in known.ids[k] for k in found)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(0)
    for _ in range(60):
        text = np.concatenate([rng.integers(97, 97 + rng.integers(1, 4), 300).astype(np.uint8), np.zeros(51, np.uint8)])
        wanted = rng.random(300) < 0.7
        order, b = suffixes.suffix_order(text, wanted), bytes(text)
        keys = [b[i:i + 50] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(np.flatnonzero(wanted))
        common = suffixes.common_prefixes(text, order)
        for k in range(1, len(order)):
            x, y = keys[k - 1], keys[k]
            assert common[k] == next((n for n in range(50) if x[n] != y[n]), 50)


def test_repeated_passages(sent, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(sent, "op3_repeated_passages")}
    seen = set()
    for doc, text in texts:
        b = text.encode()
        gone, new = np.zeros(len(b), bool), []
        for k in range(len(b) - 49):
            if b[k:k + 50] in seen:
                gone[k:k + 50] = True
            else:
                new.append(b[k:k + 50])
        seen.update(new)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[doc] == (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())


@pytest.mark.parametrize("held_words", [262_144, 50])
def test_language_model(sent, texts, held_words):
    """Base scores by counting; with few held words most counts come from the table."""
    from wayframe.llm import brown
    out = {r.doc_id: r for r in brown.score(sent.read.parquet(f"{FOLDER}/documents.parquet"), held_words=held_words, classed=held_words, exchanged=min(1_024, held_words)).collect()}
    words = {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) + [b" end"] for d, t in texts}
    count = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in words.items():
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    if held_words > 1_000:
        held = [r for r in out.values() if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("name, column", [("op5_quality", "quality"), ("op7_toxicity", "toxic")])
def test_held_out_accuracy(sent, name, column):
    folder = FOLDER.replace("0.001", "0.1")
    out = QUERIES[name](sent, folder).join(sent.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").select("predicted", column).collect()
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert sum(p == y == 1 for p, y in out) / max(1, sum(y == 1 for _, y in out)) > 0.85


def test_line_dedup(sent, texts):
    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = max(len(a), len(b)) - 1 - k
        return tail <= 0 or a[len(a) - tail:] == b[len(b) - tail:]

    got = {r.doc_id: (r.lines, r.exact, r.near, r.kept_md5) for r in rows(sent, "op8_line_dedup")}
    seen, ends = set(), defaultdict(list)
    for doc, text in texts:
        kept, exact, close = [], 0, 0
        for line in text.split("\n"):
            w = tuple(x for x in re.split("[ \t\r\x0b\f]+", line.lower()) if x)
            if w in seen:
                exact += 1
                continue
            alike = False
            if len(w) >= 8:  # one edit leaves the first or the last four words
                alike = any(near(w, x) for e in (w[:4], w[-4:]) for x in ends[e])
                ends[w[:4]].append(w)
                ends[w[-4:]].append(w)
            if w:
                seen.add(w)
            close += alike
            if not alike:
                kept.append(line)
        assert got[doc] == (text.count("\n") + 1, exact, close, hashlib.md5("\n".join(kept).encode()).hexdigest())


def alike(texts):
    sets, holders, pairs = {}, defaultdict(list), []
    for d, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        sets[d] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        common = Counter(e for g in sets[d] for e in holders[g])
        pairs += [(d, e) for e, n in common.items() if 5 * n >= 4 * (len(sets[d]) + len(sets[e]) - n)]
        for g in sets[d]:
            holders[g].append(d)
    label = {d: d for d in sets}
    for _ in label:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    links = Counter(x for p in pairs for x in p)
    return {d: (label[d], links[d]) for d in sets}


@pytest.mark.parametrize("group", [1_024, 3])
def test_classes(sent, texts, con, group, monkeypatch):
    """All links and classes, with groups whole and cut into blocks."""
    monkeypatch.setattr(ngrams.blocked, "__defaults__", (group,))
    base = " ".join(f"w{k}" for k in range(120))
    more = [(10**6 + k, base.replace(f"w{7 * k % 113} ", f"v{k} ")) for k in range(40)] + [(2 * 10**6 + k, base) for k in range(3)]
    both = [*texts, *more]
    docs = sent.createDataFrame(both, "doc_id bigint, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngrams.classes(docs).collect()} == alike(both)


def test_neighbours(sent, con):
    folder = FOLDER.replace("0.001", "0.1")
    found = defaultdict(dict)
    for r in QUERIES["op10_collision_neighbours"](sent, folder).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    data = con.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    hit = 0
    for q, got in found.items():
        far = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        far[ids == q] = np.inf
        best = np.lexsort((ids, far))[:10]
        hit += len({ids[b] for b in best} & {i for i, _ in got.values()})
        assert all(math.isclose(s, float(far[ids == i][0]), rel_tol=1e-12) for i, s in got.values())
        assert [(s, i) for _, (i, s) in sorted(got.items())] == sorted((s, i) for i, s in got.values())
    assert len(found) == (ids % 100 == 0).sum() and hit / (10 * len(found)) >= 0.9


def test_windows_that_hold_all_give_the_neighbours():
    x = np.random.default_rng(1).normal(size=(30, 3))
    for q, ids, far in neighbours.near(x, np.arange(30), x[:5], np.arange(5), 40):
        assert len(ids) == 29 and (np.diff(far) >= 0).all()


def test_pipeline(sent, con):
    """Each stage keeps what it should of its own input."""
    docs = sent.read.parquet(f"{FOLDER}/documents.parquet")
    items = [contamination.plain(t) for t, in con.sql("SELECT text FROM benchmark").fetchall()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_classes", "decontamination", "source_mix"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(sent, docs, FOLDER)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            kept = {r.doc_id for r in QUERIES["op7_toxicity"](sent, FOLDER).collect() if not r.predicted}
            assert set(after) == kept
        if name == "ngram_classes":
            assert set(after) == {d for d, (c, _) in alike(sorted((d, r.text) for d, r in before.items())).items() if d == c}
        if name == "decontamination":
            assert not any(x in contamination.plain(r.text) for r in after.values() for x in items)
        if name == "source_mix":
            assert set(after) == set(before) and abs(sum(r.taken for r in after.values()) / sum(r.size for r in after.values()) - 1.5) < 0.1
        else:
            assert out.columns == docs.columns
        from wayframe.runtime import cut
        docs = cut(out)
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(sent, FOLDER).collect()} == {r.doc_id: r.taken for r in docs.collect()}
