"""Main text of web pages by deducing the template that pages of one host share."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

# Pages, and characters, of one host that a template is deduced from together.
PAGES = 64
CHARS = 8_000_000
# Share of the pages that a class of tags must occur in; classes with words must occur in all, and in so many.
SUPPORT = 0.5
WORD_PAGES = 4

# Names as HTML has them; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head svg math iframe object canvas audio video button select textarea option".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTENT = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ASIDE_WORDS = frozenset("""nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement advertising sponsor sponsored promo
banner cookie cookies consent notice popup modal overlay comment comments reply replies respond disqus discussion share sharing social related
breadcrumb breadcrumbs widget newsletter subscribe subscription login signup search toolbar pagination pager copyright legal disclaimer""".split())
# Start tags that end an open element of these names, up to the one that holds them.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

PART = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<""", re.S | re.I)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|display\s*:\s*none""", re.I)
WORD = re.compile(r"[a-z]+")


@dataclass
class Page:
    """A page as tokens: its tags with their paths, and its words."""

    kinds: list = field(default_factory=list)   # what a token is: ("tag", path), ("word", path, word) or, in an article, ("run", path, words)
    blocks: list = field(default_factory=list)  # (number of the token, text, inside content, aside, in a link); None ends a block


def read(html: str) -> Page:
    """Tokens of a page.  Missing end tags are supplied as HTML says; a tag without its mate is passed over."""
    page = Page()
    stack: list[tuple] = []  # (name, path, inside content, aside, in a link)
    state = ("", "", False, False, False)
    breaks = lambda: page.blocks.append(None)
    for m in PART.finditer(html):
        name = m[3]
        if name is None:
            text = m[0]
            if m[1] or text[:2] in ("<!", "<?"):
                continue
            words = entities.unescape(text)
            if words.isspace():
                page.blocks.append((-1, " ", *state[2:]))
                continue
            if not state[2] and not (stack and state[0] in UNSEEN):
                # Words outside an article are tokens each; in one, what stands between two tags is a token as a whole, as single
                # words of prose agree by chance.
                lead = words[:1].isspace()
                for w in words.split():
                    page.blocks.append((len(page.kinds), (" " if lead else "") + w, *state[2:]))
                    page.kinds.append(("word", state[1], w))
                    lead = True
                if words[-1:].isspace():
                    page.blocks.append((-1, " ", *state[2:]))
            elif state[2]:
                page.blocks.append((len(page.kinds), words, *state[2:]))
                page.kinds.append(("run", state[1], " ".join(words.split())))
            continue
        name = name.lower()
        if m[2]:
            if name == "br":
                page.blocks.append((-1, " ", *state[2:]))
                continue
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if at is None:
                continue
            page.kinds.append(("end", stack[at][1]))
            if any(s[0] in BLOCK for s in stack[at:]):
                breaks()
            del stack[at:]
            state = stack[-1] if stack else ("", "", False, False, False)
            continue
        if name in BLOCK:
            breaks()
            # A block ends an open paragraph, and what is open inside it.
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in ("td", "th", "article", "body")), None)
            if at is not None and stack[at][0] == "p":
                del stack[at:]
        if name in CLOSES:
            same, within = CLOSES[name]
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in same or stack[k][0] in within), None)
            if at is not None and stack[at][0] in same:
                del stack[at:]
        state = stack[-1] if stack else ("", "", False, False, False)
        found = MARKS.findall(m[4])
        label = name + "".join(f".{a.lower()}={(b or c or d).strip()}" for a, b, c, d in found)
        path = f"{state[1]}/{label}"
        page.kinds.append(("tag", path))
        if name in VOID:
            if name in ("br", "hr"):
                page.blocks.append((-1, " ", *state[2:]))
            continue
        marks = {w for _, b, c, d in found for w in WORD.findall((b or c or d).lower())}
        aside = state[3] or name in ASIDE or name in UNSEEN or (name not in ("html", "body") and bool(marks & ASIDE_WORDS)) or bool(HIDDEN.search(m[4]))
        inside = (state[2] or name in CONTENT) and not aside
        state = (name, path, inside, aside, state[4] or name == "a")
        if not m[4].rstrip().endswith("/") or name in BLOCK:
            stack.append(state)
    return page


def template(pages: list[Page]) -> set:
    """Tokens of the valid equivalence classes of these pages.

    Tokens with the same counts in every page form a class.  A class is valid if it is frequent
    enough, holds more than one token, has its tokens in one order in every page, and lies with
    each of its occurrences in one gap of every larger valid class (or wholly around it).

    Runs of words in articles have classes of their own, of one run at least, and must stand in every page.  They count only
    if every page keeps most of its article without them: pages that share their article share no template by that.
    """
    n = len(pages)
    if n < 2:
        return set()
    seen: dict = defaultdict(dict)
    for k, page in enumerate(pages):
        for at, kind in enumerate(page.kinds):
            seen[kind].setdefault(k, []).append(at)
    classes: dict = defaultdict(list)
    for kind, where in seen.items():
        least = max(2, SUPPORT * n) if kind[0] in ("tag", "end") else n
        if len(where) >= least and (kind[0] in ("tag", "end") or n >= WORD_PAGES):
            classes[kind[0] == "run", tuple((k, len(where[k])) for k in sorted(where))].append(kind)
    held: set = set()
    frames: list[tuple[dict, list]] = []  # of valid classes that occur once a page: their places in each page
    for (runs, vector), kinds in sorted(classes.items(), key=lambda c: (c[0][0], -len(c[0][1]), sum(x for _, x in c[0][1]), -len(c[1]))):
        if len(kinds) < 2 and not runs:
            continue
        kinds.sort(key=lambda kind: seen[kind][vector[0][0]][0])
        if not _ordered(kinds, vector, seen) or not _nested(kinds, vector, seen, frames):
            continue
        held.update(kinds)
        if all(count == 1 for _, count in vector) and not runs:
            frames.append(({k: [seen[kind][k][0] for kind in kinds] for k, _ in vector}, kinds))
    return held if all(_keeps_most(page, held) for page in pages) else {kind for kind in held if kind[0] != "run"}


def _keeps_most(page: Page, held: set) -> bool:
    """Whether more than half of the words of an article stay without the runs that are held."""
    size = {True: 0, False: 0}
    for b in page.blocks:
        if b and b[2] and b[0] >= 0:
            size[page.kinds[b[0]] in held] += len(b[1].split())
    return size[False] > size[True] or not size[True]


def _ordered(kinds: list, vector: tuple, seen: dict) -> bool:
    for k, count in vector:
        last = -1
        for i in range(count):
            for kind in kinds:
                at = seen[kind][k][i]
                if at <= last:
                    return False
                last = at
    return True


def _nested(kinds: list, vector: tuple, seen: dict, frames: list) -> bool:
    from bisect import bisect
    for places, _ in frames:
        for k, count in vector:
            if k not in places:
                continue
            for i in range(count):
                gaps = {bisect(places[k], seen[kind][k][i]) for kind in (kinds[0], kinds[-1])}
                if len(gaps) > 1 and not gaps == {0, len(places[k])}:
                    return False
    return True


def slots(page: Page, held: set) -> list[str]:
    """Blocks of the slots that the template leaves: the article's if there is one, else all that is not aside."""
    article = any(b and b[2] and not b[1].isspace() for b in page.blocks)
    out, text, plain = [], [], 0

    def close() -> None:
        nonlocal plain
        joined = " ".join("".join(text).split())
        if joined and (article or plain):
            out.append(joined)
        text.clear()
        plain = 0

    for b in page.blocks:
        if b is None:
            close()
            continue
        at, words, inside, aside, link = b
        if aside or (article and not inside) or (at >= 0 and page.kinds[at] in held):
            if not words.isspace():
                text.append(" ")
            continue
        text.append(words)
        plain += not link and not words.isspace()  # blocks of links only are menus, outside an article
    close()
    return out


def texts(group: list[str]) -> list[str]:
    """Main texts of pages of one host; equal pages count once for the template."""
    pages = {h: read(h) for h in dict.fromkeys(group)}
    held = template(list(pages.values()))
    return ["\n\n".join(slots(pages[h], held)) for h in group]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    The pages are sorted by host, and there by a hash of the id, into ranges; a host of any
    size is cut into groups of at most ``PAGES`` pages and ``CHARS`` characters (one longer
    page is a group by itself).  Each group gives a template of its own.  A host's single page
    has none; then only its tags tell what is aside.

    A null page gives an empty text, and so does one without words.  Null urls are one host.
    Repeated rows are extracted each.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url").alias("place"))
             .repartitionByRange(parts, "host", "place").sortWithinPartitions("host", "place", "page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page_id, url, html, name in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                html = html or ""
                if held and (held[0][3] != name or len(held) >= PAGES or size + len(html) > CHARS):
                    yield answer(held)
                    held, size = [], 0
                held.append((page_id, url, html, name))
                size += len(html)
        if held:
            yield answer(held)

    kinds = dict(pages.dtypes)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        found = texts([r[2] for r in rows])
        ids = pa.array([r[0] for r in rows], pa.int64() if kinds["page_id"] == "bigint" else None)
        return pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return dealt.drop("place").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")


@query("op1_page_text")
def op1(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
