"""The template reaches into articles: what all pages of a host share there goes, what they only happen to share stays."""

from wayframe.llm import templates as T

NOTICE = "Readers in all regions may write to the desk at any time."


def page(k, body, notice=NOTICE):
    return f"<html><body><article><h1>Story {k}</h1><p>{body}</p><p>{notice}</p><p>The end of number {k} is near.</p></article></body></html>"


def test_a_notice_in_all_articles_goes():
    got = T.texts([page(k, f"It was the {w} of all days and the men went out") for k, w in enumerate(["first", "best", "last", "worst", "next"])])
    assert got[0] == "Story 0\n\nIt was the first of all days and the men went out\n\nThe end of number 0 is near."
    assert not any(NOTICE in t for t in got)


def test_what_not_all_articles_hold_stays():
    got = T.texts([page(k, f"Body {k}", NOTICE if k else "Another one.") for k in range(5)])
    assert all(NOTICE in t for t in got[1:])


def test_pages_that_share_their_article_keep_it():
    body = "The whole of this long story is the same on every page of the host"
    got = T.texts([page(k, body) for k in range(6)])
    assert all(body in t and NOTICE in t for t in got)


def test_few_pages_tell_no_template():
    assert all(NOTICE in t for t in T.texts([page(k, f"Body {k}") for k in range(T.WORD_PAGES - 1)]))
