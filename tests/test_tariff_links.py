"""Links by number leave their join as they are: there are as many as titles times routes of a number."""

from wayframe.operators import attach
from wayframe.plans import overlays


def test_links_by_number_are_not_shuffled(spark):
    titles = spark.createDataFrame([(1, "5D", "a"), (1, "5D", "a"), (1, "6", "a"), (2, "5", "a"), (2, None, "a"), (3, "7", "b"), (None, "5", "a"), (None, "6", "a")], "title int, number string, st string")
    routes = spark.createDataFrame([(10, "5", "a"), (10, "6D", "a"), (11, "5", "a"), (12, "7", "a"), (13, "7D", "b")], "route int, number string, st string")
    links = attach.numbers_in_states(titles, routes, "title", "route", "number", "st")
    want = [(1, 10), (1, 11), (2, 10), (2, 11), (3, 13), (None, 10), (None, 11)]
    key = lambda r: tuple(-1 if x is None else x for x in r[:2])
    assert sorted(map(tuple, links.collect()), key=key) == sorted(want, key=key)
    assert links._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # before: an aggregate over all links

    matches = spark.createDataFrame([(1, 10, 1, True), (1, 13, 1, True), (1, 13, 2, True), (3, 13, 1, True), (3, 10, 1, False), (None, 10, 1, True), (4, 11, 1, True)], "title int, route int, name int, approved boolean")
    both = overlays.tariff_links(titles, matches, routes)
    named = [(1, 13, "name"), (None, 10, "name"), (4, 11, "name")]
    assert sorted(map(tuple, both.collect()), key=lambda r: (*key(r), r[2])) == sorted([*[(*r, "number") for r in want], *named], key=lambda r: (*key(r), r[2]))
    # Two joins make links, one looks the named pairs up; before, the named pairs met every link.
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
