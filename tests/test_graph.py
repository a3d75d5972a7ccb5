"""Graph operators against plain algorithms on small random graphs."""

import heapq
import itertools
import random

from pyspark.sql import functions as F

from wayframe.operators import graph as R


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


def test_components_equal_union_find(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(0, i) for i in range(150, 200)]
    p = list(range(200))
    for a, b in links:
        x, y = find(p, a), find(p, b)
        p[max(x, y)] = min(x, y)
    got = {x.node: x.comp for x in R.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(find(p, n) == c for n, c in got.items())
    assert set(got) == {n for a, b in links if a != b for n in (a, b)}


def test_shortest_paths_equal_dijkstra(spark):
    r = random.Random(7)
    edges = [(i, r.randrange(40), r.randrange(40), float(r.randrange(1, 20)), r.random() < 0.2) for i in range(90)]
    df = spark.createDataFrame(edges, "edge_id bigint, a bigint, b bigint, cost double, bridge boolean")
    tree = R.shortest_paths(df, spark.createDataFrame([(1, 0), (2, 5)], "task bigint, node bigint"))
    got = {(x.task, x.node): x.dist for x in tree.collect()}
    for task, start in ((1, 0), (2, 5)):
        dist, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > dist[n]:
                continue
            for _, a, b, c, _ in edges:
                for x, y in ((a, b), (b, a)):
                    if x == n and d + c < dist.get(y, 1e9):
                        dist[y] = d + c
                        heapq.heappush(heap, (d + c, y))
        assert {k[1]: v for k, v in got.items() if k[0] == task} == dist
    goal = max(n for t, n in got if t == 1)
    steps = sorted(R.trace(tree, spark.createDataFrame([(1, goal)], "task bigint, node bigint")).collect(), key=lambda s: s.seq)
    assert steps[0].prev == 0 and steps[-1].node == goal
    assert all(x.node == y.prev for x, y in itertools.pairwise(steps))
    cost = {e[0]: e[3] for e in edges}
    assert sum(cost[s.edge_id] for s in steps) == got[(1, goal)]


def test_bridges_are_the_shortest_forest(spark):
    r = random.Random(11)
    nodes, edges = [], []
    for g in range(3):
        for i in range(8):
            a, b = g * 100 + i * 2, g * 100 + i * 2 + 1
            x, y = r.uniform(0, 0.6), 40 + r.uniform(0, 0.6)
            nodes += [(g, a, x, y, a), (g, b, x + 0.02, y + 0.01, a)]
            edges.append((a, a, b))
    n = spark.createDataFrame(nodes, "g bigint, node bigint, lon double, lat double, comp bigint")
    e = spark.createDataFrame(edges, "edge_id bigint, a bigint, b bigint")
    closed, comps = R.bridges(n, e, "g", 25, steps=(0.125, 0.5, 1.0))
    got = {(x.g, round(x.km, 6)) for x in closed.collect()}
    assert got == {(x.g, round(x.km, 6)) for x in R.bridges(n, e, "g", 25)[0].collect()}
    from math import asin, cos, radians, sin, sqrt

    def km(p, q):
        h = sin(radians(q[3] - p[3]) / 2) ** 2 + cos(radians(p[3])) * cos(radians(q[3])) * sin(radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0088 * asin(sqrt(h))

    want = set()
    for g in range(3):
        mine = [x for x in nodes if x[0] == g]
        p = {x[4]: x[4] for x in mine}
        for d, a, b in sorted((km(x, y), x[4], y[4]) for x, y in itertools.combinations(mine, 2)):
            ra, rb = find(p, a), find(p, b)
            if d <= 25 and ra != rb:
                p[ra] = rb
                want.add((g, round(d, 6)))
    assert got == want
    assert comps.count() == len(nodes) and comps.select("comp").distinct().count() == 24 - len(want)


def test_chains_in_order_with_circles(spark):
    r = random.Random(4)
    ids = list(range(1, 60))
    r.shuffle(ids)
    edges = []
    for k in range(21):
        a, b = 100 + k, 101 + k
        edges.append((ids[k], *((a, b) if r.random() < 0.5 else (b, a))))
    edges += [(ids[30 + k], 500 + k, 500 + (k + 1) % 7) for k in range(7)]
    edges += [(ids[40], 910, 911), (ids[41], 911, 912), (ids[42], 911, 913), (ids[43], 700, 701), (ids[44], 701, 700)]
    ends = {e: (a, b) for e, a, b in edges}
    rows = sorted((x.chain, x.pos, x.edge_id, x.forward) for x in R.chains(spark.createDataFrame(edges, "edge_id bigint, a bigint, b bigint")).collect())
    assert len(rows) == len(edges)
    sizes = []
    for _, g in itertools.groupby(rows, key=lambda x: x[0]):
        g = list(g)
        assert [x[1] for x in g] == list(range(len(g)))
        runs = [ends[e] if f else ends[e][::-1] for _, _, e, f in g]
        assert all(x[1] == y[0] for x, y in itertools.pairwise(runs))
        sizes.append(len(g))
    assert sorted(sizes) == [1, 1, 1, 2, 7, 21]


def test_corridors_join_equal_or_adjacent(spark):
    states = spark.createDataFrame([("9", 1, "AA"), ("9", 2, "BB"), ("9", 3, "DD"), ("9", 4, "DD"), ("8", 5, "BB")], "number string, piece bigint, st string")
    beside = spark.createDataFrame([("AA", "BB"), ("BB", "AA"), ("BB", "CC"), ("CC", "BB"), ("CC", "DD"), ("DD", "CC")], "st string, beside string")
    got = {x.piece: x.corridor for x in R.corridors(states.select("number", "piece").distinct(), states, beside, "number", "piece", "st").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_snapping_crosses_cells(spark):
    ends = spark.createDataFrame([("g", 1, 10.0, 40.0), ("g", 2, 10.0 - 0.00005, 40.0 - 0.00005), ("g", 3, 10.0 + 0.0006, 40.0), ("h", 4, 10.0, 40.0)],
                                 "g string, end_id bigint, lon double, lat double")
    got = {x.end_id: x.node for x in R.snap(ends, "g", 0.0002).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert R.snap(ends, "g", 0.0002).filter(F.col("end_id") == 2).first().nlon == 10.0


def _km(x1, y1, x2, y2):
    from math import asin, cos, radians, sin, sqrt
    h = sin(radians(y2 - y1) / 2) ** 2 + cos(radians(y1)) * cos(radians(y2)) * sin(radians(x2 - x1) / 2) ** 2
    return 2 * 6371.0088 * asin(sqrt(h))


def test_closest_gaps_of_wide_reach(spark):
    r = random.Random(4)
    nodes = []
    for g, reach in ((1, 400.0), (2, 30.0), (3, 900.0)):
        for comp in range(6):
            x, y = r.uniform(-110, -104), r.uniform(40, 65)
            for i in range(25):
                x, y = x + r.uniform(0, 0.05), y + r.uniform(-0.05, 0.05)
                nodes.append((g, len(nodes), x, y, g * 10 + comp, reach))
    df = spark.createDataFrame(nodes, "g bigint, node bigint, lon double, lat double, comp bigint, _reach double")
    want = {}
    for x, y in itertools.combinations(nodes, 2):
        d = _km(x[2], x[3], y[2], y[3])
        if x[0] == y[0] and x[4] != y[4] and d <= x[5]:
            key = (x[0], *sorted((x[4], y[4])))
            want[key] = min(want.get(key, (1e9,)), (d, *sorted((x[1], y[1]))))
    got = {(x.g, x.ca, x.cb): (x._gap.a, x._gap.b) for x in R.closest_gaps(df, df, "g", 900.0).collect()}
    assert len(want) > 10 and got == {k: v[1:] for k, v in want.items()}


def test_contraction_keeps_least_costs_and_rounds_are_few(spark):
    n = 600
    edges = [(i, i, i + 1, 1.0 + i % 3, False) for i in range(n)]
    df = spark.createDataFrame(edges, "edge_id bigint, a bigint, b bigint, cost double, bridge boolean")
    ways = df.selectExpr("a AS u", "b AS v").union(df.selectExpr("b", "a")).selectExpr(
        "u", "v", "named_struct('w', named_struct('cost', 1L, 'hops', 1L, 'bridged', 0L), 'into', named_struct('prev', u, 'edge_id', 0L), 'back', named_struct('prev', v, 'edge_id', 0L)) AS way",
        "u = 0 AS ufix", "v = 0 AS vfix")
    core, levels = R.contracted(ways)
    assert core.count() == 0 and len(levels) < 25
    tree = {x.node: x for x in R.shortest_paths(df, spark.createDataFrame([(1, 0)], "task bigint, node bigint")).collect()}
    assert len(tree) == n + 1 and all(tree[i].hops == i and tree[i].dist == sum(1.0 + k % 3 for k in range(i)) for i in range(n + 1))
    assert all(tree[i].prev == i - 1 and tree[i].edge_id == i - 1 for i in range(1, n + 1))


def test_components_of_hubs_and_long_chains(spark):
    links = [(0, i) for i in range(1, 400)] + [(1_000 + i, 1_001 + i) for i in range(700)] + [(5_000, 5_000)]
    got = {x.node: x.comp for x in R.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(400)} | {1_000 + i: 1_000 for i in range(701)}
    assert R.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_costs_keep_more_decimals_than_are_asked_for(spark):
    # 400 edges: rounded to 1e-9 each, their sum was wrong in the eighth decimal.
    edges = spark.createDataFrame([(i, i, i + 1, 0.1 + 4e-10, False) for i in range(400)], "edge_id bigint, a bigint, b bigint, cost double, bridge boolean")
    starts = spark.createDataFrame([(0, 0)], "task bigint, node bigint")
    far = {r.node: r.dist for r in R.shortest_paths(edges, starts).collect()}
    assert abs(far[400] - 400 * (0.1 + 4e-10)) < 1e-9


def test_ends_look_in_wide_cells(spark, monkeypatch):
    rows, join = [], R.skew_join

    def counted(left, right, on, how="inner"):
        rows.append((left.count(), right.count()))
        return join(left, right, on, how)
    monkeypatch.setattr(R, "skew_join", counted)
    ends = spark.createDataFrame([("g", k, -100 + 0.00137 * (k // 2) + 0.00003 * (k % 2), 40 + 0.0009 * (k // 2 % 7)) for k in range(400)], "g string, end_id bigint, lon double, lat double")
    assert {x.end_id: x.node for x in R.snap(ends, "g", 0.0002).collect()} == {k: k - k % 2 for k in range(400)}
    assert rows[0][1] < 2 * rows[0][0]  # before: about ten cells for each end


def test_two_cells_are_met_once(spark, monkeypatch):
    nodes = [("g", k, -100 + 0.031 * (k * k % 97), 45 + 0.027 * (k * 31 % 89), k // 2, 4.0) for k in range(160)]
    df = spark.createDataFrame(nodes, "g string, node bigint, lon double, lat double, comp bigint, _reach double")
    again = df.select("*")
    plain = lambda d: {(x.g, x.ca, x.cb): tuple(x._gap) for x in d.collect()}
    met, join = [], R.skew_join
    both = plain(R.closest_gaps(df, again, "g", 4.0))

    def counted(left, right, on, how="inner"):
        met.append(left.count())
        return join(left, right, on, how)
    monkeypatch.setattr(R, "skew_join", counted)
    assert plain(R.closest_gaps(df, df, "g", 4.0)) == both and len(both) > 10
    assert met[0] <= 8 * 160  # before: 21 cells for each
