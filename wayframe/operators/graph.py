"""Graphs of road fragments as DataFrame jobs (G-4, G-6..G-10, G-21).

Nodes and edges are rows of two tables and all groups are solved by the same jobs.  Each
round of an iterative operator is written out with :func:`cut`, so lineage stays short
and a lost executor repeats one round at most.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, haversine
from ..runtime import cut, discard, skew_join
from .grid import EARTH_KM, around, in_cell, nearest_in_rings
from .ordered import first_by

MAX_ROUNDS = 10_000
# Costs are added as whole numbers of so small a unit, so that a sum does not depend on the order of its parts, and
# that its error stays far below the last decimal that is asked for.  Sums up to 9e5 (km) fit; a greater one fails the job.
COST_UNITS = 1e13
# Nodes with more neighbours are not contracted: their shortcuts would outnumber their edges by too much.
MOST_NEIGHBOURS = 4
# Width of the cells in which ends look for each other, in tolerances.
SNAP_CELLS = 8


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """G-7: component of every node named by a link: rows (node, comp), comp the least node id.

    The graph is contracted until no link is left.  In a round every node goes to the least of the
    nodes within two links of it, by a hash that is new in each round; links between what they go to
    are the next round's graph.  A component that has become one node has no link and is gone, so a
    round costs what is still open, which shrinks by a factor each time, also for long chains and for
    hubs.  A hub's links are combined before the shuffle or split by the runtime's skew join.  At the
    end the rounds are followed backwards, from the few last nodes to all.
    """
    edges, m = cut(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), left=F.count(F.lit(1)))
    rounds: list[DataFrame] = []
    while m["left"]:
        if len(rounds) > MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("n"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        beside = both.groupBy("u").agg(F.least(F.min(ranked("v")), F.first(ranked("u"))).alias("_m"))
        further = both.join(beside.select(F.col("u").alias("v"), "_m"), "v").groupBy("u").agg(F.min("_m").alias("_f"))
        goes = cut(further.join(beside, "u").select("u", F.least("_f", "_m")["n"].alias("to")))
        moved = edges.join(goes.select("u", F.col("to").alias("_u")), "u").join(goes.select(F.col("u").alias("v"), F.col("to").alias("_v")), "v").filter(F.col("_u") != F.col("_v"))
        old = edges
        edges, m = cut(moved.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct(), left=F.count(F.lit(1)))
        discard(old)
        rounds.append(goes)
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    named = rounds.pop()
    for k, goes in enumerate(reversed(rounds)):
        last = named.select(F.col("u").alias("to"), F.col("to").alias("_to"))
        named = goes.join(last, "to", "left").select("u", F.coalesce("_to", "to").alias("to"))
        named = cut(named) if k % 4 == 3 else named
    named = cut(named)
    least = named.groupBy("to").agg(F.min("u").alias("comp"))
    return named.join(least, "to").select(F.col("u").alias("node"), "comp")


def label_nodes(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """G-7: nodes with their component; an unlinked node is its own."""
    comps = connected(links).withColumnRenamed("node", node)
    return nodes.join(comps, node, "left").withColumn("comp", F.coalesce("comp", node))


def snap(ends: DataFrame, group: str, snap_deg: float) -> DataFrame:
    """G-6: fragment ends (group, end_id, lon, lat) joined to nodes: adds ``node``, ``nlon``, ``nlat``.

    Ends of one group within the tolerance of each other share a node, also through others:
    where a greedy pass depends on the order of reading, the closure does not.  A node is
    named after, and lies at, its least end.
    """
    km = snap_deg * KM_PER_DEG
    # Cells are so much wider than the reach that most ends stand in one; at the width of the reach each is written ten times.
    size = SNAP_CELLS * snap_deg
    # Ends at the very same place are one before any pair is formed.
    spots = ends.groupBy(group, "lon", "lat").agg(F.min("end_id").alias("spot"))
    others = spots.select(group, F.col("spot").alias("other"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    pairs = skew_join(in_cell(spots, size), around(others, size, km, "olon", "olat"), [group, "_cx", "_cy"]).filter(
        (F.col("spot") < F.col("other")) & (haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")) <= km))
    named = label_nodes(spots, pairs.select(F.col("spot").alias("a"), F.col("other").alias("b")), "spot")
    # The least end of a component is itself a spot, which gives the node its place.
    place = named.filter(F.col("spot") == F.col("comp")).select("comp", F.col("lon").alias("nlon"), F.col("lat").alias("nlat"))
    nodes = named.join(place, "comp").withColumnRenamed("comp", "node").select(group, "lon", "lat", "node", "nlon", "nlat")
    return ends.join(nodes, [group, "lon", "lat"])


def degrees(edges: DataFrame) -> DataFrame:
    """Edges that meet at each node (a loop counts twice)."""
    return (edges.select(F.col("a").alias("node")).unionAll(edges.select(F.col("b").alias("node")))
            .groupBy("node").agg(F.count(F.lit(1)).alias("degree")))


def extremities(nodes: DataFrame, comp: str = "comp") -> DataFrame:
    """G-9: the two ends of a component on the map (comp, a, b).

    From the centre to the farthest node, from there to the farthest, and once more.
    Equally far nodes go to the least id.
    """
    def farthest(origin: DataFrame) -> DataFrame:
        # Rounded, so that the order in which a centre is summed cannot decide between equals.
        d = F.struct(F.round(haversine(F.col("_ox"), F.col("_oy"), F.col("lon"), F.col("lat")), 8).alias("d"), (-F.col("node")).alias("n"))
        pick = F.max_by(F.struct("node", "lon", "lat"), d).alias("_p")
        return nodes.join(origin, comp).groupBy(comp).agg(pick).select(
            comp, F.col("_p.node").alias("_n"), F.col("_p.lon").alias("_ox"), F.col("_p.lat").alias("_oy"))

    centre = nodes.groupBy(comp).agg(F.avg("lon").alias("_ox"), F.avg("lat").alias("_oy"))
    seed = farthest(centre).drop("_n")
    a = farthest(seed)
    b = farthest(a.drop("_n"))
    return a.select(comp, F.col("_n").alias("a")).join(b.select(comp, F.col("_n").alias("b")), comp)


# Gaps of up to so many km are looked for node by node; wider ones cell by cell first.
FINEST_KM = 2.0
FINER = 8


def closest_gaps(start: DataFrame, ends: DataFrame, group: str, most_km: float) -> DataFrame:
    """The shortest gap (group, ca, cb, _gap: km, a, b) of each two components of a group that come within reach.

    ``start`` and ``ends`` have group, node, lon, lat, comp and _reach (km, the same in all of a group, at most ``most_km``).
    Nodes are thinned to one for each cell and component, first in cells as wide as the reach.  Pairs of
    near cells are then looked at in ever finer cells: the nodes that stand for two cells give a gap that
    is surely there, and a pair of cells that cannot hold a shorter one than the shortest known of its two
    components is left out.  Only the cells that stay are looked at node by node, so wide gaps do not pair
    all nodes within reach.
    """
    reach = F.col("_reach")
    depth = max(0, math.ceil(math.log(most_km / FINEST_KM, FINER))) if most_km > 0 else 0
    size = lambda k: F.greatest(reach, F.lit(1e-6)) / 110 / FINER ** k
    cell = lambda df, k: df.withColumn("_cx", F.floor(F.col("lon") / size(k))).withColumn("_cy", F.floor(F.col("lat") / size(k)))
    finer = lambda df, k: cell(df, k).withColumn("_px", F.floor(F.col("lon") / size(k - 1))).withColumn("_py", F.floor(F.col("lat") / size(k - 1)))
    comps = F.least("ca", "cb"), F.greatest("ca", "cb")

    here = cell(start, 0).select(group, "_reach", F.col("comp").alias("ca"), F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay")).distinct()
    there = cell(ends, 0).select(group, F.col("comp").alias("cb"), F.col("_cx").alias("_bx"), F.col("_cy").alias("_by")).distinct()
    far = F.greatest(F.abs(F.col("_ay")), F.abs(F.col("_ay") + 1)) * size(0) + reach / 110
    wide = F.least(F.ceil(1 / F.greatest(F.cos(F.radians(F.least(far, F.lit(89.9)))), F.lit(0.01))), F.ceil(360 / size(0)))
    near = here.withColumn("_bx", F.explode(F.sequence(F.col("_ax") - wide, F.col("_ax") + wide))).withColumn("_by", F.explode(F.sequence(F.col("_ay") - 1, F.col("_ay") + 1)))
    apart = F.col("ca") != F.col("cb")
    if start is ends:  # each two cells are then met from one of them only
        beyond = (F.col("_by") > F.col("_ay")) | ((F.col("_by") == F.col("_ay")) & (F.col("_bx") > F.col("_ax")))
        level = (F.col("_by") == F.col("_ay")) & (F.col("_bx") == F.col("_ax"))
        near = near.filter(beyond | level)
        apart = apart & (~level | (F.col("ca") < F.col("cb")))
    pairs = skew_join(near, there, [group, "_bx", "_by"]).filter(apart)

    def joined(pairs: DataFrame, a: DataFrame, b: DataFrame, kept: list[str]) -> DataFrame:
        """Pairs of cells with what lies in them on both sides, and its distance."""
        side = lambda df, c, cells: df.select(group, F.col("comp").alias(f"c{c}"), *[F.col(x).alias(f"_{c}{y}") for x, y in cells], *[F.col(x).alias(f"{c}_{x}") for x in kept])
        at = [("_px", "x"), ("_py", "y")] if "_cx" in kept else [("_cx", "x"), ("_cy", "y")]
        both = skew_join(skew_join(pairs, side(a, "a", at), [group, "ca", "_ax", "_ay"]), side(b, "b", at), [group, "cb", "_bx", "_by"])
        return both.withColumn("_km", haversine(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat")))

    for k in range(1, depth + 1):
        thin = lambda df: finer(df, k).groupBy(group, "comp", "_px", "_py", "_cx", "_cy").agg(F.min(F.struct("node", "lon", "lat")).alias("_r")).select("*", "_r.lon", "_r.lat")
        looked = cut(joined(pairs, thin(start), thin(ends), ["_cx", "_cy", "lon", "lat"]).select(
            group, "_reach", "ca", "cb", F.col("a__cx").alias("_ax"), F.col("a__cy").alias("_ay"), F.col("b__cx").alias("_bx"), F.col("b__cy").alias("_by"), "_km"))
        best = looked.groupBy(group, comps[0].alias("_lo"), comps[1].alias("_hi")).agg(F.min("_km").alias("_best"))
        # A node is at most a cell's diagonal from the one that stands for its cell.
        slack = 2 * math.sqrt(2) * KM_PER_DEG * size(k) + 1e-9
        pairs = looked.withColumn("_lo", comps[0]).withColumn("_hi", comps[1]).join(best, [group, "_lo", "_hi"]).filter(
            F.col("_km") - slack <= F.least("_best", "_reach")).drop("_km", "_best", "_lo", "_hi")
    found = joined(pairs, cell(start, depth), cell(ends, depth), ["node", "lon", "lat"]).filter(F.col("_km") <= reach)
    return found.groupBy(group, comps[0].alias("ca"), comps[1].alias("cb")).agg(
        F.min(F.struct(F.col("_km").alias("km"), F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))).alias("_gap"))


def bridges(nodes: DataFrame, edges: DataFrame, group: str, budget_km: float, any_node: bool = False,
            from_extremities: bool = False, steps: tuple[float, ...] = (1 / 64, 1 / 8, 1.0), settings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """G-8: gap-closing edges (group, a, b, km) between components of a group, and the components after it (node, comp).

    ``nodes`` has group, node, lon, lat, comp.  Shortest gap first, one per merge, is a
    minimum spanning forest over the components; it is grown in rounds in which every
    component takes its shortest gap.  Reach is widened in steps, so that near gaps are closed before
    far ones are looked for.  A round holds only components that have a gap left to close.
    ``settings`` (group, bridge_km, from_extremities) gives each group its own; ``budget_km`` is then the widest.
    """
    cols = [group, "node", "lon", "lat"]
    if settings is None:
        told = nodes.select(*cols, "comp", F.lit(float(budget_km)).alias("_budget"), F.lit(from_extremities).alias("_ext"))
    else:
        told = nodes.select(*cols, "comp").join(settings.select(group, F.col("bridge_km").cast("double").alias("_budget"), F.col("from_extremities").alias("_ext")), group).filter("_budget > 0")
    dead = degrees(edges).filter(F.col("degree") == 1).select("node")
    tips = extremities(told.filter("_ext"))
    sources = dead.unionByName(tips.select(F.col("a").alias("node"))).unionByName(tips.select(F.col("b").alias("node"))).distinct()
    start = cut(told.join(sources, "node", "left_semi").select(*cols, "_budget"))
    ends = told.select(*cols, "_budget") if any_node else start
    comps = cut(nodes.select("node", "comp").distinct())
    found = []
    for step in steps:
        reached = lambda df: df.join(comps, "node").withColumn("_reach", F.col("_budget") * step)
        one = reached(start)
        cand, n = cut(closest_gaps(one, reached(ends) if any_node else one, group, budget_km * step), rows=F.count(F.lit(1)))
        renamed = []
        while n["rows"]:
            ends_of = cand.select(F.col("ca").alias("c"), "*").unionByName(cand.select(F.col("cb").alias("c"), "*"))
            chosen = cut(ends_of.groupBy("c").agg(F.min_by(F.struct("_gap", group, "ca", "cb"), "_gap").alias("_x")).select("_x.*").distinct())
            found.append(chosen.select(group, "_gap.a", "_gap.b", "_gap.km"))
            joined = cut(connected(chosen.select("ca", "cb"), "ca", "cb").select(F.col("node").alias("_old"), F.col("comp").alias("_new")))
            renamed.append(joined)
            look = lambda c: joined.select(F.col("_old").alias(c), F.col("_new").alias(f"_n{c}"))
            moved = (cand.join(look("ca"), "ca", "left").join(look("cb"), "cb", "left")
                     .select(group, "_gap", F.coalesce("_nca", "ca").alias("x"), F.coalesce("_ncb", "cb").alias("y")).filter(F.col("x") != F.col("y"))
                     .groupBy(group, F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).agg(F.min("_gap").alias("_gap")))
            cand, n = cut(moved, rows=F.count(F.lit(1)))
        for joined in renamed:
            comps = comps.join(joined, F.col("comp") == F.col("_old"), "left").select("node", F.coalesce("_new", "comp").alias("comp"))
        comps = cut(comps) if renamed else comps
    none = start.filter(F.lit(False)).select(group, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("km"))
    return reduce(lambda a, b: a.unionByName(b), found, none), comps


def chains(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """G-4: edges (edge_id, a, b) chained through nodes where exactly two ends meet.

    Gives (edge_id, chain, pos, forward, start, finish): the place of every edge in its
    chain and whether it runs that way.  ``stops`` are nodes no chain may run through.
    A walk state is an edge with a direction; each round doubles how far a state sees,
    so a chain of n edges takes log2(n) rounds.
    """
    states = edges.select("edge_id", F.inline(F.array(
        F.struct(F.lit(True).alias("fwd"), F.col("a").alias("tail"), F.col("b").alias("tip")),
        F.struct(F.lit(False).alias("fwd"), F.col("b").alias("tail"), F.col("a").alias("tip")))))
    through = degrees(edges).filter(F.col("degree") == 2).select("node")
    if stops is not None:
        through = through.join(stops.select("node"), "node", "left_anti")
    sid = lambda e, f: F.struct(F.col(e).alias("e"), F.col(f).alias("f"))
    following = states.join(through, F.col("tip") == F.col("node"), "left_semi").alias("s").join(
        states.alias("n"), (F.col("s.tip") == F.col("n.tail")) & (F.col("s.edge_id") != F.col("n.edge_id")))
    nxt = following.select(F.struct(F.col("s.edge_id").alias("e"), F.col("s.fwd").alias("f")).alias("s"), F.struct(F.col("n.edge_id").alias("e"), F.col("n.fwd").alias("f")).alias("n"))
    first = (states.select(sid("edge_id", "fwd").alias("s"), "tip").join(nxt, "s", "left")
             # hops to the last state seen, the next state beyond it, the least edge on the way, and the tip of the last
             .select("s", "n", F.lit(0).cast("long").alias("hops"), F.col("s").alias("end"), F.col("s.e").alias("low")))
    table, m = cut(first, open=F.count("n"), low=F.sum(F.xxhash64("low").cast("decimal(38,0)")))
    for _ in range(64):
        if not m["open"]:
            break
        ahead = table.select(F.col("s").alias("n"), F.col("n").alias("_n"), F.col("hops").alias("_h"), F.col("end").alias("_e"), F.col("low").alias("_l"))
        step = table.join(ahead, "n", "left").select(
            "s", F.col("_n").alias("n"), F.when(F.col("_e").isNotNull(), F.col("hops") + 1 + F.col("_h")).otherwise(F.col("hops")).alias("hops"),
            F.coalesce("_e", "end").alias("end"), F.least("low", "_l").alias("low"))
        before, old = m, table
        table, m = cut(step, open=F.count("n"), low=F.sum(F.xxhash64("low").cast("decimal(38,0)")))
        discard(old)
        if m == before:
            break
    else:
        raise RuntimeError("chains did not settle")
    # What is still open runs in circles: open each circle at its least edge, walked forward.
    circles = table.filter(F.col("n").isNotNull())
    rings = None
    if m["open"]:
        rings = _open_circles(edges, circles, nxt)
    done = table.filter(F.col("n").isNull())
    # A chain is seen from both its ends; keep the direction that ends at the lesser last edge.
    other = done.select(F.struct(F.col("s.e").alias("e"), (~F.col("s.f")).alias("f")).alias("s"), F.col("end").alias("oend"), F.col("hops").alias("ohops"))
    both = done.join(other, "s").filter((F.col("end.e") > F.col("oend.e")) | ((F.col("end.e") == F.col("oend.e")) & F.col("s.f")))
    rows = both.select(F.col("s.e").alias("edge_id"), F.least("end.e", "oend.e").alias("chain"), F.col("ohops").alias("pos"), F.col("s.f").alias("forward"))
    return rows if rings is None else rows.unionByName(rings)


def _open_circles(edges: DataFrame, circles: DataFrame, nxt: DataFrame) -> DataFrame:
    """Positions on closed chains, counted from the least edge walked forward."""
    mine = circles.select("s", F.col("low").alias("chain"))
    start = mine.filter((F.col("s.e") == F.col("chain")) & F.col("s.f")).select("s", "chain")
    # Cut the circle before its least edge, then count back to it by doubling.
    back = nxt.select(F.col("n").alias("s"), F.col("s").alias("p"))
    table, m = cut(mine.join(back, "s").join(start.select("s", F.lit(True).alias("_first")), "s", "left")
                   .select("s", "chain", F.when(F.col("_first").isNull(), F.col("p")).alias("p"), F.lit(0).cast("long").alias("hops"),
                           F.when(F.col("_first"), F.col("s")).alias("root")), open=F.count("p"))
    for _ in range(64):
        prev = table.select(F.col("s").alias("p"), F.col("p").alias("_p"), F.col("hops").alias("_h"), F.col("root").alias("_r"))
        step = table.join(prev, "p", "left").select("s", "chain", F.col("_p").alias("p"),
                                                    F.when(F.col("_h").isNotNull(), F.col("hops") + 1 + F.col("_h")).otherwise(F.col("hops")).alias("hops"),
                                                    F.coalesce("root", "_r").alias("root"))
        before, old = m, table
        table, m = cut(step, open=F.count("p"))
        discard(old)
        if not m["open"] or m == before:
            break
    else:
        raise RuntimeError("circles did not settle")
    # Only the direction that starts at the forward root reaches it.
    return table.filter(F.col("root").isNotNull()).select(F.col("s.e").alias("edge_id"), "chain", F.col("hops").alias("pos"), F.col("s.f").alias("forward"))


def shortest_paths(edges: DataFrame, starts: DataFrame, task: str = "task") -> DataFrame:
    """G-10: least cost from each task's start nodes to every node it reaches.

    ``edges`` has edge_id, a, b, cost, bridge; ``starts`` has task, node.  Gives (task, node, dist,
    prev, edge_id, hops, bridged); of equal costs the way with fewer edges counts, then the one with
    fewer bridges.

    The graph is contracted for all tasks together (:func:`contracted`), what is left of it is
    searched from the starts (:func:`relaxed`), and the contracted nodes get their costs in the
    opposite order, each from the few neighbours it had.  A round of each part writes only what it has
    settled, and there are about as many rounds as the logarithm of a road's length.
    """
    arrive = lambda n: F.struct(F.col(n).alias("prev"), F.col("edge_id").alias("edge_id"))
    weight = F.struct(F.round(F.col("cost") * COST_UNITS).cast("bigint").alias("cost"), F.lit(1).cast("bigint").alias("hops"), F.col("bridge").cast("bigint").alias("bridged"))
    way = lambda u, v: edges.filter(F.col("a") != F.col("b")).select(F.col(u).alias("u"), F.col(v).alias("v"), F.struct(weight.alias("w"), arrive(u).alias("into"), arrive(v).alias("back")).alias("way"))
    fixed = cut(starts.select("node").distinct())
    stop = lambda c: fixed.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    flagged = (way("a", "b").unionByName(way("b", "a")).groupBy("u", "v").agg(F.min("way").alias("way")).join(stop("u"), "u", "left").join(stop("v"), "v", "left")
               .select("u", "v", "way", F.coalesce("_u", F.lit(False)).alias("ufix"), F.coalesce("_v", F.lit(False)).alias("vfix")))
    core, levels = contracted(flagged)
    known = relaxed(core, starts.select(task, "node").distinct(), task)
    for level in reversed(levels):
        beside = level.select(F.col("v").alias("node"), F.col("u").alias("_x"), F.col("way.w").alias("_w"), F.col("way.back").alias("_arrive"))
        found = known.join(beside, "node").select(task, F.col("_x").alias("node"), _further("_w", "_arrive").alias("s")).groupBy(task, "node").agg(F.min("s").alias("s"))
        known = known.unionByName(cut(found))
    return known.select(task, "node", (F.col("s.cost") / COST_UNITS).alias("dist"), "s.prev", "s.edge_id", F.col("s.hops").cast("int").alias("hops"), F.col("s.bridged").cast("int").alias("bridged"))


def _further(weight: str, arrive: str) -> Column:
    """The state ``s`` moved on by a way."""
    return F.struct(*[(F.col(f"s.{c}") + F.col(f"{weight}.{c}")).alias(c) for c in ("cost", "hops", "bridged")], *[F.col(f"{arrive}.{c}").alias(c) for c in ("prev", "edge_id")])


def contracted(ways: DataFrame, most: int = MOST_NEIGHBOURS) -> tuple[DataFrame, list[DataFrame]]:
    """Take nodes out of a graph, keeping all least costs between those that stay.

    ``ways`` has both directions of each pair of neighbours: u, v, way (w: cost, hops, bridged; into
    and back: the last step of the way at v and, the other way round, at u), ufix and vfix for nodes that have to stay.
    In a round nodes with few neighbours go, no two of them neighbours (a node goes if its hash, new in
    each round, is less than its neighbours'), and each two neighbours of such a node get a shortcut past it.
    Returns what is left, and for each round the ways of the nodes that went to their neighbours of that time.
    """
    ways, size = cut(ways, rows=F.count(F.lit(1)))
    levels: list[DataFrame] = []
    for level in range(MAX_ROUNDS):
        if not size["rows"]:
            break
        draw = lambda c: F.xxhash64(c, F.lit(level))
        beside = ways.groupBy("u").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(~F.col("vfix"), draw("v"))).alias("_least"), F.max("ufix").alias("_fix"))
        going = beside.filter(~F.col("_fix") & (F.col("_n") <= most) & (draw("u") < F.coalesce("_least", F.lit((1 << 63) - 1)))).select("u")
        out, gone = cut(ways.join(going, "u"), rows=F.count(F.lit(1)))
        # The last few per cent are not worth a round each.
        if gone["rows"] * 20 <= size["rows"]:
            break
        one = out.select("u", F.col("v").alias("_v"), F.col("way").alias("_way"), F.col("vfix").alias("_vfix"))
        sums = F.struct(*[(F.col(f"_way.w.{c}") + F.col(f"way.w.{c}")).alias(c) for c in ("cost", "hops", "bridged")])
        past = one.join(out, "u").filter(F.col("_v") != F.col("v")).select(
            F.col("_v").alias("u"), "v", F.struct(sums.alias("w"), F.col("way.into").alias("into"), F.col("_way.into").alias("back")).alias("way"), F.col("_vfix").alias("ufix"), "vfix")
        there = out.withColumn("_out", F.lit(True))
        back = there.select(F.col("v").alias("u"), F.col("u").alias("v"), "way", F.col("vfix").alias("ufix"), F.col("ufix").alias("vfix"), "_out")
        every = ways.unionByName(past).withColumn("_out", F.lit(False)).unionByName(there).unionByName(back)
        old = ways
        ways, size = cut(every.groupBy("u", "v").agg(F.min("way").alias("way"), F.max("ufix").alias("ufix"), F.max("vfix").alias("vfix"), F.max("_out").alias("_out"))
                         .filter(~F.col("_out")).drop("_out"), rows=F.count(F.lit(1)))
        discard(old)
        levels.append(out)
    return ways, levels


def relaxed(ways: DataFrame, starts: DataFrame, task: str) -> DataFrame:
    """Least costs (task, node, s) from each task's starts over ``ways``, one round per step.

    What was found is only added to: a round looks at the ways from what the last round has found or
    made better, and keeps what is better than all that is known (an anti-join).
    """
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    front = cut(starts.select(task, "node", F.struct(zero.alias("cost"), zero.alias("hops"), zero.alias("bridged"), none.alias("prev"), none.alias("edge_id")).alias("s")))
    known, rounds = front, 0
    if ways.isEmpty():
        return known
    for rounds in range(MAX_ROUNDS):
        steps = front.withColumnRenamed("node", "u").join(ways, "u").withColumns({"_w": F.col("way.w"), "_into": F.col("way.into")})
        reach = steps.select(task, F.col("v").alias("node"), _further("_w", "_into").alias("s")).groupBy(task, "node").agg(F.min("s").alias("s")).alias("r")
        worse = (F.col(f"k.{task}") == F.col(f"r.{task}")) & (F.col("k.node") == F.col("r.node")) & (F.col("k.s") <= F.col("r.s"))
        front, m = cut(reach.join(known.alias("k"), worse, "left_anti"), rows=F.count(F.lit(1)))
        if not m["rows"]:
            return known.groupBy(task, "node").agg(F.min("s").alias("s")) if rounds else known
        known = known.unionByName(front)
    raise RuntimeError("shortest paths did not settle")


def trace(tree: DataFrame, goals: DataFrame, task: str = "task") -> DataFrame:
    """G-10: the path from each task's start to its goal (task, seq, node, prev, edge_id), by doubling jumps up the tree."""
    jump = cut(tree.select(task, "node", F.col("prev").alias("up")).filter(F.col("up").isNotNull()))
    on = cut(goals.select(task, "node").join(tree.select(task, "node"), [task, "node"], "left_semi"))
    for _ in range(64):
        higher = on.join(jump, [task, "node"]).select(task, F.col("up").alias("node"))
        old = on, jump
        on = cut(on.unionByName(higher).distinct())
        jump, j = cut(jump.join(jump.select(task, F.col("node").alias("up"), F.col("up").alias("_up")), [task, "up"]).select(task, "node", F.col("_up").alias("up")), n=F.count(F.lit(1)))
        discard(*old)
        if not j["n"]:
            break
    else:
        raise RuntimeError("paths did not settle")
    return tree.join(on, [task, "node"], "left_semi").filter(F.col("prev").isNotNull()).select(
        task, F.col("hops").alias("seq"), "node", "prev", "edge_id")


def climb_to(tree: DataFrame, marked: DataFrame, task: str = "task") -> DataFrame:
    """First marked node met when walking up the tree from every node (task, node, at)."""
    flag = marked.select(task, "node").distinct().withColumn("_m", F.lit(True))
    table, m = cut(tree.join(flag, [task, "node"], "left").select(
        task, "node", F.when(F.col("_m"), F.col("node")).alias("at"), F.when(F.col("_m").isNull(), F.col("prev")).alias("up")), open=F.count("up"))
    for _ in range(64):
        if not m["open"]:
            break
        old = table
        above = table.select(task, F.col("node").alias("up"), F.col("at").alias("_at"), F.col("up").alias("_up"))
        table, m = cut(table.join(above, [task, "up"], "left").select(
            task, "node", F.coalesce("at", "_at").alias("at"), F.col("_up").alias("up")), open=F.count("up"))
        discard(old)
    else:
        raise RuntimeError("trees did not settle")
    return table.filter(F.col("at").isNotNull()).select(task, "node", "at")


def corridors(pieces: DataFrame, states: DataFrame, adjacency: DataFrame, number: str, piece: str, state: str) -> DataFrame:
    """G-21: pieces of one number merged where their jurisdictions are equal or adjacent (adds ``corridor``).

    ``states`` has number, piece, state; ``adjacency`` has state, beside (both ways).
    Pieces link to their jurisdiction, and jurisdictions of one number to each other, so no
    two pieces are ever paired.
    """
    here = states.select(number, state).distinct()
    spot = lambda n, s: F.concat_ws("|", F.lit("j"), F.col(n).cast("string"), F.col(s).cast("string"))
    own = states.select(F.concat_ws("|", F.lit("p"), F.col(piece).cast("string")).alias("a"), spot(number, state).alias("b"))
    beside = (here.join(adjacency, state).select(number, state, F.col("beside"))
              .join(here.select(number, F.col(state).alias("beside")), [number, "beside"])
              .select(spot(number, state).alias("a"), spot(number, "beside").alias("b")))
    comps = connected(own.unionByName(beside)).select("node", F.col("comp").alias("_c"))
    # Name a corridor after its least piece.
    members = pieces.select(number, piece, F.concat_ws("|", F.lit("p"), F.col(piece).cast("string")).alias("node")).join(comps, "node", "left")
    members = members.withColumn("_c", F.coalesce("_c", "node"))
    least = members.groupBy("_c").agg(F.min(piece).alias("corridor"))
    return members.join(least, "_c").select(number, piece, "corridor")


def nearest_node(nodes: DataFrame, points: DataFrame, task: str) -> DataFrame:
    """Node nearest to each task's point (plon, plat) among the nodes of that task, looked for in widening rings."""
    spots = nodes.select(task, "node", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    found = nearest_in_rings(points.select(task, F.col("plon").alias("lon"), F.col("plat").alias("lat")), spots, task, "node", EARTH_KM, [task])
    return found.select(task, "node", F.col("dist").alias("km"))
