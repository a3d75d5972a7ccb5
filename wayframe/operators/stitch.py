"""Fragments stitched into routes (G-11..G-20, G-23..G-25).

The result of a stitch is a set of tables keyed by component, never one object per route:
edges (all pavement), path (the driven line in order), gaps, and a summary row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, line_km, project
from ..runtime import cut, skew_join
from .graph import bridges, chains, climb_to, connected, degrees, extremities, label_nodes, nearest_node, shortest_paths, snap, trace
from .grid import coincident_share, leg_cells, near_legs, near_points, nearest_leg_in_rings, pad
from .lines import fragment_courses, fragment_legs, sample_fragments, walk
from .ordered import first_by, merge_intervals, positions, running_sum


@dataclass
class Stitched:
    """Tables of a stitch.

    edges: comp, group, edge_id, a, b, km, coords.  path: comp, seq, edge_id, forward,
    bridge, km, piece.  gaps: comp, seq, km.  components: comp, group, km, path_km, pieces, gaps, gap_km.
    """
    edges: DataFrame
    path: DataFrame
    gaps: DataFrame
    components: DataFrame

    def branches(self) -> DataFrame:
        """Pavement that is drawn but not driven."""
        return self.edges.join(self.path.select("comp", "edge_id"), ["comp", "edge_id"], "left_anti")

    def pieces(self) -> DataFrame:
        """Vertices of the driven line in order (comp, piece, seq, i, lon, lat); each edge turned as it is driven."""
        lines = self.path.filter(~F.col("bridge")).select("comp", "piece", "seq", "edge_id", "forward").join(
            self.edges.select("comp", "edge_id", "coords"), ["comp", "edge_id"])
        turned = F.when(F.col("forward"), F.col("coords")).otherwise(F.reverse("coords"))
        rows = lines.select("comp", "piece", "seq", F.posexplode(turned).alias("i", "c"))
        # The first vertex of an edge repeats the last of the one before it in the piece.
        opens = self.path.filter(~F.col("bridge")).groupBy("comp", "piece").agg(F.min("seq").alias("_first"))
        return (rows.join(opens, ["comp", "piece"]).filter((F.col("i") > 0) | (F.col("seq") == F.col("_first")))
                .select("comp", "piece", "seq", "i", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat")))


def build_edges(segments: DataFrame, group: str, snap_deg: float) -> tuple[DataFrame, DataFrame]:
    """G-6: edges (group, edge_id, a, b, km, coords) and nodes (group, node, lon, lat) of fragments (seg_id, group, coords)."""
    usable = segments.filter(F.size("coords") >= 2)
    tip = lambda c, last: F.struct((F.col("seg_id") * 2 + (1 if last else 0)).alias("end_id"), c["lon"].alias("lon"), c["lat"].alias("lat"))
    ends = usable.select(group, F.inline(F.array(tip(F.element_at("coords", 1), False), tip(F.element_at("coords", -1), True))))
    noded = cut(snap(ends, group, snap_deg))
    at = noded.select(F.floor(F.col("end_id") / 2).alias("edge_id"), (F.col("end_id") % 2).alias("_e"), "node")
    pairs = at.groupBy("edge_id").agg(F.max(F.when(F.col("_e") == 0, F.col("node"))).alias("a"), F.max(F.when(F.col("_e") == 1, F.col("node"))).alias("b"))
    edges = usable.select(group, F.col("seg_id").alias("edge_id"), line_km(F.col("coords")).alias("km"), "coords").join(pairs, "edge_id")
    nodes = noded.select(group, "node", F.col("nlon").alias("lon"), F.col("nlat").alias("lat")).distinct()
    return edges, nodes


def cost(km: Column, bridge: Column) -> Column:
    """A bridged gap costs far more than the pavement it spans."""
    return F.when(bridge, km * 4 + 2).otherwise(km)


def contract(edges: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of edges as single edges (edge_id, a, b, cost, km, bridge), and their members (chain, pos, edge_id, forward).

    ``edges`` has edge_id, a, b, km, bridge.  Long roads shrink to their junctions, so a
    path search takes a round per junction instead of one per fragment.
    """
    members = cut(chains(edges.select("edge_id", "a", "b"), stops))
    rows = members.join(edges.select("edge_id", "a", "b", "km", "bridge"), "edge_id")
    tail = F.when(F.col("forward"), F.col("a")).otherwise(F.col("b"))
    tip = F.when(F.col("forward"), F.col("b")).otherwise(F.col("a"))
    short = rows.groupBy("chain").agg(
        F.min_by(tail, "pos").alias("a"), F.max_by(tip, "pos").alias("b"), F.sum("km").alias("km"),
        F.sum(cost(F.col("km"), F.col("bridge"))).alias("cost"), F.sum(F.col("bridge").cast("int")).alias("bridge"), F.count(F.lit(1)).alias("edges"))
    return short.withColumnRenamed("chain", "edge_id"), members


def expand(steps: DataFrame, short: DataFrame, members: DataFrame, edges: DataFrame, task: str) -> DataFrame:
    """Steps over chains (task, seq, prev, edge_id) as edges in order (task, seq, edge_id, forward, bridge, km)."""
    on = steps.join(short.select("edge_id", F.col("a").alias("_a"), F.col("edges").alias("_n")), "edge_id")
    summed = running_sum(on.withColumn("_size", F.col("_n").cast("double")), [task], "seq", "_size", "_upto")
    ahead = F.col("prev") == F.col("_a")
    rows = skew_join(members.withColumnRenamed("edge_id", "member"), summed.select(task, F.col("edge_id").alias("chain"), ahead.alias("_ahead"), "_n", (F.col("_upto") - F.col("_n")).cast("bigint").alias("_start")), ["chain"])
    pos = F.when(F.col("_ahead"), F.col("pos")).otherwise(F.col("_n") - 1 - F.col("pos"))
    return rows.select(task, (F.col("_start") + pos).alias("seq"), F.col("member").alias("edge_id"), (F.col("forward") == F.col("_ahead")).alias("forward")).join(
        edges.select("edge_id", "a", "b", "bridge", "km"), "edge_id")


def past_the_end(tree: DataFrame, ends: DataFrame, nodes: DataFrame, dead_ends: DataFrame, walked: DataFrame,
                 tail_km: float | DataFrame = 0, gain_km: float = 1.6) -> DataFrame:
    """G-11: the end moved on where the road goes on past it (comp, node).

    ``tree`` holds least costs from the other end, ``walked`` the nodes of the path to
    ``ends`` with their cost (comp, node, at).  A dead end beyond is taken if it is reached
    through the end (or its tail) without a bridge, and lies clear of the road walked.
    ``tail_km`` is one length or a table (comp, tail_km).
    """
    base = tree.join(ends, ["comp", "node"], "left_semi").select("comp", F.col("dist").alias("_base"))
    hooks = climb_to(tree, walked.select("comp", "node"), "comp")
    attach = tree.select("comp", F.col("node").alias("at"), F.col("dist").alias("_at_dist"), F.col("bridged").alias("_at_bridged"))
    beyond = (tree.join(dead_ends.select("node"), "node", "left_semi").join(base, "comp")
              .filter(F.col("dist") - F.col("_base") >= gain_km))
    per_comp = isinstance(tail_km, DataFrame)
    beyond = beyond.join(tail_km, "comp") if per_comp else beyond
    # All are looked at in one join: the farthest may be the end of the other direction's lanes.
    ok = (beyond.join(hooks, ["comp", "node"]).join(attach, ["comp", "at"])
          .filter((F.col("_base") - F.col("_at_dist") <= (F.col("tail_km") if per_comp else tail_km)) & (F.col("bridged") == F.col("_at_bridged"))))
    spots = nodes.select("node", "lon", "lat")
    path = walked.select("comp", F.col("node").alias("_w")).join(spots.select(F.col("node").alias("_w"), F.col("lon").alias("wlon"), F.col("lat").alias("wlat")), "_w")
    clear = (ok.join(spots, "node").join(path, "comp").groupBy("comp", "node", "dist", "_base")
             .agg(F.min(haversine(F.col("lon"), F.col("lat"), F.col("wlon"), F.col("wlat"))).alias("_clear")))
    taken = clear.filter(F.col("_clear") >= F.greatest(F.lit(2.0), (F.col("dist") - F.col("_base")) / 8))
    best = first_by(taken, ["comp"], [-F.col("dist"), F.col("node")], ["node"]).withColumnRenamed("node", "_far")
    return ends.join(best, "comp", "left").select("comp", F.coalesce("_far", "node").alias("node"))


def _walked(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes of an expanded path (comp, node)."""
    return (steps.select("comp", F.col("a").alias("node")).unionAll(steps.select("comp", F.col("b").alias("node")))
            .unionAll(start.select("comp", "node")).distinct())


def close_rings(edges: DataFrame, path: DataFrame, ends: DataFrame, tol_km: float = 0.08, near_km: float = 5) -> tuple[DataFrame, DataFrame]:
    """G-12: the rest of each ring, searched for without the pavement already walked.

    ``ends`` has comp, a (where the path starts), b.  Returns the steps to append
    (comp, seq, edge_id, forward, bridge, km) in travel order from the path's end, and, per
    component closed from nodes near its ends, the stretch of the path to keep (comp, first, last).
    """
    paved = edges.filter(~F.col("bridge"))
    walked = path.filter(~F.col("bridge")).select("comp", "edge_id")
    open_edges = paved.join(walked, ["comp", "edge_id"], "left_anti")
    on_path = paved.join(walked, ["comp", "edge_id"], "left_semi").join(open_edges.select("comp"), "comp", "left_semi")
    dense = sample_fragments(on_path, ["comp", "edge_id"], "coords", tol_km / 2).select("comp", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    samples = sample_fragments(open_edges, ["comp", "edge_id"], "coords", 0.2)
    # What is off the path is little beside the path itself, so its samples are the side to repeat.
    beside = coincident_share(samples, dense, ["comp", "edge_id"], tol_km, ["comp"], spread_samples=True).filter(F.col("share") >= 0.6)
    gone = walked.unionByName(beside.select("comp", "edge_id"))
    bridge_walked = path.filter("bridge").select("comp", "edge_id")
    residual, m = cut(edges.join(gone, ["comp", "edge_id"], "left_anti").join(bridge_walked, ["comp", "edge_id"], "left_anti")
                      .select("comp", "edge_id", "a", "b", "km", "bridge"), rows=F.count(F.lit(1)))
    if not m["rows"]:  # nothing is left that could close a ring
        last = F.col("seq")
        return path.filter(F.lit(False)).select("comp", "seq", "edge_id", "forward", "bridge", "km", "a", "b"), path.filter(F.lit(False)).select("comp", last.alias("first"), last.alias("last"))

    # Nodes of the path with the distance along it.
    tip = F.when(F.col("forward"), F.col("b")).otherwise(F.col("a"))
    along = running_sum(path, ["comp"], "seq", "km", "_to").select("comp", (F.col("seq") + 1).alias("idx"), tip.alias("node"), F.col("_to").alias("at"))
    along = cut(along.unionByName(ends.select("comp", F.lit(0).cast("bigint").alias("idx"), F.col("a").alias("node"), F.lit(0.0).alias("at"))))
    total = along.groupBy("comp").agg(F.max("at").alias("_total"))
    placed = along.join(total, "comp")
    stops = along.join(residual.select(F.col("a").alias("node")).unionAll(residual.select(F.col("b").alias("node"))).distinct(), "node", "left_semi").select("node").distinct()
    short, members = contract(residual, stops)
    short = cut(short)

    full = shortest_paths(short, ends.select("comp", F.col("b").alias("node")), "comp")
    closed = full.join(ends.select("comp", F.col("a").alias("node")), ["comp", "node"], "left_semi").select("comp", "node")
    steps = trace(full, closed, "comp")

    # Where the very ends give no ring, try from the nodes near them.
    rest = placed.join(closed.select("comp"), "comp", "left_anti").filter(F.col("_total") >= near_km * 4)
    head = rest.filter(F.col("at") <= near_km)
    tails = rest.filter(F.col("_total") - F.col("at") <= near_km)
    near = shortest_paths(short, tails.select("comp", "node").distinct(), "comp")
    # Pavement must lie between the two: a node of both windows is no ring.
    hit = near.join(head.groupBy("comp", "node").agg(F.max("idx").alias("first")), ["comp", "node"]).filter(F.col("hops") > 0)
    best = first_by(hit, ["comp"], ["dist", "node"], ["node", "first"])
    back = trace(near, best.select("comp", "node"), "comp")
    origin = back.filter(F.col("seq") == 1).select("comp", F.col("prev").alias("node"))
    last = origin.join(tails.groupBy("comp", "node").agg(F.min("idx").alias("last")), ["comp", "node"]).select("comp", "last")
    kept = best.select("comp", "first").join(last, "comp")
    both = steps.unionByName(back)
    edge_steps = expand(both.withColumn("seq", F.col("seq") - 1), short, members, residual, "comp")
    return cut(edge_steps.select("comp", "seq", "edge_id", "forward", "bridge", "km", "a", "b")), cut(kept)


def stitch(segments: DataFrame, group: str, snap_deg: float = 0.0025, bridge_km: float = 60, min_km: float = 1.2,
           dedupe_km: float | None = None, any_node: bool = False, from_extremities: bool = False, tail_km: float = 0,
           rings: bool = True, settings: DataFrame | None = None) -> Stitched:
    """G-19, G-20: fragments (seg_id, group, coords) stitched per group into components with one driven path each.

    Components without bridging come first; slivers shorter than ``min_km`` are dropped,
    unless the group has nothing longer; what is left is bridged and its path searched.

    ``settings`` gives each group its own bridge_km, min_km, dedupe_km (null: none), from_extremities and
    tail_km, so that groups of several systems go through the same jobs; ``bridge_km`` and ``dedupe_km``
    are then the widest of them.
    """
    edges, nodes = build_edges(segments, group, snap_deg)
    edges, nodes = cut(edges), cut(nodes)
    comps = cut(label_nodes(nodes, edges.select("a", "b")))
    sized = edges.join(comps.select(F.col("node").alias("a"), "comp"), "a")
    km = sized.groupBy(group, "comp").agg(F.sum("km").alias("km"))
    km = km.withColumn("min_km", F.lit(float(min_km))) if settings is None else km.join(settings.select(group, "min_km"), group)
    whole = km.filter(F.col("km") >= F.col("min_km"))
    alone = km.join(whole.select(group).distinct(), group, "left_anti")
    keep = cut(whole.select("comp").withColumn("alone", F.lit(False)).unionByName(alone.filter(F.col("km") > 0).select("comp").withColumn("alone", F.lit(True))))
    edges = cut(sized.join(keep.select("comp"), "comp", "left_semi").select(group, "edge_id", "a", "b", "km", "coords", F.lit(False).alias("bridge")))
    nodes = comps.join(keep.select("comp"), "comp", "left_semi")
    if bridge_km > 0:
        closed, comps = bridges(nodes, edges, group, bridge_km, any_node, from_extremities, settings=settings)
        spot = lambda n: nodes.select(F.col("node").alias(n), F.struct("lon", "lat").alias(f"_{n}"))
        closed = positions(cut(closed), [], [F.col("a"), F.col("b")], "a", name="_place")
        lines = cut(closed.join(spot("a"), "a").join(spot("b"), "b").select(
            group, (-F.col("_place")).alias("edge_id"), "a", "b", "km", F.array("_a", "_b").alias("coords"), F.lit(True).alias("bridge")))
        edges = edges.unionByName(lines)
        nodes = cut(nodes.drop("comp").join(comps, "node"))
    edges = cut(edges.join(nodes.select(F.col("node").alias("a"), "comp"), "a"))
    tails = tail_km if settings is None else cut(nodes.select(group, "comp").distinct().join(settings.select(group, "tail_km"), group).select("comp", "tail_km"))
    out = _route(edges, nodes, group, tails, rings)
    return without_opposite_carriageways(out, dedupe_km, settings=settings) if dedupe_km else out


def _route(edges: DataFrame, nodes: DataFrame, group: str, tail_km: float | DataFrame, rings: bool) -> Stitched:
    """G-9..G-13: ends, path and pieces of every component."""
    ends = cut(extremities(nodes).filter(F.col("a") != F.col("b")))
    stops = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    short, members = contract(edges, stops)
    short = cut(short)
    dead = cut(degrees(edges).filter(F.col("degree") == 1).select("node"))

    def search(start: str, goal: str):
        tree = shortest_paths(short, ends.select("comp", F.col(start).alias("node")), "comp")
        steps = trace(tree, ends.select("comp", F.col(goal).alias("node")), "comp")
        return tree, cut(expand(steps.withColumn("seq", F.col("seq") - 1), short, members, edges, "comp"))

    tree, steps = search("a", "b")
    moved = past_the_end(tree, ends.select("comp", F.col("b").alias("node")), nodes, dead, _walked(steps, ends.select("comp", F.col("a").alias("node"))), tail_km)
    ends = cut(ends.drop("b").join(moved.withColumnRenamed("node", "b"), "comp"))
    tree, steps = search("b", "a")
    moved = past_the_end(tree, ends.select("comp", F.col("a").alias("node")), nodes, dead, _walked(steps, ends.select("comp", F.col("b").alias("node"))), tail_km)
    ends = cut(ends.drop("a").join(moved.withColumnRenamed("node", "a"), "comp"))
    # The path is read from the tree that starts at b, so it runs from b to a.
    final = trace(tree, ends.select("comp", F.col("a").alias("node")), "comp")
    path = cut(expand(final.withColumn("seq", F.col("seq") - 1), short, members, edges, "comp").select("comp", "seq", "edge_id", "forward", "bridge", "km", "a", "b"))

    if rings:
        back, kept = close_rings(edges, path, ends.select("comp", F.col("b").alias("a"), F.col("a").alias("b")))
        trimmed = path.join(kept, "comp", "left").filter(F.col("first").isNull() | ((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("last"))))
        trimmed = trimmed.withColumn("seq", F.col("seq") - F.coalesce("first", F.lit(0))).drop("first", "last")
        size = trimmed.groupBy("comp").agg(F.count(F.lit(1)).alias("_n"))
        more = back.join(size, "comp").withColumn("seq", F.col("seq") + F.col("_n")).drop("_n")
        path = cut(trimmed.unionByName(more))

    # A component without a path keeps its longest edge.
    bare = edges.filter(~F.col("bridge")).join(path.filter(~F.col("bridge")).select("comp").distinct(), "comp", "left_anti")
    single = first_by(bare, ["comp"], [-F.col("km"), F.col("edge_id")], ["edge_id", "km", "a", "b"]).select(
        "comp", F.lit(0).cast("bigint").alias("seq"), "edge_id", F.lit(True).alias("forward"), F.lit(False).alias("bridge"), "km", "a", "b")
    only_bridges = path.join(bare.select("comp").distinct(), "comp", "left_anti")
    path = assemble(only_bridges.unionByName(single.select(*only_bridges.columns)))
    return _summary(edges, path, group)


def assemble(path: DataFrame) -> DataFrame:
    """G-13: number the pieces of a path: a bridged gap ends one and the next begins."""
    counted = running_sum(path.withColumn("_b", F.col("bridge").cast("double")), ["comp"], "seq", "_b", "_p")
    return cut(counted.select("comp", "seq", "edge_id", "forward", "bridge", "km", F.col("_p").cast("int").alias("piece")))


def _summary(edges: DataFrame, path: DataFrame, group: str) -> Stitched:
    paved = edges.filter(~F.col("bridge"))
    gaps = path.filter("bridge").select("comp", "seq", F.round("km", 2).alias("km"))
    total = paved.groupBy("comp", group).agg(F.sum("km").alias("km"))
    driven = path.groupBy("comp").agg(F.sum(F.when(~F.col("bridge"), F.col("km"))).alias("path_km"), F.count_distinct(F.when(~F.col("bridge"), F.col("piece"))).alias("pieces"),
                                      F.count(F.when(F.col("bridge"), 1)).alias("gaps"), F.coalesce(F.sum(F.when(F.col("bridge"), F.col("km"))), F.lit(0.0)).alias("gap_km"))
    return Stitched(paved.select(group, "comp", "edge_id", "a", "b", "km", "coords"), path, gaps, cut(total.join(driven, "comp")))


def without_opposite_carriageways(out: Stitched, tol_km: float = 0.08, share: float = 0.6, settings: DataFrame | None = None) -> Stitched:
    """G-15: components lying along longer kept ones of their group become branches of the one they lie on most.

    A component is kept once the longer ones, kept or undecided, cover less than ``share``
    of it, and dropped once kept ones cover that much.  The longest undecided of a group
    is settled in every round.  ``settings`` (group, dedupe_km) gives each group its own tolerance, null to
    leave it as it is; ``tol_km`` is then the widest.
    """
    group = [c for c in out.components.columns if c not in ("comp", "km", "path_km", "pieces", "gaps", "gap_km")][0]
    lines = out.path.filter(~F.col("bridge")).select("comp", "edge_id").join(out.edges.select(group, "comp", "edge_id", "coords"), ["comp", "edge_id"])
    several = out.components.groupBy(group).agg((F.count(F.lit(1)) > 1).alias("_s")).filter("_s").select(group)
    if settings is not None:
        several = several.join(settings.filter(F.col("dedupe_km").isNotNull()), group, "left_semi")
    lines = lines.join(several, group, "left_semi").join(out.components.select("comp", F.col("km").alias("ckm")), "comp")
    samples = cut(sample_fragments(lines, [group, "comp", "ckm", "edge_id"], "coords", 0.2))
    dense = sample_fragments(lines, [group, "comp", "ckm", "edge_id"], "coords", tol_km / 2)
    others = dense.select(group, F.col("comp").alias("other"), F.col("ckm").alias("okm"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    longer = (F.col("okm") > F.col("ckm")) | ((F.col("okm") == F.col("ckm")) & (F.col("other") < F.col("comp")))
    near = near_points(samples, others, tol_km, [group], size=tol_km / 100).filter(longer)
    if settings is not None:
        near = near.join(settings.select(group, "dedupe_km"), group).filter(F.col("dist") <= F.col("dedupe_km"))
    hits = cut(near
               .select("comp", "edge_id", "along", "other").distinct())
    n = samples.groupBy("comp").agg(F.count(F.lit(1)).alias("_n"))
    state, m = cut(samples.select("comp").distinct().withColumn("kept", F.lit(None).cast("boolean")), open=F.count(F.lit(1)))
    while m["open"]:
        mark = state.select(F.col("comp").alias("other"), F.col("kept").alias("_k"))
        # Per sample: is it covered by a kept one, and by one that may yet be kept?
        per = (hits.join(mark, "other").groupBy("comp", "edge_id", "along")
               .agg(F.max(F.coalesce("_k", F.lit(False))).alias("_sure"), F.max(F.coalesce("_k", F.lit(True))).alias("_maybe")))
        cover = per.groupBy("comp").agg(F.count(F.when(F.col("_sure"), 1)).alias("_s"), F.count(F.when(F.col("_maybe"), 1)).alias("_m"))
        decided = (state.join(n, "comp").join(cover, "comp", "left").select("comp", F.coalesce(
            "kept", F.when(F.coalesce("_s", F.lit(0)) / F.col("_n") >= share, False).when(F.coalesce("_m", F.lit(0)) / F.col("_n") < share, True)).alias("kept")))
        state, m = cut(decided, open=F.count(F.when(F.col("kept").isNull(), 1)))
    dropped = cut(state.filter(~F.col("kept")).select("comp"))
    lain = (hits.join(dropped, "comp", "left_semi").join(state.filter("kept").select(F.col("comp").alias("other")), "other", "left_semi")
            .groupBy("comp", "other").agg(F.count(F.lit(1)).alias("_h")).join(out.components.select(F.col("comp").alias("other"), "km"), "other"))
    host = first_by(lain, ["comp"], [-F.col("_h"), -F.col("km"), F.col("other")], ["other"])
    edges = out.edges.join(host, "comp", "left")
    # Only the dropped one's driven line is drawn with its host; its edges count nowhere.
    drawn = out.path.filter(~F.col("bridge")).select("comp", "edge_id").withColumn("_on", F.lit(True))
    edges = (edges.join(drawn, ["comp", "edge_id"], "left").filter(F.col("other").isNull() | F.col("_on"))
             .withColumn("comp", F.coalesce("other", "comp")).drop("other", "_on"))
    return Stitched(cut(edges), out.path.join(dropped, "comp", "left_anti"), out.gaps.join(dropped, "comp", "left_anti"),
                    out.components.join(dropped, "comp", "left_anti"))


def driven_km(path: DataFrame, edges: DataFrame, key: str, tol_km: float = 0.08, min_along_km: float = 1.6) -> DataFrame:
    """G-16: how far each edge of a path is really driven (key, seq, edge_id, km, driven).

    Pavement the path lays on itself, within ``tol_km`` but ``min_along_km`` further along,
    counts half from each side.
    """
    step = tol_km / 2
    # Edges are laid end to end as they are driven; a gap has no length.
    length = F.when(F.col("bridge"), F.lit(0.0)).otherwise(F.col("km"))
    paved = running_sum(path.select(key, "seq", "edge_id", "forward", "bridge", "km", length.alias("_km")), [key], "seq", "_km", "_to").filter(~F.col("bridge"))
    turned = F.when(F.col("forward"), F.col("coords")).otherwise(F.reverse("coords")).alias("coords")
    lines = paved.select(key, "seq", "edge_id", "forward", (F.col("_to") - F.col("km")).alias("_off")).join(edges.select("edge_id", "coords"), "edge_id").select(key, "seq", "_off", turned)
    doubled = _laid_twice(fragment_courses(lines, [key, "seq", "_off"], "coords"), key, step, tol_km, min_along_km)
    return path.filter(~F.col("bridge")).select(key, "seq", "edge_id", "km").join(doubled, [key, "seq"], "left").select(key, "seq", "edge_id", "km", F.greatest(
        F.lit(0.0), F.col("km") - F.coalesce(F.col("_n") * step, F.lit(0.0)) / 2).alias("driven"))


def _laid_twice(courses: DataFrame, key: str, step: float, tol_km: float, min_along_km: float) -> DataFrame:
    """How many samples of each edge of a path lie within ``tol_km`` of samples ``min_along_km`` away along it (key, seq, _n).

    ``courses`` are legs (key, seq, _off, ax, ay, bx, by, from_km, to_km, km).  Legs meet in cells, and only two that may come near each
    other are sampled, where they meet: samples are never shuffled.  A sample is looked at in its own cell only.
    """
    size = tol_km / 8
    dx, dy = pad(F.greatest(F.abs("ay"), F.abs("by")), tol_km)
    spread = leg_cells(courses.filter(F.col("km") > 0).drop("km"), size, dx, dy)
    a, b = spread.alias("a"), spread.alias("b")
    px, py = pad(F.greatest(F.abs("a.ay"), F.abs("a.by")), tol_km)
    of = lambda f, s, c: f(F.col(f"{s}.a{c}"), F.col(f"{s}.b{c}"))
    clear = lambda c, p: (of(F.least, "b", c) > of(F.greatest, "a", c) + p) | (of(F.greatest, "b", c) < of(F.least, "a", c) - p)
    along = lambda s, c: F.col(f"{s}._off") + F.col(f"{s}.{c}")
    apart = F.greatest(along("a", "to_km") - along("b", "from_km"), along("b", "to_km") - along("a", "from_km")) >= min_along_km - 1e-6
    # A leg is straight, so it does not come near itself.
    other = (F.col("a.seq") != F.col("b.seq")) | (F.col("a.from_km") != F.col("b.from_km"))
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    pairs = a.join(b, same & other & apart & ~clear("x", px) & ~clear("y", py)).select(
        F.col(f"a.{key}").alias(key), F.col("a._cx").alias("_cx"), F.col("a._cy").alias("_cy"), F.col("a.seq").alias("seq"),
        *[F.col(f"{s}.{c}").alias(f"_{s}_{c}") for s in "ab" for c in ("_off", "ax", "ay", "bx", "by", "from_km", "to_km")])

    def sampled(df: DataFrame, s: str) -> DataFrame:
        """The samples of a leg: its number, place and distance along the path."""
        from_km, to_km = F.col(f"_{s}_from_km"), F.col(f"_{s}_to_km")
        first, last = F.floor(from_km / step) + 1, F.ceil(to_km / step) - 1
        t = (F.col(f"_{s}n") * F.lit(float(step)) - from_km) / (to_km - from_km)
        on = lambda c: F.col(f"_{s}_a{c}") + (F.col(f"_{s}_b{c}") - F.col(f"_{s}_a{c}")) * t
        return df.filter(first <= last).withColumn(f"_{s}n", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumns(
            {f"_{s}x": on("x"), f"_{s}y": on("y"), f"_{s}along": F.col(f"_{s}__off") + F.col(f"_{s}n") * F.lit(float(step))})

    here = sampled(pairs, "a").filter((F.floor(F.col("_ax") / size) == F.col("_cx")) & (F.floor(F.col("_ay") / size) == F.col("_cy")))
    hit = sampled(here, "b").filter((F.abs(F.col("_aalong") - F.col("_balong")) >= min_along_km) & (F.abs(F.col("_ay") - F.col("_by")) <= tol_km / 110.5)
                                    & (haversine(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")) <= tol_km))
    # A sample counts in one cell, in which all its pairs are, so this needs no shuffle.
    each = hit.groupBy(key, "_cx", "_cy", "seq", "_an").agg(F.lit(1).alias("_hit")).groupBy(key, "_cx", "_cy", "seq").agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(key, "seq").agg(F.sum("_n").alias("_n"))


def node_parts(parts: DataFrame, task: str, points: DataFrame | None = None, join_km: float = 0.4) -> DataFrame:
    """G-17: fragments (task, seg_id, coords) cut where others end on their flank, and at named points (task, plon, plat).

    Gives (task, seg_id, sub, coords).
    """
    legs = fragment_legs(parts, [task, "seg_id"], "coords")
    tip = lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"))
    ends = parts.select(task, F.col("seg_id").alias("_own"), F.posexplode(F.array(tip(F.element_at("coords", 1)), tip(F.element_at("coords", -1)))).alias("_e", "_c")).select(
        task, "_own", "_e", "_c.lon", "_c.lat")
    hits = near_legs(ends, legs, join_km, [task]).filter(F.col("seg_id") != F.col("_own"))
    cuts = first_by(hits, [task, "_own", "_e"], ["dist", "seg_id", "seq"], ["seg_id", "seq", "lon", "lat", "ax", "ay", "bx", "by"])
    cuts = cuts.select(task, "seg_id", "seq", "lon", "lat", "ax", "ay", "bx", "by")
    if points is not None:
        named = points.select(task, "plon", "plat", F.col("plon").alias("lon"), F.col("plat").alias("lat")).distinct()
        nearest = nearest_leg_in_rings(named, legs, [task, "plon", "plat"], ["seg_id", "seq"], ["seg_id", "seq", "ax", "ay", "bx", "by"], [task])
        cuts = cuts.unionByName(nearest.select(task, "seg_id", "seq", F.col("plon").alias("lon"), F.col("plat").alias("lat"), "ax", "ay", "bx", "by"))
    spot = project(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    cuts = (cuts.withColumn("_s", spot).filter((haversine(F.col("_s.lon"), F.col("_s.lat"), F.col("ax"), F.col("ay")) > 1e-6) | (F.col("seq") > 1))
            .select(task, "seg_id", "seq", F.col("_s.t").alias("_at"), F.col("_s.lon").alias("lon"), F.col("_s.lat").alias("lat")).distinct())
    # A source fragment is small, so its few cuts are kept beside it as an array.
    by_part = cuts.groupBy(task, "seg_id").agg(F.array_sort(F.collect_set(F.struct("seq", "_at", "lon", "lat"))).alias("_cuts"))
    rows = parts.join(by_part, [task, "seg_id"], "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast(by_part.schema["_cuts"].dataType)))
    sub = rows.withColumn("sub", F.explode(F.sequence(F.lit(0), F.size("_cuts"))))
    lo, hi = F.get("_cuts", F.col("sub") - 1), F.get("_cuts", F.col("sub"))
    point = lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"))
    inner = F.filter("coords", lambda c, i: (i >= F.coalesce(lo["seq"], F.lit(0))) & (i < F.coalesce(hi["seq"], F.size("coords"))))
    whole = F.concat(F.when(lo.isNotNull(), F.array(point(lo))).otherwise(F.array().cast(parts.schema["coords"].dataType)), inner,
                     F.when(hi.isNotNull(), F.array(point(hi))).otherwise(F.array().cast(parts.schema["coords"].dataType)))
    clean = F.filter(whole, lambda c, i: (i == 0) | (c != F.get(whole, i - 1)))
    return sub.select(task, "seg_id", "sub", clean.alias("coords")).filter(F.size("coords") >= 2)


def stitch_between(parts: DataFrame, termini: DataFrame, task: str, snap_deg: float = 0.0025, bridge_km: float = 60) -> tuple[DataFrame, DataFrame]:
    """G-18: the path between two declared points over the union of a task's fragments.

    ``parts`` has task, seg_id, coords; ``termini`` has task, flon, flat, tlon, tlat.
    Returns the status per task (task, status, km, gaps, snap_from, snap_to) and the path
    (task, seq, edge_id, forward, bridge, km, piece).
    """
    spots = termini.select(task, F.inline(F.array(F.struct(F.col("flon").alias("plon"), F.col("flat").alias("plat")), F.struct(F.col("tlon").alias("plon"), F.col("tlat").alias("plat")))))
    noded = node_parts(parts, task, spots)
    placed = positions(cut(noded), [], [F.col("seg_id"), F.col("sub"), F.col(task)], "seg_id", name="_place")
    numbered = cut(placed.select(F.col("_place").alias("seg_id"), task, "coords"))
    edges, nodes = build_edges(numbered, task, snap_deg)
    edges = cut(edges.withColumn("bridge", F.lit(False)))
    nodes = cut(label_nodes(nodes, edges.select("a", "b")))
    if bridge_km > 0:
        closed, comps = bridges(nodes, edges, task, bridge_km, any_node=True)
        closed = positions(cut(closed), [], [F.col("a"), F.col("b")], "a", name="_place")
        extra = closed.select(task, (-F.col("_place")).alias("edge_id"), "a", "b", "km", F.lit(True).alias("bridge"))
        edges = cut(edges.select(task, "edge_id", "a", "b", "km", "bridge").unionByName(extra))
        nodes = cut(nodes.drop("comp").join(comps, "node"))
    near = lambda x, y, name: nearest_node(nodes, termini.select(task, F.col(x).alias("plon"), F.col(y).alias("plat")), task).select(
        task, F.col("node").alias(f"{name}_node"), F.round("km", 1).alias(f"snap_{name}"))
    ends = cut(near("flon", "flat", "from").join(near("tlon", "tlat", "to"), task))
    comp = lambda n: nodes.select(F.col("node").alias(n), F.col("comp").alias(f"_{n}"))
    ends = cut(ends.join(comp("from_node"), "from_node").join(comp("to_node"), "to_node").withColumn(
        "status", F.when(F.col("from_node") == F.col("to_node"), "same place").when(F.col("_from_node") != F.col("_to_node"), "disconnected").otherwise("found")))
    found = ends.filter(F.col("status") == "found")
    short, members = contract(edges, found.select(F.col("from_node").alias("node")).unionByName(found.select(F.col("to_node").alias("node"))).distinct())
    short = cut(short)
    tree = shortest_paths(short, found.select(task, F.col("from_node").alias("node")), task)
    steps = trace(tree, found.select(task, F.col("to_node").alias("node")), task)
    path = expand(steps.withColumn("seq", F.col("seq") - 1), short, members, edges, task).withColumnRenamed(task, "comp")
    path = assemble(path).withColumnRenamed("comp", task)
    sums = path.groupBy(task).agg(F.sum(F.when(~F.col("bridge"), F.col("km"))).alias("km"), F.count(F.when(F.col("bridge"), 1)).alias("gaps"))
    return ends.select(task, "status", "snap_from", "snap_to").join(sums, task, "left"), path


def between_points(lines_along: DataFrame, ends: DataFrame, facility: str, line: str, on: list[str], snap_km: float, tolerance: float, join_km: float = 0.5) -> DataFrame:
    """G-23: the stretch between two points, if it measures what is published within ``tolerance``.

    ``lines_along`` are legs with from_km/to_km and ``on``; ``ends`` has the facility, ``on`` (a row for
    each route it may lie on), flon, flat, tlon, tlat and published km.  The line with the least sum of
    offsets that reaches both points is taken.  Failing that, two lines that meet end to end within
    ``join_km``, one reaching each point: out from the first point to the end where they meet and on to the second
    (``{line}2``, join_at and join2_at are where they meet), again with the least sum of offsets and gap.
    """
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    same = dict(lines_along.dtypes)[line]
    # Both points look at once, so legs are spread over cells once, and over cells so wide that most stand in one or two.
    point = lambda x, y, first: F.struct(F.lit(first).alias("_first"), F.col(x).alias("lon"), F.col(y).alias("lat"))
    points = ends.select(facility, *on, F.inline(F.array(point("flon", "flat", True), point("tlon", "tlat", False))))
    hits = near_legs(points, lines_along, snap_km, on, size=snap_km / 10, metric="flat")
    spot = project(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    place = F.struct(F.col("dist").alias("off"), (F.col("from_km") + (F.col("to_km") - F.col("from_km")) * spot["t"]).alias("at"))
    nearest = lambda which, p: F.min_by(place, F.when(which, F.struct("dist", "seq"))).alias(p)
    reach = hits.groupBy(facility, line).agg(nearest(F.col("_first"), "f"), nearest(~F.col("_first"), "t"))
    reach = cut(reach.select(facility, line, F.col("f.off").alias("f_off"), F.col("f.at").alias("f_at"), F.col("t.off").alias("t_off"), F.col("t.at").alias("t_at")))

    both = reach.filter(F.col("f_off").isNotNull() & F.col("t_off").isNotNull()).withColumn("km", F.abs(F.col("t_at") - F.col("f_at"))).withColumn("off", F.col("f_off") + F.col("t_off"))
    one = cut(first_by(both, [facility], ["off", line], [line, none(f"{line}2", same), none("join_at", "double"), none("join2_at", "double"), "km", "off", "f_at", "t_at"]))
    published = ends.select(facility, F.col("km").alias("published")).distinct()
    drawn = F.abs(F.col("km") - F.col("published")) <= F.col("published") * tolerance
    drawn_of = lambda found: published.join(found, facility, "left").withColumn("drawn", F.coalesce(drawn, F.lit(False)))

    # The two ends of each line that a facility still without a cut reaches, and the least gap between those of two lines.
    rest, m = cut(reach.join(one.select(facility), facility, "left_anti"), rows=F.count(F.lit(1)))
    if not m["rows"]:  # every facility that reaches a line has its cut
        return drawn_of(one)
    out, back = (rest.filter(F.col(f"{p}_off").isNotNull()).select(facility, line, f"{p}_off", f"{p}_at") for p in "ft")
    reached = rest.select(line).distinct()
    tips = lines_along.join(reached, line, "left_semi").groupBy(line).agg(
        F.min_by(F.struct(F.col("ax").alias("lon"), F.col("ay").alias("lat"), F.col("from_km").alias("at")), "seq").alias("_a"),
        F.max_by(F.struct(F.col("bx").alias("lon"), F.col("by").alias("lat"), F.col("to_km").alias("at")), "seq").alias("_b"))
    tips = cut(tips.select(line, F.inline(F.array("_a", "_b"))))
    others = tips.select(F.col(line).alias(f"{line}2"), F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.col("at").alias("join2_at"))
    met = near_points(tips.withColumnRenamed("at", "join_at"), others, join_km, metric="flat").filter(F.col(line) != F.col(f"{line}2"))
    meet = first_by(met, [line, f"{line}2"], ["dist", "join_at", "join2_at"], [F.col("dist").alias("gap"), "join_at", "join2_at"])
    pairs = out.join(back.withColumnRenamed(line, f"{line}2"), facility).join(meet, [line, f"{line}2"])
    pairs = (pairs.withColumn("km", F.abs(F.col("join_at") - F.col("f_at")) + F.col("gap") + F.abs(F.col("t_at") - F.col("join2_at")))
             .withColumn("off", F.col("f_off") + F.col("t_off") + F.col("gap")))
    two = first_by(pairs, [facility], ["off", line, f"{line}2"], [line, f"{line}2", "join_at", "join2_at", "km", "off", "f_at", "t_at"])
    return drawn_of(one.unionByName(two))


def flag_stretches(parts: DataFrame, mainline: DataFrame, named: Column, key: str, close_km: float = 25, near_km: float = 5) -> DataFrame:
    """G-24: which fragments of a road belong to the stretches that carry a name.

    ``parts`` has key, seg_id and coords, ``mainline`` legs with from_km/to_km.  Named
    fragments give intervals along the mainline, merged over gaps shorter than
    ``close_km`` and drawn out to ends that near; a fragment belongs if its middle does.
    """
    total = mainline.groupBy(key).agg(F.max("to_km").alias("_total"))
    tip = lambda c: F.struct(c["lon"].alias("lon"), c["lat"].alias("lat"))
    # The ends of what is named and the middles of all are laid on the mainline in one join, in cells so wide that legs stand in few.
    middle = F.get("coords", F.floor(F.size("coords") / 2).cast("int"))
    points = (parts.select(key, "seg_id", F.coalesce(named, F.lit(False)).alias("_named"), F.posexplode(F.array(tip(F.element_at("coords", 1)), tip(F.element_at("coords", -1)), tip(middle))).alias("e", "c"))
              .filter((F.col("e") == 2) | F.col("_named")).select(key, "seg_id", "e", "c.lon", "c.lat"))
    hits = near_legs(points, mainline, near_km, [key], size=near_km / 20, metric="flat")
    spot = project(F.col("lon"), F.col("lat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    laid = cut(first_by(hits.withColumn("_at", F.col("from_km") + (F.col("to_km") - F.col("from_km")) * spot["t"]), [key, "seg_id", "e"], ["dist", "_at"], ["_at"]))
    spans = (laid.filter("e < 2").groupBy(key, "seg_id").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") == 2))
    merged = merge_intervals(spans, [key], "lo", "hi", close_km).join(total, key)
    merged = merged.withColumn("lo", F.when(F.col("lo") < close_km, 0.0).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(F.col("_total") - F.col("hi") < close_km, F.col("_total")).otherwise(F.col("hi")))
    # Merged stretches of one road lie ``close_km`` apart, so few meet a fragment's road.
    inside = F.coalesce(F.col("_at").between(F.col("lo") - 0.05, F.col("hi") + 0.05), F.lit(False))
    mids = laid.filter("e = 2").join(merged, key, "left").groupBy(key, "seg_id").agg(F.max(inside).alias("_in"))
    return parts.select(key, "seg_id", named.alias("_named")).join(mids, [key, "seg_id"], "left").select(
        key, "seg_id", F.when(F.col("_in").isNull(), F.col("_named")).otherwise(F.col("_in")).alias("flagged"))


def split_groups(segments: DataFrame, flags: DataFrame, key: str, suffix: str) -> DataFrame:
    """G-25: the flagged fragments of a group under a key of their own, to be stitched apart."""
    marked = segments.join(flags, [key, "seg_id"], "left")
    return marked.withColumn("part_key", F.when(F.coalesce("flagged", F.lit(False)), F.concat_ws("|", F.col(key).cast("string"), F.lit(suffix)))
                             .otherwise(F.col(key).cast("string"))).drop("flagged")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


__all__ = ["Stitched", "build_edges", "stitch", "assemble", "without_opposite_carriageways", "driven_km", "node_parts", "stitch_between",
           "between_points", "flag_stretches", "split_groups", "contract", "expand", "past_the_end", "close_rings", "connected", "walk"]
