"""Graph operators over nodes(id) and edges(edge, src, dst[, weight]).

Traversals are loops of edge joins that carry their path; algorithms are loops of joins and aggregates by node. Every
round is cut by a written table, and no adjacency list is gathered in one task, except for a depth-first tree, which is
sequential by definition and takes a component in one task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryError
from .checkpoints import cut, keyed
from .packs import closed, packed

DAMPING, ITERATIONS, TOLERANCE, DEEPEST = 0.85, 20, 1e-9, 8


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(edge, src, dst) in the asked direction; ``either`` has both."""
    out = edges.select("edge", "src", "dst")
    back = edges.select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "either":  # both from one reading of an edge, which a union would make twice
        return edges.select("edge", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("edge", "e.src", "e.dst")
    raise QueryError("E_METHOD_CONFLICT", f"direction {direction}")


def visible(edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """Edges that touch no hidden node; dangling ends are allowed."""
    gone = hidden.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")


def neighbours(edges: DataFrame, direction: str = "out") -> DataFrame:
    return oriented(edges, direction).select("src", "dst").distinct()


def traverse(starts: DataFrame, edges: DataFrame, least: int = 1, most: int = 1, mode: str = "walk", distinct: str = "none", direction: str = "out", limit: int | None = None) -> DataFrame:
    """(start, node, nodes, edges, depth) of paths of least to most hops.

    walk: any; trail: no edge twice; simple_path: no edge and no node twice. distinct: none, path or end_node."""
    if most < least or least < 0:
        raise QueryError("E_METHOD_CONFLICT", "min and max")
    step = oriented(edges, direction)
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("nodes"), F.array().cast(f"array<{dict(edges.dtypes)['edge']}>").alias("edges"), F.lit(0).alias("depth"))
    out = level if least == 0 else None
    seen = level.select("start", "node")
    for depth in range(1, most + 1):
        grown = level.join(step, level["node"] == step["src"])
        if mode in ("trail", "simple_path"):
            grown = grown.where(~F.array_contains("edges", F.col("edge")))
        if mode == "simple_path":
            grown = grown.where(~F.array_contains("nodes", F.col("dst")))
        level = grown.select("start", F.col("dst").alias("node"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("edge")).alias("edges"), F.lit(depth).alias("depth"))
        if distinct == "end_node":
            level = level.join(seen, ["start", "node"], "left_anti")
            first = Window.partitionBy("start", "node").orderBy("edges")
            level = cut(level.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn"))
            seen = seen.union(level.select("start", "node"))
        elif distinct == "path":
            level = level.dropDuplicates(["start", "edges"])
        if limit is not None and level.limit(limit + 1).count() > limit:
            raise QueryError("E_RESOURCE_LIMIT", f"more than {limit} paths at depth {depth}")
        if depth >= least:
            out = level if out is None else out.unionByName(level)
    return out


def hop(rows: DataFrame, edges: DataFrame, nodes: DataFrame, source: str, edge: str, target: str, direction: str = "out") -> DataFrame:
    """One hop from the column ``source``: adds the columns ``edge`` and ``target``, which is one of ``nodes``."""
    step = oriented(edges, direction).select(F.col("src").alias(source), F.col("edge").alias(edge), F.col("dst").alias(target))
    return rows.join(step, source).join(nodes.select(F.col("id").alias(target)).distinct(), target, "left_semi")


def distances(starts: DataFrame, edges: DataFrame, deepest: int = DEEPEST, direction: str = "out") -> DataFrame:
    """(start, node, depth) by breadth-first levels, the start itself at depth 0."""
    step = cut(neighbours(edges, direction))
    level = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct())
    found = level.withColumn("depth", F.lit(0))
    for depth in range(1, deepest + 1):
        grown = level.join(step, level["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        level = cut(grown.join(found.select("start", "node"), ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        found = cut(found.unionByName(level.withColumn("depth", F.lit(depth))))
    return found


def reachable(starts: DataFrame, edges: DataFrame, deepest: int = DEEPEST, direction: str = "out") -> DataFrame:
    """(id, reachable, reachable_count) of the nodes that a start reaches, itself not counted."""
    counts = distances(starts, edges, deepest, direction).groupBy(F.col("start").alias("id")).agg((F.count("*") - 1).alias("reachable_count"))
    return counts.select("id", (F.col("reachable_count") > 0).alias("reachable"), "reachable_count")


def shortest(starts: DataFrame, edges: DataFrame, targets: DataFrame | None = None, deepest: int = DEEPEST, direction: str = "out") -> DataFrame:
    """(id, shortest_distance) to the nearest target, or without targets to the nearest other node; null if there is none."""
    found = distances(starts, edges, deepest, direction).where("depth > 0")
    if targets is not None:
        found = found.join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    least = found.groupBy(F.col("start").alias("id")).agg(F.min("depth").cast("long").alias("shortest_distance"))
    return starts.select("id").distinct().join(least, "id", "left")


def all_paths(starts: DataFrame, edges: DataFrame, deepest: int = DEEPEST, k: int | None = None, direction: str = "out") -> DataFrame:
    """Distinct simple paths up to a depth; ``k`` keeps the shortest of each start and end."""
    paths = traverse(starts, edges, 1, deepest, "simple_path", "path", direction)
    if k is None:
        return paths
    by_depth = Window.partitionBy("start", "node").orderBy("depth", "edges")
    return paths.withColumn("_turn", F.row_number().over(by_depth)).where(F.col("_turn") <= k).drop("_turn")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    pairs = neighbours(edges)
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    both = nodes.select("id").distinct().join(out, "id", "left").join(into, "id", "left").na.fill(0)
    return both.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("id").distinct().count()
    return degree(nodes, edges).select("id", (F.col("degree") / F.lit(float(max(1, n - 1)))).alias("centrality"))


def closeness(nodes: DataFrame, edges: DataFrame, deepest: int = 64) -> DataFrame:
    """reached / sum of distances, 0 where nothing is reached."""
    found = distances(nodes, edges, deepest).where("depth > 0").groupBy(F.col("start").alias("id")).agg((F.count("*") / F.sum("depth")).alias("c"))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("centrality"))


def ends(edges: DataFrame) -> DataFrame:
    """A table of the (src, dst) of edges: the edges themselves, where they are one."""
    return edges if hasattr(edges, "_cut_path") and edges.columns == ["src", "dst"] else cut(edges.select("src", "dst"))


def roots(parents: DataFrame) -> DataFrame:
    """(node, label): the end of each node's way in parents(node, label), which only lead to lesser nodes, by doubling."""
    labels = cut(parents)
    while True:
        jump = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(labels.join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the weak component.

    Every node joins the least of its least neighbour and that one's least neighbour, if that is less; the trees that so
    arise become nodes, and only the edges between two of them go on, each once. The edges are read whole in the first
    round; what is left is far smaller."""
    pairs, out = ends(edges), None
    while True:
        near = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))).alias("e"))
        near = cut(near.groupBy("e.node").agg(F.min("e.near").alias("near")))
        then = near.select(F.col("node").alias("near"), F.col("near").alias("then"))
        labels = roots(near.join(then, "near", "left").select("node", F.least("node", "near", "then").alias("label")))
        # what an earlier round joined follows where its root went
        out = labels if out is None else cut(out.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label")))
        told = pairs.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").select("a", "dst").distinct()
        told = told.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a <> b")
        pairs = cut(told.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if pairs.isEmpty():
            return out


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component_id): numbered from 1 in the order of their least node; 0 for nodes without edges."""
    labels = min_labels(edges)
    roots = labels.select("label").distinct()
    numbered = roots.join(ranked(roots, "label"), "label")
    own = labels.join(numbered, "label").select(F.col("node").alias("id"), F.col("rank").alias("component_id"))
    return nodes.select("id").distinct().join(own, "id", "left").select("id", F.coalesce("component_id", F.lit(0)).cast("long").alias("component_id"))


def ranked(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): 1-based places over all rows: a range partitioning, places within, and the sizes before."""
    parts = df.select(column).distinct().repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)
    inside = Window.partitionBy("_part").orderBy(column)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.withColumn("_turn", F.row_number().over(inside)).join(F.broadcast(before), "_part").select(column, (F.col("_turn") + F.col("_before")).alias("rank"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least node of each strongly connected component.

    Rounds of colouring: every node takes the least node that reaches it; the nodes of that colour that reach their
    colour's node backwards are its component and leave the graph."""
    left = cut(nodes.select("id").distinct())
    pairs = cut(neighbours(edges).where("src <> dst"))
    done = None
    while not left.isEmpty():
        colours = cut(left.withColumn("colour", F.col("id")))
        while True:
            near = pairs.join(colours.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("near"))
            new = cut(colours.join(near, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", F.coalesce("near", "colour")).alias("colour")))
            stable = new.where("colour <> old").isEmpty()
            colours = new.drop("old")
            if stable:
                break
        member = cut(colours.where("id = colour"))
        inside = cut(pairs.join(colours.withColumnRenamed("id", "src"), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("c")), "dst").where("colour = c").select("src", "dst"))
        fringe = member
        while True:
            back = inside.join(fringe.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            fringe = cut(back.join(member, ["id", "colour"], "left_anti"))
            if fringe.isEmpty():
                break
            member = cut(member.unionByName(fringe.select("id", "colour")))
        found = member.select("id", F.col("colour").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        keep = left.select(F.col("id").alias("src"))
        pairs = cut(pairs.join(keep, "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return done if done is not None else nodes.select("id", F.col("id").alias("component"))


def page_rank(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    ids = cut(nodes.select("id").distinct())
    n = ids.count()
    # a src that is no node has no rank to share, so only the other end is asked for
    links = keyed(cut(neighbours(edges).join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")), "src")
    out = cut(links.groupBy("src").agg(F.count("*").alias("many")))
    ranks = cut(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.lit(1.0 / max(1, n)).alias("rank"), "many", F.lit(0.0).alias("move")))
    for _ in range(iterations):
        lost = ranks.where("many is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        base = (1 - DAMPING) / n + DAMPING * lost / n
        share = ranks.where("many is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("many")).alias("share"))
        into = links.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("into"))
        new = F.lit(base) + F.lit(DAMPING) * F.coalesce("into", F.lit(0.0))
        ranks = cut(ranks.join(into, "id", "left").select("id", new.alias("rank"), "many", F.abs(new - F.col("rank")).alias("move")))
        if ranks.agg(F.sum("move")).first()[0] <= tolerance:
            break
    return ranks.select("id", "rank")


def hits(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    pairs = cut(neighbours(edges))
    scores = cut(nodes.select("id").distinct().select("id", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")))

    def summed(have: str, by: str, to: str, name: str) -> DataFrame:
        return pairs.join(scores.select(F.col("id").alias(by), have), by).groupBy(F.col(to).alias("id")).agg(F.sum(have).alias(name))

    for _ in range(iterations):
        old = scores
        found = cut(scores.select("id", F.col("hub").alias("old_hub"), F.col("authority").alias("old_authority")).join(summed("hub", "src", "dst", "a"), "id", "left").na.fill(0.0))
        length = found.agg(F.sqrt(F.sum(F.col("a") * F.col("a")))).first()[0] or 1.0
        scores = cut(found.select("id", "old_hub", "old_authority", (F.col("a") / F.lit(length)).alias("authority")))
        hubs = cut(scores.join(summed("authority", "dst", "src", "h"), "id", "left").na.fill(0.0))
        length = hubs.agg(F.sqrt(F.sum(F.col("h") * F.col("h")))).first()[0] or 1.0
        scores = cut(hubs.select("id", (F.col("h") / F.lit(length)).alias("hub"), "authority", "old_hub", "old_authority"))
        moved = scores.agg(F.sum(F.abs(F.col("hub") - F.col("old_hub")) + F.abs(F.col("authority") - F.col("old_authority")))).first()[0]
        if old is not None and (moved or 0.0) <= tolerance:
            break
    return scores.select("id", "hub", "authority")


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles): ordered pairs of out-neighbours with an edge, halved.

    Each triangle of the undirected graph is met once, at its corner of the least degree, so a hub's neighbours are never
    paired there; the directions of its three sides then say what each corner counts. A side from u to x brings x's list
    of later neighbours to u, as bytes, and what that has in common with u's own list are the triangles: the paths of two
    sides, of which few are closed, are never rows."""
    side = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    sides = edges.where("src <> dst").groupBy(side.alias("e")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("ab"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("ba")).select("e.a", "e.b", "ab", "ba")
    sides = cut(sides)
    many = cut(sides.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d")).select(F.struct("d", "n").alias("place")))
    # numbers in the order of degree and id; u is the lesser end, go: u to v, back: v to u
    numbers = cut(ranked(many, "place").select(F.col("place.n").alias("n"), F.col("rank").cast("long").alias("rank")))
    told = sides.join(numbers.select(F.col("n").alias("a"), F.col("rank").alias("i")), "a").join(numbers.select(F.col("n").alias("b"), F.col("rank").alias("j")), "b")
    first = F.col("i") < F.col("j")
    go, back = F.when(first, F.col("ab")).otherwise(F.col("ba")), F.when(first, F.col("ba")).otherwise(F.col("ab"))
    x = F.greatest("i", "j")
    led = cut(told.select(F.least("i", "j").alias("u"), x.alias("x"), (x * 4 + go * 2 + back).alias("w")))
    lists = cut(led.groupBy("u").agg(F.sort_array(F.collect_list("w")).alias("near")).mapInArrow(packed, "u long, near binary"))
    brought = led.join(lists.select(F.col("u").alias("x"), F.col("near").alias("far")), "x").select("u", "w", "far")
    counts = brought.join(lists, "u").select("u", "w", "far", "near").mapInArrow(closed, "rank long, t long")
    found = counts.groupBy("rank").agg(F.floor(F.sum("t") / 2).alias("t")).join(numbers, "rank").select(F.col("n").alias("id"), "t")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("t", F.lit(0)).cast("long").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out = neighbours(edges).where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    both = triangles(nodes, edges).join(out, "id", "left")
    return both.select("id", F.when(F.col("d") >= 2, F.col("triangles") / (F.col("d") * (F.col("d") - 1) / 2)).otherwise(0.0).alias("clustering"))


def communities(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(id, community) by synchronous label propagation: the most frequent label among in- and out-neighbours, the
    smallest among equals; labels start as places in node order."""
    places = cut(ranked(nodes, "id").select("id", (F.col("rank") - 1).cast("long").alias("place")))
    number = lambda end: places.select(F.col("id").alias(end), F.col("place").alias(f"_{end}"))
    # places instead of ids, with the repeats of edges, which are votes; an end that is no node neither votes nor takes
    pairs = cut(edges.select("src", "dst").join(number("src"), "src").select("_src", "dst").join(number("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    pairs = {end: keyed(pairs, end) for end in ("src", "dst")}
    labels = places.select(F.col("place").alias("id"), F.col("place").alias("label"))
    for _ in range(iterations):
        told = [pairs[by].join(labels.select(F.col("id").alias(by), "label"), by).select(F.col(to).alias("id"), "label") for by, to in (("dst", "src"), ("src", "dst"))]
        votes = told[0].unionByName(told[1]).groupBy("id", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
        new = cut(labels.join(best, "id", "left").select("id", F.col("label").alias("old"), F.coalesce("best", "label").alias("label")))
        stable = new.where("label <> old").isEmpty()
        labels = new.drop("old")
        if stable:
            break
    return places.join(labels.select(F.col("id").alias("place"), F.col("label").alias("community")), "place").select("id", "community")


def betweenness(nodes: DataFrame, edges: DataFrame, deepest: int = 64) -> DataFrame:
    """Directed, unnormalised, over all sources: path counts by level, then dependencies level by level backwards."""
    pairs = cut(neighbours(edges).where("src <> dst"))
    level = cut(nodes.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("sigma")))
    levels, seen = [level], level.select("s", "v")
    for _ in range(deepest):
        grown = level.join(pairs, level["v"] == pairs["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        level = cut(grown.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut(seen.union(level.select("s", "v")))
    below, total = None, None
    for depth in range(len(levels) - 1, 0, -1):
        own = levels[depth]
        delta = own.withColumn("delta", F.lit(0.0)) if below is None else own.join(below, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce("part", F.lit(0.0)).alias("delta"))
        delta = cut(delta)
        total = delta.select("v", "delta") if total is None else total.union(delta.select("v", "delta"))
        up = levels[depth - 1].select("s", F.col("v").alias("src"), F.col("sigma").alias("up"))
        below = pairs.join(delta.withColumnRenamed("v", "dst"), "dst").join(up, ["s", "src"]).groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("up") / F.col("sigma") * (1 + F.col("delta"))).alias("part"))
    ids = nodes.select("id").distinct()
    if total is None:
        return ids.withColumn("centrality", F.lit(0.0))
    summed = total.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("c"))
    return ids.join(summed, "id", "left").select("id", F.coalesce("c", F.lit(0.0)).alias("centrality"))


def minimum_forest(pairs: DataFrame) -> DataFrame:
    """The (src, dst) of ``pairs(src, dst, weight)`` in a minimum spanning forest, equal weights in the order of the ends.

    Boruvka rounds: every tree takes its least edge to another tree, and trees that are joined become one."""
    edges = cut(pairs.where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    trees = cut(neighbours(edges.withColumn("edge", F.lit(0)), "either").select(F.col("src").alias("node")).distinct().withColumn("tree", F.col("node")))
    taken = None
    while True:
        apart = edges.join(trees.select(F.col("node").alias("src"), F.col("tree").alias("a")), "src").join(trees.select(F.col("node").alias("dst"), F.col("tree").alias("b")), "dst").where("a <> b")
        edges = cut(apart.select("src", "dst", "weight", "a", "b"))  # edges inside a tree are never needed again
        if edges.isEmpty():
            return taken if taken is not None else edges.select("src", "dst")
        order = F.struct("weight", "src", "dst")
        ends = edges.select("a", "b", order.alias("o")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), order.alias("o")))
        best = cut(ends.groupBy("a").agg(F.min(F.struct("o", "b")).alias("m")).select("a", F.col("m.b").alias("b"), "m.o.src", "m.o.dst"))
        new = best.select("src", "dst").distinct()
        taken = cut(new if taken is None else taken.unionByName(new))
        labels = min_labels(best.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0).alias("edge")))
        trees = cut(trees.join(labels.select(F.col("node").alias("tree"), "label"), "tree").select("node", F.col("label").alias("tree")))
        edges = edges.select("src", "dst", "weight")


def levels_from(roots: DataFrame, forth: DataFrame, back: DataFrame) -> DataFrame:
    """(id, tree_parent, tree_depth): a breadth-first tree by levels, over pairs by their src and by their dst, which are
    steps in both directions. Of several parents the one that was reached first
    counts, and the nodes of a level are in the order of their parents and then of their ids."""
    level = cut(roots.select("id", F.lit(None).cast(dict(roots.dtypes)["id"]).alias("tree_parent"), F.lit(0).cast("long").alias("tree_depth"), F.lit(0).cast("long").alias("turn")))
    out, depth = level, 0
    while True:
        depth += 1
        ahead = level.select(F.col("id").alias("src"), "turn").join(forth, "src").select("dst", F.col("src").alias("id"), "turn")
        behind = level.select(F.col("id").alias("dst"), "turn").join(back, "dst").select(F.col("src").alias("dst"), F.col("dst").alias("id"), "turn")
        grown = ahead.unionByName(behind).groupBy("dst").agg(F.min(F.struct("turn", "id")).alias("p"))
        fresh = cut(grown.select(F.col("dst").alias("id"), "p").join(out.select("id"), "id", "left_anti"))
        if fresh.isEmpty():
            return out.drop("turn")
        placed = fresh.withColumn("place", F.struct("p.turn", "id"))
        turns = ranked(placed, "place")
        level = cut(placed.join(turns, "place").select("id", F.col("p.id").alias("tree_parent"), F.lit(depth).cast("long").alias("tree_depth"), F.col("rank").cast("long").alias("turn")))
        out = cut(out.unionByName(level))


def spanning_tree(nodes: DataFrame, edges: DataFrame, kind: str = "bfs", weight: str | None = None) -> DataFrame:
    """(id, tree_parent, tree_depth): one tree for each weak component, grown from the least node.

    bfs and min_weight are joins by levels and by Boruvka rounds; min_weight takes edges by (weight, source, target) and
    refuses negative weights. A depth-first order is sequential, so there each component is one task."""
    if kind not in ("bfs", "dfs", "min_weight"):
        raise QueryError("E_METHOD_CONFLICT", f"tree {kind}")
    sides = ends(edges)
    forth, node_type = keyed(sides, "src"), dict(edges.dtypes)["src"]
    labels = min_labels(forth)
    alone = nodes.select("id").distinct().join(labels.select(F.col("node").alias("id")), "id", "left_anti")
    alone = alone.select("id", F.lit(None).cast(node_type).alias("tree_parent"), F.lit(0).cast("long").alias("tree_depth"))
    if kind != "dfs":
        if kind == "min_weight":
            from .relational import fails

            weighed = edges.select("src", "dst", (F.col(weight) if weight else F.lit(0.0)).cast("double").alias("weight"))
            sides = minimum_forest(weighed.where(fails(F.col("weight").isNull() | (F.col("weight") < 0), "E_METHOD_CONFLICT")))
            forth = sides
        return levels_from(labels.select(F.col("label").alias("id")).distinct(), forth, keyed(sides, "dst")).unionByName(alone)
    own = edges.select("src", "dst").join(labels.select(F.col("node").alias("src"), "label"), "src")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        near: dict = {n: set() for n in [*rows["src"], *rows["dst"]]}
        for a, b in zip(rows["src"], rows["dst"], strict=True):
            near[a].add(b)
            near[b].add(a)
        start = min(near)
        out, seen = [(start, None, 0)], {start}
        line = [(start, 0, iter(sorted(near[start])))]
        while line:
            node, depth, rest = line[-1]
            following = next((x for x in rest if x not in seen), None)
            if following is None:
                line.pop()
                continue
            seen.add(following)
            out.append((following, node, depth + 1))
            line.append((following, depth + 1, iter(sorted(near[following]))))
        return pd.DataFrame(out, columns=["id", "tree_parent", "tree_depth"]).astype({"id": object, "tree_parent": object})

    return own.groupBy("label").applyInPandas(grow, f"id {node_type}, tree_parent {node_type}, tree_depth long").unionByName(alone)
