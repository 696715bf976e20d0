"""Process graphs and hierarchies as tables of nodes and edges, many graphs at once, each under its key g."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procloom import workers
from procloom.tables import scratch, spill

#: Width and height of shapes by node type, and the steps of a layout.
SIZES = {"GATEWAY": (50, 50), "EVENT": (36, 36), "TASK": (120, 80)}
LEFT, RANK_STEP, LANE_LEAST, LANE_PAD, STACK_GAP = 260, 200, 150, 60, 10
#: Levels of a hierarchy, from the top.
LEVELS = ["L1", "L2", "L3", "L4", "L5", "L6", "SOP"]


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (g, node) that no edge (g, src, dst) touches."""
    return nodes.join(endpoints(edges), ["g", "node"], "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, node, n_in, n_out, role: SPLIT with several edges out, JOIN with several in, BOTH, or PLAIN."""
    ends = edges.select("g", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("g", "e.*")
    n = ends.groupBy("g", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    told = nodes.select("g", "node").join(n, ["g", "node"], "left").na.fill(0, ["n_in", "n_out"])
    split, join = F.col("n_out") > 1, F.col("n_in") > 1
    return told.withColumn("role", F.when(split & join, "BOTH").when(split, "SPLIT").when(join, "JOIN").otherwise("PLAIN"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, edge, side, ref of the ends of edges (g, edge, src, dst) that are no node of their graph."""
    ends = edges.select("g", "edge", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("src").alias("ref")), F.struct(F.lit("target").alias("side"), F.col("dst").alias("ref")))).alias("e")).select("g", "edge", "e.*")
    return ends.join(nodes.select("g", F.col("node").alias("ref")), ["g", "ref"], "left_anti").select("g", "edge", "side", "ref")


def back_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, src, dst of edges that lead back to a node on the path of a depth-first search in the order of pos (nodes: g, node, pos; edges: g, src, dst, pos).

    The set depends on the order of the search, so each graph is walked by one task; a graph is one process's diagram."""
    workers.ship(nodes.sparkSession)
    rows = nodes.select("g", "node", F.lit(None).cast("string").alias("dst"), "pos").unionByName(edges.select("g", F.col("src").alias("node"), "dst", "pos"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        own = pdf[pdf["dst"].isna()]["node"].tolist()
        out: dict[str, list[str]] = {n: [] for n in own}
        for s, d in pdf[pdf["dst"].notna()][["node", "dst"]].itertuples(index=False):
            if s in out and d in out:
                out[s].append(d)
        state, found = dict.fromkeys(own, 0), []
        for start in own:
            stack = [(start, iter(out[start]))] if not state[start] else []
            state[start] = state[start] or 1
            while stack:
                node, rest = stack[-1]
                nxt = next(rest, None)
                if nxt is None:
                    state[node] = 2
                    stack.pop()
                elif state[nxt] == 1:
                    found.append((pdf["g"].iloc[0], node, nxt))
                elif not state[nxt]:
                    state[nxt] = 1
                    stack.append((nxt, iter(out[nxt])))
        return pd.DataFrame(sorted(set(found)), columns=["g", "src", "dst"])

    return rows.groupBy("g").applyInPandas(walk, "g string, src string, dst string")


#: Edges of a graph up to which it is solved inside a task, with others of the kind; larger ones spread over the cluster.
SMALL = 100_000


def _numbered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The nodes (g, node) of a table of edges (dst is null for a node alone), and the ends of its edges by number."""
    edges = pdf[pdf["dst"].notna()]
    ends = pd.concat([pdf[["g", "src"]].set_axis(["g", "node"], axis=1), edges[["g", "dst"]].set_axis(["g", "node"], axis=1)], ignore_index=True)
    code = ends.groupby(["g", "node"], dropna=False, sort=False).ngroup().to_numpy()
    nodes = ends.drop_duplicates(ignore_index=True)
    return nodes, code[: len(pdf)][pdf["dst"].notna().to_numpy()], code[len(pdf) :]


def _peel(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, done): nodes whose predecessors are done are, level by level; rank is the longest path to a done node."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    rank, done, waits = np.zeros(n, np.int64), np.zeros(n, bool), np.bincount(dst, minlength=n)
    front, level = np.flatnonzero(waits == 0), 0
    while len(front):
        rank[front], done[front], level = level, True, level + 1
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        hit, times = np.unique(to[at], return_counts=True)
        waits[hit] -= times
        front = hit[waits[hit] == 0]
    return rank, done


def _on_cycle(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Which nodes lie on a cycle: what peeling from both ends leaves, in components of several nodes or with a loop of their own (Tarjan)."""
    left = ~(_peel(src, dst, n)[1] | _peel(dst, src, n)[1])
    keep = left[src] & left[dst]
    src, dst = src[keep], dst[keep]
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    found = np.zeros(n, bool)
    found[src[src == dst]] = True
    index, low, on = [-1] * n, [0] * n, [False] * n
    path: list[int] = []
    count = 0
    for start in np.flatnonzero(left).tolist():
        if index[start] >= 0:
            continue
        calls = [(start, first[start])]
        while calls:
            v, at = calls.pop()
            if at == first[v] and index[v] < 0:
                index[v] = low[v] = count
                count += 1
                path.append(v)
                on[v] = True
            elif at > first[v]:
                low[v] = min(low[v], low[to[at - 1]]) if on[to[at - 1]] else low[v]
            while at < first[v + 1] and index[to[at]] >= 0:
                low[v] = min(low[v], index[to[at]]) if on[to[at]] else low[v]
                at += 1
            if at < first[v + 1]:
                calls += [(v, at + 1), (to[at], first[to[at]])]
            elif low[v] == index[v]:
                part = []
                while not part or part[-1] != v:
                    part.append(path.pop())
                    on[part[-1]] = False
                found[part] |= len(part) > 1
    return found


def _large(edges: DataFrame, small: int) -> DataFrame:
    """g of the graphs with more than small edges; as few as the edges divided by small."""
    return spill(edges.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > small).select("g"), "large", outlast=1)


def _buckets(rows: DataFrame, small: int) -> DataFrame:
    """rows with a bucket of whole graphs, about small rows each."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(1 + rows.count() // small)))


def ranks(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """g, node, rank: the longest path that leads to a node (nodes: g, node) of an acyclic graph (edges: g, src, dst; pass them without back_edges).

    Edges with an end that is no node are left out; nodes on a cycle or behind one have no row. Graphs of up to small edges are ranked
    inside tasks, many at a time; a larger one level by level over the cluster, one round a level."""
    spark = nodes.sparkSession
    workers.ship(spark)
    with scratch():
        own = spill(nodes.select("g", "node").distinct(), "nodes", outlast=1)
        known = lambda c: own.select("g", F.col("node").alias(c))
        arcs = spill(edges.select("g", "src", "dst").distinct().join(known("src"), ["g", "src"], "left_semi").join(known("dst"), ["g", "dst"], "left_semi").select("g", "src", "dst"), "edges", outlast=1)
        large = _large(arcs, small)
        none = large.isEmpty()
        rows = own.select("g", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(arcs)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            told, src, dst = _numbered(pdf)
            rank, done = _peel(src, dst, len(told))
            return told.assign(rank=rank)[done]

        found = _buckets(rows if none else rows.join(large, "g", "left_anti"), small).groupBy("bucket").applyInPandas(solve, "g string, node string, rank int")
        if none:
            return found
        waits = arcs.join(large, "g", "left_semi")
        left, level = spill(own.join(large, "g", "left_semi"), "left"), 0
        while True:
            front = spill(left.join(waits.select("g", F.col("dst").alias("node")), ["g", "node"], "left_anti"), "front", outlast=1)
            if front.isEmpty():
                return found
            found = found.unionByName(front.withColumn("rank", F.lit(level)))
            left = spill(left.join(front, ["g", "node"], "left_anti"), "left")
            waits, level = spill(waits.join(front.withColumnRenamed("node", "src"), ["g", "src"], "left_anti"), "waits"), level + 1


def on_cycle(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """g, node of the nodes that a path of edges (g, src, dst) leads back to.

    Graphs of up to small edges are solved inside tasks, many at a time. A larger one is trimmed over the cluster from both ends; then the
    greatest name that reaches a node colours it, and what of a colour reaches its namesake back is one strong component (Orzan)."""
    workers.ship(edges.sparkSession)
    with scratch():
        arcs = spill(edges.select("g", "src", "dst").where("src is not null and dst is not null").distinct(), "edges", outlast=1)
        large = _large(arcs, small)
        none = large.isEmpty()

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            told, src, dst = _numbered(pdf)
            return told[_on_cycle(src, dst, len(told))]

        found = _buckets(arcs if none else arcs.join(large, "g", "left_anti"), small).groupBy("bucket").applyInPandas(solve, "g string, node string")
        if none:
            return found
        left = arcs.join(large, "g", "left_semi")
        loops = spill(left.where("src = dst").select("g", F.col("src").alias("node")), "loops", outlast=1)
        found, left = found.unionByName(loops), spill(left.where("src <> dst"), "left")
        while not left.isEmpty():
            left = _trimmed(left)
            colour = _spread(left, left.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
            same = left.join(colour.select("g", F.col("node").alias("src"), "c"), ["g", "src"]).join(colour.select("g", F.col("node").alias("dst"), F.col("c").alias("d")), ["g", "dst"])
            same = spill(same.where("c = d").select("g", F.col("src").alias("dst"), F.col("dst").alias("src"), "c"), "same")  # turned round
            back = _spread(same.select("g", "src", "dst"), colour.withColumn("c", F.when(F.col("node") == F.col("c"), F.col("c"))))
            part = spill(back.where("c is not null").select("g", "node"), "part", outlast=1)
            many = same.join(part.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(part.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi")
            found = found.unionByName(spill(many.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct(), "many", outlast=1))
            gone = lambda df, c: df.join(part.withColumnRenamed("node", c), ["g", c], "left_anti")
            left = spill(gone(gone(left, "src"), "dst"), "left")
        return found.distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that lead from a node with none in, or to one with none out, until none is left of these."""
    while True:
        kept = edges.join(edges.select("g", F.col("dst").alias("src")).distinct(), ["g", "src"], "left_semi").join(edges.select("g", F.col("src").alias("dst")).distinct(), ["g", "dst"], "left_semi")
        kept, before = spill(kept.select("g", "src", "dst"), "trimmed"), edges
        if kept.count() == before.count():
            return kept
        edges = kept


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(g, node, c): the greatest label (g, node, c) that reaches each node along edges."""
    label = spill(label, "labels")
    while True:
        come = edges.join(label.where("c is not null").select("g", F.col("node").alias("src"), "c"), ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.max("c").alias("in"))
        new = label.join(come, ["g", "node"], "left").select("g", "node", F.greatest("c", "in").alias("c"), (F.col("in") > F.coalesce("c", F.lit(""))).alias("changed"))
        new = spill(new, "labels")
        label = new.select("g", "node", "c")
        if new.where("changed").isEmpty():
            return label


# --- Hierarchies: node, type, parent_id


def orphans(tree: DataFrame, top: str = "L3") -> DataFrame:
    """Nodes below the top type without a parent that exists."""
    known = tree.select(F.col("node").alias("parent_id"))
    return tree.where(F.col("type") != top).join(known, "parent_id", "left_anti").select("node", "type", "parent_id")


def fanout(tree: DataFrame, warn: int = 10, block: int = 20) -> DataFrame:
    """parent_id, children, severity of nodes with children."""
    n = tree.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))
    return n.withColumn("severity", F.when(F.col("children") > block, "BLOCKER").when(F.col("children") > warn, "MAJOR").otherwise("OK"))


def level_jumps(tree: DataFrame, levels: list[str]) -> DataFrame:
    """node, type, parent_type of nodes that don't stand one level below their parents."""
    at = lambda c: F.array_position(F.array(*map(F.lit, levels)), c)
    parents = tree.select(F.col("node").alias("parent_id"), F.col("type").alias("parent_type"))
    return tree.join(parents, "parent_id").where(at(F.col("type")) != at(F.col("parent_type")) + 1).select("node", "type", "parent_type")


def leaves(tree: DataFrame) -> DataFrame:
    parents = tree.where("parent_id is not null").select(F.col("parent_id").alias("node"))
    return tree.join(parents, "node", "left_anti").select("node", "type")


# --- Layout


def size_class(node_type: Column) -> Column:
    return F.when(node_type.contains("GATEWAY"), "GATEWAY").when(node_type.rlike("EVENT|CATCH|THROW"), "EVENT").otherwise("TASK")


def layout(nodes: DataFrame, lanes: DataFrame) -> DataFrame:
    """g, node, x, y, width, height of nodes (g, node, node_type, lane, rank, pos) in lanes (g, lane, pos). A lane is as high as its fullest rank needs."""
    kind = size_class(F.col("node_type"))
    pick = lambda i: F.when(kind == "GATEWAY", SIZES["GATEWAY"][i]).when(kind == "EVENT", SIZES["EVENT"][i]).otherwise(SIZES["TASK"][i])
    sized = nodes.withColumn("width", pick(0)).withColumn("height", pick(1))
    stack = Window.partitionBy("g", "lane", "rank")
    before = stack.orderBy("pos", "node").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("total", F.sum("height").over(stack) + (F.count("*").over(stack) - 1) * STACK_GAP)
    sized = sized.withColumn("above", F.coalesce(F.sum(F.col("height") + STACK_GAP).over(before), F.lit(0)))
    heights = lanes.join(sized.groupBy("g", "lane").agg(F.max("total").alias("most")), ["g", "lane"], "left")
    heights = heights.withColumn("lane_height", F.greatest(F.coalesce("most", F.lit(0)) + LANE_PAD, F.lit(LANE_LEAST)))
    top = Window.partitionBy("g").orderBy("pos", "lane").rowsBetween(Window.unboundedPreceding, -1)
    heights = heights.withColumn("lane_y", F.coalesce(F.sum("lane_height").over(top), F.lit(0))).select("g", "lane", "lane_height", "lane_y")
    placed = sized.join(heights, ["g", "lane"])
    x = LEFT + F.col("rank") * RANK_STEP + (SIZES["TASK"][0] - F.col("width")) / 2
    y = F.col("lane_y") + (F.col("lane_height") - F.col("total")) / 2 + F.col("above")
    return placed.select("g", "node", x.alias("x"), y.alias("y"), "width", "height")


def routes(places: DataFrame, edges: DataFrame) -> DataFrame:
    """g, edge, n_points, points of edges (g, edge, src, dst, back): four points, or six on a detour below all shapes for edges that lead back."""
    at = lambda side: places.select("g", F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("x", "y", "width", "height")])
    low = places.groupBy("g").agg((F.max(F.col("y") + F.col("height")) + 40).alias("low"))
    told = edges.join(at("src"), ["g", "src"]).join(at("dst"), ["g", "dst"]).join(low, "g")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    sx, sy = F.col("src_x") + F.col("src_width"), F.col("src_y") + F.col("src_height") / 2
    dx, dy = F.col("dst_x"), F.col("dst_y") + F.col("dst_height") / 2
    mid = (sx + dx) / 2
    forward = F.array(point(sx, sy), point(mid, sy), point(mid, dy), point(dx, dy))
    around = F.array(point(sx, sy), point(sx + 20, sy), point(sx + 20, F.col("low")), point(dx - 20, F.col("low")), point(dx - 20, dy), point(dx, dy))
    points = F.when(F.col("back"), around).otherwise(forward)
    return told.select("g", "edge", F.size(points).alias("n_points"), points.alias("points"))


def crossings(flows: DataFrame) -> DataFrame:
    """g, flow, n_crossings, others of flows (g, flow, src, dst, points) that cross another in its process.

    Segments of one process meet by the cells of a grid that they pass, so only near ones are compared; an end or an overlap in line is no crossing, nor are flows that share an end. The flow with more points is named, of equals the lesser id."""
    seg = flows.where(F.size("points") >= 2).select("g", "flow", "src", "dst", F.size("points").alias("n"), F.posexplode(F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points")).alias("b"))).alias("k", "s"))
    seg = seg.select("g", "flow", "src", "dst", "n", "k", *[F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "ab" for c in "xy"])
    cell = lambda c: F.floor(c / 200).cast("int")
    spanned = seg.withColumn("i", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx"))))).withColumn("j", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))))
    p, q = spanned.alias("p"), spanned.alias("q")
    pairs = p.join(q, ["g", "i", "j"]).where("p.flow < q.flow and p.src <> q.src and p.src <> q.dst and p.dst <> q.src and p.dst <> q.dst")
    v = lambda name: F.col(name)
    rx, ry, sx, sy = v("p.bx") - v("p.ax"), v("p.by") - v("p.ay"), v("q.bx") - v("q.ax"), v("q.by") - v("q.ay")
    det = rx * sy - ry * sx
    ox, oy = v("q.ax") - v("p.ax"), v("q.ay") - v("p.ay")
    t, u = (ox * sy - oy * sx) / F.nullif(det, F.lit(0.0)), (ox * ry - oy * rx) / F.nullif(det, F.lit(0.0))
    inner = lambda z: (z > 1e-9) & (z < 1 - 1e-9)
    hit = pairs.where(inner(t) & inner(u)).select("g", F.when(v("q.n") > v("p.n"), v("q.flow")).otherwise(v("p.flow")).alias("flow"), F.when(v("q.n") > v("p.n"), v("p.flow")).otherwise(v("q.flow")).alias("other")).distinct()
    return hit.groupBy("g", "flow").agg(F.count("*").alias("n_crossings"), F.min("other").alias("first_other"))


def ancestors(tree: DataFrame) -> DataFrame:
    """node, ancestor, distance (from 1) of all ancestors in a hierarchy of any depth, by doubling: each round joins paths end to end, so d levels take log2(d) rounds. A circle's
    nodes are told once for each of them (a node isn't its own ancestor); the pairs are as many as nodes times their depth."""
    paths = spill(tree.where("parent_id is not null").select("node", F.col("parent_id").alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct(), "ancestors")
    n, length = paths.count(), 1
    while n:
        far = paths.where(F.col("distance") == length).select(F.col("ancestor").alias("mid"), F.col("node"))
        if far.isEmpty():  # nothing is so far apart
            break
        ahead = paths.select(F.col("node").alias("mid"), F.col("ancestor"), F.col("distance").alias("more"))
        longer = far.join(ahead, "mid").select("node", "ancestor", (F.col("more") + length).alias("distance")).where("node <> ancestor")
        both = paths.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        paths = spill(both, "ancestors")
        length, before, n = 2 * length, n, paths.count()
        if n == before:
            break
    return paths


def continuity(tree: DataFrame, uses: DataFrame) -> DataFrame:
    """node, type, output, reached (how many levels up the output is still told; 0: its parent doesn't) of the outputs of nodes (tree: node, type, parent_id) that lead nowhere: they are outputs
    of no parent and inputs of no sibling. uses: node, kind (INPUT or OUTPUT), name. For an output that goes on, every ancestor is looked at, from the leaf to the root: reached
    tells where it is lost, and one that the root has isn't listed."""
    named = spill(uses.where("name is not null").distinct(), "uses")
    out = named.where("kind = 'OUTPUT'").select("node", F.col("name").alias("output"))
    chain = spill(ancestors(tree), "chain")
    held = out.join(chain, "node").join(out.select(F.col("node").alias("ancestor"), F.col("output")), ["ancestor", "output"], "left_semi").select("node", "output", "distance")
    order = Window.partitionBy("node", "output").orderBy("distance")
    unbroken = held.withColumn("n", F.row_number().over(order)).where("n = distance").groupBy("node", "output").agg(F.max("distance").alias("reached"))  # as far as no level is missing
    depth = chain.groupBy("node").agg(F.max("distance").alias("depth"))
    parents = spill(tree.where("parent_id is not null").select("node", "type", "parent_id").distinct(), "parents")
    siblings = named.where("kind = 'INPUT'").join(parents.select("node", "parent_id"), "node").select(F.col("node").alias("other"), "parent_id", F.col("name").alias("output"))
    # another sibling takes it in if the least or the greatest of those that do is another; so a parent has a row for each name, however many children
    takers = siblings.groupBy("parent_id", "output").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    used = out.join(parents.select("node", "parent_id"), "node").join(takers, ["parent_id", "output"]).where("least <> node or most <> node").select("node", "output").distinct()
    told = out.join(parents.select("node", "type"), "node").join(depth, "node").join(unbroken, ["node", "output"], "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    return told.where("reached < depth").join(used, ["node", "output"], "left_anti").select("node", "type", "output", "reached")
