"""Parent-child links to full hierarchies: heavy-path decomposition.

The graph is cut at *joints*, the nodes with several parents.  What is left is a forest
of *local trees* under roots and joints, and in a forest everything takes a number of
rounds that is logarithmic in the depth:

* subtree sizes, by pointer doubling (a node's sum over distance < 2^k plus the sums of
  the nodes at distance exactly 2^k);
* heavy paths: every node's largest child continues its chain; chain heads and positions
  by pointer doubling along the heavy links;
* the tree of chains, whose depth is at most log2(n).

A node's place is then its chain's base depth plus its position, its path the
concatenation of chain prefixes, and its descendants are chain intervals.  Loops are
separated before anything is labelled: loops of links only show up while doubling, loops
through joints are the strongly connected components of the much smaller graph of joints;
the links on them are prefixes of chains.  Joints inherit the (root, depth) pairs of
their parents by doubling over the graph of joints.

Every round is written to the shared folder and joined on one key; rows of a parent with
very many children are spread by salting.  Nothing is gathered per tree or component.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.skew import salted_join
from locusframe.session import Rounds, cut


#: Layers that one job peels off the graph of joints.
PEEL = 3


@dataclass
class Forest:
    """What :func:`decompose` yields, all as written tables.

    nodes:   node, indeg, parent (null at roots and joints), n_children
    labels:  node, chain, pos, top, dist - one row per node; ``top`` is the root, joint
             or loop node that ends its walk up, ``dist`` the number of links to it
    chains:  chain, up_chain, up_pos, top, base, length - one row per chain with children
    loops:   node, loop_id - the nodes on loops of two or more nodes
    places:  node, root, depth - for joints off loops, one row per different pair
    selfs:   node - the nodes that have a row to themselves
    edges:   p, c - the distinct links between different nodes
    """

    nodes: DataFrame
    labels: DataFrame
    chains: DataFrame
    loops: DataFrame
    places: DataFrame
    selfs: DataFrame
    edges: DataFrame


def _up(state: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """Left join of ``state.on`` to ``target.node``; hot targets are salted."""
    if "n_children" in target.columns:
        t = target.withColumnRenamed("node", on)
        return salted_join(state, t, on, "n_children", "left", ["node"]).drop("n_children")
    return state.join(target.withColumnRenamed("node", on), on, "left")


def _link_loops(inner: DataFrame) -> DataFrame:
    """(head, last): the smallest node of every loop made of single-parent nodes only,
    and the parent that closes it.  ``inner``: node, parent of the single-parent nodes
    that have children."""
    spark = inner.sparkSession
    rounds = Rounds(spark, "loop-walk")
    walk = rounds.put(inner.select("node", F.col("parent").alias("jump"), F.col("parent").alias("lo")))
    while True:
        # a node is the head of a loop once its strict ancestors hold itself and nothing smaller;
        # all loops are found once every walk left has jumped onto a loop with a known head
        far = walk.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("lo").alias("via"))
        walk = rounds.put(walk.select("node", "jump", "lo").join(far, "jump").select("node", F.col("jump2").alias("jump"), F.least("lo", "via").alias("lo"), "via"))
        heads = walk.filter("node = lo").select("node")
        if walk.join(heads.withColumnRenamed("node", "via"), "via", "left_anti").isEmpty():
            return inner.join(heads, "node").select(F.col("node").alias("head"), F.col("parent").alias("last"))


def _subtree_sizes(inner: DataFrame) -> DataFrame:
    """node -> size.  ``inner``: node, parent, weight of the nodes that have children;
    the weight counts the node and its childless children."""
    rounds = Rounds(inner.sparkSession, "sizes")
    state = rounds.put(inner.select("node", F.col("parent").alias("jump"), F.col("weight").alias("size")))
    while not state.filter("jump is not null").isEmpty():
        live = state.filter("jump is not null")
        sums = live.groupBy("jump").agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("n_children"))
        target = state.select("node", F.col("jump").alias("jump2"))
        nxt = live.join(target.withColumnRenamed("node", "jump"), "jump", "left").select("node", "jump2")
        state = rounds.put(
            state.select("node", "size").join(nxt, "node", "left").join(sums.select(F.col("jump").alias("node"), "more"), "node", "left")
            .select("node", F.col("jump2").alias("jump"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )
    return state.select("node", "size")


def _rank_lists(state: DataFrame, label: str) -> DataFrame:
    """Pointer doubling over lists: from (node, jump, dist) with the distance to the next
    node, to (node, far, dist): the end of the walk and the distance to it."""
    rounds = Rounds(state.sparkSession, label)
    state = rounds.put(state.select("node", "jump", F.coalesce("jump", "node").alias("far"), "dist"))
    while not state.filter("jump is not null").isEmpty():
        done, live = state.filter("jump is null"), state.filter("jump is not null")
        target = state.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("far").alias("f2"), F.col("dist").alias("d2"))
        moved = live.join(target, "jump").select("node", F.col("j2").alias("jump"), F.col("f2").alias("far"), (F.col("dist") + F.col("d2")).alias("dist"))
        state = rounds.put(done.unionByName(moved))
    return state.select("node", "far", "dist")


def _least_before(links: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """(node, least): the smallest node that leads to each node over (a, b), itself
    included.  A node's label is replaced by its label's own label every round, so that what
    has gone k links goes 2k: a logarithmic number of rounds along a chain."""
    rounds = Rounds(links.sparkSession, label)
    state = rounds.put(nodes.select("node", F.col("node").alias("least")))
    while True:
        sent = links.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("least").alias("sent"))
        far = state.select(F.col("node").alias("least"), F.col("least").alias("far"))
        heard = state.join(sent, "node", "left").join(far, "least", "left")
        nxt = rounds.put(heard.select("node", F.least("least", "sent", "far").alias("least"), (F.least("sent", "far") < F.col("least")).alias("moved")))
        state = nxt.select("node", "least")
        if nxt.filter("moved").isEmpty():
            return cut(state, label)


def _components(edges: DataFrame) -> DataFrame:
    """(node, comp): the strongly connected components of (a, b) that hold a link, a link
    from a node to itself included.  Nodes without a way in or a way out are peeled off,
    PEEL layers a job; the smallest node that leads to a node is its colour, and a node that
    leads back to its colour, within the colour, is of its component."""
    spark = edges.sparkSession
    rounds = Rounds(spark, "joints")
    live = rounds.put(edges.select("a", "b").distinct())
    found: DataFrame | None = None
    n = live.count()
    while n:
        while True:  # peel
            rest = live
            for _ in range(PEEL):
                rest = rest.join(rest.select(F.col("b").alias("a")), "a", "left_semi").join(rest.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
            live = rounds.put(rest)
            m = live.count()
            if m == n:
                break
            n = m
        if not n:
            break
        colour = _least_before(live, live.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "colours")
        ca = colour.select(F.col("node").alias("a"), F.col("least").alias("colour"))
        cb = colour.select(F.col("node").alias("b"), F.col("least").alias("cb"))
        same = cut(live.join(ca, "a").join(cb, "b").filter("colour = cb").select("a", "b"), "same-colour")
        back = _least_before(same.select(F.col("b").alias("a"), F.col("a").alias("b")), colour, "back")
        reach = cut(back.join(colour.withColumnRenamed("least", "colour"), "node").filter("least = colour").select("node", "colour"), "back")
        # a colour's own node is a component only if a link leads back into it
        closed = same.join(reach.select(F.col("node").alias("a"), "colour"), "a").filter("b = colour").select("colour").distinct()
        done = cut(reach.join(closed, "colour", "left_semi").select("node", F.col("colour").alias("comp")), "components")
        found = done if found is None else found.unionByName(done)
        gone = reach.select("node")
        live = rounds.put(live.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
        n = live.count()
    if found is None:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, comp {kind.simpleString()}")
    return found


def _climb(marks: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain, upto, loop): the chain prefixes on the way from each mark (chain, pos, loop)
    to the top of its local tree.  At most log2(n) rounds."""
    rounds = Rounds(marks.sparkSession, "climb")
    step = rounds.put(marks.groupBy("chain", "loop").agg(F.max("pos").alias("upto")))
    parts = [step]
    all_ups = chains.select("chain", "up_chain", "up_pos")
    while True:
        nxt = step.join(all_ups, "chain").filter("up_chain is not null").groupBy(F.col("up_chain").alias("chain"), "loop").agg(F.max("up_pos").alias("upto"))
        step = cut(nxt, "climb")
        if step.isEmpty():
            break
        parts.append(step)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("chain", "loop").agg(F.max("upto").alias("upto"))


def decompose(links: DataFrame, parent: str, child: str) -> Forest:
    """Heavy-path decomposition of (parent, child) rows.

    Ids are taken as they are; rows with a null end are left out, repeated rows count
    once, a row from a node to itself only shows in ``selfs``.
    """
    spark = links.sparkSession
    rows = links.select(F.col(parent).alias("p"), F.col(child).alias("c")).filter("p is not null and c is not null").distinct()
    rows = cut(rows, "links")
    selfs = rows.filter("p = c").select(F.col("p").alias("node"))
    edges = rows.filter("p <> c")
    ends = edges.select(F.explode(F.array(F.struct(F.col("p").alias("node"), F.lit(None).cast(edges.schema["p"].dataType).alias("par"), F.lit(1).alias("kid")), F.struct(F.col("c").alias("node"), F.col("p").alias("par"), F.lit(0).alias("kid")))).alias("x")).select("x.*")
    nodes = ends.groupBy("node").agg(F.count("par").alias("indeg"), F.min("par").alias("par"), F.sum("kid").alias("n_children"))
    nodes = cut(nodes.select("node", "indeg", F.when(F.col("indeg") == 1, F.col("par")).alias("parent"), "n_children"), "nodes")

    # loops of single-parent nodes are opened at their smallest node
    single = nodes.filter("parent is not null and n_children > 0").select("node", "parent")
    opened = cut(_link_loops(single), "link-loops")
    cutnodes = opened.select(F.col("head").alias("node"), F.lit(True).alias("_cut"))
    nodes = cut(nodes.join(cutnodes, "node", "left").select("node", "indeg", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"), "n_children"), "nodes")

    # sizes of local subtrees: childless nodes are counted by their parents
    leaves = nodes.filter("n_children = 0 and parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_leaves"), F.min("node").alias("first_leaf"))
    inner = nodes.filter("n_children > 0").join(leaves, "node", "left")
    inner = cut(inner.select("node", "parent", "first_leaf", (1 + F.coalesce("n_leaves", F.lit(0))).alias("weight"), "n_children"), "inner")
    sizes = _subtree_sizes(inner)
    sized = inner.select("node", "parent").join(sizes, "node")
    best = sized.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min(F.struct((-F.col("size")).alias("s"), "node")).alias("b"))
    heavy = inner.join(best, "node", "left").select("node", F.coalesce("b.node", "first_leaf").alias("heavy"))
    heavy = cut(heavy.filter("heavy is not null"), "heavy")

    # chains, first over nodes with children; childless nodes take theirs from the parent
    on = heavy.select(F.col("heavy").alias("node"), F.lit(True).alias("on_path"))
    state = inner.join(on, "node", "left").select("node", F.when(F.col("on_path"), F.col("parent")).alias("jump"))
    ranked = _rank_lists(state.withColumn("dist", F.when(F.col("jump").isNotNull(), 1).otherwise(0).cast("long")), "chains")
    placed = cut(inner.select("node", "parent", "n_children").join(ranked.select("node", F.col("far").alias("chain"), F.col("dist").alias("pos")), "node"), "placed")
    length = placed.groupBy("chain").agg((F.max("pos") + 1).alias("length"))
    above = placed.select(F.col("node").alias("parent"), F.col("chain").alias("up_chain"), F.col("pos").alias("up_pos"))
    heads = placed.filter("node = chain").select("chain", "parent").join(above, "parent", "left").select("chain", "up_chain", "up_pos").join(length, "chain")
    heads = cut(heads, "chain-heads")
    bases = _rank_lists(heads.select(F.col("chain").alias("node"), F.col("up_chain").alias("jump"), F.coalesce(F.col("up_pos") + 1, F.lit(0)).alias("dist")), "bases")
    chains = cut(heads.join(bases.select(F.col("node").alias("chain"), F.col("far").alias("top"), F.col("dist").alias("base")), "chain"), "chains")
    labels = placed.join(chains.select("chain", "top", "base"), "chain").select("node", "chain", "pos", "top", (F.col("base") + F.col("pos")).alias("dist"), "n_children")
    labels = cut(labels, "labels")

    # the graph of joints: local tops linked by what enters a joint
    joints = nodes.filter("indeg > 1").select("node")
    into = edges.join(joints.withColumnRenamed("node", "c"), "c", "left_semi")
    into = cut(_up(into.select(F.col("c").alias("joint"), F.col("p").alias("at"), F.col("p").alias("node")), labels, "at"), "into-joints")
    # the tops that are joints or heads of opened loops; the others are roots
    through = into.select(F.col("top").alias("a"), F.col("joint").alias("b")).join(joints.withColumnRenamed("node", "a"), "a", "left_semi")
    comps = cut(_components(through), "loop-joints")
    ca = comps.select(F.col("node").alias("top"), F.col("comp").alias("loop"))
    cb = comps.select(F.col("node").alias("joint"), F.col("comp").alias("loop"))
    marks = into.join(ca, "top").join(cb, ["joint", "loop"]).select("chain", "pos", "loop")
    last = opened.select(F.col("last").alias("node"), F.col("head").alias("loop")).join(labels, "node").select("chain", "pos", "loop")
    prefixes = cut(_climb(marks.unionByName(last), chains), "loop-prefixes")
    on_loop = labels.join(prefixes, "chain").filter("pos <= upto").select("node", "loop")
    on_loop = cut(on_loop.unionByName(comps.select("node", F.col("comp").alias("loop"))).distinct(), "on-loop")
    least = on_loop.groupBy("loop").agg(F.min("node").alias("loop_id"))
    loops = cut(on_loop.join(least, "loop").select("node", "loop_id"), "loops")

    # (root, depth) pairs of the joints off loops
    bad = loops.select("node")
    way = into.select(F.col("joint").alias("v"), F.col("top").alias("a"), (F.col("dist") + 1).alias("w")).distinct()
    way = way.join(bad.withColumnRenamed("node", "v"), "v", "left_anti").join(bad.withColumnRenamed("node", "a"), "a", "left_anti")
    way = cut(way.join(joints.select(F.col("node").alias("a"), F.lit(True).alias("by_joint")), "a", "left"), "ways")
    ended = cut(way.filter("by_joint is null").select("v", "a", "w"), "ended")
    rounds, ends_rounds = Rounds(spark, "ways"), Rounds(spark, "ended")
    going = rounds.put(way.filter("by_joint").select("v", "a", "w"))
    while not going.isEmpty():
        hop = lambda t: going.join(t.select(F.col("v").alias("a"), F.col("a").alias("b"), F.col("w").alias("w2")), "a").select("v", F.col("b").alias("a"), (F.col("w") + F.col("w2")).alias("w"))  # noqa: B023, E731
        ended_next = ends_rounds.put(ended.unionByName(hop(ended)).distinct())
        going = rounds.put(hop(going).distinct())
        ended = ended_next
    places = ended.select(F.col("v").alias("node"), F.col("a").alias("root"), F.col("w").alias("depth"))

    # childless nodes
    bare = nodes.filter("n_children = 0")
    child_leaves = bare.filter("parent is not null").select("node", F.col("parent").alias("at"))
    child_leaves = _up(child_leaves, labels, "at").join(heavy.select(F.col("heavy").alias("node"), F.lit(True).alias("on_path")), "node", "left")
    child_leaves = child_leaves.select("node", F.when(F.col("on_path"), F.col("chain")).otherwise(F.col("node")).alias("chain"), F.when(F.col("on_path"), F.col("pos") + 1).otherwise(F.lit(0)).alias("pos"), "top", (F.col("dist") + 1).alias("dist"))
    lone = bare.filter("parent is null").select("node", F.col("node").alias("chain"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("top"), F.lit(0).cast("long").alias("dist"))
    every = cut(labels.drop("n_children").unionByName(child_leaves).unionByName(lone), "all-labels")
    return Forest(nodes, every, chains, loops, places, selfs, edges)


def node_places(f: Forest) -> DataFrame:
    """(node, root, depth): each node reached from a root without passing a loop, one row
    per different number of links."""
    tops = f.nodes.filter("indeg = 0").select(F.col("node").alias("top"))
    off = f.labels.join(f.loops, "node", "left_anti").select("node", "top", "dist")
    per_top = off.groupBy("top").agg(F.count(F.lit(1)).alias("n_under"))
    homes = tops.select("top", F.col("top").alias("root"), F.lit(0).cast("long").alias("w"))
    homes = homes.unionByName(f.places.select(F.col("node").alias("top"), "root", F.col("depth").alias("w")))
    homes = cut(homes.join(per_top, "top"), "homes")
    placed = salted_join(off, homes, "top", "n_under", spread=["node"])
    placed = placed.select("node", "root", (F.col("w") + F.col("dist")).alias("depth")).distinct()
    alone = f.selfs.join(f.nodes, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))
    return placed.unionByName(alone)


def hierarchy_rows(f: Forest) -> DataFrame:
    """(node, root, node_depth): :func:`node_places`, and depth -1 with the smallest id of
    the loop as root for nodes on loops; a node with a row to itself that is on no larger
    loop is its own loop."""
    own = f.selfs.join(f.loops, "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(-1).alias("node_depth"))
    on = f.loops.select("node", F.col("loop_id").alias("root"), F.lit(-1).alias("node_depth"))
    return node_places(f).select("node", "root", F.col("depth").cast("int").alias("node_depth")).unionByName(on).unionByName(own)


def _entries(f: Forest) -> DataFrame:
    """(joint, at): the links that lead into the top of a local tree, be it a joint or
    the head of an opened loop."""
    tops = f.nodes.filter("indeg > 0 and parent is null").select(F.col("node").alias("c"))
    return f.edges.join(tops, "c").select(F.col("c").alias("joint"), F.col("p").alias("at"))


def tree_paths(f: Forest, separator: str = "/") -> DataFrame:
    """(node, top, depth, path): each node's full path from its root, one row per root and
    depth of :func:`node_places`.  Of several ways of one length the one over the fewest
    joints counts, then the smallest.  What lies on or below a loop has no root there: its
    path begins at the top of the loop's local tree.  Takes as many rounds as a way has
    joints."""
    local = cut(_local_paths(f, separator), "local-paths")
    joints = f.nodes.filter("indeg > 0 and parent is null").select("node")
    off = joints.join(f.loops.select("node"), "node", "left_anti")
    into = _entries(f).join(off.select(F.col("node").alias("joint")), "joint").join(local.withColumnRenamed("node", "at"), "at")
    into = cut(into.select("joint", "top", "depth", F.concat("path", F.lit(separator)).alias("way")), "path-entries")
    starts = local.filter("depth = 0").select("top").join(off.select(F.col("node").alias("top")), "top", "left_anti")
    step = cut(starts.select("top", F.col("top").alias("root"), F.lit(0).alias("w"), F.lit("").alias("prefix")), "path-tops")
    known = step
    while True:
        nxt = step.join(into, "top").select(F.col("joint").alias("top"), "root", (F.col("w") + F.col("depth") + 1).alias("w"), F.concat("prefix", "way").alias("prefix"))
        step = cut(nxt.groupBy("top", "root", "w").agg(F.min("prefix").alias("prefix")).join(known, ["top", "root", "w"], "left_anti"), "path-tops")
        if step.isEmpty():
            break
        known = known.unionByName(step)
    rows = local.join(known, "top").select("node", F.col("root").alias("top"), (F.col("depth") + F.col("w")).alias("depth"), F.concat("prefix", "path").alias("path"))
    rows = rows.groupBy("node", "top", "depth").agg(F.min("path").alias("path"))
    alone = f.selfs.join(f.nodes, "node", "left_anti")
    return rows.unionByName(alone.select("node", F.col("node").alias("top"), F.lit(0).alias("depth"), F.col("node").cast("string").alias("path")))


def _local_paths(f: Forest, separator: str) -> DataFrame:
    """(node, top, depth, path): each node's path from the top of its local tree, made of
    chain prefixes.  A path is as long as the node is deep; that much is put together in
    one task, as the result itself is one value."""
    on = f.labels.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x.node).alias("ids"))
    ups = f.labels.filter("pos = 0").join(f.chains.select("chain", "up_chain", "up_pos"), "chain", "left")
    # the head of a childless node's own chain hangs on its parent
    hang = f.nodes.select(F.col("node").alias("chain"), F.col("parent").alias("at"))
    place = f.labels.select(F.col("node").alias("at"), F.col("chain").alias("c2"), F.col("pos").alias("p2"))
    ups = ups.join(hang, "chain", "left").join(place, "at", "left").select("chain", F.coalesce("up_chain", "c2").alias("up_chain"), F.coalesce("up_pos", "p2").alias("up_pos"))
    state = cut(on.join(ups, "chain").withColumn("prefix", F.array().cast("array<string>")), "path-chains")
    rounds = Rounds(f.labels.sparkSession, "paths")
    known = rounds.put(state.select("chain", "ids", "up_chain", "up_pos", "prefix"))
    while not known.filter("up_chain is not null").isEmpty():
        far = known.select(F.col("chain").alias("up_chain"), F.col("ids").alias("i2"), F.col("prefix").alias("f2"), F.col("up_chain").alias("u2"), F.col("up_pos").alias("q2"), (F.col("prefix").isNotNull()).alias("there"))
        base = state.select(F.col("chain").alias("up_chain"), F.col("ids").alias("base"))
        step = known.join(far.drop("i2"), "up_chain", "left").join(base, "up_chain", "left")
        piece = F.concat(F.coalesce("f2", F.array().cast("array<string>")), F.slice("base", F.lit(1), F.col("up_pos").cast("int") + 1), "prefix")
        known = rounds.put(step.select("chain", "ids", F.col("u2").alias("up_chain"), F.col("q2").alias("up_pos"), F.when(F.col("base").isNull(), F.col("prefix")).otherwise(piece).alias("prefix")))
    rows = f.labels.join(known.select("chain", "ids", "prefix"), "chain")
    path = F.array_join(F.concat("prefix", F.slice("ids", F.lit(1), F.col("pos").cast("int") + 1)), separator)
    return rows.select("node", "top", F.col("dist").cast("int").alias("depth"), path.alias("path"))


def descendants(f: Forest, of: DataFrame) -> DataFrame:
    """(node, descendant): all that the nodes ``of`` lead to, each once and without the
    node itself.  What hangs on a node's local tree, then over the graph of joints."""
    own = cut(_local_descendants(f, of), "own")
    into = cut(_entries(f), "entries")
    held = own.unionByName(of.select("node", F.col("node").alias("descendant")).distinct())
    step = cut(held.join(into, held["descendant"] == into["at"]).select("node", "joint").distinct(), "reached")
    known = step
    over = cut(into.join(f.labels.select(F.col("node").alias("at"), "top"), "at").select(F.col("top").alias("from"), F.col("joint").alias("to")).distinct(), "joint-links")
    while True:
        nxt = step.join(over, step["joint"] == over["from"]).select("node", F.col("to").alias("joint")).distinct()
        step = cut(nxt.join(known, ["node", "joint"], "left_anti"), "reached")
        if step.isEmpty():
            break
        known = known.unionByName(step)
    under = known.join(f.labels.select(F.col("top").alias("joint"), F.col("node").alias("descendant")), "joint").select("node", "descendant")
    return own.unionByName(under).filter("node <> descendant").distinct()


def _local_descendants(f: Forest, of: DataFrame) -> DataFrame:
    """(node, descendant) within the local trees of the nodes ``of``: the rest of each
    node's chain, and whole chains that hang on what was found, chain by chain (at most
    log2(n) rounds)."""
    place = f.labels.select("node", "chain", "pos")
    found = of.select("node").distinct().join(place, "node").select("node", "chain", F.col("pos").alias("beyond"))
    hang = f.labels.filter("pos = 0").select("node").join(f.nodes.select("node", "parent"), "node").filter("parent is not null")
    hang = cut(hang.join(place.select(F.col("node").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("at")), "parent").select(F.col("node").alias("chain"), "up", "at"), "hanging")
    first = cut(found, "intervals")
    parts, step, own = [first], first, True
    while True:
        reach = F.col("at") >= F.col("beyond") if own else F.lit(True)
        step = cut(hang.join(step.select("node", F.col("chain").alias("up"), "beyond"), "up").filter(reach).select("node", "chain", F.lit(-1).cast("bigint").alias("beyond")), "intervals")
        own = False
        if step.isEmpty():
            break
        parts.append(step)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(f.labels.select(F.col("node").alias("descendant"), "chain", "pos"), "chain").filter("pos > beyond").select("node", "descendant")
