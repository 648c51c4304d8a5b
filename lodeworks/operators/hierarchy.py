"""Hierarchies of vectors that rest on a minimum spanning tree: HDBSCAN, reachability, single linkage.

The tree is that of mutual reachability: two points are as far apart as the largest of their distance and their core distances, a
core distance being that of the ``min_samples``-th point, the point itself counted. It grows in Boruvka rounds. In a round, every
component looks for its shortest edge to another one: first in the lists of nearest neighbours that the core distances
come from, then in pairs of blocks of the metric index that are nearer than what it has found, those within one component left out.
Edges are in order of (weight, smaller key, larger key), so that the tree is unique but for copies, which hang on the smallest key of theirs.

Merges are made from the tree's edges in order, in ranges of STEPS edges. A task holds one range, with no more than what its edges touch:
which component each end belongs to, and how large it is. What a range joins is told to the edges of later ranges by a join. The
condensed tree, its stabilities and the choice of clusters are joins, components of links, and sweeps over ranges of clusters likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised
from lodeworks.operators.graph import components
from lodeworks.operators.metric import BLOCK, CHUNK, Block, Index, Product, index, near_blocks, pivots_of, places, together, unpacked
from lodeworks.operators.neighbours import Numbered, copies, k_nearest, numbered, rounds

#: Edges, or clusters, that one task takes in order at a time.
STEPS = 1_000_000
#: Neighbours of a node in the lists that rounds look at first, at least.
LIST = 8
#: The density of points at distance 0 is that of this distance.
CLOSEST = 1e-10

# The tree


def _best(edges: DataFrame) -> DataFrame:
    """(comp, other, w, lo, hi): the first edge of each component."""
    return edges.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")


def _packed_rows(ix: Index, rows: DataFrame) -> DataFrame:
    """(block, extra, limit, part) of rows (k, comp, core, least, limit): values in order of keys; a block's limit, and its component if all
    rows are of one."""

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = unpacked(batch.column(1)[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column(0)[i].as_py())), pa.array(keys)], ["block", "k"])

    # Both sides have a row a node; Spark takes ``where`` for as small as the blocks are many, so it is kept from being broadcast.
    where = ix.blocks.select("block", "keys").mapInArrow(unfolded, "block long, k long").hint("merge")
    each = where.join(rows, "k").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "comp", "core", "limit"))).alias("rows"))  # of one block each

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra, limit, part = [], [], []
            for i in range(batch.num_rows):
                own = batch.column(1)[i].values
                comp, core, reach = (own.field(c).to_numpy() for c in ("comp", "core", "limit"))
                extra.append(comp.tobytes() + core.tobytes() + reach.tobytes())
                limit.append(reach.max())
                part.append(int(comp[0]) if (comp == comp[0]).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(extra, pa.binary()), pa.array(limit, pa.float64()), pa.array(part, pa.int64())], ["block", "extra", "limit", "part"])

    return materialised(each.mapInArrow(packed, "block long, extra binary, limit double, part long"), "packed")


def _crossing(pairs: DataFrame, ix: Index, packed: DataFrame) -> DataFrame:
    """(comp, other, w, lo, hi): for each cell of blocks the first edge from a component to another one, within limits."""

    def work(met: list[tuple[Block, list[tuple[Block, float]]]]) -> Iterator[pa.RecordBatch]:
        of: dict[int, tuple] = {}
        for b in (b for a, others in met for b in (a, *(o for o, _ in others))):
            n = len(b.keys)
            of[b.number] = (unpacked(b.extra[: 8 * n], np.int64), *unpacked(b.extra[8 * n :]).reshape(2, n))
        names = np.unique(np.concatenate([of[a.number][0] for a, _ in met]))
        least, found = np.full(len(names), np.inf), []
        for a, others in met:
            comp, core, limit = of[a.number]
            code = np.searchsorted(names, comp)
            for b, bound in others:
                other, core_b, _ = of[b.number]
                open_ = np.flatnonzero((limit >= bound) & (least[code] >= bound))
                for lo in range(0, len(open_), CHUNK):
                    at = open_[lo : lo + CHUNK]
                    product, reach = Product(a, at, b), np.minimum(limit[at], least[code[at]])
                    endless = np.flatnonzero(np.isinf(reach))
                    if len(endless):
                        # Some edge of each is a limit for its component.
                        apart = comp[at[endless]][:, None] != other[None]
                        q = np.where(apart, product.value[endless], -np.inf).argmax(1)
                        some = apart[np.arange(len(endless)), q]
                        p, q = endless[some], q[some]
                        w = np.maximum(np.maximum(product.exact(p, q), core[at[p]]), core_b[q])
                        np.minimum.at(least, code[at[p]], w)
                        reach = np.minimum(limit[at], least[code[at]])
                    p, q = places(product.possible(reach))
                    apart = comp[at[p]] != other[q]
                    p, q = p[apart], q[apart]
                    w = np.maximum(np.maximum(product.exact(p, q), core[at[p]]), core_b[q])
                    good = w <= reach[p]
                    p, q, w = p[good], q[good], w[good]
                    np.minimum.at(least, code[at[p]], w)
                    good = w <= least[code[at[p]]]
                    p, q, w = p[good], q[good], w[good]
                    one, two = a.keys[at[p]], b.keys[q]
                    found.append((comp[at[p]], other[q], w, np.minimum(one, two), np.maximum(one, two)))
        if found:
            c, o, w, low, high = (np.concatenate(v) for v in zip(*found))
            order = np.lexsort((high, low, w, c))
            first = order[np.r_[True, c[order][1:] != c[order][:-1]]] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(v[first]) for v in (c, o, w, low, high)], ["comp", "other", "w", "lo", "hi"])

    return together(pairs, ix, ix, work, "comp long, other long, w double, lo long, hi long", packed.select("block", "extra"), both=True)


def _joined(best: DataFrame) -> DataFrame:
    """(comp, root): components after each has been joined to the one that its best edge leads to. Such steps end in two components that chose the same
    edge, of which the smaller is the root; others reach it by jumps of doubled length."""
    back = best.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    up = best.join(back, "other").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root"))
    up = materialised(up, "hooks")
    while True:
        higher = up.select(F.col("comp").alias("root"), F.col("root").alias("_root"))
        up = materialised(up.join(higher, "root").select("comp", F.col("_root").alias("root"), (F.col("_root") != F.col("root")).alias("moved")), "hooks")
        if not up.where("moved").limit(1).count():
            return up.select("comp", "root")


def _grown(ix: Index, nodes: DataFrame, lists: DataFrame, report: dict | None) -> DataFrame:
    """(lo, hi, w): the tree over the nodes (k, core), by Boruvka rounds; ``lists`` (q, neighbour, w, last): near edges, and the distance
    beyond which a node's list says nothing."""
    compared, tree = 0, None
    comps = materialised(nodes.select("k", "core", F.col("k").alias("comp")), "comps")
    last = lists.groupBy("q").agg(F.max("last").alias("least"))
    while comps.select("comp").distinct().limit(2).count() > 1:
        side = lambda c, name: comps.select(F.col("k").alias(c), F.col("comp").alias(name))
        near = lists.join(side("q", "comp"), "q").join(side("neighbour", "other"), "neighbour").where("comp <> other")
        best = materialised(_best(near.select("comp", "other", "w", F.least("q", "neighbour").alias("lo"), F.greatest("q", "neighbour").alias("hi"))), "edges")
        after = None
        for first in rounds(ix.n_blocks):
            limits = comps.join(best.select("comp", "w"), "comp", "left").join(last.withColumnRenamed("q", "k"), "k", "left")
            reach, least = F.coalesce("w", F.lit(float("inf"))), F.greatest("core", F.coalesce("least", F.lit(0.0)))
            # What a node's list doesn't show is at least as far as the list reaches.
            packed = _packed_rows(ix, limits.select("k", "comp", "core", F.when(least <= reach, reach).otherwise(F.lit(-1.0)).alias("limit")))
            bounds = packed.select("block", "limit").where("limit >= 0")
            bounds = bounds.withColumns({"after_bound": F.lit(-1.0), "after_b": F.lit(-1).cast("long")}) if after is None else bounds.join(after, "block", "left").na.fill({"after_bound": -1.0, "after_b": -1})
            pairs = near_blocks(ix, ix, bounds, first, parts=packed.select("block", "part"))
            n = pairs.count()
            if not n:
                break
            compared += n
            best = materialised(_best(_crossing(pairs, ix, packed).unionByName(best)), "edges")
            if first is None:
                break
            done = pairs.groupBy(F.col("a").alias("block")).agg(F.max(F.struct("bound", "b")).alias("m")).select("block", F.col("m.bound").alias("after_bound"), F.col("m.b").alias("after_b"))
            after = materialised(done if after is None else done.union(after).groupBy("block").agg(F.max(F.struct("after_bound", "after_b")).alias("m")).select("block", "m.*"), "last-pairs")
        chosen = best.select("lo", "hi", "w").distinct()
        tree = materialised(chosen if tree is None else tree.union(chosen), "tree")
        comps = materialised(comps.join(_joined(best), "comp").select("k", "core", F.col("root").alias("comp")), "comps")
    if report is not None:
        report |= {"block_pairs": ix.n_blocks**2, "compared": compared}
    return tree if tree is not None else nodes.sparkSession.createDataFrame([], "lo long, hi long, w double")


def _tree(df: DataFrame, key: str, vector: str, min_samples: int, block: int, report: dict | None) -> tuple[Numbered, DataFrame, DataFrame]:
    """The numbered rows, (k, core) of all keys, and (lo, hi, w) of the tree over them."""
    (own,), dim = numbered([df], key, vector)
    members, nodes = copies(own.rows)
    members, nodes = materialised(members, "members"), materialised(nodes, "nodes")
    ix = index(nodes, dim, pivots_of(nodes, dim, block), block)
    k = max(LIST, min_samples) + 1
    near = materialised(k_nearest(ix, ix, k), "near")
    weights = nodes.select(F.col("k").alias("neighbour"), "w")
    seen = F.sum("w").over(Window.partitionBy("q").orderBy("rank"))
    core = near.join(weights, "neighbour").withColumn("_seen", seen).groupBy(F.col("q").alias("k"))
    core = core.agg(F.coalesce(F.min(F.when(F.col("_seen") >= min_samples, F.col("distance"))), F.max("distance")).alias("core"), F.max("distance").alias("last"), F.count(F.lit(1)).alias("n"))
    # A list that is not full holds all nodes there are.
    core = materialised(core.select("k", F.lit(0.0).alias("core") if min_samples < 2 else "core", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("last")).alias("last")), "core")
    both = near.where("q <> neighbour").join(core.select(F.col("k").alias("q"), F.col("core").alias("c1"), "last"), "q").join(core.select(F.col("k").alias("neighbour"), F.col("core").alias("c2")), "neighbour")
    lists = materialised(both.select("q", "neighbour", F.greatest("distance", "c1", "c2").alias("w"), "last"), "lists")
    tree = _grown(ix, core.select("k", "core"), lists, report)
    joined = members.join(core.select(F.col("k").alias("node"), "core"), "node")
    hung = joined.where("k <> node").select(F.col("node").alias("lo"), F.col("k").alias("hi"), F.col("core").alias("w"))
    return own, joined.select("k", "core"), materialised(tree.union(hung), "tree")


def spanning_tree(df: DataFrame, key: str, vector: str, min_samples: int = 1, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """(a, b, weight), a < b: the minimum spanning tree of mutual reachability, of plain distances with ``min_samples`` 1. A table of n rows with
    vectors has n - 1 edges; with fewer rows than ``min_samples``, core distances are those of the farthest point. ``report`` is told how many pairs of blocks
    there are, and how many were compared over all rounds."""
    own, _, tree = _tree(df, key, vector, min_samples, block, report)
    return own.named(tree.select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("w").alias("weight")), ("a", "b"))


# Merges

_MERGES = "step long, w double, one long, other long, n_one long, n_other long, gone long, kept long"


def merges(tree: DataFrame, steps: int = STEPS) -> DataFrame:
    """(step, w, one, other, n_one, n_other) of a tree (lo, hi, w) over numbers that are not negative, in order of (w, lo, hi): the two that an edge
    merges, a point by its number and a merge by -1 - step, and how many points each holds. Steps rise with the order, but have gaps."""
    n = tree.count()
    ranges = max(1, -(-n // steps))
    ordered = tree.repartitionByRange(ranges, "w", "lo", "hi").sortWithinPartitions("w", "lo", "hi").withColumn("step", F.monotonically_increasing_id())
    ends = [c for s in ("lo", "hi") for c in (F.col(s).alias(f"{s}_comp"), F.col(s).alias(f"{s}_top"), F.lit(1).cast("long").alias(f"{s}_n"))]
    left = materialised(ordered.select("step", "w", *ends), "edges")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        top: dict[int, tuple[int, int]] = {}  # of the components that the edges of this range touch

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for batch in batches:
            out = []
            for step, w, a, b, ta, tb, na, nb in zip(*(c.to_pylist() for c in batch.columns)):
                for c, t in ((a, (ta, na)), (b, (tb, nb))):
                    if c not in parent:
                        parent[c], top[c] = c, t
                a, b = find(a), find(b)
                (one, n_one), (other, n_other) = top[a], top[b]
                parent[max(a, b)] = min(a, b)
                top[min(a, b)] = (-1 - step, n_one + n_other)
                out.append((step, w, one, other, n_one, n_other, None, None))
            yield _rows(out)
        gone = [(c, find(c)) for c in parent]
        for at in range(0, len(gone), 65536):
            yield _rows([(top[r][0], None, None, None, top[r][1], None, c, r) for c, r in gone[at : at + 65536]])

    found = []
    for r in range(ranges):
        own = left.where(F.shiftright("step", 33) == r).select("step", "w", "lo_comp", "hi_comp", "lo_top", "hi_top", "lo_n", "hi_n")
        done = materialised(own.coalesce(1).sortWithinPartitions("step").mapInArrow(work, _MERGES), "merges")
        found.append(done.where("gone is null").select("step", "w", "one", "other", "n_one", "n_other"))
        if r + 1 < ranges:
            told = done.where("gone is not null").select("gone", "kept", F.col("step").alias("top"), F.col("n_one").alias("n"))
            left = left.where(F.shiftright("step", 33) > r)
            for s in ("lo", "hi"):
                left = left.join(told, F.col(f"{s}_comp") == F.col("gone"), "left").withColumns({f"{s}_comp": F.coalesce("kept", f"{s}_comp"), f"{s}_top": F.coalesce("top", f"{s}_top"), f"{s}_n": F.coalesce("n", f"{s}_n")}).drop("gone", "kept", "top", "n")
            left = materialised(left, "edges")
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _MERGES.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "w" else pa.int64()) for n, c in zip(names, columns)], names)


# Clusters


def _swept(clusters: DataFrame, descending: bool, steps: int, task: Callable, schema: str, told: str) -> DataFrame:
    """``task`` over the clusters in order of their number, ``steps`` at a time; what it tells other clusters (``told``: a column of (cluster, value)
    rows) reaches those of later ranges as ``carried``, summed up."""
    n = clusters.count()
    ranges = max(1, -(-n // steps))
    order = F.col("cluster").desc() if descending else F.col("cluster")
    dealt = materialised(clusters.repartitionByRange(ranges, order).withColumn("_range", F.spark_partition_id()), "clusters")
    out, heard = None, None
    for r in range(ranges):
        own = dealt.where(F.col("_range") == r).drop("_range")
        own = own.withColumn("carried", F.lit(None).cast("double" if told == "value" else "long")) if heard is None else own.join(heard, "cluster" if told == "value" else "parent", "left")
        done = materialised(own.coalesce(1).sortWithinPartitions(order).mapInArrow(task, schema), "swept")
        out = done if out is None else out.union(done)
        if told == "value":
            heard = materialised(out.where("told is not null").groupBy(F.col("told").alias("cluster")).agg(F.sum("value").alias("carried")), "carried")
        else:
            heard = materialised(out.select(F.col("cluster").alias("parent"), F.col("label").alias("carried")), "carried")
    return out


def _chosen(clusters: DataFrame, single: bool, steps: int) -> DataFrame:
    """(cluster, label) of clusters (cluster, parent, stability): of each branch the clusters whose stability is at least the sum of the best below
    them; label: the one chosen of a cluster and those above it."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, float] = {}
        for batch in batches:
            rows = []
            for cluster, parent, stability, carried in zip(*(batch.column(c).to_pylist() for c in ("cluster", "parent", "stability", "carried"))):
                best = below.pop(cluster, 0.0) + (carried or 0.0)
                flagged = stability >= best and (single or parent is not None)
                rows.append((cluster, parent, max(stability, best), flagged))
                if parent is not None:
                    below[parent] = below.get(parent, 0.0) + rows[-1][2]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.bool_())], ["cluster", "parent", "best", "flagged"])
        # What later ranges have to know.
        yield pa.RecordBatch.from_arrays([pa.array(list(below), pa.int64()), pa.array([None] * len(below), pa.int64()), pa.array(list(below.values()), pa.float64()), pa.array([None] * len(below), pa.bool_())], ["cluster", "parent", "best", "flagged"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label: dict[int, int | None] = {}
        for batch in batches:
            rows = []
            for cluster, parent, flagged, carried in zip(*(batch.column(c).to_pylist() for c in ("cluster", "parent", "flagged", "carried"))):
                above = label[parent] if parent in label else carried
                label[cluster] = above if above is not None else cluster if flagged else None
                rows.append((cluster, label[cluster]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["cluster", "label"])

    def told_up(batches):
        for batch in up(batches):
            flagged = batch.column("flagged")
            outside = flagged.is_null()
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(outside, batch.column("cluster"), None), pc.if_else(outside, batch.column("best"), None)], ["cluster", "parent", "best", "flagged", "told", "value"])

    flags = _swept(clusters, True, steps, told_up, "cluster long, parent long, best double, flagged boolean, told long, value double", "value").where("flagged is not null").select("cluster", "parent", "flagged")
    return _swept(materialised(flags, "flags"), False, steps, down, "cluster long, label long", "label")


def condensed(found: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the merges ``found``: the clusters (cluster, parent, birth, stability), parent null at the root; what falls out of them (child, cluster,
    density, n), children being points or merges of too few of them; and (node, component), the top of the merge, or of the small
    group of points, that a point or merge is part of, for those that are part of one.

    A cluster is the chain of merges from its top down to where it splits into two of ``min_cluster_size`` points or more; its number is that
    of its top."""
    size = F.col("n_one") + F.col("n_other")
    rows = found.withColumns({"id": -1 - F.col("step"), "size": size, "density": 1 / F.greatest("w", F.lit(CLOSEST)), "split": (F.col("n_one") >= min_cluster_size) & (F.col("n_other") >= min_cluster_size)})
    ends = F.explode(F.array(F.struct(F.col("one").alias("child"), F.col("n_one").alias("n")), F.struct(F.col("other").alias("child"), F.col("n_other").alias("n")))).alias("e")
    sides = materialised(rows.select("id", "size", "density", "split", ends).select("id", "size", "density", "split", "e.*"), "sides")
    big = F.col("size") >= min_cluster_size
    links = sides.where(~big | (~F.col("split") & (F.col("n") >= min_cluster_size)))
    part = materialised(components(links.select("id", "child"), "id", "child"), "parts")
    at = lambda df, c: df.join(part, F.col(c) == F.col("node"), "left").withColumn("cluster", F.coalesce("component", c)).drop("node", "component")
    inside = materialised(at(sides.where(big), "id"), "inside")
    births = inside.where("split").select(F.col("child").alias("top"), F.col("cluster").alias("parent"), F.col("density").alias("birth"))
    tops = inside.select(F.col("cluster").alias("top")).distinct().join(births, "top", "left").select(F.col("top").alias("cluster"), "parent", F.coalesce("birth", F.lit(0.0)).alias("birth"))
    gone = inside.where("split or n < %d" % min_cluster_size).groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("density")).alias("mass"))
    clusters = tops.join(gone, "cluster", "left").select("cluster", "parent", "birth", (F.coalesce("mass", F.lit(0.0)) - F.coalesce("n", F.lit(0)) * F.col("birth")).alias("stability"))
    falls = inside.where(F.col("n") < min_cluster_size).select("child", "cluster", "density", "n")
    return materialised(clusters, "clusters"), materialised(falls, "falls"), part


def hdbscan(df: DataFrame, key: str, vector: str, min_cluster_size: int = 5, min_samples: int | None = None, single: bool = False, block: int = BLOCK, steps: int = STEPS) -> DataFrame:
    """(key, cluster, strength): clusters of excess of mass, named by their smallest key; null for noise, whose strength is 0. The strength of a member is
    the density at which it leaves its cluster over the largest such density there. ``min_samples`` is ``min_cluster_size`` unless given;
    ``single``: the whole table may be one cluster. Rows without a vector are noise; a table of fewer than ``min_cluster_size`` vectors is."""
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")
    own, points, tree = _tree(df, key, vector, min_samples or min_cluster_size, block, None)
    ids = materialised(points.select("k").orderBy("k").withColumn("no", F.monotonically_increasing_id()), "points")
    number = lambda c: ids.select(F.col("k").alias(c), F.col("no").alias(f"_{c}"))
    edges = tree.join(number("lo"), "lo").join(number("hi"), "hi").select(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "w")
    clusters, falls, part = condensed(materialised(merges(edges, steps), "merges"), min_cluster_size)
    label = _chosen(clusters.select("cluster", "parent", "stability"), single, steps)
    left = falls.join(label, "cluster").select("child", "label", "density")
    top = ids.join(part, F.col("no") == F.col("node"), "left").select("k", F.coalesce("component", "no").alias("child"))
    each = materialised(top.join(left, "child").where("label is not null").select("k", "label", "density"), "members")
    name = each.groupBy("label").agg(F.min("k").alias("cluster"), F.max("density").alias("most"))
    found = each.join(name, "label").select(F.col("k").alias("_key"), "cluster", (F.col("density") / F.col("most")).alias("strength"))
    found = own.named(found, ("_key", "cluster"))
    return df.select(key).join(found.distinct(), F.col(key) == F.col("_key"), "left").select(key, "cluster", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def single_linkage(df: DataFrame, key: str, vector: str, k: int | None = None, height: float | None = None, block: int = BLOCK) -> DataFrame:
    """(key, cluster) of agglomerative clustering by the nearest members, cut at ``k`` clusters or at a distance: pairs no farther than ``height`` stay
    together. A cluster is named by its smallest key. Rows without a vector have null."""
    own, points, tree = _tree(df, key, vector, 1, block, None)
    if k is not None:
        cut = tree.orderBy(F.desc("w"), F.desc("lo"), F.desc("hi")).limit(k - 1)  # ``k`` is small beside the table
        kept = tree.join(cut, ["lo", "hi"], "left_anti")
    else:
        kept = tree.where(F.col("w") <= height)
    joined = points.join(components(kept.select("lo", "hi"), "lo", "hi"), F.col("k") == F.col("node"), "left")
    found = own.named(joined.select(F.col("k").alias("_key"), F.coalesce("component", "k").alias("cluster")), ("_key", "cluster"))
    return df.select(key).join(found.distinct(), F.col(key) == F.col("_key"), "left").select(key, "cluster")


def reachability(df: DataFrame, key: str, vector: str, min_samples: int = 5, block: int = BLOCK, steps: int = STEPS) -> DataFrame:
    """(key, place, core_distance, reachability): the points in the order of the merges of the tree of mutual reachability, the valley of a cluster being its
    points in a row. The reachability of a point is the weight at which it, with those that follow, meets those before; null for the first. Of two
    parts that an edge merges, the one with its smaller key comes first. Places count from 0. Rows without a vector are left out."""
    own, points, tree = _tree(df, key, vector, min_samples, block, None)
    ids = materialised(points.select("k", "core").orderBy("k").withColumn("no", F.monotonically_increasing_id()), "points")
    number = lambda c: ids.select(F.col("k").alias(c), F.col("no").alias(f"_{c}"))
    edges = tree.join(number("lo"), "lo").join(number("hi"), "hi").select(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "w")
    found = materialised(merges(edges, steps), "merges")
    first = F.struct(F.col("one").alias("child"), (-1 - F.col("step")).alias("up"), F.lit(0).cast("long").alias("skip"), F.lit(None).cast("double").alias("w"))
    second = F.struct(F.col("other").alias("child"), (-1 - F.col("step")).alias("up"), F.col("n_one").alias("skip"), F.col("w").alias("w"))
    # Jumps of doubled length towards the root: ``skip`` sums up what comes before, ``w`` is that of the lowest merge that is entered second.
    above = materialised(found.select(F.explode(F.array(first, second)).alias("e")).select("e.*"), "jumps")
    while True:
        higher = above.select(F.col("child").alias("up"), F.col("up").alias("_up"), F.col("skip").alias("_skip"), F.col("w").alias("_w"))
        jumped = above.join(higher, "up", "left").select("child", F.coalesce("_up", "up").alias("up"), (F.col("skip") + F.coalesce("_skip", F.lit(0))).alias("skip"), F.coalesce("w", "_w").alias("w"), F.col("_up").isNotNull().alias("moved"))
        jumped = materialised(jumped, "jumps")
        above, moved = jumped.drop("moved"), jumped.where("moved").limit(1).count()
        if not moved:
            break
    placed = ids.join(above, F.col("no") == F.col("child"), "left")
    out = placed.select(F.col("k").alias(key), F.coalesce("skip", F.lit(0)).cast("long").alias("place"), F.col("core").alias("core_distance"), F.col("w").alias("reachability"))
    return own.named(out, (key,))
