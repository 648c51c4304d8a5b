"""Neighbours over the metric index, and the hierarchies that rest on them, against loops."""

from __future__ import annotations

import numpy as np
import pytest

from lodeworks.operators import cluster, hierarchy, metric, neighbours


def table(spark, x, keys=None):
    rows = [(keys[i] if keys else i, None if v is None else list(map(float, v))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"id {'string' if keys else 'long'}, v array<double>").repartition(3)


def clustered(n=400, seed=1, spread=0.3, dim=3, centres=8):
    rng = np.random.default_rng(seed)
    at = rng.uniform(-20, 20, (centres, dim))
    return at[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dim))


def grid(n=300, seed=2):
    return np.random.default_rng(seed).integers(0, 6, (n, 2)).astype(float)  # copies and ties


def test_nearest_leaves_out_most_block_pairs_of_clusters(spark):
    x, report = clustered(), {}
    got = sorted(tuple(r) for r in neighbours.nearest(table(spark, x), table(spark, x), "id", "v", 4, 16, report).select("id", "rank", "neighbour", "distance").collect())
    d = metric.distances(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert got == [(i, k + 1, int(near[i, k]), d[i, near[i, k]]) for i in range(len(x)) for k in range(4)]
    assert report["compared"] < 0.4 * report["block_pairs"], report


@pytest.mark.parametrize("block", [7, 1024])
def test_nearest_of_copies_ties_and_string_keys(spark, block):
    x = [*grid(120), None, [np.nan, 1.0], [2.0], [2.0, 0.0]]
    keys = [f"k{(i * 37) % 1000:03}" for i in range(len(x))]
    df = table(spark, x, keys)
    whole = {k: np.array([*v, 0.0][:2]) for k, v in zip(keys, x) if v is not None and not np.isnan(v).any()}
    wanted = set()
    for a, v in whole.items():
        order = sorted((float(np.sqrt(((v - w) ** 2).sum())), b) for b, w in whole.items() if a != b)[:5]
        wanted |= {(a, b, r + 1, d) for r, (d, b) in enumerate(order)}
    assert {tuple(r) for r in neighbours.nearest(df, df, "id", "v", 5, block).select("id", "neighbour", "rank", "distance").collect()} == wanted
    pairs = {(a, b) for a in whole for b in whole if a != b and ((whole[a] - whole[b]) ** 2).sum() <= 1}
    assert {tuple(r) for r in neighbours.within(df, "id", "v", 1.0, block).collect()} == pairs
    assert {tuple(r) for r in neighbours.count_within(df, "id", "v", 1.0, block).collect()} == {(a, sum(p == a for p, _ in pairs)) for a in whole if any(p == a for p, _ in pairs)}


def test_nothing_has_no_neighbours(spark):
    empty = table(spark, [[1.0]]).limit(0)
    assert neighbours.nearest(empty, empty, "id", "v", 3).count() == 0
    assert neighbours.count_within(empty, "id", "v", 1.0).count() == 0
    assert hierarchy.spanning_tree(empty, "id", "v").count() == 0
    assert hierarchy.hdbscan(empty, "id", "v").count() == 0
    assert cluster.dbscan(empty, "id", "v", 1.0).count() == 0
    one = table(spark, [[1.0], None])
    assert [tuple(r) for r in hierarchy.reachability(one, "id", "v").select("id", "place", "reachability").collect()] == [(0, 0, None)]
    assert {tuple(r) for r in hierarchy.hdbscan(one, "id", "v").collect()} == {(0, None, 0.0), (1, None, 0.0)}


def test_dbscan_equals_a_loop_and_names_by_key(spark):
    x = np.concatenate([clustered(150, 4, 0.5, 2, 4), grid(60)])
    keys, report = [f"p{(i * 71) % 1000:03}" for i in range(len(x))], {}
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in cluster.dbscan(table(spark, x, keys), "id", "v", 0.6, 4, 11, report).collect()}
    near = metric.distances(x, x) <= 0.6
    core = near.sum(1) >= 4
    label = [keys[i] if core[i] else None for i in range(len(x))]
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else None for i in range(len(x))]
        if new == label:
            break
        label = new
    final = [label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(x))]
    assert got == {k: (c, bool(f)) for k, c, f in zip(keys, final, core)}
    assert report["compared"] < report["block_pairs"] / 2


# Brute force of the hierarchy: all edges in order, one union after the other.


def slow_tree(x, min_samples):
    d = metric.distances(x, x)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x)) - 1] if min_samples > 1 else np.zeros(len(x))
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    first = {}
    for i, v in enumerate(map(tuple, x)):
        first.setdefault(v, i)
    nodes = sorted(first.values())
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    edges = [(core[i], first[tuple(v)], i) for i, v in enumerate(x) if first[tuple(v)] != i]
    for w, a, b in sorted((reach[a, b], a, b) for a in nodes for b in nodes if a < b):
        if find(a) != find(b):
            root[find(b)] = find(a)
            edges.append((w, a, b))
    return sorted(edges), core


class Merge:
    def __init__(self, w, one, other):
        self.w, self.one, self.other = w, one, other
        self.points = (one.points if isinstance(one, Merge) else [one]) + (other.points if isinstance(other, Merge) else [other])


def slow_merges(edges, n):
    top = {i: i for i in range(n)}
    home = list(range(n))
    node = 0
    for w, a, b in edges:
        node = Merge(w, top[home[a]], top[home[b]])
        new = home[a]
        for p in node.points:
            home[p] = new
        top[new] = node
    return node


def slow_hdbscan(edges, n, size, single):
    root = slow_merges(edges, n)
    points = lambda v: v.points if isinstance(v, Merge) else [v]

    def explore(v, birth):
        """(stability, best, members of the chosen clusters below or here as (point, density) lists, all falls)"""
        falls, children, stability = [], [], 0.0
        while True:
            density = 1 / max(v.w, hierarchy.CLOSEST)
            a, b = v.one, v.other
            if len(points(a)) >= size and len(points(b)) >= size:
                stability += len(v.points) * (density - birth)
                children = [explore(c, density) for c in (a, b)]
                break
            rest = None
            for c in (a, b):
                if len(points(c)) >= size:
                    rest = c
                else:
                    falls += [(p, density) for p in points(c)]
                    stability += len(points(c)) * (density - birth)
            if rest is None:
                break
            v = rest
        best = sum(c[1] for c in children)
        every = falls + [f for c in children for f in c[3]]
        if stability >= best:
            return stability, stability, [every], every
        return stability, best, [g for c in children for g in c[2]], every

    if not isinstance(root, Merge) or n < size:
        return {}
    stability, best, chosen, every = explore(root, 0.0)
    if len(chosen) == 1 and chosen[0] is every and not single:
        # The root may not be chosen: what is best below it.
        v = root
        while not (len(points(v.one)) >= size and len(points(v.other)) >= size):
            v = next((c for c in (v.one, v.other) if len(points(c)) >= size), None)
            if v is None:
                return {}
        density = 1 / max(v.w, hierarchy.CLOSEST)
        chosen = [g for c in (v.one, v.other) for g in explore(c, density)[2]]
    out = {}
    for group in chosen:
        name, most = min(p for p, _ in group), max(d for _, d in group)
        out |= {p: (name, d / most) for p, d in group}
    return out


@pytest.mark.parametrize("x,min_samples,block", [(clustered(200), 1, 10), (grid(150), 4, 8), (clustered(500, 7, 4.0, 5), 6, 1024)])
def test_tree_equals_all_edges_in_order(spark, x, min_samples, block):
    report = {}
    found = sorted((r["weight"], r["a"], r["b"]) for r in hierarchy.spanning_tree(table(spark, x), "id", "v", min_samples, block, report).collect())
    assert found == slow_tree(x, min_samples)[0]
    if block == 10:
        assert report["compared"] < report["block_pairs"], report


@pytest.mark.parametrize("x,size,single,steps", [(clustered(200, 5, 1.5), 8, False, 40), (grid(150), 5, True, 1000), (np.zeros((20, 2)), 5, True, 7)])
def test_clusters_equal_brute_force(spark, x, size, single, steps):
    edges, _ = slow_tree(x, size)
    wanted = slow_hdbscan(edges, len(x), size, single)
    got = {r["id"]: (r["cluster"], r["strength"]) for r in hierarchy.hdbscan(table(spark, x), "id", "v", size, single=single, block=64, steps=steps).collect()}
    assert {k for k, v in got.items() if v[0] is None} == set(range(len(x))) - set(wanted)
    for p, (name, strength) in wanted.items():
        assert got[p][0] == name and abs(got[p][1] - strength) < 1e-9, p


def test_rows_of_blocks_are_not_broadcast(spark, monkeypatch):
    nodes = table(spark, clustered(300)).selectExpr("id AS k", "1L AS w", "v AS x")
    ix = metric.index(nodes, 3, metric.pivots_of(nodes, 3, 64), 64)
    monkeypatch.setattr(hierarchy, "materialised", lambda df, name: df)
    found = hierarchy._packed_rows(ix, nodes.selectExpr("k", "k % 2 AS comp", "0.5D AS core", "0D AS least", "double(k) AS limit"))
    rows = {r["block"]: r for r in found.collect()}
    assert len(rows) == ix.n_blocks and max(r["limit"] for r in rows.values()) == 299 and {r["part"] for r in rows.values()} == {None}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_single_linkage_and_reachability(spark):
    x = clustered(100, 6, 1.0, 2, 5)
    edges, core = slow_tree(x, 1)
    for cut in ({"k": 4}, {"height": 1.0}):
        kept = edges[: len(edges) - 3] if "k" in cut else [e for e in edges if e[0] <= 1.0]
        label = list(range(len(x)))
        for _ in x:
            for _, a, b in kept:
                label[a] = label[b] = min(label[a], label[b])
        assert {r["id"]: r["cluster"] for r in hierarchy.single_linkage(table(spark, x), "id", "v", block=64, **cut).collect()} == dict(enumerate(label))
    edges, core = slow_tree(x, 5)
    root, order = slow_merges(edges, len(x)), []

    def walk(v, w):
        if isinstance(v, Merge):
            walk(v.one, w)
            walk(v.other, v.w)
        else:
            order.append((v, len(order), core[v], w))

    walk(root, None)
    assert sorted(tuple(r) for r in hierarchy.reachability(table(spark, x), "id", "v", 5, 64, 40).collect()) == sorted(order)


@pytest.fixture
def striped(monkeypatch):
    monkeypatch.setattr(metric, "STRIPE_ROWS", 40)


def test_a_block_moves_once_for_a_stripe(spark, striped):
    x = np.random.default_rng(3).normal(size=(400, 6))  # no structure: every block meets every other
    rows = spark.createDataFrame([(i, 1, list(map(float, v))) for i, v in enumerate(x)], "k long, w long, x array<double>")
    ix = metric.index(rows, 6, metric.pivots_of(rows, 6, 8), 8)
    pairs = metric.near_blocks(ix, ix, float("inf"), once=True)

    def work(met):
        sent = {(0, a.number) for a, _ in met} | {(1, b.number) for _, others in met for b, _ in others}
        yield metric.pa.RecordBatch.from_arrays([metric.pa.array([len(sent)]), metric.pa.array([sum(len(o) for _, o in met)])], ["sent", "pairs"])

    found = metric.together(pairs, ix, ix, work, "sent long, pairs long").agg({"sent": "sum", "pairs": "sum"}).first()
    assert ix.stripes == 10
    assert found["sum(pairs)"] == pairs.count() == ix.n_blocks * (ix.n_blocks + 1) // 2
    assert found["sum(sent)"] <= 1.2 * ix.n_blocks * (ix.stripes + 1)  # not 2 for each pair


@pytest.mark.parametrize("shift,scale", [(1000.0, 1.0), (0.0, 1e-9), (0.0, 1e20)])
def test_products_lose_no_neighbour(spark, striped, shift, scale):
    x = (np.random.default_rng(4).integers(0, 5, (170, 3)) / 4 + np.random.default_rng(5).choice([0, 1e-7], (170, 1)) + shift) * scale
    df = table(spark, x)
    d = metric.distances(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :3]
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.nearest(df, df, "id", "v", 3, 16).collect()}
    assert got == {(i, k + 1): (int(order[i, k]), d[i, order[i, k]]) for i in range(len(x)) for k in range(3)}
    eps = float(np.sort(d[0])[7])
    assert {tuple(r) for r in neighbours.count_within(df, "id", "v", eps, 16).collect()} == {(i, int(n)) for i, n in enumerate((d <= eps).sum(1)) if n}


def test_silhouettes_equal_all_distances(spark, striped):
    x = np.concatenate([clustered(150, 3, 1.0, 3, 3), [[5.0, 5.0, 5.0]] * 4])
    labels = [*(i % 3 for i in range(150)), 1, 1, 2, 9]
    df = spark.createDataFrame([(i, list(map(float, v)), labels[i]) for i, v in enumerate(x)], "id long, v array<double>, l int")
    d = metric.distances(x, x)
    got = {r["id"]: r["silhouette"] for r in cluster.silhouette(df, "id", "v", "l", 16).collect()}
    for i in range(len(x)):
        mean = {n: np.mean(own) for n in set(labels) if (own := [d[i, j] for j in range(len(x)) if labels[j] == n and j != i])}
        a, b = mean.pop(labels[i], None), min(v for n, v in mean.items() if n != labels[i])
        assert abs(got[i] - (0.0 if a is None else (b - a) / max(a, b))) < 1e-9
