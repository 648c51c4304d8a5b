"""Clusters over grid cells against loops over points."""

from __future__ import annotations

import numpy as np

from lodeworks.operators import cells, workflow
from tests.test_neighbours import clustered, table


def test_cell_features_and_birch_equal_loops(spark):
    x = clustered(150, 3, 0.8, 2, 4)
    place = [tuple(v) for v in np.floor(x / 2.0)]
    own = {p: [i for i, q in enumerate(place) if q == p] for p in place}
    for parts in (1, 5):
        found = {r["cell"]: (r["n"], r["centre"]) for r in cells.cell_features(table(spark, x).repartition(parts), "id", "v", 2.0).collect()}
        assert found.keys() == {min(v) for v in own.values()}
        assert all(found[min(v)][0] == len(v) and np.allclose(found[min(v)][1], x[v].mean(0)) for v in own.values())
    centre = {min(v): x[v].mean(0) for v in own.values()}
    label = {c: c for c in centre}
    while len(set(label.values())) > 4:  # the two nearest clusters become one
        _, a, b = min((np.linalg.norm(centre[a] - centre[b]), a, b) for a in centre for b in centre if a < b and label[a] != label[b])
        lo, hi = sorted((label[a], label[b]))
        label = {c: lo if n == hi else n for c, n in label.items()}
    got = {r["id"]: r["cluster"] for r in cells.birch(table(spark, [*x, None]), "id", "v", 2.0, 4).collect()}
    assert got == {**{i: label[min(own[place[i]])] for i in range(len(x))}, len(x): None}


def test_mean_shift_equals_a_loop(spark):
    x, width = clustered(120, 6, 0.5, 2, 3), 3.0
    place = [tuple(v) for v in np.floor(x / width)]
    seeds = {min(i for i, q in enumerate(place) if q == p): x[[i for i, q in enumerate(place) if q == p]].mean(0) for p in place}
    for _ in range(50):
        moved = {k: x[np.linalg.norm(x - s, axis=1) <= width].mean(0) for k, s in seeds.items()}
        far = max(np.linalg.norm(moved[k] - seeds[k]) for k in seeds)
        seeds = moved
        if far <= 1e-3 * width:
            break
    name = {k: k for k in seeds}
    for _ in seeds:
        for a in seeds:
            for b in seeds:
                if np.linalg.norm(seeds[a] - seeds[b]) <= width / 2:
                    name[a] = name[b] = min(name[a], name[b])
    got = {r["id"]: (r["cluster"], r["mode"]) for r in cells.mean_shift(table(spark, [*x, None]), "id", "v", width, block=16).collect()}
    assert got[len(x)] == (None, None)
    for i, v in enumerate(x):
        k = min(seeds, key=lambda s: (np.linalg.norm(seeds[s] - v), s))
        assert got[i][0] == name[k] and np.allclose(got[i][1], seeds[name[k]], atol=1e-6)
    assert len({c for c, _ in got.values()}) == 4


def test_report_follows_its_own_advice(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 3, 300) * 10.0
    rows = [(i, float(c + a), float(2 * c + b) if i % 7 else None, 5.0, "x") for i, (c, a, b) in enumerate(zip(centre, rng.normal(size=300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, constant double, other string")
    found = workflow.cluster_report(df, "id", ("a", "b", "constant"), 3)
    actions = {r["column_name"]: r["action"] for r in found["actions"].collect()}
    assert actions["constant"] == "drop: constant" and actions["b"].startswith("impute")
    label = {r["id"]: r["cluster"] for r in found["clusters"].collect()}
    assert len(label) == 300 and len({(c, label[i]) for i, c in enumerate(centre) if i % 7}) == 3  # whole rows part by their centres
    assert found["metrics"].first()["n_clusters"] == 3 and found["profile"].count() == 9
    long = workflow.long_report(found, {"audit": ("column_name",), "metrics": (), "profile": ("cluster", "column_name")})
    assert {r["section"] for r in long.collect()} == {"audit", "metrics", "profile"} and long.where("section = 'audit' and item = 'a' and name = 'n_rows'").first()["value"] == "300"
    plan = {r["step"]: r["choice"] for r in workflow.model_plan(df.drop("other"), ("a", "b"), "constant").collect()}
    assert plan["task"] == "classification" and plan["models"] == "logistic, tree" and plan["order"].startswith("clean") and plan["selection"] in ("correlation", "none")
