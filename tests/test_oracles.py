"""Every query that has SQL against DuckDB, over the smallest test tables."""

from __future__ import annotations

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lodeworks.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(columns, data):
    """Rows as sorted tuples, columns by name; missing values alike, whole floats as integers."""

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return int(v) if isinstance(v, float) and v.is_integer() else v

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, sql, name):
    found = registry.QUERIES[name](spark, sf)
    wanted = sql.execute(registry.ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got, expected = rows(found.columns, found.collect()), rows(names, wanted.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, int | float) and isinstance(y, int | float) and abs(x - y) <= 2e-6 * max(1, abs(y))), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_is_stable(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["column_name", "n_rows", "n_missing", "n_unique", "mean", "std", "q25", "q50", "q75", "n_outliers"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_event_is_cast(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    found = {r["event_id"]: r["whole"] for r in registry.QUERIES["q16_cast_all"](spark, sf).collect()}
    values = {r["event_id"]: r["value"] for r in events.collect()}
    assert any(v != math.floor(v) for v in values.values())
    assert found == {k: math.trunc(v) for k, v in values.items()}


def test_mixture_sees_the_whole_embedding(spark, tmp_path):
    rng = random.Random(3)
    first = [[0.125 * rng.gauss(0, 1) for _ in range(4)] for _ in range(300)]
    rows = [(i, first[i % 300] + [0.125 * (rng.gauss(0, 1) + 6 * (i // 300)) for _ in range(60)]) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["vec_id"]: r["cluster"] for r in registry.QUERIES["c7_gaussian_mixture"](spark, str(tmp_path)).collect()}
    assert len(found) == 600
    assert sum(found[i] != found[i + 300] for i in range(300)) > 100  # equal in the first four components, far apart in the others


def test_every_subset_is_scored(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=60)
    names = ("l_quantity", "l_discount", "l_tax")
    spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in (*names, "l_extendedprice"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {frozenset(r["subset"].split(",")): r["r2"] for r in registry.QUERIES["f9_exhaustive_all"](spark, str(tmp_path)).collect()}
    assert len(found) == 7
    for subset, r2 in found.items():
        a = np.column_stack([np.ones(60), *[x[:, names.index(c)] for c in subset]])
        rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert abs(r2 - (1 - rest @ rest / ((y - y.mean()) @ (y - y.mean())))) < 2e-6
