"""Mining and compression of vectors against loops over all pairs of rows."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, no long, x string, v array<int>, id string, code string, slot long, score double"
NAN, INF = float("nan"), float("inf")


def awkward_vectors(n=240, dim=8, seed=3):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-3, 3)) / 4 for _ in range(dim)], rng.randint(0, 3)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * dim, None), (n + 2, [NAN] * dim, 1), (n + 3, [INF] + [0.0] * (dim - 1), 2), (n + 4, [None] + [0.5] * (dim - 1), 2), (None, [0.75] * dim, 1), (None, [0.75] * dim, 1)]
    rows += [(n + 5, [], 1), (n + 6, [0.5] * 3, 2), (n + 7, [0.0] * dim, 3), (20, list(rows[20][1]), rows[20][2]), (30, list(rows[31][1]), rows[31][2]), (7, list(rows[7][1]), rows[7][2]), (7, list(rows[7][1]), 1)]
    rows += [(n + 8 + i, [0.25, -0.5] * (dim // 2), 1) for i in range(80)]  # a third of all rows alike
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", [1], "i", "c", 1, 0.0) for i, v, label in rows], SCHEMA).repartition(3)


def fit(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def mined(rows, every, positives, negatives, low=30, high=90):
    whole = [(i, tuple(math.floor(256 * c) for c in v), label) for i, v, label in rows if i is not None and label is not None and fit(v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = []
    for a in {r for r in whole if r[0] % every == 0}:
        own = sorted((-score(a, b), b[0]) for b in whole if b[2] == a[2] and b[0] != a[0])[:positives]
        for s, p in own:
            other = sorted((-score(a, b), b[0]) for b in whole if b[2] != a[2] and low * -s <= 100 * score(a, b) <= high * -s)[:negatives]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n) in enumerate(other)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_mining_equals_all_pairs(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(hard_negatives, "PENDING", 50)
    monkeypatch.setattr(hard_negatives, "TILE", (7, 5))
    rows = awkward_vectors()
    found = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, positives=4, negatives=6, block_bytes=block_bytes)
    assert sorted(tuple(r) for r in found.collect()) == mined(rows, 10, 4, 6)
    assert found.count() > 300


def test_mining_knows_no_rows_and_no_rounding(spark):
    nothing = table(spark, [(1, [1.0], 1)]).limit(0)
    assert hard_negatives.hard_negatives(nothing, F.col("vec_id") % 2 == 0).count() == 0
    assert hard_negatives.hard_negatives(table(spark, awkward_vectors()), F.lit(None).cast("boolean")).count() == 0
    alone = table(spark, [(2, [1.0, 2.0], 1), (3, [1.0, 2.0], 2), (4, None, None)])
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 2 == 0).count() == 0  # no positive
    with pytest.raises(Exception, match="exact below"):
        hard_negatives.hard_negatives(table(spark, [(2, [1e12], 1), (4, [1e12], 1)]), F.col("vec_id") % 2 == 0).count()


def test_floors_do_not_decide(spark, monkeypatch):
    rows = awkward_vectors(seed=9)
    expected = mined(rows, 20, 5, 10)
    for seed in (1, 1_000_000):  # floors from all candidates, and from hardly any
        monkeypatch.setattr(hard_negatives, "SEED", seed)
        found = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0)
        assert sorted(tuple(r) for r in found.collect()) == expected


def compressed(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if fit(v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = sorted(((i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for e in set(own):
                mine = [c[p] for c, k in zip(cut, own) if k == e]
                books[p][e] = tuple(sum(v) // len(mine) for v in zip(*mine))
    final = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in final]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, final, errors)), key=repr)


@pytest.mark.parametrize("dim,parts,entries", [(8, 4, 16), (8, 4, 256), (6, 4, 9)])
def test_codes_equal_a_loop(spark, dim, parts, entries):
    rows = awkward_vectors(dim=dim)
    found = vector_codes.vector_codes(table(spark, rows), parts=parts, entries=entries)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == compressed(rows, parts, entries, 4)


def test_codes_of_few_and_no_rows(spark):
    rows = [(3, [1.0, 2.0], None), (1, [0.5, -0.5], 1), (1, [0.5, -0.5], 1), (2, None, 1)]
    assert sorted((tuple(r) for r in vector_codes.vector_codes(table(spark, rows)).collect()), key=repr) == compressed(rows, 4, 256, 4)
    empty = vector_codes.vector_codes(table(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert {r["code"] for r in vector_codes.vector_codes(table(spark, [(1, [], 1), (2, [], None)])).collect()} == {"00000000"}
    with pytest.raises(Exception, match="exact below"):
        vector_codes.vector_codes(table(spark, [(2, [1e7], 1)])).count()
