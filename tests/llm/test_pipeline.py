"""Stages of the pipeline by themselves, and all together."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodeworks.llm import decontaminate, langid, quality
from lodeworks.llm import text as T
from tests.llm.test_operators import links_of, shingles, smallest


@pytest.fixture(scope="session")
def stages():
    return dict(corpus_pipeline.STAGES)


def test_all_but_the_last_stage_return_the_columns_of_documents(spark, sf, awkward, nothing, stages):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (awkward, nothing):
            assert stage(spark, docs, sf).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, sf).count() == 0


def both_kinds(spark, sf, awkward):
    """Documents of the test tables and awkward ones, with repeated rows and ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = awkward.select(*docs.columns)
    return docs.unionByName(odd).unionByName(odd.where("doc_id < 3")).repartition(4)


def rows_of(df):
    return Counter(map(repr, df.collect()))


def test_quality_stage_equals_brute_force(spark, sf, awkward, stages):
    docs = both_kinds(spark, sf, awkward)
    network = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = Counter()
    for r in docs.collect():
        (p,) = quality._probabilities(network, pa.array([r["text"]], pa.string()))  # each text by itself
        want[repr(r)] += p >= 0.3
    assert rows_of(stages["quality"](spark, docs, sf)) == +want


def test_language_stage_equals_brute_force(spark, sf, awkward, stages):
    docs = both_kinds(spark, sf, awkward)
    model = langid.fit(docs.where(langid.fold("doc_id", 5) != 0))
    want = Counter()
    for r in docs.collect():
        text = (r["text"] or "").encode()
        if not any(map(str.isalpha, r["text"] or "")):
            continue
        grams = [langid.trigrams(T.Chunk(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)])))]
        margins = sum(model.weights[g].astype(float) for g in grams[0]) / max(len(text) - 2, 1) ** 0.5
        loss = [sum(w * np.logaddexp(0, -m * c) for m, c, w in zip(margins, code, model.bit_weight)) for code in model.code]
        share = np.exp(min(loss) - np.array(loss))
        first, second = sorted(share / share.sum(), reverse=True)[:2]
        want[repr(r)] += not (second > 0.25 and first < 0.4)
    assert rows_of(stages["language"](spark, docs, sf)) == +want


def test_near_duplicate_stage_equals_brute_force(spark, sf, awkward, stages):
    docs = both_kinds(spark, sf, awkward)
    rows = docs.collect()
    sets, links = links_of([(r["doc_id"], r["text"]) for r in rows], 80, 100)
    groups = {}
    for k, root in enumerate(smallest(len(rows), links)):
        groups.setdefault(root, []).append(rows[k])
    kept = stages["near duplicates"](spark, docs, sf).collect()
    have = Counter(map(repr, kept))
    for group in groups.values():
        if not shingles(group[0]["text"]):
            assert all(have[repr(r)] >= 1 for r in group)
            continue
        stays = [r for r in {repr(r): r for r in group}.values() if have[repr(r)]]
        least = min((r["doc_id"] for r in group if r["doc_id"] is not None), default=None)
        assert len(stays) == 1 and have[repr(stays[0])] == 1 and stays[0]["doc_id"] == least
    assert len(kept) == sum(len(g) if not shingles(g[0]["text"]) else 1 for g in groups.values())


def test_the_session_is_left_as_it_was(spark, sf):
    before = spark.conf.get(corpus_pipeline.BATCH)
    corpus_pipeline.run(spark, sf)
    assert spark.conf.get(corpus_pipeline.BATCH) == before


def test_run_keeps_what_all_stages_keep(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf)
    ids = {r["doc_id"] for r in out.collect()}
    assert len(ids) == out.count() and ids <= {r["doc_id"] for r in docs.collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(ids & bad) <= 0.3 * len(bad) and len(ids & good) > 0.5 * len(good)
    tainted = {r["doc_id"] for r in decontaminate.find_contained(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert not tainted & ids


def test_a_stage_runs_on_its_own_output(spark, sf, stages):
    once = stages["decontamination"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert stages["decontamination"](spark, once, sf).count() == once.count()
