"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets, in classes of powers of two. Whole documents are far larger
than items, which makes their MinHash values useless for containment; so for each class a document is cut into windows
of twice the class's size that overlap by half. Window and item are then comparable in size, and an item is a candidate
for the document if at least one of HASHES minima agrees. Candidates are verified by exact containment of the item's
shingles in all of the document's. Documents stream by once, without a shuffle; items are searched in blocks of bounded size.

With an item of n shingles, 80 % of them in the document, a minimum agrees with a chance of 0.16 at least (the window
holds 4n others at most), and all HASHES fail with a chance below 2e-5, wherever in the document the shingles are; with an item
of one shingle, which a window of eight holds, of 2e-4.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import text as T
from lodeworks.llm.common import releasing

SHINGLE = 5
HASHES = 64
#: UTF-8 bytes of the items that are broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Shingles of the windows that are hashed at a time, or one window.
WINDOW_SHINGLES = 1 << 18
_FILTER_BITS = 22
_rng = np.random.default_rng(17)
FACTORS = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over the last axis."""
    return np.stack([((shingles ^ m) * f).min(axis=-1) for m, f in zip(MASKS, FACTORS)], axis=-1)  # one hash at a time


@dataclass
class Index:
    """Items by size class: numbers, minima; all items' sets, and a filter of all their shingles."""

    ids: list
    sets: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray]]
    known: np.ndarray
    filter: np.ndarray


def build_index(ids: list, texts: list[str | None]) -> Index:
    sets: list[np.ndarray] = []
    for chunk in T.chunks(pa.array(texts, pa.string())):
        s, first = T.shingles(T.words(chunk, T.ALNUM), SHINGLE)
        sets += [np.unique(s[a:b]) for a, b in zip(first[:-1], first[1:])]
    classes: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        if len(own):
            classes.setdefault(max(int(np.ceil(np.log2(len(own)))), 2), []).append(i)
    known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[known >> np.uint64(64 - _FILTER_BITS)] = True
    packed = {c: (np.array(own), np.stack([minima(sets[i]) for i in own])) for c, own in classes.items()}
    return Index(ids, sets, packed, known, bits)


def candidates(index: Index, shingles: np.ndarray, at: np.ndarray) -> set[int]:
    """Items one of whose minima agrees with that of a window of the document. ``at``: places of shingles that some item
    holds; windows without any can't agree, as the minimum of an item is one of its shingles."""
    found: set[int] = set()
    for c, (items, signatures) in index.classes.items():
        stride = 1 << c
        first = np.unique(np.concatenate([at // stride, np.maximum(at // stride - 1, 0)]))
        step = max(1, WINDOW_SHINGLES // (2 * stride))
        for lo in range(0, len(first), step):
            place = first[lo : lo + step, None] * stride + np.arange(2 * stride)
            windows = shingles[np.minimum(place, len(shingles) - 1)]  # past the end, the last shingle once more
            # Agreement is counted hash by hash, with the items' minima in order.
            agree = minima(windows)
            for k in range(HASHES):
                own = signatures[:, k]
                hit = np.isin(own, agree[:, k])
                if hit.any():
                    found.update(items[hit].tolist())
    return found


def matches(index: Index, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shingles of the item, those shared) of all pairs that reach the threshold."""
    for chunk in T.chunks(texts):
        s, first = T.shingles(T.words(chunk, T.ALNUM), SHINGLE)
        maybe = np.flatnonzero(index.filter[s >> np.uint64(64 - _FILTER_BITS)])
        maybe = maybe[np.isin(s[maybe], index.known)] if len(maybe) else maybe
        rows = np.searchsorted(first, maybe, side="right") - 1
        edges = np.flatnonzero(np.diff(rows, prepend=-1))
        for r, a, b in zip(rows[edges], edges, [*edges[1:], len(rows)]):
            own, at = s[first[r] : first[r + 1]], maybe[a:b] - first[r]
            held = np.unique(own[at])
            for i in sorted(candidates(index, own, at)):
                shared, n = len(np.intersect1d(index.sets[i], held, assume_unique=True)), len(index.sets[i])
                if shared >= threshold * n - 1e-9:
                    yield chunk.lo + int(r), i, n, shared


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and an item at least ``threshold`` of whose shingles stand in the document: doc_id, item_id,
    n_shingles (of the item), n_shared, containment.

    Shingles are five words, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z folded; a text of fewer words is one
    shingle of its own, which only a text of the same words holds; a text without words, or null, has no shingle and is
    in no pair. Repeated rows give repeated pairs; ids of any type, null ones too. Texts of any length are whole, in pieces.
    No rows on either side give no rows. Items of equal text are searched once, and their ids joined afterwards. Distinct
    texts of items are broadcast in blocks of about ``block_bytes``, by a hash of the text; documents are scanned once for each.
    """
    kind = dict(docs.dtypes)[doc_id]
    hit_doc, hit_key = "_hit_doc", "_hit_key"
    schema = f"{hit_doc} {kind}, {hit_key} long, n_shingles long, n_shared long"

    def search(shipped):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                found = list(matches(index, batch.column(1), threshold))
                if found:
                    rows, which, sizes, shared = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([index.ids[i] for i in which], pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], [hit_doc, hit_key, "n_shingles", "n_shared"])

        return work

    parts = [docs.select(doc_id, doc_text).mapInArrow(search(shipped), schema) for shipped in shipped_blocks(items, item_text, block_bytes)]
    found = reduce(DataFrame.unionByName, parts)
    names = items.select(F.col(item_id).alias("_hit_item"), _text_key(item_text).alias(hit_key))
    joined = found.join(names, hit_key)
    return joined.select(F.col(hit_doc).alias(doc_id), F.col("_hit_item").alias(item_id), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def _text_key(item_text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(item_text), F.lit("")))


def shipped_blocks(items: DataFrame, item_text: str, block_bytes: int) -> Iterator:
    """Broadcasts of the indexes of the items' distinct texts, about ``block_bytes`` of text in each; one at least."""
    source = items.select(_text_key(item_text).alias("key"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).dropDuplicates(["key", "text"])
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = source.where(F.pmod("key", F.lit(blocks)) == b).orderBy("key").collect()  # about block_bytes
        yield items.sparkSession.sparkContext.broadcast(build_index([r["key"] for r in rows], [r["text"] for r in rows]))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_text: str = "text", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they were; nothing is shuffled."""
    at = docs.columns.index(doc_text)

    def keep(shipped):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[row for row, *_ in matches(shipped.value, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(good))

        return work

    for shipped in shipped_blocks(items, item_text, block_bytes):
        docs = docs.mapInArrow(releasing(keep(shipped)), docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sets_sql(table: str, key: str) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN ['=' || array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {key}, {words} AS w FROM {table})"""


ORACLES = {
    "op1_decontaminate": f"""
    WITH d AS ({_sets_sql("documents", "doc_id")}), b AS ({_sets_sql("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
    p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
    SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM p JOIN n USING (item_id) WHERE 10 * n_shared >= 8 * n_shingles"""
}
QUERIES = {"op1_decontaminate": op1_decontaminate}
