"""Hard negatives by blocked matrix products.

Anchors are cut into blocks of ANCHOR_BYTES, one of which at a time is collected and broadcast; candidates stream past it, and
a task multiplies a tile of anchors by a tile of candidates in double precision, which is exact as components are integers and
sums stay below 2**53. A task keeps, for each anchor, the first few candidates of the same label that it has seen; such
lists merge, and a window over the lists of all tasks leaves the first few of all. Each of these positives opens a window of scores
for its anchor, and a second pass keeps the first few candidates of other labels inside each window likewise.

Tasks return few rows since a pass starts from floors: the same search over one in SEED candidates, by a hash, whose last kept
score no final list can fall below. Floors only spare rows that some other list would push out; every candidate is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions.storage import discard, shared_folder, stored
from lodeworks.llm.common import releasing
from lodeworks.llm.vectors import check_exact, finite, float_vector, largest, whole_parts

#: Bytes of one block of anchors in double precision: what the driver holds, and each executor is sent, at a time.
ANCHOR_BYTES = 16 << 20
#: Anchors and candidates of one product.
TILE = 2048, 512
#: Floors come from one candidate in so many.
SEED = 8
#: Kept pairs of a task before they are cut back to the first few of each list.
PENDING = 1 << 19

_LISTS = "slot long, score long, id long"


def _first(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each slot: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, int)
    place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
    keep = place < k
    return slot[keep], score[keep], ids[keep]


class _Lists:
    """The first ``k`` pairs of every slot so far, with the score that a new pair has to reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.held, self.n = floors.copy(), k, [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(slot):
            self.held.append((slot, score, ids))
            self.n += len(slot)
            if self.n > PENDING:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [np.concatenate(c) for c in zip(*self.held)] if self.held else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        slot, score, ids = _first(*parts, self.k)
        n = np.bincount(slot, minlength=len(self.floors))
        last = np.cumsum(n)[n == self.k] - 1  # pairs are in order of slots, so a full slot's last pair is its lowest
        self.floors[n == self.k] = np.maximum(self.floors[n == self.k], score[last])
        self.held, self.n = [(slot, score, ids)], len(slot)
        return slot, score, ids


def _searched(candidates: DataFrame, anchors: dict, scale: int, k: int, hits: Callable) -> DataFrame:
    """Rows of _LISTS: what is left in the lists of each task. ``hits(scores, anchors at lo, labels, ids, floors)`` says which cells of a
    tile belong to which slot."""
    block = candidates.sparkSession.sparkContext.broadcast(anchors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        x, width = own["x"], own["x"].shape[1]
        lists, most = _Lists(own["floors"], k), largest(x)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE[1]):
                part = batch.slice(at, TILE[1])
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                y = whole_parts(part.column(2), scale, width)
                check_exact(width * most * largest(y))
                for lo in range(0, len(x), TILE[0]):
                    lists.add(*hits(x[lo : lo + TILE[0]] @ y.T, own, lo, labels, ids, lists.floors))
        slot, score, ids = lists.cut()
        for at in range(0, len(slot), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(slot[at : at + 65536]), pa.array(score[at : at + 65536].astype(np.int64)), pa.array(ids[at : at + 65536])], ["slot", "score", "id"])

    found = candidates.select("id", "label", "x").mapInArrow(releasing(work), _LISTS)
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _same_label(scores: np.ndarray, own: dict, lo: int, labels: np.ndarray, ids: np.ndarray, floors: np.ndarray):
    part = slice(lo, lo + len(scores))
    good = (scores >= floors[part][:, None]) & (own["labels"][part][:, None] == labels[None]) & (own["ids"][part][:, None] != ids[None])
    a, b = np.nonzero(good)
    return a + lo, scores[a, b], ids[b]


def _in_windows(scores: np.ndarray, own: dict, lo: int, labels: np.ndarray, ids: np.ndarray, floors: np.ndarray):
    """Slot ``p * anchor + i`` is the window of the anchor's i-th positive. An anchor without one has empty windows."""
    part, p = slice(lo, lo + len(scores)), own["low"].shape[1]
    least = np.maximum(own["low"][part], floors.reshape(-1, p)[part])
    good = (scores >= least.min(1)[:, None]) & (scores <= own["high"][part].max(1)[:, None]) & (own["labels"][part][:, None] != labels[None])
    a, b = np.nonzero(good)
    s = scores[a, b]
    pair, i = np.nonzero((s[:, None] >= least[a]) & (s[:, None] <= own["high"][part][a]))
    return (a[pair] + lo) * p + i, s[pair], ids[b[pair]]


def _floors(candidates: DataFrame, anchors: dict, scale: int, k: int, hits: Callable, slots: int) -> np.ndarray:
    """For each slot the score of its k-th pair among one candidate in SEED, or minus infinity where it has fewer."""
    out = np.full(slots, -np.inf)
    some = candidates.where(F.pmod(F.xxhash64("id"), F.lit(SEED)) == 0)
    last = _searched(some, anchors | {"floors": out}, scale, k, hits).where(F.col("rank") == k).select("slot", "score").toArrow()
    out[last.column(0).to_numpy()] = last.column(1).to_numpy()
    return out


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    The score of two rows is the inner product of floor(scale * component), an exact integer; higher scores come first, ties by
    smaller id. Anchors are the rows for which ``is_anchor`` (over the columns of ``vectors``) is true. An anchor's positives are its
    first ``positives`` other rows of the same label, and a positive's negatives the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, all if there are fewer; a positive without one gives no row.

    Rows with a null id or label, or with a vector that is null or holds a null or non-finite component, take no part. Of vectors of
    different length the shorter one counts as if zeros followed. Ids and labels are whole numbers. Repeated rows are candidates
    each, so that an id can stand in a list twice, but rows with an anchor's id are not its positives; rows that repeat an anchor are
    one anchor, and of rows that share an id but differ each is an anchor. Other columns are ignored; no anchors, or no
    rows, give no rows. Scores that might pass 2**53 are an error.
    """
    spark, x = vectors.sparkSession, float_vector(vectors, vector_col)
    whole = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & finite(x)
    rows = vectors.where(whole).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    taken = [stored(rows, "vectors")]
    candidates = spark.read.schema(rows.schema).parquet(taken[0])
    chosen = candidates.where("anchor").select("id", "label", "x").distinct().withColumn("no", F.monotonically_increasing_id())
    taken.append(stored(chosen, "anchors"))
    chosen = spark.read.schema(chosen.schema).parquet(taken[1])
    n, width = chosen.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    blocks = max(1, -(-n * ((width or 0) + 6 * positives) * 8 // block_bytes))
    out = f"{shared_folder(spark)}/{taken[1].rsplit('/', 1)[1]}-negatives"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for b in range(blocks if n else 0):
        table = chosen.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).sort("no").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids, m = table["id"].to_numpy(), table.num_rows
        own = {"x": whole_parts(table["x"].combine_chunks(), scale, width), "ids": ids, "labels": table["label"].to_numpy()}
        floors = _floors(candidates, own, scale, positives, _same_label, m)
        best = _searched(candidates, own | {"floors": floors}, scale, positives, _same_label).toArrow()  # ``positives`` rows an anchor of this block
        slot, rank = best["slot"].to_numpy(), best["rank"].to_numpy() - 1
        windows = own | {"low": np.full((m, positives), np.inf), "high": np.full((m, positives), -np.inf)}
        score = best["score"].to_numpy()
        windows["low"][slot, rank], windows["high"][slot, rank] = -(-low * score // 100), high * score // 100
        floors = _floors(candidates, windows, scale, negatives, _in_windows, m * positives)
        found = _searched(candidates, windows | {"floors": floors}, scale, negatives, _in_windows)
        named = pa.table({"slot": slot * positives + rank, "anchor_id": ids[slot], "positive_id": best["id"], "positive_score": score})
        joined = found.join(F.broadcast(spark.createDataFrame(named)), "slot")  # of one block of anchors
        joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    for path in taken:
        discard(spark, path)
    return spark.read.schema(schema).parquet(out)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
# Every anchor against every row, for small tables.
ORACLES = {
    "op11_hard_negatives": """
    WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::double)) AS x
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::bigint AS score FROM e a JOIN e b ON a.id % 100 = 0 AND b.id <> a.id),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
    n AS (SELECT p.a, p.b, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT a AS anchor_id, b AS positive_id, rank::int AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10"""
}
