"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

Word vectors: every word bucket owns a sparse random index vector; the vector of a word is the sum of the index vectors
of its neighbours over the whole corpus (random indexing), gathered in one pass of integer counts. A document is the
mean of its words' vectors, their spread, and the mean product of neighbouring words' vectors (repetition shows there).
A two-layer numpy network is fitted to labelled documents; a temperature fitted on documents it hasn't seen calibrates
its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import text as T
from lodeworks.llm.common import fold, releasing

BUCKETS = 1 << 13
DIMS = 32
WINDOW = 2
#: Labelled documents that the network is fitted to at most, taken by a hash of their id.
MAX_LABELLED = 6000
FEATURES = 3 * DIMS + 1
#: Words whose neighbours are gathered at a time.
GATHER_WORDS = 1 << 19
#: UTF-8 bytes of the texts that are pooled at a time: a word takes several rows of DIMS numbers meanwhile.
POOL_BYTES = 1 << 18

#: Letters and digits keep their case; everything else that isn't space forms words of its own.
_kind = np.full(256, 2, np.uint8)
_kind[[0, 0x20, *range(0x09, 0x0E)]] = 0
_kind[0x30:0x3A] = _kind[0x41:0x5B] = _kind[0x61:0x7B] = _kind[0x80:] = 1


def tokens(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets in text order, and each row's first one: runs of letters and digits, and runs of signs."""
    n, rows = len(chunk.data), chunk.hi - chunk.lo
    if not n:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    kind = _kind[chunk.data]
    begin = kind != 0
    begin[1:] &= kind[1:] != kind[:-1]
    edge = chunk.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] = kind[edge] != 0
    start = np.flatnonzero(begin)
    stop = np.ones(n + 1, bool)  # a run ends where the kind changes or a row begins
    stop[1:n] = kind[1:] != kind[:-1]
    stop[edge] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, start, side="right")]
    hashes = T.run_hashes(lambda lo, hi: chunk.data[lo:hi].astype(np.uint64) + np.uint64(1), start, end, n)
    return (hashes >> np.uint64(64 - 13)).astype(np.int64), np.searchsorted(start, chunk.offsets)


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs for each bucket."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (BUCKETS, 2)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, 2))


def gather_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of the corpus, BUCKETS x DIMS: every task adds up its own texts, the sums are added up in
    Spark, and a table of fixed size reaches the driver."""
    place, sign = index_vectors()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            for chunk in T.chunks(batch.column(0)):
                every, first = tokens(chunk)
                whole = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for lo in range(0, len(every), GATHER_WORDS):
                    for apart in range(1, WINDOW + 1):
                        word, row = (x[lo : lo + GATHER_WORDS + apart] for x in (every, whole))
                        same = row[apart:] == row[:-apart]
                        a, b = word[:-apart][same], word[apart:][same]
                        for of, by in ((a, b), (b, a)):
                            for j in range(2):
                                total += np.bincount(of * DIMS + place[by, j], weights=sign[by, j], minlength=BUCKETS * DIMS)
        total = total.reshape(BUCKETS, DIMS)
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(total[used, d]) for d in range(DIMS))], ["bucket", *(f"v{d}" for d in range(DIMS))])

    schema = "bucket int, " + ", ".join(f"v{d} double" for d in range(DIMS))
    summed = docs.select(text_col).mapInArrow(work, schema).groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)]).toPandas()
    vectors = np.zeros((BUCKETS, DIMS))
    vectors[summed["bucket"]] = summed.drop(columns="bucket").to_numpy()
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


#: Words of one text that are pooled at a time.
POOL_WORDS = 1 << 16


def pooled(chunk: T.Chunk, vectors: np.ndarray) -> np.ndarray:
    """FEATURES for each row; a row without words is all 0. A long text is summed up piece by piece."""
    word, first = tokens(chunk)
    rows = len(first) - 1
    sums, squares, nears = (np.zeros((rows, DIMS)) for _ in range(3))
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    for lo in range(0, len(word), POOL_WORDS):
        hi = min(len(word), lo + POOL_WORDS)
        v = vectors[word[lo : hi + 1]]  # and the next one, for the last product
        near = v[: hi - lo].copy()
        near[: len(v) - 1] *= v[1:][: hi - lo]
        last = np.flatnonzero(np.append(row[lo + 1 : hi + 1] != row[lo : min(hi, len(word) - 1)], [True] * (hi == len(word))))
        near[last] = 0
        v = v[: hi - lo]
        at = np.flatnonzero(np.r_[True, row[lo + 1 : hi] != row[lo : hi - 1]])
        own = row[lo + at]
        sums[own] += np.add.reduceat(v, at, axis=0, dtype=np.float64)
        squares[own] += np.add.reduceat(v * v, at, axis=0, dtype=np.float64)
        nears[own] += np.add.reduceat(near, at, axis=0, dtype=np.float64)
    out = np.zeros((rows, FEATURES))
    many = np.maximum(n, 1)[:, None]
    mean = sums / many
    out[:, :DIMS] = mean
    out[:, DIMS : 2 * DIMS] = np.sqrt(np.maximum(squares / many - mean**2, 0))
    out[:, 2 * DIMS : 3 * DIMS] = nears / np.maximum(many - 1, 1)
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Network:
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.spread @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 24, steps: int = 400, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on the cross entropy over four fifths of the rows; the temperature minimises it over the rest. Without rows of
    both labels, every score is the smoothed share of label 1."""
    centre, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    share = (y.sum() + 1) / (len(y) + 2)
    zero = (np.zeros((FEATURES, hidden)), np.zeros(hidden), np.zeros(hidden), np.array(np.log(share / (1 - share))))
    net = Network(vectors, centre, spread, zero, 1.0)
    if len(np.unique(y)) < 2:
        return net
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    z, t = (x[~held] - centre) / spread, y[~held]
    p = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), zero[3].copy()]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t) / len(t)
        back = error[:, None] * p[2] * (1 - h * h)
        grads = [z.T @ back + decay * p[0], back.sum(0), h.T @ error + decay * p[2], error.sum()]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    net.layers = tuple(p)
    if held.any():
        logit, truth = net.logits(x[held]), y[held]
        temperatures = np.geomspace(0.25, 8, 60)
        costs = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logit / c)) for c in temperatures]
        net.temperature = float(temperatures[int(np.argmin(costs))])
    return net


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` ids with a label outside the held-out fold, the first by a hash of the id; repeated ids count once."""
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0))
    once = own.groupBy(id_col).agg(F.max(label_col).cast("double").alias("_label"))
    return once.orderBy(F.xxhash64(id_col), id_col).limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Network:
    vectors = gather_vectors(docs, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(0), POOL_BYTES):
                x = pooled(chunk, shipped.value)
                own = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays([own.column(1), own.column(2), own.column(3), pa.array(list(x), pa.list_(pa.float64()))], [id_col, "_label", "_h", "x"])

    # At most ``most`` narrow rows are broadcast, and as many come back.
    sample = F.broadcast(labelled_sample(labels, id_col, label_col, most))
    rows = docs.select(id_col, text_col).join(sample, id_col)
    kind = dict(docs.dtypes)[id_col]
    # Of several rows of an id the text with the smallest hash is learned from; its features are picked before any reach the driver.
    pooled_rows = rows.select(text_col, id_col, "_label", F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h")).mapInArrow(work, f"`{id_col}` {kind}, _label double, _h long, x array<double>")
    found = pooled_rows.groupBy(id_col).agg(F.min_by(F.struct("_label", "x"), "_h").alias("one")).select(id_col, "one.*").toPandas().sort_values(id_col, kind="stable")
    x = np.vstack(found["x"]) if len(found) else np.zeros((0, FEATURES))
    order = np.random.default_rng(1).permutation(len(found))
    return fit_network(x[order], found["_label"].to_numpy()[order] if len(found) else np.zeros(0), vectors)


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, the calibrated probability of label 1) of every whole text; null is an empty text, and an
    empty one is scored like any other. Rows are independent: repeated ones get equal scores, null ids and further columns
    are fine, no rows give no rows. A text of any length is scored whole, in pieces."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_probabilities(shipped.value, batch.column(1)))], [id_col, "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, score double")


def _probabilities(network: Network, texts: pa.Array) -> np.ndarray:
    p = [network.probabilities(pooled(chunk, network.vectors)) for chunk in T.chunks(texts, POOL_BYTES)]
    return np.concatenate(p) if p else np.zeros(0)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were; nothing is shuffled. Learns from those
    of them that have labels outside the held-out fold."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_probabilities(shipped.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(releasing(keep), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, network)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
