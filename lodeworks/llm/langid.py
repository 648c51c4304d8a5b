"""Language identification by error-correcting output codes over binary n-gram classifiers.

Every language owns a codeword of bits. For each bit there is a binary naive-Bayes classifier on hashed byte trigrams:
the log-odds of a trigram between the languages whose bit is 1 and those whose bit is 0. Their counts are taken over
all training texts in one pass. A text's margins, one for each bit, are held against every codeword: a wrong bit costs
its logistic loss, weighted by how well the bit told its two sides apart in training, and the cheapest codeword wins.
A second codeword about as cheap flags the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import text as T
from lodeworks.llm.common import fold, releasing

BUCKETS = 1 << 14
UNDETERMINED = "und"
#: Up to so many languages get the exhaustive code of 2**(n-1) - 1 bits, 31 of them; its length doubles with each further
#: language, so more get random codewords of 10 log2(n) bits. It depends on the number of languages alone, never on the corpus.
EXHAUSTIVE = 6

_letters = np.full(256, 0x20, np.uint8)
_letters[0x61:0x7B] = np.arange(0x61, 0x7B)
_letters[0x41:0x5B] = np.arange(0x61, 0x7B)
_letters[0x80:] = np.arange(0x80, 0x100)
_is_ascii_letter = np.zeros(256, bool)
_is_ascii_letter[0x41:0x5B] = _is_ascii_letter[0x61:0x7B] = True


def trigrams(chunk: T.Chunk) -> np.ndarray:
    """The bucket of the trigram at each byte; BUCKETS where a row ends before the trigram does. Digits, signs and
    spaces are one symbol, A-Z is folded."""
    n = len(chunk.data)
    t = _letters[chunk.data].astype(np.uint32)
    out = np.full(n, BUCKETS, np.int32)
    if n >= 3:
        code = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:]
        out[:-2] = (code * np.uint32(2654435761)) >> np.uint32(18)
    ends = chunk.offsets[1:]
    for back in (1, 2):
        at = ends - back
        out[at[(at >= chunk.offsets[:-1]) & (at >= 0)]] = BUCKETS
    return out


def long_counts(chunk: T.Chunk) -> np.ndarray:
    """How often each trigram stands in a chunk of one long text, taken piece by piece."""
    total, n = np.zeros(BUCKETS + 1, np.int64), len(chunk.data)
    for lo in range(0, n, T.CHUNK_BYTES):
        hi = min(n, lo + T.CHUNK_BYTES + 2)  # the last two trigrams of a piece reach into the next one
        piece = chunk.data[lo:hi]
        total += np.bincount(trigrams(T.Chunk(0, 1, piece, np.array([0, len(piece)]))), minlength=BUCKETS + 1)
    return total


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1 and -1. Up to EXHAUSTIVE: every split of the languages in two, once. More: the best of 200 random
    codes of 10 log2(n) bits, by the smallest distance of two rows."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        apart = (code.astype(int) @ code.T.astype(int) - bits * np.eye(n, dtype=int) * 2).max()
        if best is None or -apart > most:
            best, most = code, -apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS + 1 x bits, the last row 0
    bit_weight: np.ndarray

    def margins(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """For each row the summed log-odds of each bit over the square root of its trigrams, and their number."""
        rows, width = chunk.hi - chunk.lo, self.weights.shape[1]
        sums = np.zeros((rows, width))
        if rows == 1 and len(chunk.data) > T.CHUNK_BYTES:  # one long text: by counts
            sums[0] = long_counts(chunk)[:BUCKETS] @ self.weights[:BUCKETS].astype(np.float64)
        elif len(full := np.flatnonzero(np.diff(chunk.offsets) > 0)):
            sums[full] = np.add.reduceat(self.weights[trigrams(chunk)], chunk.offsets[:-1][full], axis=0, dtype=np.float64)
        n = np.maximum(np.diff(chunk.offsets) - 2, 1)
        return sums / np.sqrt(n)[:, None], n

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability, and the probability of the second."""
        agree = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -agree) * self.bit_weight).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        at = np.arange(len(p))
        second = p[at, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[at, order[:, 0]], second


def count_trigrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all rows that have a language; each task sends its own sums only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for chunk in T.chunks(batch.column(0)):
                own = langs[chunk.lo : chunk.hi]
                if len(own) == 1 and len(chunk.data) > T.CHUNK_BYTES:
                    sums[str(own[0])] = sums.get(str(own[0]), 0) + long_counts(chunk)[:BUCKETS]
                    continue
                grams = trigrams(chunk)
                names, code = np.unique(own.astype(str), return_inverse=True)
                of_byte = np.repeat(code, np.diff(chunk.offsets))
                for k, name in enumerate(names):
                    found = np.bincount(grams[of_byte == k], minlength=BUCKETS + 1)[:BUCKETS]
                    sums[name] = sums.get(name, 0) + found
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at].astype(np.int64))], ["lang", "bucket", "n"])

    counted = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col).mapInArrow(work, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Trains on all rows with a text and a language; None without any. What reaches the driver is a row for each
    language and bucket, whatever the number of texts."""
    found = count_trigrams(docs, text_col, lang_col).toPandas()
    if not len(found):
        return None
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}), found["bucket"]] = found["n"]
    code = codewords(len(langs))
    # Each language counts the same on its side of a bit, however much text it has.
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weights = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    apart = np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, other = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(one) and len(other):
            odds = np.log(one.mean(0)) - np.log(other.mean(0))
            weights[:BUCKETS, b] = odds
            # The mean margin of the weakest language on each side: how surely the bit tells them apart.
            apart[b] = max(min(*(one @ odds), *(-(other @ odds))), 0.01)
    return Model(langs, code, weights, apart / apart.mean())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", ambiguous_over: float = 0.25) -> DataFrame:
    """The language of every whole text: id, lang_pred, score, ambiguous.

    lang_pred is one of the learned languages; ``und`` with score 0 if the text is null, empty or has no letter, or if
    nothing was learned. score is the winner's share of exp(-loss) over all codewords (0 to 1); ambiguous is true if
    the second has more than ``ambiguous_over``. Rows are independent: repeated ones get equal results, null ids and further
    columns are fine, no rows give no rows. A text of any length is read whole, in pieces. Ties go to the language first in
    the alphabet.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = _languages(shipped.value, batch.column(1), ambiguous_over)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [id_col, "lang_pred", "score", "ambiguous"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")


def _languages(model: Model | None, texts: pa.Array, ambiguous_over: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    lang, score, unsure = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
    for chunk in T.chunks(texts) if model is not None else ():
        at = np.flatnonzero(_is_ascii_letter[chunk.data])
        has = np.diff(np.searchsorted(at, chunk.offsets)) > 0
        for r in np.flatnonzero(~has & (np.diff(chunk.offsets) > 0)):
            has[r] = any(map(str.isalpha, texts[chunk.lo + int(r)].as_py()))
        best, p, second = model.decode(model.margins(chunk)[0])
        at = chunk.lo + np.flatnonzero(has)
        lang[at] = np.array(model.langs, object)[best[has]]
        score[at], unsure[at] = p[has], second[has] > ambiguous_over
    return lang, score, unsure


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts all."""
    model = fit(docs.where(fold("doc_id", 5) != 0))
    return identify(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)


def keep_identified(docs: DataFrame, min_score: float = 0.4, ambiguous_over: float = 0.25, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined, all columns as they were; nothing is shuffled. Those without go:
    ``und``, and ambiguous ones that reach less than ``min_score``."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs.where(fold("doc_id", 5) != 0), text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure = _languages(shipped.value, batch.column(at), ambiguous_over)
            yield batch.filter(pa.array((lang != UNDETERMINED) & ~(unsure & (score < min_score)), pa.bool_()))

    return docs.mapInArrow(releasing(keep), docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return learn_and_identify(docs).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op4_langid": op4_langid}
