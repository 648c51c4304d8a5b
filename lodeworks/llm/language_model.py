"""Log-probabilities of whole documents under a gated recurrent language model, beside an add-one unigram model.

Counts of all words of all training texts are taken in Spark. The recurrent model knows the N_WORDS most frequent words;
the others share a class, inside which a word has its add-one share. It is trained in ROUNDS passes, each over its own
part of the training texts, so that every text is learned from once. A pass deals its texts to workers: every worker trains
on its texts from the same start (truncated backpropagation, in numpy), and Spark averages the workers' parameters. Which
worker gets a text, and their number, follow from the texts alone (a hash, and WORKER_TOKENS), never from files, partitions or
batches; parameters are averaged as whole numbers, whose sum doesn't depend on the order. So scores don't either.

Counts of the FREQUENT most frequent words are broadcast, a table of fixed size. The counts of all others, which grow with
the corpus, are joined to the documents that hold those words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import text as T
from lodeworks.llm.common import fold, written
from lodeworks.llm.gru import Gru, Trainer, log_likelihoods, packed

N_WORDS = 4096
FREQUENT = 1 << 18
ROUNDS = 8
RATES = (0.01, 0.01, 0.01, 0.008, 0.006, 0.004, 0.003, 0.002)
#: Training tokens of a worker in a pass, about. Their number grows with the corpus, what one of them holds doesn't.
WORKER_TOKENS = 250_000
MOST_TASKS = 4096
#: Parameters that travel in one row, workers whose parameters are added up first, and steps of a whole number in one.
SLOT, JOINED, SCALE = 2048, 64, float(1 << 24)
#: Tokens that are scored at a time, or one text.
SCORED_TOKENS = 1 << 20
#: Stands for the end of a text among word hashes.
END = 0x5DEECE66D1F83A27


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): the hash of every word, and END, with its number in all texts. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z folded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [T.words(chunk).hash for chunk in T.chunks(batch.column(0))]
            word, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[T.signed(word), END]), pa.array(np.r_[n, batch.num_rows].astype(np.int64))], ["word", "n"])

    return docs.select(text_col).mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Frequent:
    """The most frequent words: sorted hashes, and count and rank of each."""

    word: np.ndarray
    n: np.ndarray
    rank: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places among the sorted words; -1 for others."""
        if not len(self.word):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        return np.where(self.word[at] == hashes, at, -1)

    def top(self, n: int) -> Frequent:
        own = self.rank < n
        return Frequent(self.word[own], self.n[own], self.rank[own])


@dataclass
class Statistics:
    """N and V of the training tokens; the same of those that the recurrent model doesn't know; texts."""

    tokens: int
    types: int
    other_tokens: int
    other_types: int
    texts: int


def statistics(counts: DataFrame) -> tuple[Frequent, Statistics]:
    """FREQUENT rows at most, a histogram of fixed size and three numbers reach the driver, whatever the corpus. Words that are
    as frequent as those that no longer fit stay out together."""
    level = F.floor(F.log2(F.col("n")) * 64)
    words = counts.where(F.col("word") != END)
    levels = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    fit, least = 0, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        fit += r["n"]
        if fit > FREQUENT:
            least = r["level"] + 1
            break
    top = words.where(level >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("d")).first()
    word, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    known = int(n[:N_WORDS].sum())
    order = np.argsort(word)
    stats = Statistics(total["n"], total["v"], total["n"] - total["d"] - known, total["v"] - (total["d"] > 0) - min(len(n), N_WORDS), total["d"])
    return Frequent(word[order], n[order], order.astype(np.int64)), stats


def _ids(chunk: T.Chunk, vocabulary: Frequent, net: Gru) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a chunk's texts, each with its END, and where each begins, with the end."""
    w = T.words(chunk)
    at = vocabulary.find(w.hash)
    ids = np.where(at < 0, net.other, vocabulary.rank[at] if len(vocabulary.rank) else 0)
    rows = len(w.first) - 1
    first = w.first + np.arange(rows + 1)
    out = np.full(len(ids) + rows, net.end, np.int32)
    out[np.arange(len(ids)) + w.row] = ids
    return out, first


def train(docs: DataFrame, frequent: Frequent, stats: Statistics, text_col: str = "text") -> Gru:
    """ROUNDS passes, each over the texts of its hash class, so over all texts once. Only parameters reach the driver."""
    vocabulary = frequent.top(N_WORDS)
    by_rank = vocabulary.n[np.argsort(vocabulary.rank)]
    net = Gru.start(by_rank, stats.other_tokens, stats.texts)
    texts = written(_tokenised(docs, vocabulary, net, text_col), "token-ids")
    workers = max(1, -(-stats.tokens // (ROUNDS * WORKER_TOKENS)))
    turn_of, worker = F.pmod("h", F.lit(ROUNDS)), F.pmod(F.expr(f"h div {ROUNDS}"), F.lit(workers))
    for turn in range(ROUNDS):
        own = texts.where(turn_of == turn).select(worker.alias("worker"), "h", "ids", "n")
        # A worker's texts are few bytes and much work: adaptive execution is not to put several together.
        net = Gru(net.n_words, _averaged(own.repartition(min(workers, MOST_TASKS), "worker"), net, RATES[turn]))
    return net


def _tokenised(docs: DataFrame, vocabulary: Frequent, net: Gru, text_col: str) -> DataFrame:
    """(h, ids, n): a hash of each text, its token ids in 16 bits, and how often it stands in ``docs``. A text that a great
    many rows share is one row after the partial counts."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                ids, first = _ids(chunk, words.value, net)
                ids = ids.astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, chunk.hi - chunk.lo), pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["h", "ids"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(work, "h long, ids binary").groupBy("h", "ids").agg(F.count(F.lit(1)).alias("n"))


def _averaged(texts: DataFrame, net: Gru, rate: float) -> np.ndarray:
    """The mean of the parameters that the workers reach."""
    n_words, shipped = net.n_words, texts.sparkSession.sparkContext.broadcast(net.theta)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("n", "ascending")])
        ids = [np.frombuffer(b, "<u2").astype(np.int32) for b in table["ids"].to_pylist()]
        size = np.array([len(i) for i in ids])
        own = Trainer(Gru(n_words, shipped.value.copy()), rate)
        own.learn(np.concatenate(ids), np.r_[0, np.cumsum(size)[:-1]], np.repeat(table["n"].to_numpy().astype(np.float32), size))
        whole = np.rint(own.net.theta.astype(np.float64) * SCALE).astype("<i8")
        parts = [whole[lo : lo + SLOT].tobytes() for lo in range(0, len(whole), SLOT)]
        joined = table["worker"][0].as_py() // JOINED
        return pa.table({"joined": pa.array([joined] * len(parts), pa.int64()), "slot": pa.array(range(len(parts)), pa.int32()), "workers": pa.array([1] * len(parts), pa.int64()), "theta": pa.array(parts, pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<i8") for b in table["theta"].to_pylist())
        return pa.table({"joined": table["joined"].slice(0, 1), "slot": table["slot"].slice(0, 1), "workers": pa.array([sum(table["workers"].to_pylist())], pa.int64()), "theta": pa.array([total.tobytes()], pa.binary())})

    schema = "joined long, slot int, workers long, theta binary"
    rows = texts.groupBy("worker").applyInArrow(learn, schema).groupBy("joined", "slot").applyInArrow(added, schema)
    rows = rows.groupBy("slot").applyInArrow(added, schema).toPandas()  # a row for each slot
    out = net.theta.copy()
    for slot, workers, b in zip(rows["slot"], rows["workers"], rows["theta"]):
        out[slot * SLOT : slot * SLOT + len(b) // 8] = np.frombuffer(b, "<i8") / SCALE / workers
    return out


def _scored(docs: DataFrame, net: Gru, frequent: Frequent, stats: Statistics, id_col: str, text_col: str) -> DataFrame:
    """For each row its own key and: tokens, those known, sums of logs over the frequent words, the recurrent model's score
    without the rare words' share in their class, and the rare words with their numbers."""
    sc = docs.sparkSession.sparkContext
    shipped, parameters, n_words = sc.broadcast(frequent), sc.broadcast(net.theta), net.n_words
    base, other = math.log10(stats.tokens + stats.types + 1), math.log10(stats.other_tokens + stats.other_types + 1)
    end_logs = math.log10(stats.texts + 1) - base
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shipped.value, Gru(n_words, parameters.value)
        log_n = np.log10(known.n + 1.0)
        here, at_row = TaskContext.get().partitionId() << 40, 0
        def scored(ids: pa.Array, parts: list) -> pa.RecordBatch:
            nonlocal at_row
            texts, rows, lists = zip(*parts)
            score = log_likelihoods(model, *packed(texts)) / math.log(10)
            n_tokens, n_known, base_sum, inner = (np.concatenate(c) for c in zip(*rows))
            rare = [pa.chunked_array([pa.ListArray.from_arrays(pa.array(e), pa.array(r[k])) for e, *r in lists]).combine_chunks() for k in range(2)]
            keys = here + at_row + np.arange(len(ids))
            at_row += len(ids)
            return pa.RecordBatch.from_arrays([pa.array(keys), ids, pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base_sum), pa.array(score + inner), *rare], ["_key", "_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

        for batch in batches:
            parts, held, began = [], 0, 0
            for chunk in T.chunks(batch.column(1)):
                w = T.words(chunk)
                at = known.find(w.hash)
                n = len(w.first) - 1
                sums = lambda values, own=w.row, n=n: np.bincount(own, weights=values, minlength=n)
                hit = at >= 0
                own_log = np.where(hit, log_n[at] if len(log_n) else 0.0, 0.0)
                ids = np.where(hit, known.rank[at] if len(log_n) else 0, n_words)
                outside = ids >= n_words
                ids = np.minimum(ids, n_words)
                n_tokens = np.diff(w.first)
                base_sum = sums(own_log) - n_tokens * base + end_logs
                inner = sums(np.where(outside, own_log - other, 0.0))
                full = np.full(len(ids) + n, model.end, np.int32)
                full[np.arange(len(ids)) + w.row] = ids
                rare, of = w.hash[~hit], w.row[~hit]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                new = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])]) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.r_[new, len(rare)])
                ends = np.r_[0, np.cumsum(np.bincount(of[new], minlength=n))].astype(np.int32)
                parts.append(((full, w.first + np.arange(n + 1)), (n_tokens + 1, sums(hit) + (stats.texts > 0), base_sum, inner), (ends, T.signed(rare[new]), times.astype(np.int32))))
                held += len(full)
                if held >= SCORED_TOKENS:
                    yield scored(batch.column(0).slice(began, chunk.hi - began), parts)
                    parts, held, began = [], 0, chunk.hi
            if parts:
                yield scored(batch.column(0).slice(began), parts)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"_key long, _id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>")


def language_model_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text of ``docs`` by models of the texts of ``training``.

    One row for each row of ``docs``: id, n_tokens (words and one end), n_known (those that training has), train_tokens,
    base_score (log10 probability by add-one unigram counts), score (the recurrent model's log10 probability of the whole
    text, its state carried to the end). Null is an empty text, which has its end. Repeated rows are scored each; null
    ids and further columns are fine; no rows give no rows. Without training texts both models know only unseen words.
    The same texts give the same scores however they are partitioned or ordered, but for the last digits of sums.
    """
    counts = written(count_words(training, text_col), "word-counts")
    frequent, stats = statistics(counts)
    net = train(training, frequent, stats, text_col)
    rows = written(_scored(docs, net, frequent, stats, id_col, text_col), "scored")
    rare = rows.select("_key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    # Words that training lacks add log10(1) = 0. One of them may stand in very many texts; both sides are tables that are
    # exchanged for this join alone, so that adaptive execution splits such a key.
    found = rare.join(counts, "word").groupBy("_key").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_logs"))
    out = rows.drop("rare", "times").join(found, "_key", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    # The class of other words has the same logs, and its own total; that total is counted for the rare words already.
    return out.select(F.col("_id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(stats.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 7) == 2
    scored = language_model_scores(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_language_model": op8_language_model}
