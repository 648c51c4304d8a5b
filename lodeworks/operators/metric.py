"""Vectors in blocks by distance to pivots, and the pairs of blocks that can hold near vectors.

Some rows, far from each other, become pivots. A row goes to its nearest pivot; the rows of a pivot are cut by their distance from it
into rings of one block or less. A block knows, for every pivot, the least and greatest distance of its rows from it. By the
triangle inequality two rows differ at least by the difference of their distances to any pivot, so the gap between the ranges of two blocks
is a lower bound for all their pairs, and blocks farther apart than the question asks are never brought together.

Bounds come from summaries of blocks, a thousandth of the rows, which are compared in groups; the table itself moves only where a pair of
blocks is left. Blocks meet in cells of two stripes of STRIPE_BYTES at most, so that a block moves once for a stripe, not once for each block that it
meets. Neither a pair of rows nor the table ever stands in one place.

In a cell a product of matrices tells which pairs of rows can't be within reach, by a bound for its rounding; distances themselves are taken by
differences, of the few pairs that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodeworks.functions.storage import materialised

BLOCK = 1024
#: Blocks that a partition of an index has, about.
DEALT = 8
#: Pivots at most, and the rows, picked by a hash, that they are chosen from.
PIVOTS, SAMPLE = 128, 4096
#: Summaries of blocks that are compared at a time.
GROUP = 256
#: Stripes that a table is cut into at least, where each has STRIPE_ROWS rows; bytes of vectors that one has at most, about.
STRIPES, STRIPE_ROWS, STRIPE_BYTES = 12, 2048, 64 << 20
#: Rows of a block that are held against another block at a time.
CHUNK = 512


@dataclass
class Index:
    """``blocks``: (block, n, keys, weights, x, low, high), the last five packed as int64 and double; ``n_blocks`` of them, of ``n`` rows."""

    blocks: DataFrame
    n_blocks: int
    dim: int
    pivots: np.ndarray
    n: int

    @property
    def stripes(self) -> int:
        return max(1, min(self.n_blocks, max(-(-self.n * self.dim * 8 // STRIPE_BYTES), min(STRIPES, self.n // STRIPE_ROWS))))

    def stripe(self, block: str, parts: int) -> Column:
        """The stripe of a block, which rises with its number."""
        place = F.shiftright(block, 32) * DEALT + F.least(F.col(block).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(DEALT - 1))
        return F.floor(place * self.stripes / (parts * DEALT)).cast("int")


@dataclass
class Block:
    """A block in a task: rows in order of keys."""

    number: int
    keys: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    extra: bytes | None

    @cached_property
    def squares(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x, self.x)

    @cached_property
    def top(self) -> float:
        return float(self.squares.max(initial=0))

    @cached_property
    def left(self) -> np.ndarray:
        return np.concatenate([self.x, np.ones((len(self.x), 1))], 1)

    @cached_property
    def right(self) -> np.ndarray:
        return np.concatenate([self.x, -self.squares[:, None] / 2], 1)

    @cached_property
    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """``left`` and ``right`` in single precision."""
        return self.left.astype(np.float32), self.right.astype(np.float32)


class Product:
    """x y - y y / 2 of some rows x of a block and all rows y of another, which is x x / 2 less half their squared distance, and what it says of distances.
    In single precision, unless squares of lengths would come near the ends of its range."""

    def __init__(self, a: Block, at: np.ndarray, b: Block):
        self.a, self.at, self.b = a, at, b
        single = 1e-12 < b.top < 1e30 and a.top < 1e30
        self.value = a.short[0][at] @ b.short[1].T if single else a.left[at] @ b.right.T
        # No squared distance is farther from the one by differences than this, however either, or a limit, was rounded.
        self.slack = (1e-6 if single else 2e-15) * (a.x.shape[1] + 4) * (a.squares[at] + b.top)

    def _from(self, limit: np.ndarray) -> np.ndarray:
        hit = self.value >= limit.astype(self.value.dtype)[:, None]
        if not np.isfinite(self.slack).all():  # what overflowed may be near
            hit = ~(self.value < limit[:, None])
        return hit

    def possible(self, reach: np.ndarray) -> np.ndarray:
        """Which pairs may be within ``reach`` of their rows."""
        return self._from((self.a.squares[self.at] - reach * reach - self.slack) / 2)

    def sure(self, reach: np.ndarray) -> np.ndarray:
        return self.value >= ((self.a.squares[self.at] - reach * reach + self.slack) / 2).astype(self.value.dtype)[:, None]

    def first(self, k: int) -> np.ndarray:
        """Which pairs may be among the k nearest of their rows."""
        n = self.value.shape[1]
        if n <= k:
            return np.ones(self.value.shape, bool)
        return self._from(np.partition(self.value, n - k, axis=1)[:, n - k] - self.slack)

    def exact(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return beside_distances(self.a.x, self.at[p], self.b.x, q)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, by differences: the same for a pair whichever way round it is taken."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d][:, None] - b[:, d][None]) ** 2
    return np.sqrt(out)


def places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table of flags of which few are set."""
    rows = np.flatnonzero(hit.any(1))
    p, q = np.nonzero(hit[rows])
    return rows[p], q


def beside_distances(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``distances`` of the rows p of ``a`` from the rows q of ``b``, one pair each, to the last digit."""
    out = np.zeros(len(p))
    for lo in range(0, len(p), 4096):
        x, y, part = a[p[lo : lo + 4096]], b[q[lo : lo + 4096]], out[lo : lo + 4096]
        for d in range(a.shape[1]):
            part += (x[:, d] - y[:, d]) ** 2
    return np.sqrt(out)


def all_distances(a: Block, at: np.ndarray, b: Block) -> np.ndarray:
    """``distances`` of rows of ``a`` from all rows of ``b``, by a product where that leaves ten digits, else by differences."""
    scale = a.squares[at][:, None] + b.squares[None]
    squared = scale - 2 * (a.x[at] @ b.x.T)
    p, q = places(~(squared > 1e-3 * scale))
    d = np.sqrt(np.maximum(squared, 0))
    d[p, q] = beside_distances(a.x, at[p], b.x, q)
    return d


def whole(vector: Column) -> Column:
    """True for vectors without a missing component."""
    x = vector.cast("array<double>")
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)) & (F.size(x) > 0)


def padded(vector: Column, dim: int) -> Column:
    x = vector.cast("array<double>")
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(x), F.lit(0))))


def pivots_of(rows: DataFrame, dim: int, block: int = BLOCK) -> np.ndarray:
    """A pivot for each block of rows, PIVOTS at most: rows of a sample, each the farthest from those before it."""
    n = rows.count()
    most = min(PIVOTS, max(1, n // block))
    sample = rows.orderBy(F.xxhash64("k"), "k").select("x").limit(SAMPLE if most > 1 else 1).collect()
    x = np.array([r["x"] for r in sample], float).reshape(-1, dim)
    chosen, gap = x[:1], np.full(len(x), np.inf)
    while len(chosen) < min(most, len(x)):
        gap = np.minimum(gap, distances(x, chosen[-1:])[:, 0])
        if not gap.max():
            break
        chosen = np.concatenate([chosen, x[[gap.argmax()]]])
    return chosen


_BLOCK_SCHEMA = "block long, n long, keys binary, weights binary, x binary, low binary, high binary"


def index(rows: DataFrame, dim: int, pivots: np.ndarray, block: int = BLOCK) -> Index:
    """The index of ``rows`` (k long, w long, x array<double> of ``dim`` components); a block has its rows in order of k."""
    n = rows.count()
    shipped = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                d = distances(part.column(2).flatten().to_numpy().reshape(-1, dim), shipped.value)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array(d[np.arange(len(own)), own])], ["k", "w", "x", "p", "d"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, pivot = TaskContext.get().partitionId() << 32, [], None

        def full() -> pa.RecordBatch:
            nonlocal number, held
            k, w, x = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(k, kind="stable")
            k, w, x = k[order], w[order], x[order]
            d = distances(x, shipped.value)
            out = [[number], [len(k)], *([a.tobytes()] for a in (k, w, x, d.min(0), d.max(0)))]
            number, held = number + 1, []
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["block", "n", "keys", "weights", "x", "low", "high"])

        for batch in batches:
            k, w, p = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(-1, dim)
            edges = [*np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), len(p)] if len(p) else []
            for lo, hi in zip(edges, edges[1:]):
                if held and p[lo] != pivot:
                    yield full()
                pivot = p[lo]
                while lo < hi:
                    end = min(hi, lo + block - sum(len(h[0]) for h in held))
                    held.append((k[lo:end], w[lo:end], x[lo:end]))
                    lo = end
                    if sum(len(h[0]) for h in held) >= block:
                        yield full()
        if held:
            yield full()

    placed = rows.select("k", "w", "x").mapInArrow(place, "k long, w long, x array<double>, p long, d double")
    dealt = placed.repartitionByRange(max(1, -(-n // (DEALT * block))), "p", "d", "k").sortWithinPartitions("p", "d", "k")
    blocks = materialised(dealt.mapInArrow(pack, _BLOCK_SCHEMA), "blocks")
    return Index(blocks, blocks.count(), dim, pivots, n)


def unpacked(data: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(data, kind)


def lower_bounds(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """The least distance that blocks with these ranges (a row each) can have, less what rounding may add."""
    out = np.zeros((len(low), len(other_low)))
    for p in range(low.shape[1]):
        np.maximum(out, low[:, p][:, None] - other_high[:, p][None], out=out)
        np.maximum(out, other_low[:, p][None] - high[:, p][:, None], out=out)
    return np.maximum(out - 1e-9 * (1 + max(high.max(initial=0), other_high.max(initial=0))), 0)


def _grouped(summaries: DataFrame, n: int) -> tuple[DataFrame, int]:
    groups = max(1, -(-n // GROUP))
    dealt = summaries.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").agg(F.collect_list(F.struct(*summaries.columns)).alias("rows")), groups  # about GROUP summaries each


def near_blocks(left: Index, right: Index, limits: DataFrame | float, first: int | None = None, once: bool = False, parts: DataFrame | None = None) -> DataFrame:
    """(a, b, bound): pairs of blocks with a lower bound of their distance within the limit of ``a``.

    ``limits`` is a number for all, or a table (block, limit, after_bound, after_b), of which only pairs behind the last two in order of
    (bound, b) are taken. ``first``: only so many for each ``a``, the nearest. ``once``: of the pairs of an index with itself each way round
    one, and each block with itself. ``parts`` (block, part): two blocks of one part, if it isn't null, don't meet."""
    own, other = left.blocks.select("block", "low", "high"), right.blocks.select("block", "low", "high")
    own, other = (t.withColumn("part", F.lit(None).cast("long")) if parts is None else t.join(parts, "block", "left") for t in (own, other))
    if isinstance(limits, DataFrame):
        own = own.join(limits, "block")
    else:
        own = own.select("*", F.lit(float(limits)).alias("limit"), F.lit(-1.0).alias("after_bound"), F.lit(-1).cast("long").alias("after_b"))
    a, _ = _grouped(own, left.n_blocks)
    b, groups = _grouped(other, right.n_blocks)
    met = a.select(F.col("rows").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")).join(b.select("g", F.col("rows").alias("b")), "g").select("a", "b")

    def matrix(rows: pa.StructArray, name: str) -> np.ndarray:
        return np.stack([unpacked(v.as_py()) for v in rows.field(name)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column(0)[i].values, batch.column(1)[i].values
                ids, others = x.field("block").to_numpy(), y.field("block").to_numpy()
                bound = lower_bounds(matrix(x, "low"), matrix(x, "high"), matrix(y, "low"), matrix(y, "high"))
                after, last = x.field("after_bound").to_numpy()[:, None], x.field("after_b").to_numpy()[:, None]
                good = (bound <= x.field("limit").to_numpy()[:, None]) & ((bound > after) | (bound == after) & (others[None] > last))
                one, two = (s.field("part").fill_null(-1).to_numpy() for s in (x, y))
                good &= (one[:, None] != two[None]) | (one < 0)[:, None]
                if once:
                    good &= ids[:, None] <= others[None]
                if first is not None:
                    order = np.lexsort((np.broadcast_to(others, bound.shape), np.where(good, bound, np.inf)), axis=1)[:, :first]
                    keep = np.zeros_like(good)
                    np.put_along_axis(keep, order, True, axis=1)
                    good &= keep
                p, q = np.nonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.array(others[q]), pa.array(bound[p, q])], ["a", "b", "bound"])

    pairs = met.mapInArrow(work, "a long, b long, bound double")
    if first is not None:
        order = Window.partitionBy("a").orderBy("bound", "b")
        pairs = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first).drop("_n")
    return materialised(pairs, "block-pairs")


def brought_together(pairs: DataFrame, left: Index, right: Index, beside: DataFrame | None = None, both: bool = False) -> DataFrame:
    """(a, b, a_keys, a_weights, a_x, b_keys, b_weights, b_x, bound) of every pair; with ``beside`` (block, extra binary) also a_extra
    and, if ``both``, b_extra, null where a block has none."""

    def side(blocks: DataFrame, s: str, extra: bool) -> DataFrame:
        names = ["keys", "weights", "x"]
        if extra:
            blocks, names = blocks.join(beside, "block", "left"), [*names, "extra"]
        return blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in names])

    return pairs.join(side(left.blocks, "a", beside is not None), "a").join(side(right.blocks, "b", beside is not None and both), "b")


def together(pairs: DataFrame, left: Index, right: Index, work: Callable[[list[tuple[Block, list[tuple[Block, float]]]]], Iterator[pa.RecordBatch]], schema: str, beside: DataFrame | None = None, both: bool = False) -> DataFrame:
    """What ``work`` makes of the pairs (a, b, bound) of blocks, a cell at a time: for each block of ``left`` its partners, those of the least bound first.
    With ``beside`` (block, extra binary) the blocks of ``left``, if ``both`` those of ``right`` too, have ``extra``, None where there is no row for them.

    A cell is all pairs of two stripes, and is given to ``work`` once. Of a stripe only blocks that have a partner in the other are sent."""
    parts = [ix.blocks.agg(F.coalesce(F.max(F.shiftright("block", 32)), F.lit(0))).first()[0] + 1 for ix in (left, right)]
    cells = pairs.select(left.stripe("a", parts[0]).alias("ga"), right.stripe("b", parts[1]).alias("gb"), "a", "b", "bound")
    none = F.lit(None).cast("binary")

    def side(ix: Index, s: str, kind: int, extra: bool) -> DataFrame:
        blocks = ix.blocks.select("block", "keys", "weights", "x")
        blocks = blocks.join(beside, "block", "left") if extra else blocks.withColumn("extra", none)
        needed = cells.select("ga", "gb", F.col(s).alias("block")).distinct()
        return needed.join(blocks, "block").select("ga", "gb", F.lit(kind).alias("kind"), "block", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("bound"), "keys", "weights", "x", "extra")

    met = cells.select("ga", "gb", F.lit(0).alias("kind"), F.col("a").alias("block"), F.col("b").alias("other"), "bound", none.alias("keys"), none.alias("weights"), none.alias("x"), none.alias("extra"))
    rows = met.union(side(left, "a", 1, beside is not None)).union(side(right, "b", 2, beside is not None and both))
    own, dim = to_arrow_schema(StructType.fromDDL(schema)), left.dim

    def cell(table: pa.Table) -> pa.Table:
        kind, number = table["kind"].to_numpy(), table["block"].to_numpy()
        blocks: dict[tuple[int, int], Block] = {}
        for i in np.flatnonzero(kind):
            k, w, x, extra = (table[c][int(i)].as_py() for c in ("keys", "weights", "x", "extra"))
            blocks[int(kind[i]), int(number[i])] = Block(int(number[i]), unpacked(k, np.int64), unpacked(w, np.int64), unpacked(x).reshape(-1, dim), extra)
        at = np.flatnonzero(kind == 0)
        a, b, bound = number[at], table["other"].take(at).to_numpy(), table["bound"].take(at).to_numpy()
        partners: dict[int, list[tuple[Block, float]]] = {}
        for i in np.lexsort((b, bound, a)):
            partners.setdefault(int(a[i]), []).append((blocks[2, int(b[i])], float(bound[i])))
        return pa.Table.from_batches(list(work([(blocks[1, n], others) for n, others in partners.items()])), own)

    # Three partitions a cell, as cells meet by chance in one.
    return rows.repartition(3 * left.stripes * right.stripes, "ga", "gb").groupBy("ga", "gb").applyInArrow(cell, schema)
