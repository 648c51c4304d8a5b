"""Near-duplicate vectors by collision counting over one-dimensional projections.

SIGNS random directions are drawn. Two unit vectors at the threshold's distance differ along a direction by a normal variate
of that distance (times the root of the dimension), so along PROJECTIONS of the directions a window of WIDTH such distances,
centred on the query, mostly holds the other one; and they mostly lie on the same side of a direction. Both are counted: a
pair with enough sides and enough window collisions in common, numbers calibrated so that a true pair has fewer with a
chance below MISS, is verified by its cosine in double precision.

Windows of one projection hold a fixed share of all vectors, so pairs are not looked for along whole lines. Vectors meet in
cells: a table of cells deals them by their sides of some directions, as many as bring a cell down to about CELL vectors; there
are as many tables, each with directions of its own, as a pair at the threshold needs to share a cell in one of them but
for a chance of LOST (``tables``). So the work grows with n to the power of about 1.3 (8 tables at 65,000 vectors, 57 at 67 million), not with its square. A pair counts in the
first table in which it shares a cell, hence once. Up to CELL vectors there is one cell, and nothing can be lost.

Equal vectors are one node from the start. What moves between tasks is a node's number, its sides and its places along the
projections, 40 bytes; vectors follow only for nodes with a candidate. In a cell the nodes are sorted by the first projection
and packed into blocks; blocks of one cell within a window of each other meet. A task returns numbers of links, and a
forest of its links, so that no pair of vectors ever leaves it: a group of copies of any size costs rows in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.joins import spread_join
from lodeworks.llm.common import written
from lodeworks.llm.components import smallest_reached
from lodeworks.operators.graph import components

SIGNS = 128
PROJECTIONS = 16
WIDTH = 2.5
#: Chances that a pair at the threshold has too few collisions, of either kind, and that it shares no cell.
MISS = 1e-4
LOST = 1e-3
CELL = 4096
#: Nodes of a cell that one task takes at a time. Most cells are smaller; those of a large group of near vectors are not.
BLOCK = 8192
#: Steps of a projection's scale in half a window; one more is added, for rounding.
STEPS = 27
_LOWEST, _HIGHEST = 38, 216  # so that differences in eight bits are never taken for others
#: Bytes of vectors that one verifying task takes.
GROUP_BYTES = 8 << 20


def window(threshold: float) -> float:
    """Half the width of a window: WIDTH times the distance of two unit vectors at the threshold."""
    return WIDTH * math.sqrt(max(2 - 2 * threshold, 1e-12))


def _exceeded(n: int, p: float, miss: float) -> int:
    """The smallest k that Binomial(n, p) exceeds with a chance below ``miss``."""
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if 1 - total < miss:
            return k
    return n


def misses_allowed() -> int:
    """Windows without a collision that a pair may have."""
    return _exceeded(PROJECTIONS, math.erfc(WIDTH / math.sqrt(2)), MISS)


def sides_allowed(threshold: float) -> int:
    """Directions that a pair may lie on different sides of."""
    return _exceeded(SIGNS, math.acos(min(threshold, 1.0)) / math.pi, MISS)


def tables(n: int, threshold: float, cell: int | None = None, seed: int = 31) -> np.ndarray:
    """For each table the directions whose sides deal ``n`` nodes to cells, as bits of two words. There are as many tables as leave at most LOST
    of 200,000 drawn pairs at the threshold without a common cell."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / (cell or CELL))))
    if not bits:
        return np.zeros((1, SIGNS // 64), np.uint64)
    rng = np.random.default_rng(seed)
    apart = rng.random((200_000, SIGNS)) < math.acos(min(threshold, 1.0)) / math.pi
    out = []
    while len(apart) > LOST * 200_000:
        own = np.isin(np.arange(SIGNS), rng.choice(SIGNS, min(bits, SIGNS), replace=False))
        out.append(_words(own[None])[0])
        apart = apart[apart[:, own].any(1)]
    return np.stack(out)


def _words(sides: np.ndarray) -> np.ndarray:
    """Rows of SIGNS booleans as rows of words."""
    return np.packbits(sides, axis=1, bitorder="little").view("<u8")


def directions(dim: int, seed: int = 23) -> np.ndarray:
    """Random unit directions, times the root of the dimension."""
    d = np.random.default_rng(seed).normal(size=(dim, SIGNS))
    return d / np.linalg.norm(d, axis=0) * math.sqrt(dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides (bits of words) and places (a byte for each projection) of the rows of x."""
    p = unit(x) @ directions(x.shape[1])
    middle = (_LOWEST + _HIGHEST) / 2
    places = np.clip(np.rint(middle + p[:, :PROJECTIONS] * (STEPS / window(threshold))), _LOWEST, _HIGHEST)
    return _words(p > 0), places.astype(np.uint8)


def candidates(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs of ``a`` and ``b`` (sides, places; in order of the first place) with collisions enough; ``same``: a is b,
    each pair once."""
    (side_a, place_a), (side_b, place_b) = a, b
    reach = STEPS + 1
    sides, misses = sides_allowed(threshold), misses_allowed()
    line = place_b[:, 0].astype(np.int16)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(side_a), 256):
        own = place_a[at : at + 256, 0].astype(np.int16)
        # Windows of the first projection that follow each other: one run. It alone reaches a step further.
        left, right = int(np.searchsorted(line, own[0] - 2 * reach)), int(np.searchsorted(line, own[-1] + 2 * reach, side="right"))
        left = max(left, at) if same else left
        for lo in range(left, right, 4096):
            hi = min(right, lo + 4096)
            apart = np.zeros((len(own), hi - lo), np.uint8)
            for w in range(SIGNS // 64):
                apart += np.bitwise_count(side_a[at : at + 256, w][:, None] ^ side_b[lo:hi, w][None])
            p, q = np.nonzero(apart <= sides)
            p, q = p + at, q + lo
            if same:
                p, q = p[q > p], q[q > p]
            for k in range(0, len(p), 65536):
                i, j = p[k : k + 65536], q[k : k + 65536]
                outside = (place_b[j] - (place_a[i] - np.uint8(reach)) > np.uint8(2 * reach)).sum(1)
                out_a.append(i[outside <= misses])
                out_b.append(j[outside <= misses])
    return np.concatenate(out_a), np.concatenate(out_b)


def first_shared(apart: np.ndarray, table: int, masks: np.ndarray) -> np.ndarray:
    """Whether ``table`` is the first one in which pairs with these different sides share a cell."""
    good = ((apart & masks[table]) == 0).all(1)
    for earlier in masks[:table]:
        good[good] = ((apart[good] & earlier) != 0).any(1)
    return good


_BLOCK_SCHEMA = "block long, t int, code long, lo int, hi int, data binary"
_ROW = np.dtype([("no", "<i8"), ("sides", "<u8", SIGNS // 64), ("places", "u1", PROJECTIONS)])


def _coded(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(no, s0, s1, places) of the nodes of one length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                sides, places = codes(_matrix(part.column(1), dim), threshold)
                words = [pa.array(np.ascontiguousarray(sides[:, w]).view(np.int64)) for w in range(SIGNS // 64)]
                yield pa.RecordBatch.from_arrays([part.column(0), *words, pa.array([r.tobytes() for r in places], pa.binary())], ["no", "s0", "s1", "places"])

    return nodes.select("no", "x").mapInArrow(work, "no long, s0 long, s1 long, places binary")


def _blocks(coded: DataFrame, masks: np.ndarray, n: int) -> DataFrame:
    """Rows of _BLOCK_SCHEMA: up to BLOCK nodes of a cell, neighbours in the first projection, ``data`` packed as _ROW."""
    own = lambda m: F.xxhash64(*[F.col(f"s{w}").bitwiseAND(F.lit(int(x)).cast("long")) for w, x in enumerate(m.view(np.int64))])
    cells = F.array(*[F.struct(F.lit(t).alias("t"), own(m).alias("code")) for t, m in enumerate(masks)])
    place = F.conv(F.hex(F.substring("places", 1, 1)), 16, 10).cast("int")
    posted = coded.select("no", "s0", "s1", "places", place.alias("p"), F.explode(cells).alias("c")).select("c.t", "c.code", "p", "no", "s0", "s1", "places")
    dealt = posted.repartitionByRange(max(1, -(-n * len(masks) // (8 * BLOCK))), "t", "code", "p", "no").sortWithinPartitions("t", "code", "p", "no")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, cell = TaskContext.get().partitionId() << 32, [], None

        def block() -> pa.RecordBatch:
            nonlocal number
            rows = np.concatenate(held)
            ends = rows["places"][[0, -1], 0].astype(int)
            out = [[number], [cell[0]], [cell[1]], [int(ends[0])], [int(ends[1])], [rows.tobytes()]]
            number += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["block", "t", "code", "lo", "hi", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, code = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = np.zeros(batch.num_rows, _ROW)
            rows["no"] = batch.column(3).to_numpy()
            for w in range(SIGNS // 64):
                rows["sides"][:, w] = batch.column(4 + w).to_numpy().view(np.uint64)
            rows["places"] = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, PROJECTIONS)
            edges = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (code[1:] != code[:-1])])
            for lo, hi in zip(edges, [*edges[1:], len(t)]):
                if held and cell != (t[lo], code[lo]):
                    yield block()
                    held = []
                cell = (t[lo], code[lo])
                while lo < hi:
                    room = BLOCK - sum(map(len, held))
                    held.append(rows[lo : min(hi, lo + room)])
                    lo += room
                    if sum(map(len, held)) >= BLOCK:
                        yield block()
                        held = []
        if held:
            yield block()

    return dealt.select("t", "code", "p", "no", "s0", "s1", "places").mapInArrow(pack, _BLOCK_SCHEMA)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_HIT_SCHEMA = "a long, b long, t int, left boolean, no long, s0 long, s1 long"


def _hits(blocks: DataFrame, masks: np.ndarray, threshold: float) -> DataFrame:
    """Rows of _HIT_SCHEMA: the nodes of a pair of blocks that have a candidate there, each side of them once."""

    def found(a: int, b: int, t: int, left: bytes, right: bytes) -> Iterator[pa.RecordBatch]:
        x, y = np.frombuffer(left, _ROW), np.frombuffer(right, _ROW)
        i, j = candidates((x["sides"], x["places"]), (y["sides"], y["places"]), threshold, a == b)
        good = first_shared(x["sides"][i] ^ y["sides"][j], t, masks)
        i, j = np.unique(i[good]), np.unique(j[good])
        for rows, at, is_left in ((x, i, True), (y, j, False)):
            if len(at):
                fixed = [pa.array(np.full(len(at), v), k) for v, k in ((a, pa.int64()), (b, pa.int64()), (t, pa.int32()), (is_left, pa.bool_()))]
                words = [pa.array(np.ascontiguousarray(rows["sides"][at, w]).view(np.int64)) for w in range(SIGNS // 64)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(rows["no"][at]), *words], ["a", "b", "t", "left", "no", "s0", "s1"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, t, data = (batch.column(c)[r].as_py() for c in range(3))
                yield from found(block, block, t, data, data)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield from found(*(batch.column(c)[r].as_py() for c in range(5)))

    own = blocks.select("block", "t", "data").mapInArrow(alone, _HIT_SCHEMA)
    # Blocks of one cell within a window of each other, by the parts of the line that they reach.
    reach = 2 * (STEPS + 1)
    part = lambda c: F.floor(c / reach)
    ends = blocks.select("block", "t", "code", "lo", "hi")
    left = ends.select("t", "code", F.col("block").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(part(F.col("lo")), part(F.col("hi") + reach))).alias("part"))
    right = ends.select("t", "code", F.col("block").alias("b"), F.col("lo").alias("blo"), part(F.col("lo")).alias("part"))
    later = (F.col("alo") < F.col("blo")) | ((F.col("alo") == F.col("blo")) & (F.col("a") < F.col("b")))
    pairs = written(left.join(right, ["t", "code", "part"]).where(later & (F.col("blo") <= F.col("ahi") + reach)).select("a", "b", "t"), "block-pairs")
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("data").alias(f"data_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t", "data_a", "data_b")
    return own.union(met.mapInArrow(both, _HIT_SCHEMA))


def _linked(hits: DataFrame, nodes: DataFrame, masks: np.ndarray, dim: int, threshold: float) -> DataFrame:
    """(no, root, n): for each pair of blocks and node with links there, their number and the smallest node they lead to."""
    hits = written(hits, "hits")
    groups = max(12, -(-hits.count() * (dim * 8 + 64) // GROUP_BYTES))
    rows = hits.join(nodes.select("no", "n", "x"), "no").withColumn("_g", F.pmod(F.xxhash64("a", "b"), F.lit(groups)))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("a", "ascending"), ("b", "ascending"), ("left", "descending"), ("no", "ascending")])
        a, b, t, left, no, n = (table[c].to_numpy() for c in ("a", "b", "t", "left", "no", "n"))
        sides, out = np.stack([table["s0"].to_numpy(), table["s1"].to_numpy()], 1).view(np.uint64), []
        x = table["x"].combine_chunks()
        edges = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else []
        for lo, hi in zip(edges, [*edges[1:], len(a)]):
            v = unit(_matrix(x.slice(lo, hi - lo), dim))
            first = np.flatnonzero(left[lo:hi])
            second = np.flatnonzero(~left[lo:hi])
            found_i, found_j = [], []
            for k in range(0, len(first), 256):
                p, q = np.nonzero(v[first[k : k + 256]] @ v[second].T >= threshold - 1e-9)
                p, q = first[k + p], second[q]
                if a[lo] == b[lo]:
                    p, q = p[no[lo + p] != no[lo + q]], q[no[lo + p] != no[lo + q]]
                good = first_shared(sides[lo + p] ^ sides[lo + q], t[lo], masks)
                p, q = p[good], q[good]
                good = np.einsum("ij,ij->i", v[p], v[q]) >= threshold
                found_i.append(p[good])
                found_j.append(q[good])
            names, at = np.unique(no[lo:hi], return_inverse=True)
            own_n = np.zeros(len(names))
            own_n[at] = n[lo:hi]
            i, j = at[np.concatenate(found_i)] if found_i else np.zeros(0, int), at[np.concatenate(found_j)] if found_j else np.zeros(0, int)
            if not len(i):
                continue
            if a[lo] == b[lo]:  # a node may stand on both sides: each pair once
                i, j = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
            links = np.bincount(i, weights=own_n[j], minlength=len(names)) + np.bincount(j, weights=own_n[i], minlength=len(names))
            own = np.flatnonzero(links)
            roots = smallest_reached(len(names), i, j)
            out.append((names[own], names[roots[own]], links[own].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("no", "root", "n"), map(pa.array, cols))))

    return rows.groupBy("_g").applyInArrow(verify, "no long, root long, n long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links vectors whose cosine, in double precision, is ``threshold`` (0 < threshold <= 1) or more.

    One row for each row of ``vectors``: id, n_links (other rows linked directly), component_id (the smallest id reachable
    by links, itself included). Vectors that are null, empty or zero, or hold a null or non-finite component, link with
    nothing, and vectors of different length don't link; their component is their own id. Repeated rows are linked and
    counted each; null ids count as larger than any. Other columns are ignored; no rows give no rows. Among more than
    CELL distinct vectors a pair at the threshold is missed with a chance of LOST + 2 * MISS, a closer one more rarely;
    nothing below the threshold is linked. The numbers of links in a group of near vectors are counted pair by pair, so that
    such a group costs the square of its distinct vectors.
    """
    kind = "double" if "double" in dict(vectors.dtypes)[vector_col] else "float"
    x = F.col(vector_col).cast(f"array<{kind}>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)
    name = F.concat(*[F.lpad(F.hex(F.xxhash64("x", F.lit(seed))), 16, "0") for seed in (1, 2)])
    named = vectors.select(F.col(id_col).alias("_id"), F.when(fit, x).alias("x")).withColumn("node", F.when(F.col("x").isNotNull(), name))
    # A vector that very many rows share is one row after the partial aggregates.
    grouped = named.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_id"), F.first("x").alias("x"))
    nodes = written(grouped.withColumn("no", F.monotonically_increasing_id()), "nodes")
    found = None
    for dim, n in sorted(tuple(r) for r in nodes.groupBy(F.size("x")).count().collect()):  # a row for each length of vector
        own, masks = nodes.where(F.size("x") == dim), tables(n, threshold)
        blocks = written(_blocks(written(_coded(own, dim, threshold), "codes"), masks, n), "blocks")
        links = _linked(_hits(blocks, masks, threshold), own, masks, dim, threshold)
        found = links if found is None else found.union(links)
    rows = named.select("_id", "node")
    if found is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    found = written(found, "vector-links")
    counts = found.groupBy("no").agg(F.sum("n").alias("_links"))
    parts = components(found.where("no <> root"), "no", "root").withColumnRenamed("node", "no")
    joined = nodes.select("node", "no", "n", "_id").join(parts, "no", "left").join(counts, "no", "left").withColumn("part", F.coalesce("component", "no"))
    joined = written(joined.select("node", "no", "part", "_id", (F.col("n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links")), "named")
    smallest = joined.groupBy("part").agg(F.min("_id").alias("component_id"))
    # Written, so that rows are exchanged for the last join alone and a vector that very many of them share can be split.
    of_node = written(spread_join(joined, smallest, ["part"], ["no"]).select("node", "n_links", "component_id"), "of-node")
    out = rows.join(of_node, "node", "left")
    alone = F.col("node").isNull()
    return out.select(F.col("_id").alias(id_col), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op5_similar_vectors": op5_similar_vectors}
# The self-join of all vectors, for small tables.
ORACLES = {
    "op5_similar_vectors": """
    WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda v: v::double) AS x FROM embeddings),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0)::bigint AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id, vec_id <= coalesce(m.m, vec_id) AS kept
    FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""
}
