"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its five-word shingles; documents of equal sets are one node from the start. A node's MinHash
signature has HASHES coordinates. Nodes are posted under coordinate-value pairs, and pairs of nodes that agree in at
least ``least`` coordinates are candidates, to be confirmed on full sets.

Prefix: two signatures that agree in ``least`` of HASHES coordinates share one of the first HASHES - least + 1 in any
common order of coordinate-value pairs. Rare pairs come first, so that a pair which thousands of nodes hold is rarely
posted. The order uses hashed counts of fixed size; whatever they are, no candidate is lost.

Skip: only components are wanted, so a list of posts is not expanded into pairs. Every list has a pivot, the node of the
smallest hash; lists of one pivot are merged. First each node is compared with its pivots only, and components are taken. Then
nodes of different components in one list are compared, in blocks, and a block pair within one component is skipped.
Nothing else is left out: every pair of nodes that agrees in ``least`` coordinates is either compared or already
in one component. The comparing task verifies pairs on full sets itself and returns a forest of links, so that the
rows it makes grow with nodes, not with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.joins import spread_join
from lodeworks.llm import text as T
from lodeworks.llm.common import bit_words, fresh, has_bit, row_hashes, releasing, split_by_filter, written
from lodeworks.llm.components import smallest_reached
from lodeworks.operators.graph import components

HASHES = 64
ORDER_BINS = 1 << 16
#: Logarithms of the bits of the filters of documents whose sets are read again (2 MB), of coordinate-value pairs that several
#: nodes hold (2 MB) and of rows that may have to go (1 MB), whatever the corpus. A fuller filter only lets more through to the
#: join that decides.
FILTER_BITS, POST_BITS, ROW_BITS = 24, 24, 23
#: Nodes of one list that meet in one task as one side of a block pair, and how many of them are compared at a time.
BLOCK = 4096
TILE = 512
#: More than tiles of any block: blocks are dealt by a hash, and hold about BLOCK nodes.
TILES = 64
#: Bytes of sets and signatures that one comparing task takes, unless a single block pair has more.
GROUP_BYTES = 4 << 20
SECOND = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(29)
FACTORS = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64)


def least_matches(similarity: float, miss: float = 1e-6, n: int = HASHES) -> int:
    """The largest number of agreeing coordinates that a pair of this similarity misses with a chance below ``miss``."""
    below, t = 0.0, 0
    while True:
        below += math.comb(n, t) * similarity**t * (1 - similarity) ** (n - t)
        if below > miss:
            return t
        t += 1


def signatures(chunk: T.Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: size of its set, a hash of the set, and the 32-bit minima (rows x HASHES)."""
    s, first = T.shingles(T.words(chunk), k)
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    sizes = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    full = np.flatnonzero(sizes)
    minima, node = np.zeros((rows, HASHES), np.uint32), np.zeros(rows, np.uint64)
    if len(full):
        for j in range(HASHES):
            minima[full, j] = np.minimum.reduceat((s ^ MASKS[j]) * FACTORS[j], at[full]) >> np.uint64(32)
        one = np.add.reduceat(T.mix(s), at[full])
        other = np.bitwise_xor.reduceat(T.mix(s + SECOND), at[full])
        node[full] = T.mix(one ^ T.mix(other + sizes[full].astype(np.uint64)))
    return sizes, node, minima


def _node(shingles: np.ndarray) -> int:
    """The hash of one set, as in ``signatures``."""
    other = np.bitwise_xor.reduce(T.mix(shingles + SECOND))
    return int(T.mix(np.atleast_1d(T.mix(shingles).sum() ^ T.mix(np.atleast_1d(other + np.uint64(len(shingles))))))[0])


def _sign(docs: DataFrame, id_col: str, text_col: str, k: int, hashes: bool) -> DataFrame:
    """(_id, n_shingles, node, signature); node and signature are null for a text without words. With ``hashes`` also _h1 and
    _h2 of the whole row."""
    kind = dict(docs.dtypes)[id_col]
    more = [c.alias(n) for c, n in zip(row_hashes(docs), ("_h1", "_h2"))] if hashes else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                sizes, node, minima = signatures(chunk, k)
                own = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                none = sizes == 0
                sig = pa.array([None if e else m.tobytes() for e, m in zip(none, minima)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sizes, pa.int64()), pa.array(T.signed(node), mask=none), sig, *own.columns[2:]], ["_id", "n_shingles", "node", "signature", *(["_h1", "_h2"] if hashes else [])])

    schema = f"_id {kind}, n_shingles long, node long, signature binary" + (", _h1 long, _h2 long" if hashes else "")
    return docs.select(F.col(id_col), F.col(text_col), *more).mapInArrow(releasing(work), schema)


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _coordinates(minima: np.ndarray) -> np.ndarray:
    """A hash of each coordinate-value pair."""
    return T.mix(minima.astype(np.uint64) | (np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(32)))


def _order(nodes: DataFrame) -> np.ndarray:
    """How many nodes hold the coordinate-value pairs of each bin: ORDER_BINS numbers, whatever the number of nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BINS, np.int64)
        for batch in batches:
            total += np.bincount((_coordinates(_stack(batch.column(0))) >> np.uint64(48)).astype(np.int64).ravel(), minlength=ORDER_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    rows = nodes.select("signature").mapInArrow(work, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(ORDER_BINS, np.int64)
    out[rows["bin"]] = rows["n"]
    return out


def _posts(nodes: DataFrame, least: int, often) -> Callable[..., DataFrame]:
    """(key, node) for the rarest HASHES - least + 1 coordinate-value pairs of each node; with a filter, only the pairs that it lets
    through. ``often``: the broadcast counts of ``_order``."""
    prefix = HASHES - least + 1

    def posts(filter_words: np.ndarray | None = None) -> DataFrame:
        several = None if filter_words is None else nodes.sparkSession.sparkContext.broadcast(filter_words)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = _coordinates(_stack(batch.column(1)))
                counts = often.value[(keys >> np.uint64(48)).astype(np.int64)]
                # One order for all nodes: by count of the bin, then by the hash itself.
                order = np.lexsort((keys, counts), axis=1)[:, :prefix]
                own, node = T.signed(np.take_along_axis(keys, order, 1).ravel()), np.repeat(batch.column(0).to_numpy(), prefix)
                if several is not None:
                    hit = has_bit(several.value, own)
                    own, node = own[hit], node[hit]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(node)], ["key", "node"])

        return nodes.select("node", "signature").mapInArrow(work, "key long, node long")

    return posts


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int, repeated: bool) -> DataFrame:
    """(node, shingles), one row for each of the ``wanted`` (node, _id), from the texts of those ids. A filter of fixed size
    decides which texts are split again; those it lets through needlessly do no harm. A task sends the set of a node once,
    however many rows of that id and text it meets; ``repeated``: there are such rows, so several tasks may send it."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(bit_words(wanted.select(F.xxhash64("_id").alias("h")), "h", FILTER_BITS))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            hit = np.flatnonzero(has_bit(shipped.value, batch.column(1).to_numpy()))
            for chunk in T.chunks(batch.column(0).take(pa.array(hit))):
                s, first = T.shingles(T.words(chunk), k)
                rows = np.flatnonzero(np.diff(first))
                own = {int(r): np.unique(s[first[r] : first[r + 1]]) for r in rows}
                node = {r: _node(x) for r, x in own.items()}
                ids = batch.column(2).take(pa.array(hit[chunk.lo : chunk.hi])).to_pylist()
                fresh_rows = []
                for r in own:
                    if (node[r], ids[r]) not in sent:
                        sent.add((node[r], ids[r]))
                        fresh_rows.append(r)
                if fresh_rows:
                    names = T.signed(np.array([node[r] for r in fresh_rows], np.uint64))
                    sets = pa.array([own[r].view(np.int64) for r in fresh_rows], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(names), sets, batch.column(2).take(pa.array(hit[[chunk.lo + r for r in fresh_rows]]))], ["node", "shingles", "_own"])

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(F.col(text_col), F.xxhash64(id_col).alias("_hash"), F.col(id_col)).mapInArrow(work, f"node long, shingles array<long>, _own {kind}")
    own = found.join(wanted, "node").where(F.col("_own").eqNullSafe(F.col("_id"))).select("node", "shingles")
    return own.dropDuplicates(["node"]) if repeated else own


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets_of, least: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that agree in ``least`` coordinates and whose sets reach the similarity. Full sets are
    read for the nodes of such pairs only."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = (_stack(batch.column(2)) == _stack(batch.column(3))).sum(1) >= least
                yield batch.select([0, 1]).filter(pa.array(good))

    side = lambda x: sigs.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    near = written(both.select("a", "b", "sa", "sb").mapInArrow(matched, "a long, b long"), "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(sigs.select("node", "_id"), "node")
    sets = sets_of(written(wanted, "wanted"))
    full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    held = near.join(full("a"), "a").join(full("b"), "b")
    held = held.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
    return held.where(F.col("both") * den >= (F.col("sum") - F.col("both")) * num).select("a", "b")


def _across(members: DataFrame, sigs: DataFrame, sets_of, least: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between components, found in lists that hold nodes of several. In each list, the nodes of its
    largest component are compared with the others, and those with each other, a block pair of BLOCK x BLOCK at a time. A task
    counts collisions; where pairs have enough of them, another one verifies these on full sets, and returns a forest of the
    components it joins: no more rows than components, however many pairs are near."""
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    lists = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    # Two nodes of a list of two have been compared already.
    lists = written(lists.where((F.col("most.n") < F.col("all")) & (F.col("all") > 2)), "contested-lists")
    rows = members.join(lists, "key").withColumn("other", F.col("label") != F.col("most.label"))
    mains = F.ceil(F.col("most.n") / BLOCK).cast("int")
    others = F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("other"), others).otherwise(mains)).cast("int")
    rows = written(rows.select("key", "node", "label", "other", own.alias("own"), mains.alias("mains"), others.alias("others")), "contested")
    # A block pair is (left, right, whether left is of the main component).
    side = lambda l, r, main: F.struct(l.cast("int").alias("l"), r.cast("int").alias("r"), F.lit(main).alias("main"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    as_main = F.transform(count(F.col("others")), lambda j: side(F.col("own"), j, True))
    as_other = F.concat(F.transform(count(F.col("mains")), lambda i: side(i, F.col("own"), True)), F.transform(count(F.col("others")), lambda j: side(F.least(F.col("own"), j), F.greatest(F.col("own"), j), False)))
    pairs = F.when(F.col("other"), as_other).otherwise(as_main)
    size = rows.agg(F.coalesce(F.sum(F.size(pairs)), F.lit(0))).first()[0] * (HASHES * 4 + 64)
    placed = rows.withColumn("pair", F.explode(pairs)).select("key", F.col("pair.l").alias("l"), F.col("pair.r").alias("r"), F.col("pair.main").alias("main"), "other", "own", "node", "label")
    signed = lambda placed: placed.join(sigs.select("node", "signature"), "node")

    def dealt(rows: DataFrame, size: int):
        # Many small block pairs share a group, a full one has its own.
        group = F.pmod(F.xxhash64("key", "l", "r", "main"), F.lit(max(12, -(-size // GROUP_BYTES))))
        return rows.withColumn("_g", group).groupBy("_g")

    def collide(table: pa.Table) -> pa.Table:
        table, found = _in_order(table), []
        key, l, r, main, own = (table[c].to_numpy() for c in ("key", "l", "r", "main", "own"))
        for left, right, (i, j), near in _near_tiles(table, least):
            # Each tile with a near pair becomes a block pair of its own, of the nodes that have one there.
            left, right, at = left[near.any(1)], right[near.any(0)], left[0]
            if not main[at] and l[at] == r[at] and i == j:
                right = np.setdiff1d(right, left)
            rows = np.concatenate([left, right])
            tile = np.repeat([i, j], [len(left), len(right)])
            fixed = {"key": key[at], "l": l[at] * TILES + i, "r": r[at] * TILES + j, "main": main[at]}
            place = {c: np.full(len(rows), v) for c, v in fixed.items()} | {"own": own[rows] * TILES + tile}
            found.append(pa.table({c: pa.array(place[c], t) if c in place else table[c].take(pa.array(rows)) for c, t in _PLACE_TYPES.items()}))
        return pa.concat_tables(found) if found else pa.table({c: pa.array([], t) for c, t in _PLACE_TYPES.items()})

    def verify(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        label, sets = table["label"].to_numpy(), table["shingles"].combine_chunks()
        ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        out: list[np.ndarray] = []
        for left, right, _, near in _near_tiles(table, least):
            left, right, near = left[near.any(1)], right[near.any(0)], near[near.any(1)][:, near.any(0)]
            if not near.size:
                continue
            both = _shared([values[ends[i] : ends[i + 1]] for i in left], [values[ends[i] : ends[i + 1]] for i in right])
            total = np.diff(ends)[left][:, None] + np.diff(ends)[right][None]
            p, q = np.nonzero(near & (both * den >= (total - both) * num))
            names, ids = np.unique(np.concatenate([label[left[p]], label[right[q]]]), return_inverse=True)
            roots = smallest_reached(len(names), ids[: len(p)], ids[len(p) :])
            own_root = np.flatnonzero(roots != np.arange(len(names)))
            out.append(np.stack([names[roots[own_root]], names[own_root]]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # First by signatures alone; full sets go only where some pair has collisions enough.
    hit = written(dealt(signed(placed), size).applyInArrow(collide, ", ".join(f"{c} {t}" for c, t in PLACE.items())), "collisions")
    wanted = written(sigs.join(hit.select("node").distinct(), "node", "left_semi").select("node", "_id", "n"), "wanted")
    size = hit.join(wanted, "node").agg(F.coalesce(F.sum(F.col("n") * 8 + HASHES * 4), F.lit(0))).first()[0]
    full = signed(hit).join(sets_of(wanted.select("node", "_id")), "node")
    return dealt(full, size).applyInArrow(verify, "a long, b long").distinct()


#: A node's place in a block pair of a list.
PLACE = {"key": "long", "l": "int", "r": "int", "main": "boolean", "other": "boolean", "own": "int", "node": "long", "label": "long"}
_PLACE_TYPES = {c: {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t] for c, t in PLACE.items()}


def _in_order(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by([(c, "ascending") for c in ("key", "main", "l", "r")])


def _near_tiles(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int], np.ndarray]]:
    """For each block pair of an ordered table, TILE x TILE rows at a time: the rows of its sides, the tile, and which of their pairs have
    different labels and agree in ``least`` coordinates."""
    if not len(table):
        return
    key, l, r, main, other, mine, label = (table[c].to_numpy() for c in ("key", "l", "r", "main", "other", "own", "label"))
    sig = _stack(table["signature"])
    edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1]) | (main[1:] != main[:-1])])
    for lo, hi in zip(edges, [*edges[1:], len(key)]):
        at = np.arange(lo, hi)
        if main[lo]:
            left, right = at[~other[lo:hi]], at[other[lo:hi]]
        else:
            left, right = at[mine[lo:hi] == l[lo]], at[mine[lo:hi] == r[lo]]
        for i in range(0, len(left), TILE):
            for j in range(i if not main[lo] and l[lo] == r[lo] else 0, len(right), TILE):
                x, y = left[i : i + TILE], right[j : j + TILE]
                apart = label[x][:, None] != label[y][None]
                if not apart.any():
                    continue  # one component
                agree = np.zeros(apart.shape, np.uint8)
                for h in range(HASHES):
                    agree += sig[x, h][:, None] == sig[y, h][None]
                near = (agree >= least) & apart
                if near.any():
                    yield x, y, (i // TILE, j // TILE), near


def _shared(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``, by products of incidence matrices."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(common):
        return out
    sides = []
    for sets, values in ((left, a), (right, b)):
        column = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[column] == values
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(column[hit], kind="stable")
        sides.append((row[hit][order], column[hit][order], len(sets)))
    for lo in range(0, len(common), width):
        m = []
        for row, column, n in sides:
            x, y = np.searchsorted(column, (lo, lo + width))
            dense = np.zeros((n, min(width, len(common) - lo)), np.float32)
            dense[row[x:y], column[x:y] - lo] = 1
            m.append(dense)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def _linked(docs: DataFrame, num: int, den: int, k: int, id_col: str, text_col: str, hashes: bool = False) -> DataFrame:
    """One row for each row of ``docs``: _id, n_shingles, node, part (the node that names its component; both null for an
    empty set), smallest (its component's smallest id), and with ``hashes`` _h1 and _h2 of the whole row."""
    least = least_matches(num / den)
    rows = written(_sign(docs, id_col, text_col, k, hashes), "signatures")
    grouped = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    nodes = written(grouped, "nodes")
    posts = _posts(nodes, least, docs.sparkSession.sparkContext.broadcast(_order(nodes)))
    # A node is a hash already, so the smallest one is as good a pivot as any. Most pairs are held by one node alone; a filter of
    # the others keeps them from being dealt out a second time. Written first, so that long lists of posts are exchanged for this
    # join alone, and can be split.
    lists = written(posts().groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot"), "lists")
    shared = posts(bit_words(lists, "key", POST_BITS))
    # Lists of the same pivot are merged: the many lists of a group of near copies mostly have the same one.
    members = written(spread_join(shared, lists, ["key"], ["node"], salts=4).select(F.col("pivot").alias("key"), "node").distinct(), "members")
    repeated = not rows.where("node is not null").groupBy("node", "_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    sets_of = lambda wanted: _sets(docs, wanted, id_col, text_col, k, repeated)
    pairs = members.where("node <> key").select(F.least("node", "key").alias("a"), F.greatest("node", "key").alias("b")).distinct()
    links = written(_confirmed(pairs, nodes, sets_of, least, num, den), "pivot-links")
    joined = components(links, "a", "b")
    labelled = written(members.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "labelled")
    links = written(links.union(_across(labelled, nodes, sets_of, least, num, den)), "links")
    joined = components(links, "a", "b")
    named = written(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "_id"), "named")
    smallest = named.groupBy("part").agg(F.min("_id").alias("smallest"))
    of_node = written(spread_join(named, smallest, ["part"], ["node"]).select("node", "part", "smallest"), "parts")
    # Equal texts are one node here, and texts without words have none: both may be a third of all rows.
    # The table of parts is written, so that rows are exchanged for this join alone and a hot node can be split.
    return rows.drop("signature").join(of_node, "node", "left")


def near_duplicate_components(docs: DataFrame, num: int = 85, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose ``k``-word shingle sets have an intersection of at least num/den of their union.

    One row for each row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links, itself included),
    node (a hash of the set, null if it is empty).
    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded. A text of fewer than k words is one shingle, its whole sequence; a
    null text, or one without words, has none and is linked with nothing: its component is its own id. Repeated rows are
    linked and counted each. Null ids count as larger than any id. Texts of any length are whole; other columns are
    ignored; no rows give no rows. A pair at the threshold is missed with a chance below 1e-6 (see ``least_matches``), a
    closer one more rarely.
    """
    out = _linked(docs, num, den, k, id_col, text_col)
    alone = F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("smallest"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", alone.alias("component_id"), "node")


def keep_one_of_each(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, all columns as they were: the one with the smallest id (null ids last), of
    several with that id the one of the smallest row hash, of rows that are equal in all columns any one. Rows are told
    apart by all their columns, not by their id, so that a row whose id also stands elsewhere is kept or dropped for its own
    text. Texts without words are in no group and are all kept."""
    h1, h2 = fresh("h"), fresh("h")
    found = written(_linked(docs, num, den, k, id_col, text_col, hashes=True).where("node is not null"), "components")
    order = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_h1", "_h2")
    chosen = found.groupBy("part").agg(F.min(order).alias("first"))
    staying = written(chosen.select(F.col("first._h1").alias(h1), F.col("first._h2").alias(h2)), "staying")
    mine = found.select(F.col("_h1").alias(h1), F.col("_h2").alias(h2))
    # Rows to drop may be very many. Only rows that a filter of them lets through are dealt out to be held against them; all
    # others stay where they are. Rows equal in all columns come once.
    times = mine.groupBy(h1, h2).agg(F.count(F.lit(1)).alias("n"))
    gone = written(times.join(staying, [h1, h2], "left_anti").select(h1, h2), "gone")
    repeated = written(times.where("n > 1").join(staying, [h1, h2], "left_semi").select(h1, h2), "repeated")
    hashed = docs.withColumns(dict(zip((h1, h2), row_hashes(docs))))
    some = written(gone.unionByName(repeated), "gone-or-repeated")
    sure, maybe = split_by_filter(hashed, h1, some, h1, ROW_BITS)
    kept = maybe.join(gone, [h1, h2], "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, [h1, h2], "left_semi").dropDuplicates([h1, h2])
        kept = kept.join(repeated, [h1, h2], "left_anti").unionByName(once)
    return sure.unionByName(kept).select(docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
# All pairs of documents that share a shingle, for small tables.
ORACLES = {
    "op7_near_duplicates": """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['=' || array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.m, d.doc_id) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""
}
