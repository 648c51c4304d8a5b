"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number that depends on its content alone, never on partitioning: rows are dealt to
a fixed number of buckets by a hash of their key, numbered inside the bucket in key order, and shifted by the
rows of the buckets before. A keyed Feistel network permutes the numbers 0 .. n-1; the place of a row in the
shuffled order then gives its shard and its slot by arithmetic. All of it is DataFrame expressions.

Law: ``rows``. With n rows and k shards, place p goes to shard p mod k, slot p div k, so shard sizes differ by
one row at most and the slots of a shard are gapless from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import written

MASK31 = 0x7FFFFFFF
#: Odd multipliers of the round function, below 2**30 so that products stay inside a signed long.
MULTIPLIERS = (0x2C1B3C6D, 0x297A2D39)
ROUNDS = 6
#: Images outside 0 .. n-1 are walked at most so far; there are fewer than sqrt(n)+1 of them altogether.
WALK = 64
BUCKETS = 4096


def _mix(v: Column, key: int) -> Column:
    """A 31-bit mix of a long, in arithmetic that other SQL engines share."""
    t = (v + F.lit(key)).bitwiseAND(F.lit(MASK31))
    for shift, factor in ((15, MULTIPLIERS[0]), (12, MULTIPLIERS[1])):
        t = t.bitwiseXOR(F.shiftright(t, shift))
        t = (t * F.lit(factor).cast("long")).bitwiseAND(F.lit(MASK31))
    return t.bitwiseXOR(F.shiftright(t, 15))


def round_keys(seed: int) -> list[int]:
    return [(seed * 1_000_003 + r * 7_919 + 12_345) % MASK31 for r in range(ROUNDS)]


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0 .. a*b-1: halves in Z_a and Z_b take turns to be shifted by a mix of the other."""
    both = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
    if ROUNDS % 2:
        raise ValueError("ROUNDS is even")
    # One struct goes from round to round, so that the expression stays linear in the number of rounds.
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
    pairs = F.array(*[F.struct(keys[i].alias("p"), keys[i + 1].alias("q")) for i in range(0, ROUNDS, 2)])

    def step(acc: Column, k: Column) -> Column:
        left = (acc["l"] + _mix_col(acc["r"], k["p"])) % a
        return F.struct(left.alias("l"), ((acc["r"] + _mix_col(left, k["q"])) % b).alias("r"))

    return F.aggregate(pairs, both, step, lambda acc: acc["l"] * b + acc["r"])


def _mix_col(v: Column, key: Column) -> Column:
    return _mix(v + key, 0)


def permute(x: Column, n: Column, seed: int) -> Column:
    """The place of row number x among n: walk the cycle until the image lies below n.

    The domain is a*b with a = ceil(sqrt(n)), b = ceil(n/a): fewer than a numbers lie outside. A walk longer
    than WALK steps (possible only with n over WALK**2, and then with a chance below n**(-WALK/2)) raises.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.floor((n + a - 1) / a).cast("long")
    first = feistel(x, a, b, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_first"), lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, a, b, seed)))
    return first, F.when(F.col("_first") < n, F.col("_first")).otherwise(walked)


def number_rows(rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``row_no`` (0 .. n-1, by content alone) and ``n_rows``. Rows equal in ``key`` are alike and share out
    the numbers of their place in any order; they are counted before the shuffle, so that a row repeated without
    end is one row here until it is unfolded. ``buckets`` bounds what is broadcast: a row for each.
    """
    # By the whole key: rows of one id, or of none, that differ otherwise don't share a bucket.
    whole_key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    bucket = F.pmod(F.conv(F.substring(F.md5(whole_key), 1, 6), 16, 10).cast("long"), F.lit(buckets))
    counted = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket), "row-counts")
    sizes = counted.groupBy("_bucket").agg(F.sum("_n").alias("_size"))
    # At most ``buckets`` rows: numbering them in one task is bounded.
    whole = Window.partitionBy(F.lit(0))
    starts = sizes.select("_bucket", (F.sum("_size").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).alias("_start"), F.sum("_size").over(whole).alias("n_rows"))
    inside = Window.partitionBy("_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in key]).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_before", F.sum("_n").over(inside) - F.col("_n")).join(F.broadcast(starts), "_bucket")
    # Unfolded in two steps, dealt out in between: a row repeated very often is not unfolded by one task.
    block = 1024
    unfolded = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block).cast("long"))))
    unfolded = unfolded.repartition(*[F.col(c) for c in key], F.col("_block"))
    inner = F.sequence(F.col("_block") * block, F.least(F.col("_n"), (F.col("_block") + 1) * block) - 1)
    unfolded = unfolded.withColumn("_i", F.explode(inner))
    return unfolded.withColumn("row_no", F.col("_start") + F.col("_before") + F.col("_i")).drop("_bucket", "_size", "_before", "_start", "_n", "_block", "_i")


def feistel_shards(docs: DataFrame, n_shards: int = 24, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 8) -> DataFrame:
    """Deals every row of ``docs`` to a shard and a slot.

    Returns doc_id, size (UTF-8 bytes of the text plus ``row_overhead``; null text has none), text_crc32 (of the
    UTF-8 text, unsigned; null text: 0), n_rows, row_no, place, shard, slot. Only these narrow columns are shuffled, never
    the text. Null ids, null or empty texts, repeated rows and other columns are fine; no rows give no rows.
    The same rows give the same result however they are partitioned or ordered; ``seed`` picks the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + row_overhead).alias("size"), F.crc32(text).alias("text_crc32"))
    numbered = number_rows(rows, ["doc_id", "text_crc32", "size"])
    first, walked = permute(F.col("row_no"), F.col("n_rows"), seed)
    placed = numbered.withColumn("_first", first).withColumn("place", walked).drop("_first")
    checked = placed.withColumn("place", F.when(F.col("place") < F.col("n_rows"), F.col("place")).otherwise(F.raise_error(F.lit("a cycle is longer than WALK; take another seed")).cast("long")))
    return checked.withColumns({"shard": (F.col("place") % n_shards).cast("int"), "slot": F.floor(F.col("place") / n_shards).cast("long")})


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = feistel_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no", "place")


def _feistel_sql(source: str, seed: int) -> str:
    """A SELECT of i, n, a, b, walked + 1 and feistel(place) of the rows of ``source``: one level for each step, as an alias used
    twice would be computed twice, and those inside it again."""
    keep, sql = "i, n, a, b, walked", f"(SELECT i, n, a, b, walked, place // b AS l, place % b AS r FROM {source})"
    for j, key in enumerate(round_keys(seed)):
        of, to = ("r", "l") if j % 2 == 0 else ("l", "r")
        sql = f"(SELECT *, ({of} + {key}) & {MASK31} AS t FROM {sql})"
        for shift, factor in ((15, MULTIPLIERS[0]), (12, MULTIPLIERS[1])):
            sql = f"(SELECT {keep}, l, r, (xor(t, t >> {shift}) * {factor}) & {MASK31} AS t FROM {sql})"
        own = f"({to} + xor(t, t >> 15)) % {'a' if to == 'l' else 'b'}"
        sql = f"(SELECT {keep}, {own if to == 'l' else 'l'} AS l, {own if to == 'r' else 'r'} AS r FROM {sql})"
    return f"SELECT i, n, a, b, walked + 1, l * b + r FROM {sql}"


def _sql(n_shards: int = 24, seed: int = 2024, overhead: int = 8) -> str:
    """The law in SQL: CRC-32 byte by byte, row numbers by one window, and the walk as a recursion."""
    crc = "c >> 8"
    for bit in range(8):  # what each bit of the byte adds
        own = 1 << bit
        for _ in range(8):
            own = own >> 1 ^ 0xEDB88320 * (own & 1)
        crc = f"xor({crc}, (xor(c, x) >> {bit} & 1) * {own})"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::bigint + {overhead} AS size,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)), lambda c, x: {crc})) AS text_crc32 FROM documents),
    o AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), text_crc32, size)), 1, 6))::bigint % {BUCKETS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS i, count(*) OVER () AS n FROM d),
    s AS (SELECT i, n, greatest(ceil(sqrt(n))::bigint, 1) AS a, (n + a - 1) // a AS b FROM o),
    w(i, n, a, b, walked, place) AS (SELECT i, n, a, b, 0, i FROM s UNION ALL {_feistel_sql('w WHERE place >= n OR walked = 0', seed)})
    SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {n_shards})::int AS shard, place // {n_shards} AS slot, NULL::int AS grown_shard, i AS row_no, place
    FROM o JOIN w USING (i) WHERE walked > 0 AND place < w.n"""


QUERIES = {"op2_sharding": op2_sharding}
ORACLES = {"op2_sharding": _sql()}
