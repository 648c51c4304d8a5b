"""Product codes of vectors: weighted Lloyd rounds over the distinct integer parts.

Vectors are cut into equal parts, whose components are floored to integers. Equal parts at one position are one row with a
weight, so what many vectors share is assigned once. Each round sends the codebooks, whose size is fixed, to the tasks; a
task returns a sum and a weight for each entry, and only these are added up. At the end every distinct part has a code and
an error, which are joined back to the vectors that hold it. All numbers are integers, so nothing depends on the order of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.storage import discard, stored
from lodeworks.llm.common import releasing, written
from lodeworks.llm.vectors import check_exact, finite, float_vector, largest

#: Parts that are compared with a codebook at a time.
TILE = 2048


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers its nearest row of ``book``, the first of several, and the squared distance; exact."""
    check_exact(4 * x.shape[1] * max(largest(x), largest(book)) ** 2)
    d = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code].astype(np.int64)


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), width)


def _of_parts(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for p in range(n):
        own = np.flatnonzero(part == p)
        for lo in range(0, len(own), TILE):
            yield p, own[lo : lo + TILE]


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry the floor of the weighted mean of the parts nearest to it; unused ones stay."""
    shipped, (parts, entries, width) = distinct.sparkSession.sparkContext.broadcast(books), books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            part, n, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            for p, own in _of_parts(part, parts):
                code, _ = nearest_entries(x[own], shipped.value[p])
                np.add.at(sums[p], code, x[own].astype(np.int64) * n[own][:, None])
                np.add.at(weights[p], code, n[own])
        used = np.argwhere(weights)
        if len(used):
            p, e = used.T
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(weights[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    each = distinct.select("part", "n", "v").mapInArrow(releasing(work), "part long, entry long, n long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    out = books.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # a row for each entry at most
        out[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return out


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, v, code, error) of every distinct part."""
    shipped, (parts, _, width) = distinct.sparkSession.sparkContext.broadcast(books), books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p, own in _of_parts(part, parts):
                code[own], error[own] = nearest_entries(x[own], shipped.value[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], ["part", "v", "code", "error"])

    return distinct.select("part", "v").mapInArrow(releasing(work), "part int, v array<int>, code long, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256), a row for each vector.

    Components become floor(scale * component); vectors are cut into ``parts`` equal consecutive parts, whose codebooks of at most 256
    ``entries`` start as the parts of the vectors with the smallest ids. Each round assigns every part to its nearest entry (ties:
    the lower index), then moves entries to the floor of the mean of their parts; a last assignment gives the codes. ``code`` has two
    hex digits for each part; ``error`` is the sum of the final squared distances, ``label_error`` that sum over all rows of the
    label. ``codebooks_sha256`` is the hash of all final components, joined by commas.

    Rows whose vector is null or holds a null or non-finite component are dropped. Shorter vectors count as if zeros followed up to the
    longest one's length, and that as if up to a multiple of ``parts``. Null ids come last among the smallest ids, rows of equal id
    in order of their integers; null labels are one label. Repeated rows count each. With fewer rows than ``entries`` the codebooks
    are as long as there are rows; no rows give no rows. Other columns are ignored. Squared distances that might pass 2**53 are an error.
    """
    spark, x = vectors.sparkSession, float_vector(vectors, vector_col)
    label, key = F.col(f"`{label_col}`"), F.col(f"`{id_col}`")
    cut = vectors.where(finite(x)).select(key.alias("id"), label.alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))
    path = stored(cut.withColumn("no", F.monotonically_increasing_id()), "vectors")
    rows = spark.read.parquet(path)
    n, longest, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        discard(spark, path)
        schema = vectors.select(key.alias(id_col)).schema.add("code", "string").add("error", "long").add("label_error", "long")
        return spark.createDataFrame([], schema.add("codebooks_sha256", "string"))
    width = -(-longest // parts)
    check_exact(4 * max(width, 1) * (most or 0.0) ** 2)
    padded = F.concat(F.col("v").cast("array<int>"), F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v")))
    whole = rows.select("no", "id", "label", padded.alias("v"))
    start = np.array([r["v"] for r in whole.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()], np.float64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    slices = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", p * width + 1, width).alias("v")) for p in range(parts)])
    posted = whole.select("no", F.explode(slices).alias("s")).select("no", "s.part", "s.v")
    held = stored(posted.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")), "distinct-parts")
    distinct = spark.read.parquet(held)
    for _ in range(rounds):
        books = _moved(distinct, books)
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    coded = written(_coded(distinct, books), "coded-parts")
    # Both sides are exchanged for this join alone, so that adaptive execution can split a part that very many vectors hold.
    found = posted.join(coded, ["part", "v"]).groupBy("no").agg(F.sum("error").alias("error"), *[F.max(F.when(F.col("part") == p, F.col("code"))).alias(f"c{p}") for p in range(parts)])
    code = F.lower(F.concat(*[F.lpad(F.hex(f"c{p}"), 2, "0") for p in range(parts)]))
    done = written(rows.select("no", "id", "label").join(found, "no").select("id", "label", code.alias("code"), "error"), "codes")
    by_label = written(done.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    for p in (path, held):
        discard(spark, p)
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(rounds: int = 4) -> str:
    """Lloyd's rounds written out, over all parts without a table of distinct ones."""
    nearest = lambda k: f"SELECT id, part, v, min({{'d': d, 'e': entry}}) AS best FROM (SELECT p.id, p.part, p.v, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{k} b USING (part)) GROUP BY ALL"
    sql = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM e, range(4) r(part)),
    b0 AS (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry FROM p QUALIFY entry < 256)"""
    for k in range(rounds):
        sql += f""", a{k} AS MATERIALIZED ({nearest(k)}),
        m{k} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, best.e AS entry, i, floor(sum(v[i])::double / count(*))::bigint AS m FROM a{k}, range(1, 65) r(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
    return (
        sql
        + f""", f AS ({nearest(rounds)}), c AS (SELECT id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::bigint AS error FROM f GROUP BY id),
    h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
    SELECT c.id AS vec_id, code, error, (sum(error) OVER (PARTITION BY e.label))::bigint AS label_error, codebooks_sha256 FROM c JOIN e USING (id), h"""
    )


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _oracle()}
