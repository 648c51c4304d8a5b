"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.storage import materialised


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(n))


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row, by which it is found again whatever its id."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    # A null leaves a hash as it is, so which columns are null counts as well.
    nulls = F.concat(*[F.when(F.col(f"`{f.name}`").isNull(), "1").otherwise("0") for f in df.schema.fields])
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit(1), *reversed(parts), nulls)


def bit_table(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(w, bits): a filter of 2**bits bits for the hashes in ``column``, a row for 64 of them, so 2**(bits - 6) rows at most whatever
    the number of keys. A fuller filter only lets more through to the join that decides."""
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    return keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))


def bit_words(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The same as 2**(bits - 6) words on the driver, to be sent to tasks."""
    rows = bit_table(keys, column, bits).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"]
    return out


def has_bit(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a filter of ``bit_words`` lets through."""
    at = hashes & np.int64(len(words) * 64 - 1)
    return (words[at >> 6] >> (at & 63)) & 1 == 1


def split_by_filter(df: DataFrame, column: str, keys: DataFrame, key: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose hash in ``column`` is surely none of ``keys``, and the others; neither is shuffled, as the filter is
    broadcast, whose size is fixed."""
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    table = F.broadcast(bit_table(keys, key, bits).select(F.col("w").alias("_w"), F.col("bits").alias("_bits")))
    tested = df.join(table, F.shiftright(slot, 6) == F.col("_w"), "left")
    hit = F.coalesce(F.expr(f"shiftright(_bits, cast(pmod(`{column}`, {1 << bits}) & 63 as int)) & 1") == 1, F.lit(False))
    return tested.where(~hit).select(df.columns), tested.where(hit).select(df.columns)


def releasing(work: Work) -> Work:
    """``work`` for mapInArrow, after each batch of which Arrow gives memory that it no longer needs back to the system: workers live
    on from stage to stage, and would keep the most that any stage took."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()

    return trimmed


written = materialised
