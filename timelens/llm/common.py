"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a sample's key, such as languages.
MOST_KEYS = 1000

_held: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only (the path may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is absent on a single machine (tests) is a folder of our own used; a cluster must name one.
    The files go when the frame is no longer referenced, if the session cleans checkpoints.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def without_estimate(df: DataFrame) -> DataFrame:
    """A checkpointed frame of few plain columns, planned as one of unknown size.

    A checkpoint keeps the size that Spark estimated for its plan, and a join's is the product of both sides'. In a loop whose rounds join what the
    rounds before have joined, the number of its digits is multiplied in each round, until the driver does nothing but multiply.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files and checkpoints of plans that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bucket_of(key: str, buckets: int) -> Column:
    """crc32 of a key as text, modulo ``buckets``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets))


def bounded_sample(df: DataFrame, key: str, order: str, per_key: int, columns: Sequence[str]) -> list:
    """At most ``per_key`` distinct rows for each value of ``key``, chosen by a hash of ``order`` and ``columns``.

    All rows are counted, by a sketch of their hashes; the choice is the same on every run, repeated rows count once, and what reaches the
    driver is bounded by about 1.2 times ``per_key`` for each of at most MOST_KEYS values.
    """
    hashed = df.select(*columns, F.xxhash64(F.col(order).cast("string"), *columns).alias("_rank"), F.col(order).cast("string").alias("_order"))
    counts = {r[0]: r[1] for r in hashed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.approx_count_distinct("_rank", 0.02)).limit(MOST_KEYS + 1).collect()}
    if len(counts) > MOST_KEYS:
        raise ValueError(f"{key} has more than {MOST_KEYS} values")
    if not counts:
        return []
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        share = min(1.0, (1.2 * per_key + 20) / max(n, 1))
        keep = keep | ((F.col(key) == F.lit(value)) & (F.col("_rank") <= F.lit(int(share * (1 << 63)) * 2 - (1 << 63) - 1)))
    taken: dict = {}
    out = []
    for row in sorted(hashed.filter(keep).distinct().collect(), key=lambda r: (r["_rank"], r["_order"] or "")):
        if taken.get(row[key], 0) < per_key:
            taken[row[key]] = taken.get(row[key], 0) + 1
            out.append(row)
    return out


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks; asked for as a task begins.

    Workers are used again by other operators; each drops what the others kept. Memory that earlier tasks have freed goes back to the system.
    """
    if owner not in _held:
        _held.clear()
        gc.collect()
        _held[owner] = {}
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the system's allocator has no such call
        ctypes.CDLL(None).malloc_trim(0)
    return _held[owner]


def text_parts(column: pa.Array, most: int) -> Iterator[list[str]]:
    """Texts of a column in order, null as empty, in parts of about ``most`` bytes; a part holds one text at least."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


def slices(texts: list[str], most: int) -> Iterator[list[str]]:
    """Texts in order, in parts of about ``most`` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
