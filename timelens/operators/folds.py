"""Folds over a key's rows in order, where each step depends on the last: sorted within partitions and streamed, never held as one array."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows put out at once.
BATCH = 2000


def streamed(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], fold: Callable[[tuple, Iterable[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``fold(key, rows)`` yields for each key, where rows are tuples of ``values``, sorted by ``order``, nulls first.

    The sort spills, and one row at a time reaches the fold, so a key's rows needn't fit into memory.
    """
    # dealt by a hash of the keys: dealing by the keys themselves would be left out after a join or a grouping on them, whose own dealing
    # isn't kept when the join turns out to be small or skewed, as a fold over Arrow batches doesn't ask for it
    rows = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*keys, *values)
    kind, n = to_arrow_schema(StructType.fromDDL(schema)), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = (x for key, part in itertools.groupby(every, key=lambda r: r[:n]) for x in fold(key, (r[n:] for r in part)))
        while chunk := list(itertools.islice(out, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk, strict=True), kind, strict=True)], schema=kind)

    return rows.mapInArrow(run, schema)
