"""Folds over sorted rows of a key, for steps in which each row depends on the ones before it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that leave a worker together.
TOGETHER = 4096


def folded(df: DataFrame, keys: tuple[str, ...], order: list[str], columns: list[str], fold: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """keys and what `fold` gives (in `schema`), for each key, from its rows (`order` and then `columns`) in order.

    One shuffle by key; a task's rows are sorted and streamed past, so a key costs no more memory than `fold` holds, and time in
    proportion to its rows."""
    kind = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(schema).fields])
    arrow, n = to_arrow_schema(kind), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def batch(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

        made: list[tuple] = []
        for key, group in groupby(rows(), key=lambda r: r[:n]):
            for out in fold(r[n:] for r in group):
                made.append((*key, *out))
                if len(made) >= TOGETHER:
                    yield batch(made)
                    made = []
        if made:
            yield batch(made)

    return df.select(*keys, *order, *columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
