"""Folds over the rows of a key in order, for rules whose next step depends on the last decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]], added: T.StructType) -> DataFrame:
    """Adds the columns that ``step(state, row)`` returns, row by row within each key.

    Rows are dealt out by key, sorted, and streamed: a task holds one state and one batch, whatever a key's size.
    A key's rows are taken one after another, since the rules applied here can't be split.
    """
    out_schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        schema = to_arrow_schema(out_schema)
        for batch in batches:
            rows, made = batch.to_pylist(), []
            for row in rows:
                key = tuple(row[c] for c in by)
                if key != own:
                    own, state = key, start()
                state, values = step(state, row)
                made.append(values)
            columns = zip(*made, strict=True) if made else [()] * len(added)
            extra = [pa.array(c, schema.field(f.name).type) for c, f in zip(columns, added.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f.name for f in out_schema.fields])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, out_schema)
