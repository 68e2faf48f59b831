"""Counts of terms in whole texts, gathered in the tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from packreview.llm.common import reach_workers, slices

#: Terms, and bytes of terms, that a task holds before it hands its counts on.
HELD_TERMS, HELD_BYTES = 400_000, 48 << 20


def counted(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Rows of `schema` that make() gathers over the rows of df, whose last column is a text (null: empty).

    make() gives an object with add(columns, texts), where texts are UTF-8 bytes, full() and take(); take() returns the
    columns gathered so far and starts anew. A task hands on what it holds when full, so its memory is bounded.
    """
    from pyspark.sql.types import StructType

    reach_workers(df.sparkSession)
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(fields)

        def out() -> Iterator[pa.RecordBatch]:
            cols = held.take()
            for a in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)], f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

        held = make()
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1).cast(pa.string()), "").cast(pa.binary())
            for a, b in slices(np.asarray(pc.binary_length(texts))):
                held.add([batch.column(i).slice(a, b - a).to_pylist() for i in range(batch.num_columns - 1)], texts.slice(a, b - a).to_pylist())
                if held.full():
                    yield from out()
        yield from out()

    return df.mapInArrow(run, fields)
