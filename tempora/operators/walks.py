"""Recurrences over ordered series, row by row in bounded memory."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tempora.session import ship


def walk(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, kind: T.DataType, start, step) -> DataFrame:
    """Rows with ``out``: step(state, *values of the columns) gives the next state and the row's value.

    Each series (null keys are one) begins with ``start``. Series are dealt by their keys, sorted, and walked Arrow batch by
    Arrow batch with the state carried on, so that no series has to fit in memory; a series is one task's work.
    """
    ship(rows.sparkSession)
    names = rows.columns
    flagged = rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
    arrow = to_arrow_type(kind)

    def run(batches):
        state = start
        for batch in batches:
            made = []
            values = zip(*(batch.column(names.index(c)).to_pylist() for c in columns), strict=True)
            for first, value in zip(batch.column(len(names)).to_pylist(), values, strict=True):
                state, x = step(start if first else state, *value)
                made.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(made, arrow)], [*names, out])

    return flagged.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, kind)]))
