"""Ordered folds: recurrences that no window frame expresses, streamed through sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def ordered_fold(df: DataFrame, by: list[str], order: list[str], inputs: list[str], outputs: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """``df`` with the columns of ``outputs`` ("name type, ..."): what a step made by ``start`` for each group gives for ``inputs``, row after row.

    One shuffle by ``by``; a group's rows pass through one task as a stream, so memory does not grow with the group.
    """
    ship(df.sparkSession)
    extra = [x.split() for x in outputs.split(", ")]
    kept = [f for f in df.schema.fields if f.name not in {n for n, _ in extra}]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t in extra)])
    at_by, at_in = [names.index(c) for c in by], [names.index(c) for c in inputs]
    types = [_TYPES[t] for _, t in extra]
    columns = [*names, *(n for n, _ in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in at_by), strict=True)
            rows = zip(*(batch.column(k).to_pylist() for k in at_in), strict=True)
            out = []
            for key, row in zip(keys, rows, strict=True):
                if key != now:
                    now, step = key, start()
                out.append(step(*row))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], columns)

    return df.select(*(f"`{n}`" for n in names)).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
