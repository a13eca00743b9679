"""Passing a DataFrame's own columns through an Arrow function next to new ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cadastra.llm.textarrays import slices

ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def with_columns_by_slice(df: DataFrame, new: dict[str, str], make: Callable[[pa.RecordBatch], dict[str, object]], text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` and without columns whose names clash with ``new`` (case-insensitively),
    plus the columns that ``make`` returns for each slice of ``text`` (see textarrays.slices).

    ``new`` maps names to Spark types; ``make`` also sees the dropped columns.
    """
    names = {c.lower() for c in new}
    given = [f for f in df.schema.fields if f.name.lower() not in names]
    kept = [f for f in given if f.name not in drop]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` {t}" for c, t in new.items()])
    types = {c: ARROW[t] for c, t in new.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                made = make(batch)
                arrays = [batch.column(f.name) for f in kept] + [pa.array(made[c], t) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in kept), *types])

    return df.select(*[df[f"`{f.name}`"] for f in given]).mapInArrow(run, schema)
