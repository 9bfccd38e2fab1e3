"""Python functions of the texts of a row, in Arrow batches: no shuffle, and memory that a few rows set, not the table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows whose texts are Python objects at a time.
AT_ONCE = 64
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def over_texts(df: DataFrame, keys: Sequence[str], texts: Sequence[str], columns: Sequence[tuple[str, str]], make: Callable[..., Iterable[Sequence[object]]]) -> DataFrame:
    """(keys, columns): the rows that ``make`` gives for the texts of each row of ``df``."""
    keys, names, types = list(keys), [c for c, _ in columns], [_TYPES[t] for _, t in columns]
    ready = df.select(*keys, *texts)
    schema = ", ".join([f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in keys] + [f"`{c}` {t}" for c, t in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                at, out = [], []
                for i, some in enumerate(zip(*[part.column(len(keys) + n).to_pylist() for n in range(len(texts))], strict=True)):
                    for row in make(*some):
                        at.append(i)
                        out.append(row)
                if out:
                    own = [part.column(n).take(pa.array(at, pa.int32())) for n in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]], [*keys, *names])

    return ready.mapInArrow(run, schema)
