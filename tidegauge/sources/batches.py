"""Rows between Spark and its Python workers, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

#: Rows of a batch that goes out, and rows that become Python values at once.
ROWS, STEP = 4096, 256


def schema(ddl: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "timestamp": pa.timestamp("us", "UTC")}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def columns(batch, names: list[str]) -> list:
    """Columns of a batch, times as microseconds."""
    import pyarrow as pa

    return [c.cast(pa.int64()) if pa.types.is_timestamp(c.type) else c for c in (batch.column(n) for n in names)]


def values(column) -> list:
    """A column as Python values; by way of numpy for numbers and booleans, which is several times as fast."""
    import pyarrow as pa

    plain = not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_boolean(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def tuples(batches: Iterable, names: list[str]) -> Iterator[tuple]:
    """The rows of some columns as Python values, times as microseconds."""
    for b in batches:
        cols = columns(b, names)
        for at in range(0, b.num_rows, STEP):
            yield from zip(*[values(c.slice(at, STEP)) for c in cols])


def packed(rows: Iterable[dict], ddl: str, size: int = ROWS) -> Iterator:
    """Rows as Arrow batches; a column that a row lacks is null."""
    import pyarrow as pa

    kinds, rows = schema(ddl), iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(part, schema=kinds)


def groups(batches: Iterable, key: str) -> Iterator:
    """Tables of whole groups, from batches in order of an integer key: only the rows of the last key wait for the next batch."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not t.num_rows:
            continue
        if t[key].null_count:
            raise ValueError(f"{key} is null")
        keys = t[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest
