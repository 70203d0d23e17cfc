"""Algorithms on small groups (a panel, an axis), many to a task: a partition is sorted by key and streamed group by group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Output rows of a batch.
ROWS = 20_000


def per_key(df: DataFrame, key: str, columns: list[str], run: Callable[[object, dict[str, np.ndarray]], list[tuple]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """run(key value, columns as arrays, rows in `order`) -> output rows, for each key. A task holds one batch and one group.

    Grouped pandas functions do the same with a data frame for each group, which costs milliseconds where a group is a few rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        out: list[tuple] = []
        held: pa.Table | None = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        def groups(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table | None]:
            keys = table.column(key).to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            end = len(cuts) - 1 if last else len(cuts) - 2
            arrays = {c: table.column(c).to_numpy(zero_copy_only=False) for c in columns}
            got = [r for a, b in zip(cuts[:end], cuts[1 : end + 1], strict=True) for r in run(keys[a], {c: v[a:b] for c, v in arrays.items()})]
            return got, None if last else table.slice(cuts[end])

        for b in batches:
            if types is None:
                types = wanted
            if not len(b):
                continue
            table = pa.Table.from_batches([b])
            got, held = groups(pa.concat_tables([held, table]) if held is not None else table, False)
            out += got
            while len(out) >= ROWS:
                yield batch(out[:ROWS])
                out = out[ROWS:]
        if held is not None:
            out += groups(held, True)[0]
        if types is not None:
            yield batch(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]
    rows = df.select(key, *columns, *[c for c in order if c not in columns and c != key])
    return rows.repartition(key).sortWithinPartitions(key, *order).select(key, *columns).mapInArrow(work, schema)
