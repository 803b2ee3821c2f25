"""Row generators over Arrow batches: the one way in which this library leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[..., Iterable[tuple]]], schema: str, chunk: int = 4000, weigh: Callable[[tuple], int] | None = None) -> DataFrame:
    """Apply to each row, given as the values of `columns`, a function that yields result rows as tuples.

    `make` runs once per task and returns the function, so costly state (automata, tables) is built once per task.
    Results leave in batches of `chunk` rows, or of rows that weigh 16 million together by `weigh`, also within one input row, so
    that one long input can't hold a task's memory.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(kind)
        row, out = make(), []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(target)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, target.types, strict=True)], schema=target)
            out.clear()
            return batch

        for batch in batches:
            for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if weigh is None:
                    for result in row(*values):
                        out.append(result)
                        if len(out) >= chunk:
                            yield flush()
                    continue
                weight = sum(map(weigh, out))
                for result in row(*values):
                    out.append(result)
                    weight += weigh(result)
                    if len(out) >= chunk or weight >= 16_000_000:
                        yield flush()
                        weight = 0
        yield flush()

    return df.select(*columns).mapInArrow(run, kind)
