"""Small helpers for Arrow-batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def with_columns(df: DataFrame, made: dict[str, tuple[str, Callable]], over: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus one column per entry of ``made`` (name -> (SQL type, function from the list of values of ``over``))."""
    from pyspark.sql.types import StructField, StructType

    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = StructType([*kept, *(StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType) for name, (kind, _) in made.items())])
    names = [f.name for f in kept]
    fns = {k: f for k, (_, f) in made.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for b in batches:
            values = b.column(over).to_pylist()
            cols = [b.column(n) for n in names] + [pa.array(f(values), out.field(k).type) for k, f in fns.items()]
            yield pa.RecordBatch.from_arrays([c.cast(out.field(i).type) if c.type != out.field(i).type else c for i, c in enumerate(cols)], schema=out)

    return df.mapInArrow(run, schema)
