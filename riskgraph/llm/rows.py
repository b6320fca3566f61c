"""Row-wise Python over Arrow batches, for operators that read whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from riskgraph.functions.cluster import ship_package

#: Rows that are held as Python objects at a time.
CHUNK = 64


def map_rows(df: DataFrame, columns: list[str], factory: Callable, schema: str, many: bool = False) -> DataFrame:
    """Calls a function for each row of ``columns``; its tuples make up ``schema``.

    ``factory()`` runs once per task and returns the function. With ``many`` the
    function returns an iterable of tuples. Only ``columns`` leave the JVM, so
    further columns of ``df`` can neither clash nor cost anything.
    """
    ship_package(df.sparkSession)
    struct: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                rows = zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)
                if many:
                    out = [t for r in rows for t in f(*r)]
                else:
                    out = [f(*r) for r in rows]
                if out:
                    cols = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=x.type) for c, x in zip(cols, arrow, strict=True)], schema=arrow
                    )

    return df.select(*columns).mapInArrow(run, struct)


def row_schema(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string, for operators that hand rows through."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
