"""Small tables from the driver as local relations, whose size the planner knows."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    cols = list(zip(*rows)) or [[] for _ in schema]
    arrays = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], f.type) for c, f in zip(cols, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
