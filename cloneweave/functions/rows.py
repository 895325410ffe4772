"""Columns from the annotation kernel's functions of Python values, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def per_row(f: Callable, kind: DataType, *columns: Column, nulls: bool = False) -> Column:
    """``f`` of each row's values; null where one of them is, unless ``f`` takes ``nulls``."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(*values: pa.Array) -> pa.Array:
        return pa.array([None if not nulls and None in row else f(*row) for row in zip(*(v.to_pylist() for v in values))], arrow)

    return run(*columns)
