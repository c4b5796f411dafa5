"""Rewrite every string inside nested columns without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_strings(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StringType):
        return True
    if isinstance(data_type, T.StructType):
        return any(has_strings(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return has_strings(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return has_strings(data_type.valueType)
    return False


def map_strings(column: Column, data_type: T.DataType, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` at any depth of structs, arrays and map values; map keys stay."""
    if not has_strings(data_type):
        return column
    if isinstance(data_type, T.StringType):
        return change(column)
    if isinstance(data_type, T.StructType):
        for field in data_type.fields:
            if has_strings(field.dataType):
                inner = map_strings(column[field.name], field.dataType, change)
                column = column.withField(f"`{field.name}`", inner)
        return column
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: map_strings(item, data_type.elementType, change))
    return F.transform_values(column, lambda _key, item: map_strings(item, data_type.valueType, change))
