"""Type names of the schema language and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import ParseError

NAMES = {
    "STRING": T.StringType(), "INT64": T.LongType(), "INT": T.LongType(), "SERIAL": T.LongType(), "INT32": T.IntegerType(), "INT16": T.ShortType(),
    "INT8": T.ByteType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "BLOB": T.BinaryType(), "BYTES": T.BinaryType(),
}


def to_spark(name: str) -> T.DataType:
    """STRING, INT64, DOUBLE, BOOL...; a name with [] after it is a list."""
    if name.endswith("[]"):
        return T.ArrayType(to_spark(name[:-2]))
    if name.upper() not in NAMES:
        raise ParseError(f"unknown type {name}")
    return NAMES[name.upper()]


def to_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return to_name(kind.elementType) + "[]"
    return next((n for n, k in NAMES.items() if k == kind), kind.simpleString().upper())
