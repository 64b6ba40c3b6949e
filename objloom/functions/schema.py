"""Schemas from text without a session, so that modules can be imported anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "binaries": T.ArrayType(T.BinaryType()),
          "headers": T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())]))}


def struct(text: str) -> T.StructType:
    """``name type, name type``; binaries is an array of binary, headers an array of struct(key, value)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])
