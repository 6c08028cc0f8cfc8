"""Column types: their names in declarations, and what they are in Spark."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Spelling to type; unsigned ones are kept in the next wider type.
NAMES: dict[str, T.DataType] = {
    "TINYINT": T.ByteType(), "INT8": T.ByteType(), "SMALLINT": T.ShortType(), "INT16": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "INT32": T.IntegerType(),
    "BIGINT": T.LongType(), "INT64": T.LongType(), "UINT8": T.ShortType(), "UINT16": T.IntegerType(), "UINT32": T.LongType(), "UINT64": T.DecimalType(20, 0),
    "REAL": T.FloatType(), "FLOAT32": T.FloatType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "FLOAT64": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "CHAR": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(),
    "BINARY": T.BinaryType(), "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(), "BYTES": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType(),
}
SIZES = {"ByteType": 1, "ShortType": 2, "IntegerType": 4, "LongType": 8, "FloatType": 4, "DoubleType": 8, "BooleanType": 1, "DateType": 4, "TimestampNTZType": 8, "DecimalType": 16}


def parse_type(text: str) -> tuple[T.DataType, dict]:
    """A declared type and its metadata (the dimension of a vector)."""
    own = re.sub(r"\s+", " ", text.strip().upper())
    if own.endswith("[]"):
        return T.ArrayType(parse_type(own[:-2])[0]), {}
    name, _, rest = own.partition("(")
    args = [int(x) for x in rest.rstrip(")").split(",")] if rest else []
    name = name.strip()
    if name in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(args[0] if args else 38, args[1] if len(args) > 1 else (0 if args else 10)), {}
    if name == "VECTOR":
        return T.ArrayType(T.FloatType()), {"vector_dim": args[0] if args else 128}
    if name not in NAMES:
        raise ValueError(f"no type {text!r}")
    return NAMES[name], {}


def byte_size(kind: T.DataType, dim: int | None = None) -> int | None:
    """Bytes of a value of fixed width; None for others."""
    return 4 * dim if isinstance(kind, T.ArrayType) and dim else SIZES.get(type(kind).__name__)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)
