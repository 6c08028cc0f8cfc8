"""A registry of user functions: scalar, vectorised, aggregate, and table functions, usable in SQL once registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

KINDS = ("scalar", "pandas", "aggregate", "window", "frame", "table")


def over_frames(function: Callable, returns: str) -> Callable:
    """function(values, starts) on a column of arrays, in Arrow batches: frame i of a batch begins at values[starts[i]] and ends where the next begins.

    Null and empty frames give null, and the function does not see them.
    """

    kind = to_arrow_type(_parse_datatype_string(returns))

    @F.arrow_udf(returns)
    def run(frames: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(frames), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        full = sizes > 0
        if not full.any():
            return pa.nulls(len(frames), kind)
        found = function(frames.flatten().to_numpy(zero_copy_only=False), (np.cumsum(sizes) - sizes)[full])
        return pa.array(found).cast(kind).take(pa.array(np.cumsum(full) - 1, mask=~full))

    return run


@dataclass(frozen=True)
class FunctionInfo:
    name: str
    kind: str
    returns: str
    arity: int | None


class FunctionRegistry:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._known: dict[str, FunctionInfo] = {}

    def register(self, name: str, function: Callable, returns: str, kind: str = "pandas", arity: int | None = None) -> FunctionInfo:
        """kind: pandas takes and gives pandas series (Arrow batches), aggregate and window take series and give a value (of a group, or of a row's frame in
        OVER), scalar takes single values, table is a class with eval(). An aggregate or a window function sees a whole group or frame in one task.
        A window function is called once a row, which costs about a quarter of a millisecond; a frame function takes the frames of a whole batch of rows at once
        (see over_frames) and is called on collect_list(x) OVER (...).
        """
        if kind not in KINDS:
            raise ValueError(f"{kind!r} is none of {KINDS}")
        if name in self._known:
            raise ValueError(f"{name} is registered already")
        if kind == "table":
            self.spark.udtf.register(name, F.udtf(function, returnType=returns))
        elif kind == "scalar":
            self.spark.udf.register(name, F.udf(function, returns, useArrow=True))
        elif kind == "frame":
            self.spark.udf.register(name, over_frames(function, returns))
        else:
            if kind in ("aggregate", "window") and "return" not in getattr(function, "__annotations__", {}):
                raise ValueError(f"{name} needs type hints: series to a value")
            self.spark.udf.register(name, F.pandas_udf(function, returns))
        self._known[name] = info = FunctionInfo(name, kind, returns, arity)
        return info

    def unregister(self, name: str) -> None:
        del self._known[name]
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def list(self) -> list[FunctionInfo]:
        return sorted(self._known.values(), key=lambda f: f.name)

    def info(self, name: str) -> FunctionInfo:
        return self._known[name]
