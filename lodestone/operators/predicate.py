"""The portable predicate language: JSON trees to columns, and the key range that a predicate leaves.

A node is {"op": ..., ...}: eq ne lt le gt ge with "col" and "val"; and, or with "args"; not with "arg"; in with "col" and "vals"; between with
"col", "low", "high"; like and ilike with "col" and "val" or "pattern"; is_null with "col"; true. A value is {KIND: ...} or {"type": KIND, "value": ...}
with a KIND of int, float, str, bool, bytes (base64) or null, or a plain JSON value. Nulls follow SQL's three-valued logic.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"int": int, "float": float, "str": str, "bool": bool, "bytes": base64.b64decode}
_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


def _value(spec: object) -> object:
    if not isinstance(spec, dict):
        return spec
    kind, value = (spec["type"], spec.get("value")) if "type" in spec else next(iter(spec.items()), (None, None))
    if kind != "null" and kind not in _KINDS:
        raise ValueError(f"{spec!r} is no value")
    return None if kind == "null" or value is None else _KINDS[kind](value)


def _literal(spec: object) -> Column:
    value = _value(spec)
    return F.lit(bytearray(value)) if isinstance(value, bytes) else F.lit(value)


def parse_filter(tree: str | dict | None) -> Column:
    """A predicate column from JSON text or a parsed tree; nothing at all keeps every row."""
    node = json.loads(tree) if isinstance(tree, str) and tree else tree
    if not node:
        return F.lit(True)
    op = node["op"]
    if op in _COMPARE:
        return _COMPARE[op](F.col(node["col"]), _literal(node["val"]))
    if op in ("and", "or"):
        args = [parse_filter(a) for a in node["args"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), args) if args else F.lit(op == "and")
    if op == "not":
        return ~parse_filter(node["arg"])
    if op == "in":
        return F.col(node["col"]).isin([_value(v) for v in node["vals"]])
    if op == "between":
        return F.col(node["col"]).between(_literal(node["low"]), _literal(node["high"]))
    if op in ("like", "ilike"):
        return getattr(F.col(node["col"]), op)(_value(node["val"] if "val" in node else node["pattern"]))
    if op == "is_null":
        return F.col(node["col"]).isNull()
    if op == "true":
        return F.lit(True)
    raise ValueError(f"no predicate {op!r}")


@dataclass(frozen=True)
class KeyRange:
    """Keys from low to high; None is unbounded. `empty` if no key is left."""

    low: object = None
    high: object = None
    low_open: bool = False
    high_open: bool = False

    @property
    def empty(self) -> bool:
        if self.low is None or self.high is None:
            return False
        return self.low > self.high or (self.low == self.high and (self.low_open or self.high_open))

    def both(self, other: KeyRange) -> KeyRange:
        low, low_open = max(((r.low, r.low_open) for r in (self, other) if r.low is not None), default=(None, False))
        high, closed = min(((r.high, not r.high_open) for r in (self, other) if r.high is not None), default=(None, True))
        return KeyRange(low, high, low_open, not closed)

    def overlaps(self, start: object, end: object) -> bool:
        """Whether a shard of the keys start (inclusive) to end (exclusive; None unbounded) may hold a key of the range."""
        if self.empty or (end is not None and self.low is not None and self.low >= end):
            return False
        return not (start is not None and self.high is not None and (self.high < start or (self.high == start and self.high_open)))

    def column(self, key: str) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = F.col(key) > F.lit(self.low) if self.low_open else F.col(key) >= F.lit(self.low)
        if self.high is not None:
            out = out & (F.col(key) < F.lit(self.high) if self.high_open else F.col(key) <= F.lit(self.high))
        return out


def key_bounds(tree: str | dict | None, key: str) -> KeyRange:
    """The range of `key` outside which the predicate can't hold. Only conjunctions narrow it; an `or` or `not` leaves it whole."""
    node = json.loads(tree) if isinstance(tree, str) and tree else tree
    if not node:
        return KeyRange()
    op = node["op"]
    if op == "and":
        return reduce(KeyRange.both, (key_bounds(a, key) for a in node["args"]), KeyRange())
    if node.get("col") != key:
        return KeyRange()
    if op == "between":
        return KeyRange(_value(node["low"]), _value(node["high"]))
    if op == "in" and node["vals"]:
        values = [v for v in map(_value, node["vals"]) if v is not None]  # nothing equals a null
        return KeyRange(min(values), max(values)) if values else KeyRange()
    v = _value(node["val"]) if "val" in node else None
    return {"eq": KeyRange(v, v), "gt": KeyRange(low=v, low_open=True), "ge": KeyRange(low=v), "lt": KeyRange(high=v, high_open=True), "le": KeyRange(high=v)}.get(op, KeyRange())
