"""Numbers, strings, and times."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["date_bin", "gcd", "iszero", "lcm", "regexp_match", "regexp_replace_first", "similar_pattern", "similar_to", "strpos", "to_hex", "trunc"]


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps: 46 halve a pair of 32-bit numbers to nothing, 93 one of 64-bit."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    common = gcd(a, b)
    return F.when(common == 0, F.lit(0).cast("long")).otherwise((F.abs(a).cast("long") / common).cast("long") * F.abs(b))


def iszero(x: Column) -> Column:
    return x == 0


def trunc(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def date_bin(seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin of `seconds` that holds ts, counted from origin. timestamp_ntz stays timestamp_ntz."""
    base = F.unix_timestamp(F.lit(origin).cast("timestamp"))
    at = F.unix_micros(ts.cast("timestamp")) - base * 1_000_000
    return F.timestamp_micros((F.floor(at / (seconds * 1_000_000)) * seconds + base) * 1_000_000).cast("timestamp_ntz")


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """The regular expression of a SIMILAR TO pattern: % and _ stand for any text and any character, | * + ? {} () [] keep their meaning, all else is itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": "(?s:.*)", "_": "(?s:.)"}.get(c) or (c if c in "|*+?{}()[]^-," else re.escape(c)))
        i += 1
    return f"^(?:{''.join(out)})$"


def similar_to(text: Column, pattern: str, escape: str = "\\") -> Column:
    """The whole text matches; null where the text is."""
    return text.rlike(similar_pattern(pattern, escape))


def strpos(text: Column, part: Column | str) -> Column:
    return F.locate(part, text) if isinstance(part, str) else F.position(part, text)


def regexp_replace_first(text: Column, pattern: str, to: str) -> Column:
    """Only the first match, where Spark's regexp_replace takes all."""
    at = F.regexp_instr(text, F.lit(pattern))
    found = F.regexp_substr(text, F.lit(pattern))
    return F.when(at == 0, text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(to), F.substring(text, at + F.length(found), F.length(text))))


def regexp_match(text: Column, pattern: str, groups: int = 0) -> Column:
    """The groups of the first match as an array (the whole match without groups); null where nothing matches."""
    parts = [F.regexp_extract(text, pattern, g) for g in (range(1, groups + 1) if groups else (0,))]
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array(*parts))
