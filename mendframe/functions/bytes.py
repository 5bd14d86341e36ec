"""Byte strings as Column expressions: occurrences, positions, sampling, integers, entropy, error texts.

Searches are Arrow functions: a batch of blobs goes to Python once for all searches of a projection, and each search walks
over a blob's bytes once, in linear time. No needle here can overlap itself, so left to right every occurrence is found.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def latin(content: Column) -> Column:
    """Bytes as characters of the same number."""
    return F.decode(content, "ISO-8859-1")


def over_bytes(each: Callable[[bytes], object], kind: str, arrow: pa.DataType, null: object = None) -> Callable[[Column], Column]:
    """A function of a binary column, or of a string of latin-1 characters, made of a function of bytes."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
        own = (v.as_py() for v in values)
        return pa.array([null if v is None else each(v.encode("latin-1") if text else v) for v in own], arrow)

    return run


@lru_cache(maxsize=None)
def _pattern(needles: tuple[str, ...]) -> re.Pattern:
    """Finds each place where a needle begins; needles may overlap each other, so those of several bytes are looked ahead for."""
    marks = [bytes.fromhex(n) for n in needles]
    firsts = {m[:1] for m in marks}
    if all(len(m) == 2 for m in marks) and len(firsts) == 1 and not any(m[1:] in firsts for m in marks):
        return re.compile(re.escape(marks[0][:1]) + b"[" + b"".join(re.escape(m[1:]) for m in marks) + b"]", re.DOTALL)
    if len(marks) == 1:
        return re.compile(re.escape(marks[0]), re.DOTALL)
    return re.compile(b"(?=" + b"|".join(re.escape(m) for m in marks) + b")", re.DOTALL)


def found(data: bytes, needles: Iterable[str]) -> list[int]:
    """Ascending offsets of the bytes of any needle."""
    return [m.start() for m in _pattern(tuple(needles)).finditer(data)]


def sampled(held: list[int], limit: int) -> list[int]:
    """The Python twin of sample()."""
    n = len(held)
    if n <= limit:
        return held
    ends = {i for i in (0, 1, 2, n - 3, n - 2, n - 1) if 0 <= i < n}
    rest = limit - len(ends)
    return [held[i] for i in sorted(ends | {round(i * ((n - 1) / rest)) for i in range(rest)})]


@lru_cache(maxsize=None)
def _finder(needles: tuple[str, ...]) -> Callable[[Column], Column]:
    return over_bytes(lambda data: found(data, needles), "array<int>", pa.list_(pa.int32()), [])


@lru_cache(maxsize=None)
def _counter(needles: tuple[str, ...]) -> Callable[[Column], Column]:
    marks = [bytes.fromhex(n) for n in needles]
    return over_bytes(lambda data: sum(data.count(m) for m in marks), "bigint", pa.int64())


def count_of(content: Column, hexadecimal: str) -> Column:
    """How often the bytes occur."""
    return _counter((hexadecimal,))(content)


def count_of_any(content: Column, needles: list[str]) -> Column:
    return _counter(tuple(needles))(content)


def positions(content: Column, hexadecimal: str) -> Column:
    """Ascending 0-based offsets of the bytes; none for a null."""
    return _finder((hexadecimal,))(content)


def positions_of_any(content: Column, needles: list[str]) -> Column:
    return _finder(tuple(needles))(content)


def sample(held: Column, limit: int) -> Column:
    """At most about limit of the positions: all if few; else three at each end and evenly spread ones, half to even."""

    def of(pos: Column) -> Column:
        n = F.size(pos)
        ends = F.array_distinct(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2), n - 3, n - 2, n - 1), lambda i: (i >= 0) & (i < n)))
        rest = F.lit(limit) - F.size(ends)
        step = (n - 1).cast("double") / F.greatest(rest, F.lit(1))
        spread = F.transform(F.sequence(F.lit(0), F.greatest(rest - 1, F.lit(0))), lambda i: F.bround(i * step, 0).cast("int"))
        chosen = F.array_sort(F.array_distinct(F.concat(ends, F.when(rest > 0, spread).otherwise(F.array().cast("array<int>")))))
        return F.when(n <= limit, pos).otherwise(F.transform(chosen, lambda i: F.get(pos, i)))

    # the array is held once, as the one element of an outer array
    return F.flatten(F.transform(F.array(held), of))


def bytes_at(content: Column, offset: Column, length: int) -> Column:
    """length bytes from a 0-based offset."""
    return F.substring(content, offset + 1, F.lit(length))


def little_endian(content: Column, offset: Column) -> Column:
    """The unsigned 32-bit little-endian number at a 0-based offset; null past the end."""
    digits = F.concat(*[F.hex(F.substring(content, offset + k, F.lit(1))) for k in (4, 3, 2, 1)])
    return F.when(F.length(digits) == 8, F.conv(digits, 16, 10).cast("long"))


def byte_entropy(data: bytes) -> float:
    """Shannon entropy of a histogram of bytes in bits, 0 for no bytes."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(data))
    return float(-(share * np.log2(share)).sum()) if len(data) else 0.0


@lru_cache(maxsize=None)
def _entropy() -> Callable[[Column], Column]:
    return over_bytes(byte_entropy, "double", pa.float64(), 0.0)


def entropy(content: Column) -> Column:
    return _entropy()(content)


def compact_error(text: Column, lines: int = 4, chars: int = 400) -> Column:
    """The first lines of an error text, trimmed and joined by ' | ', cut to a length."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n")
    kept = F.slice(F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != ""), 1, lines)
    joined = F.array_join(kept, " | ")
    return F.when(F.length(joined) > chars, F.concat(F.substring(joined, 1, chars - 3), F.lit("..."))).otherwise(joined)
