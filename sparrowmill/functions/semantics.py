"""Scalar semantics that differ from Spark's defaults, as column expressions.

Integer division truncates and gives NULL for a zero divisor; modulo likewise. SUBSTR counts a start of 0 as the place
before the first character. LIKE has no escape character. IN drops list elements of another kind than the operand.
Orders put NULLs first, ascending and descending. Booleans are integers 0 and 1 in results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type of an arithmetic result: string only with string; double wins; long with a floating type is double."""
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        if type(left) is not type(right):
            raise TypeError("a string has a common type with a string only")
        return T.StringType()
    kinds = {type(left), type(right)}
    if T.DoubleType in kinds or (T.LongType in kinds and T.FloatType in kinds):
        return T.DoubleType()
    if T.LongType in kinds:
        return T.LongType()
    return T.FloatType() if T.FloatType in kinds else T.IntegerType()


def int_div(a: Column, b: Column, to: str = "int") -> Column:
    """Division of integers, truncated."""
    return F.call_function("div", a, F.nullif(b, F.lit(0))).cast(to)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def safe_mod(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign."""
    return a % F.nullif(b, F.lit(0))


def substr(text: Column, start: Column | int, length: Column | int) -> Column:
    start = start if isinstance(start, Column) else F.lit(start)
    length = length if isinstance(length, Column) else F.lit(length)
    zero = start == 0
    return F.substr(text, F.when(zero, 1).otherwise(start), F.when(zero, F.greatest(length - 1, F.lit(0))).otherwise(F.greatest(length, F.lit(0))))


def concat(*parts: Column) -> Column:
    """NULL if any part is."""
    return F.concat(*parts)


def like(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    pattern = pattern.replace("\\", "\\\\")
    return text.ilike(pattern) if ignore_case else text.like(pattern)


def _kind(value) -> str:
    return "string" if isinstance(value, str) else "number"


def in_list(operand: Column, values: list, kind: str = "number") -> Column:
    """kind: "string" or "number", that of the operand."""
    return operand.isin([v for v in values if v is None or _kind(v) == kind])


def as_int(condition: Column) -> Column:
    return condition.cast("int")


def cast_to_int(x: Column, to: str = "int") -> Column:
    """A floating value is truncated and clamped to the type's range."""
    low, high = (-(1 << 31), (1 << 31) - 1) if to == "int" else (-(1 << 63), (1 << 63) - 1)
    return F.when(x >= float(high), F.lit(high)).when(x <= float(low), F.lit(low)).otherwise(F.when((x < float(high)) & (x > float(low)), x).cast(to))


def extract(part: str, moment: Column) -> Column:
    """year, month, day, hour and minute as int, second as double with its fraction."""
    if part == "second":
        return F.date_part(F.lit("SECOND"), moment).cast("double")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute}[part](moment).cast("int")


def nulls_first(*names: str, descending: tuple[str, ...] = ()) -> list[Column]:
    """Sort keys with NULLs first in either direction."""
    return [F.col(n).desc_nulls_first() if n in descending else F.col(n).asc_nulls_first() for n in names]
