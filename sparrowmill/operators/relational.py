"""Relational operators over DataFrames: the eight join modes, aggregates, windows, sorting, set operations.

Each one states a logical plan; Catalyst and adaptive execution choose how to run it. Hints are for callers who want a
certain physical operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import nulls_first

INDEX_BYTES = 64 << 20
MODES = ("inner", "left", "right", "full", "cross", "semi", "anti_null_as_false", "anti_null_as_true")


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[tuple[str, str, str]] | None, mode: str = "inner", algorithm: str | None = None) -> DataFrame:
    """on: a condition, or triples (left column, operator, right column) that all must hold. algorithm: hash, sort_merge or
    nested_loop, as a hint; index has every task probe a hash index of the whole right side, if the planner's estimate of its
    size is at most INDEX_BYTES, and is hash otherwise. anti_null_as_true (NOT IN) keeps a row if every comparison is false, none unknown."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "cross":
        return left.crossJoin(right)
    if algorithm:
        if algorithm == "index":
            algorithm = "broadcast" if _estimate(right) <= INDEX_BYTES else "hash"
        right = right.hint({"hash": "shuffle_hash", "sort_merge": "merge", "nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast"}[algorithm])
    if on is not None and not isinstance(on, Column):
        compare = {"=": Column.__eq__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
        parts = [compare[op](left[a], right[b]) for a, op, b in on]
        if mode == "anti_null_as_true" and [op for _, op, _ in on] == ["="]:
            # the form that the planner knows as a null-aware anti join, by hash
            return left.join(right, parts[0] | parts[0].isNull(), "left_anti")
        condition = reduce(Column.__and__, parts) if parts else F.lit(True)
    else:
        condition = on
    if mode == "anti_null_as_true":
        # an unknown comparison counts as a match; rows with one are few, so they are joined by themselves, and the others by
        # whatever the condition allows
        return left.join(right, condition, "left_anti").join(right, condition.isNull(), "left_anti")
    how = {"semi": "left_semi", "anti_null_as_false": "left_anti"}.get(mode, mode)
    return left.join(right, condition, how)


def _estimate(df: DataFrame) -> int:
    """The planner's estimate of a result's bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def using(left: DataFrame, right: DataFrame, names: Sequence[str], mode: str = "inner") -> DataFrame:
    """JOIN .. USING: the left input's key columns are kept, in all modes."""
    left, right = left.alias("_l"), right.alias("_r")
    condition = F.lit(True)
    for n in names:
        condition = condition & (F.col(f"_l.{n}") == F.col(f"_r.{n}"))
    joined = left.join(right, condition, mode)
    return joined.select(*(F.col(f"_l.{c}") for c in left.columns), *(F.col(f"_r.{c}") for c in right.columns if c not in names))


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joined on all columns of equal names; a product if there are none."""
    names = [c for c in left.columns if c in right.columns]
    return using(left, right, names) if names else left.crossJoin(right)


AGGREGATES = ("count", "count_distinct", "sum", "avg", "min", "max", "stddev_samp", "any")


def aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """aggregates: (function, column or None for all rows, alias). Sums of integers are long, others double; no function but
    min, max, count and any takes strings. Without aggregates the result is the distinct keys."""
    if not aggregates:
        return df.select(*keys).distinct()
    out = []
    for name, column, alias in aggregates:
        if name not in AGGREGATES:
            raise ValueError(f"functions are {AGGREGATES}")
        if name in ("sum", "avg", "stddev_samp"):
            kind = df.schema[column].dataType
            if isinstance(kind, T.StringType):
                raise TypeError(f"{name} of a string")
        c = F.col(column) if column else F.lit(1)
        value = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev_samp": F.stddev_samp, "any": F.any_value}[name](c)
        if name == "sum":
            value = value.cast("long" if isinstance(kind, (T.IntegerType, T.LongType)) else "double")
        out.append(value.alias(alias))
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def reduce_group_by(df: DataFrame, keys: Sequence[str], determined: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Group by the keys only; columns that they determine are taken from any row, which narrows the shuffle's key."""
    return df.groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in determined), *aggregates)


def sort(df: DataFrame, keys: Sequence[str], descending: Sequence[str] = (), stable: bool = False) -> DataFrame:
    """stable: rows of equal keys keep their order in df."""
    order = nulls_first(*keys, descending=tuple(descending))
    if not stable:
        return df.orderBy(*order)
    return df.withColumn("_place", F.monotonically_increasing_id()).orderBy(*order, "_place").drop("_place")


def top(df: DataFrame, keys: Sequence[str], n: int, descending: Sequence[str] = ()) -> DataFrame:
    if not isinstance(n, int) or n < 0:
        raise ValueError("a limit is an integer of 0 or more")
    return sort(df, keys, descending).limit(n)


RANKS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def windowed(function: str, column: str | None, partition: Sequence[str], order: Sequence[Column] = (), frame: tuple[str, int | None, int | None] | None = None) -> Column:
    """A window function. frame: (rows or range, start, end), bounds as offsets or None for unbounded. Ranks are long."""
    w = W.partitionBy(*partition)
    if order:
        w = w.orderBy(*order)
    if frame:
        kind, start, end = frame
        if start is not None and end is not None and end < start:
            raise ValueError("a frame that ends before it starts")
        start, end = W.unboundedPreceding if start is None else start, W.unboundedFollowing if end is None else end
        w = w.rowsBetween(start, end) if kind == "rows" else w.rangeBetween(start, end)
    if function in RANKS:
        return RANKS[function]().over(w).cast("long")
    if function in ("percent_rank", "cume_dist"):
        return getattr(F, function)().over(w)
    c = F.col(column) if column else F.lit(1)
    if function == "count_distinct":
        # a set for each row: counted() does without, where there is no frame
        return F.size(F.collect_set(c).over(w)).cast("long")
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev_samp": F.stddev_samp}[function](c).over(w)


def counted(df: DataFrame, column: str, partition: Sequence[str], alias: str) -> DataFrame:
    """df with COUNT(DISTINCT column) OVER (PARTITION BY partition), counted once for each group and joined back, so that no
    row holds its group's values."""
    keys = [f"_key_{i}" for i in range(len(partition))]
    counts = df.groupBy(*(F.col(p).alias(k) for p, k in zip(partition, keys))).agg(F.count_distinct(column).alias(alias))
    same = reduce(Column.__and__, (df[p].eqNullSafe(counts[k]) for p, k in zip(partition, keys)))
    return df.join(counts, same).drop(*keys)


def render(df: DataFrame, rows: int = 100) -> str:
    """The first rows of a result as text, in columns."""
    found = df.limit(rows).collect()
    cells = [df.columns, *([("NULL" if v is None else str(v)) for v in r] for r in found)]
    widths = [max(len(c[i]) for c in cells) for i in range(len(df.columns))]
    lines = ["| " + " | ".join(x.ljust(w) for x, w in zip(c, widths)) + " |" for c in cells]
    return "\n".join([lines[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *lines[1:]])


def _same_types(a: DataFrame, b: DataFrame) -> None:
    if [f.dataType for f in a.schema.fields] != [f.dataType for f in b.schema.fields]:
        raise TypeError("set operations need equal column types")


def set_operation(a: DataFrame, b: DataFrame, operation: str, all_rows: bool = False) -> DataFrame:
    """union, except or intersect, of sets or (all_rows) bags."""
    _same_types(a, b)
    if operation == "union":
        return a.unionAll(b) if all_rows else a.union(b).distinct()
    if operation == "except":
        return a.exceptAll(b) if all_rows else a.subtract(b)
    if operation == "intersect":
        return a.intersectAll(b) if all_rows else a.intersect(b)
    raise ValueError("operation is union, except or intersect")


def unique_columns(df: DataFrame) -> DataFrame:
    """Which single columns hold no value twice and no NULL: one aggregation for all of them."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_distinct(c).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), (F.col(c) == F.col("_n")).cast("int").alias("is_unique")) for c in df.columns))
    return counts.select(F.inline(pairs))
