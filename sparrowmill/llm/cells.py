"""Comparing the members of inverted lists that lie in different components, in cells of a bounded size.

Lists that hold about the same members (a near copy is in many lists of its group) have a least member by hash in common:
such lists are compared as one where that takes fewer comparisons than one after the other.

A list's largest component needs no comparisons within itself, so its members meet the list's other members only. Both are
dealt to blocks of CELL members (or WEIGHT of what they weigh), by hash: each block of the others meets each block of the
others and each of the largest component's. So no task holds a whole list, and while a list's others fit in one block its
cells grow with its size. A cell gives no pairs but one row for each component that it connects with another, so what
comes out of it is bounded by its members and not by their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

CELL = 1024
WEIGHT = 1 << 19

#: Of a cell's rows, their components and their sides, the places of linked pairs, as two arrays; of the pairs that connect the
#: same components one is enough. Members of one component aren't to be compared, nor are those of one side, where sides are
#: 0 or more.
Compare = Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def open_members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Of lists (token, key, ..) the rows of those whose members lie in unlike components, with each row's `component`; a
    key that labels (node, component) don't have is a component of its own."""
    named = lists.join(labels.select(F.col("node").alias("key"), F.col("component").alias("_c")), "key", "left").withColumn("component", F.coalesce("_c", "key")).drop("_c")
    unlike = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return named.join(unlike, "token")


def merged(members: DataFrame) -> DataFrame:
    """members (token, key, component, weight), a written table, with one token for lists of one least member, if all pairs of
    their members are no more than the pairs of each of the lists; each key once in a list."""
    least = F.min(F.struct(F.xxhash64("key").alias("h"), "key"))["key"]
    lists = runtime.checkpointed(members.groupBy("token").agg(least.alias("pivot"), F.count("*").cast("double").alias("size")))
    apart = lists.groupBy("pivot").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    together = members.join(lists, "token").select("pivot", "key").distinct().groupBy("pivot").count()
    fewer = together.join(apart, "pivot").where(F.col("count").cast("double") * F.col("count") <= F.col("apart")).select("pivot", F.xxhash64("pivot").alias("list"))
    named = lists.join(fewer, "pivot", "left").select("token", F.coalesce("list", "token").alias("list"))
    each = members.join(named, "token").groupBy(F.col("list").alias("token"), "key").agg(F.first("component").alias("component"), F.first("weight").alias("weight"))
    out = runtime.checkpointed(each)
    runtime.release(lists)
    return out


def _dealt(members: DataFrame) -> DataFrame:
    by = members.groupBy("token", "component").agg(F.count("*").alias("count"), F.sum("weight").alias("weight"))
    of = by.groupBy("token").agg(
        F.max_by("component", F.struct("count", "component")).alias("_largest"),
        F.max("count").alias("_most"), F.sum("count").alias("_all"),
        F.max_by("weight", F.struct("count", "component")).alias("_most_weight"), F.sum("weight").alias("_all_weight"),
    )

    def blocks_of(count, weight):
        return F.greatest(F.lit(1), F.ceil(count / CELL), F.ceil(weight / WEIGHT))

    blocks = {"_others": blocks_of(F.col("_all") - F.col("_most"), F.col("_all_weight") - F.col("_most_weight")), "_main": blocks_of(F.col("_most"), F.col("_most_weight"))}
    rows = members.join(of.withColumns(blocks), "token")
    rows = rows.withColumn("_in_main", F.col("component") == F.col("_largest")).withColumn("_block", F.pmod(F.xxhash64("key", "token"), F.when(F.col("_in_main"), F.col("_main")).otherwise(F.col("_others"))))

    def cell(kind: int, i, j, side):
        return F.struct(F.xxhash64("token", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))

    def upto(n):
        return F.sequence(F.lit(0).cast("long"), n - 1)

    block = F.col("_block")
    own = F.transform(upto(F.col("_others")), lambda o: cell(0, F.least(o, block), F.greatest(o, block), F.when(o != block, block > o).cast("int")))
    across = F.transform(upto(F.col("_main")), lambda d: cell(1, block, d, F.lit(0)))
    main = F.transform(upto(F.col("_others")), lambda o: cell(1, o, block, F.lit(1)))
    every = rows.withColumn("_cells", F.when(F.col("_in_main"), main).otherwise(F.concat(own, across)))
    return every.select(F.inline("_cells"), "key", "component").select("cell", F.coalesce("side", F.lit(-1)).alias("side"), "key", "component")


def connected(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the components that pairs of places connect, each and the least one that it is connected with."""
    low: dict[int, int] = {}

    def least(x: int) -> int:
        while (y := low.setdefault(x, x)) != x:
            low[x] = low[y]
            x = y
        return x

    for x, y in zip(component[a].tolist(), component[b].tolist()):
        x, y = least(x), least(y)
        low[max(x, y)] = min(x, y)
    rows = np.array([(least(x), x) for x in list(low) if least(x) != x], np.int64).reshape(-1, 2)
    return rows[:, 0], rows[:, 1]


def links(members: DataFrame, held: DataFrame, compare: Compare) -> DataFrame:
    """Links (a, b) between components, a < b, each once, that connect all those that `compare` finds to have linked members
    among members (token, key, component, weight) of a list, as a written table. held: the rows (key, ..) that it is given."""
    dealt = _dealt(members).join(held, "key").select("cell", "side", "component", *held.columns).repartition("cell").sortWithinPartitions("cell")

    def within(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        component, side = (table.column(c).to_numpy() for c in ("component", "side"))
        return connected(component, *compare(table, component, side))

    def found(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables).combine_chunks()
        cell = table.column("cell").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        got = [within(table.slice(s, e - s)) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()) if e - s > 1]
        both = np.stack([np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1)])
        both = np.unique(both, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of one cell, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(0).to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield found([*held, batch.slice(0, last)])
                held = []
            elif held and held[0].column(0)[0].as_py() != cell[-1]:
                yield found(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield found(held)

    return runtime.checkpointed(dealt.mapInArrow(run, "a long, b long").distinct())
