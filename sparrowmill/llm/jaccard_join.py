"""Operator 10: n-gram Jaccard self-join by a size-aware heavy-light algorithm.

A document's set holds its distinct SHINGLE-word shingles. Two documents link when 100 * |intersection| >= 75 * |union|.

Equal sets are one class, told by aggregation of their signatures; all that follows works on classes. Shingles are dealt by
hash to parts, packed as bytes, so that each part learns which of its shingles more than one class holds, and how many do.
Only those can be in an intersection: a class with fewer of them than three quarters of its set links with nothing and goes.
In the others' sets the shingles that no other class holds come first, then the rarer before the more common.

Light classes (of at most `boundary()` shingles) are enumerated: each gives every subset of the size that a link with a
partner of allowed size needs, and a link is a common subset. Heavy ones are scanned: each gives its prefix, the quarter of
its shingles that comes first, one of which any link must have in common. The boundary is where a set's subsets cost more
than the entries that its prefix meets in the inverted lists, whose mean length is measured. Both kinds of keys make lists.

A list isn't expanded into all its pairs. First each compares its members with one pivot, chosen by hash, so that lists of
the same members share a pivot: this links many near copies of one text at once. Then the other members of lists in which
these lie in different components are compared in cells of a bounded size (see `cells`), lists of about the same members as
one. A cell holds its members' sets and counts the shingles that members of different components have in common, so that no
link between components is lost, and gives only the components that it connects; links within a component change nothing.

Shingles that HOT_HERE classes of one flush hold skip their part (which only gets a mark for each flush) and come last in the
order, by ORDER_BUCKETS counters of a fixed size: so no part has more than HOT_HERE entries a flush of one shingle.

Shingles are 64-bit hashes of their words; equal sets are told by 128 bits and the size. Lists and bounds work on 48 bits of
a shingle and its part, links are those of these hashes.

Defined cases: null and empty texts have no shingles, n_shingles 0 and link with nothing; a text under SHINGLE words has
its whole sequence as its one shingle. Repeated rows are copies of each other, and rows of one doc_id with unlike texts are
documents of their own that share the id: a component's id is the smallest doc_id of its rows. An empty table gives no rows.
Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cells, runtime
from .components import components, joined
from .wordhash import WordHasher, mix, signed

SHINGLE = 5
PIVOTS = 2
MOST_LIGHT = 14  # more shingles than that are never light; a bound on a row's subsets, which changes no result
FLUSH_SHINGLES = 1 << 20
PART_SHINGLES = 2 << 20
LEAST_PARTS = 64
HOT_HERE = 32
HOT_RANK = 1 << 24
ORDER_BUCKETS = 1 << 20


def needed(a: int, b: int) -> int:
    """The least intersection of sets of sizes a and b that link: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def prefix_size(n: int) -> int:
    """Of the n shingles in order, one of so many first ones is in any set that links."""
    return n - -(-3 * n // 4) + 1


def subset_sizes(n: int, most: int) -> list[int]:
    return sorted({needed(n, m) for m in range(-(-3 * n // 4), min(most, 4 * n // 3) + 1)})


def boundary(list_length: float) -> int:
    """The largest size whose subsets cost no more than its prefix, each entry of which meets list_length others."""
    n = 1
    while n < MOST_LIGHT and sum(comb(n + 1, s) for s in subset_sizes(n + 1, n + 1) if s <= n + 1) <= prefix_size(n + 1) * (1 + list_length):
        n += 1
    return n


class Shingles:
    def __init__(self):
        self.hasher = WordHasher()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted by hash."""
        hashes, borders = self.hasher.words(texts, lower=True)
        if not len(hashes):
            return [np.zeros(0, np.uint64)] * len(texts)
        prefix = self.hasher.prefix(hashes)
        every = self.hasher.runs(prefix, np.arange(max(0, len(hashes) - SHINGLE + 1)), SHINGLE)
        out = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(every[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(self.hasher.runs(prefix, np.array([a]), b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def signature(x: np.ndarray) -> np.uint64:
    return x.sum(dtype=np.uint64)


def may_link(n, place, other_n, other_place):
    """Bounds on list members, as numbers or columns: their sizes, and how much can still be common after their places in the
    order, where a place below 0 tells nothing. Of the places before a common shingle at most as many are common as the
    lesser place."""
    least, most = (np.minimum, np.maximum) if isinstance(n, (int, np.ndarray)) else (F.least, F.greatest)
    fits = 4 * least(n, other_n) >= 3 * most(n, other_n)
    common = least(place, other_place) + least(n - place, other_n - other_place)
    return fits & ((place < 0) | (other_place < 0) | (7 * common >= 3 * (n + other_n)))


def _bytes(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the signature (s1, s2) of each row's set; and rows (bucket, n) of how many of a task's sets have
    a shingle in one of ORDER_BUCKETS, for buckets well above the usual."""
    names = ["doc_id", "n_shingles", "s1", "s2", "bucket", "n"]

    def run(batches):
        shingles, counts = Shingles(), np.zeros(ORDER_BUCKETS, np.int32)
        salt = np.uint64(0x5851F42D4C957F2D)
        for batch in batches:
            sets = shingles.sets(_bytes(batch.column(1)))
            one = np.array([signature(x) for x in sets], np.uint64)
            two = np.array([signature(mix(x ^ salt)) for x in sets], np.uint64)
            for x in sets:
                buckets = (x & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)
                counts[buckets] += 1  # two shingles of a set in one bucket count once
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(signed(one)), pa.array(signed(two)), none, none], names=names)
        many = np.flatnonzero(counts > 8 + 4 * counts.mean())
        none = pa.nulls(len(many), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(many), pa.array(counts[many].astype(np.int64))], names=names)

    return docs.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def common_shingles(rows: DataFrame) -> np.ndarray:
    """For each of ORDER_BUCKETS how common its shingles are, as a power of 2 (0: not seen to be common)."""
    out = np.zeros(ORDER_BUCKETS, np.int32)
    sums = rows.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # ORDER_BUCKETS rows at most
    if len(sums):
        out[sums.column("bucket").to_numpy()] = np.floor(np.log2(sums.column("n").to_numpy())) + 1
    return out


_PACKED = ("part", "keys", "sizes", "counts", "shingles", "marks")


def _short(shingles: np.ndarray) -> bytes:
    return shingles.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(column, part: int, bits: int) -> np.ndarray:
    """The shingles of packed rows: 48 bits of each, and its part's number as the highest ones."""
    some = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 6)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, :6] = some
    return out.view(np.uint64).ravel() | np.uint64(part << (64 - bits))


def scattered(docs: DataFrame, bits: int) -> DataFrame:
    """The classes' shingles by parts (the first `bits` bits of a shingle), a row for each flush and part: as bytes, the
    classes' keys and sizes, how many of their shingles are here, and these; and marks, the shingles that are hot here.
    Entries of hot ones are rows of a part with a negative number, one for each flush."""

    def pack(held: dict[int, np.ndarray], part_id: int):
        keys, sizes = np.array(list(held), np.uint64), np.array([len(x) for x in held.values()], np.int32)
        flat, doc = np.concatenate(list(held.values())), np.repeat(np.arange(len(held)), sizes)
        part = (flat >> np.uint64(64 - bits)).astype(np.int64)
        _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        hot = times[back] >= HOT_HERE
        part[hot] = -1
        order = np.argsort(part.astype(np.int16) if bits < 15 else part, kind="stable")
        border = np.searchsorted(part[order], np.arange(-1, (1 << bits) + 1))
        marks = np.unique(flat[hot])
        at = np.searchsorted((marks >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
        rows = []
        for p in range(-1, 1 << bits):
            seg = order[border[p + 1] : border[p + 2]]
            own = marks[at[p] : at[p + 1]] if p >= 0 else marks[:0]
            if not len(seg) and not len(own):
                continue
            first = np.flatnonzero(np.diff(doc[seg], prepend=-1))
            here = doc[seg][first]
            counts = np.diff(first, append=len(seg)).astype(np.int32)
            some = flat[seg]
            rows.append((p if p >= 0 else part_id, keys[here].tobytes(), sizes[here].tobytes(), counts.tobytes(), _short(some) if p >= 0 else some.tobytes(), _short(own)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))], names=list(_PACKED))

    def run(batches):
        shingles, held, size = Shingles(), {}, 0
        number = -1 - (TaskContext.get().partitionId() << 24)
        for batch in batches:
            for x in shingles.sets(_bytes(batch.column(1))):
                if len(x) and (key := int(signature(x))) not in held:
                    held[key] = x
                    size += len(x)
                    if size >= FLUSH_SHINGLES:
                        yield pack(held, number)
                        held, size, number = {}, 0, number - 1
        if held:
            yield pack(held, number)

    return docs.select("doc_id", "text").mapInArrow(run, "part long, keys binary, sizes binary, counts binary, shingles binary, marks binary")


def _binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrays of so many numbers each, out of one, as bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def repeated(packed: DataFrame, bits: int, common: np.ndarray) -> DataFrame:
    """Per part and class: key, n (its set's size), and its shingles that other classes hold too, with their ranks."""
    shared = packed.sparkSession.sparkContext.broadcast(common)  # of a fixed size
    names = ["key", "n", "m", "shingles", "ranks"]

    def hot_rank(x: np.ndarray) -> np.ndarray:
        return HOT_RANK + shared.value[(x & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)]

    def run(part, table):
        part = part[0].as_py()
        keys, sizes, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("sizes", np.int32), ("counts", np.int32)))
        doc = np.repeat(np.arange(len(keys)), counts)
        if part < 0:
            flat = np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64)
            # as the parts cut their shingles
            flat = flat & np.uint64((1 << 48) - 1 | ((1 << bits) - 1) << 64 - bits)
            rank = hot_rank(flat)
        else:
            flat, marks = _long(table.column("shingles"), part, bits), np.unique(_long(table.column("marks"), part, bits))
            # a class may come from several flushes; its shingles of this part are the same but for hot ones, which come by themselves
            once = np.zeros(len(keys), bool)
            once[np.unique(keys, return_index=True)[1]] = True
            keep = once[doc]
            flat, doc = flat[keep], doc[keep]
            order = np.argsort(flat, kind="stable")
            flat, doc = flat[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            times = np.diff(first, append=len(flat))
            hot = np.isin(flat[first], marks, assume_unique=True)
            rank = np.where(hot, hot_rank(flat[first]), np.minimum(times, HOT_RANK - 1))
            keep = np.repeat(hot | (times > 1), times)
            rank = np.repeat(rank, times)[keep]
            flat, doc = flat[keep], doc[keep]
            order = np.argsort(doc, kind="stable")
            flat, doc, rank = flat[order], doc[order], rank[order]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        here, counts = doc[first], np.diff(first, append=len(doc))
        return pa.table([pa.array(signed(keys[here])), pa.array(sizes[here]), pa.array(counts.astype(np.int32)), _binaries(flat, counts), _binaries(rank.astype(np.int32), counts)], names=names)

    return packed.groupBy("part").applyInArrow(run, "key long, n int, m int, shingles binary, ranks binary")


def candidates(docs: DataFrame, n_shingles: int, common: np.ndarray) -> DataFrame:
    """The classes that may link: key, n, their shingles that other classes hold (as bytes, in order), and how many entries of lists their prefix has and meets."""
    bits = max(LEAST_PARTS, n_shingles // PART_SHINGLES).bit_length() - 1
    found = repeated(scattered(docs, bits), bits, common)
    # summed before they move; a hot shingle may be counted twice here, from two flushes
    sums = found.groupBy("key").agg(F.first("n").alias("n"), F.sum("m").alias("m"), F.collect_list("shingles").alias("shingles"), F.collect_list("ranks").alias("ranks")).where("4 * m >= 3 * n")
    names = ["key", "n", "shingles", "entries", "met"]

    def run(batches):
        for batch in batches:
            rows = []
            for key, n, some, ranks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                flat, at = np.unique(np.frombuffer(b"".join(some), np.uint64), return_index=True)
                rank = np.frombuffer(b"".join(ranks), np.int32)[at]
                if 4 * len(flat) < 3 * n:
                    continue
                order = np.lexsort((flat, rank))
                flat, rank = flat[order], rank[order]
                prefix = rank[: max(0, prefix_size(n) - (n - len(flat)))]
                met = np.where(prefix < HOT_RANK, prefix, 2.0 ** np.minimum(40, prefix - HOT_RANK))
                rows.append((key, n, flat.tobytes(), len(prefix), float(met.sum())))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return sums.select("key", "n", "shingles", "ranks").mapInArrow(run, "key long, n int, shingles binary, entries long, met double")


def entries(classes: DataFrame, light: int) -> DataFrame:
    """The inverted lists' entries: token, key, n (the set's size) and place (of the token in the set's order; -1: a subset)."""

    def run(batches):
        for batch in batches:
            tokens, places, counts = [], [], []
            sizes = batch.column(1).to_numpy()
            for n, some in zip(sizes.tolist(), batch.column(2).to_pylist()):
                x = np.frombuffer(some, np.uint64)
                alone, size = n - len(x), 0
                if 4 * n >= 3 * (light + 1):
                    own = x[: max(0, prefix_size(n) - alone)]
                    tokens.append(own)
                    places.append(alone + np.arange(len(own)))
                    size += len(own)
                if n <= light:
                    for k in subset_sizes(n, light):
                        if k <= len(x):
                            chosen = np.array(list(combinations(np.sort(x).tolist(), k)), np.uint64)
                            tokens.append(mix(chosen.sum(axis=1, dtype=np.uint64) + np.uint64(k)))
                            places.append(np.full(len(chosen), -1))
                            size += len(chosen)
                counts.append(size)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            place = np.concatenate(places) if places else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(flat)), pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(np.repeat(sizes, counts).astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["token", "key", "n", "place"],
            )

    return classes.select("key", "n", "shingles").mapInArrow(run, "token long, key long, n int, place int")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys, a written table, whose sets link."""
    sets = classes.select("key", "n", "shingles")
    both = pairs.join(sets.toDF("b", "b_n", "b_set"), "b").join(sets.toDF("a", "a_n", "a_set"), "a")

    def run(batches):
        for batch in batches:
            good = []
            for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                i = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                good.append(7 * i >= 3 * (n + m))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "a_n", "a_set", "b_n", "b_set").mapInArrow(run, "a long, b long")


def _linked_in_cell(table: pa.Table, component: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of linked members, as few pairs as connect all components that linked members connect."""
    n, sets = table.column("n").to_numpy(), table.column("shingles").to_pylist()
    sizes = np.array([len(x) // 8 for x in sets])
    borders = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(sets), np.uint64)
    order = np.argsort(flat, kind="stable")
    holders = np.repeat(np.arange(len(n)), sizes)[order]  # of a shingle, in order of their places
    first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0])) if len(flat) else np.zeros(0, np.int64)
    times = np.diff(first, append=len(flat))
    after, end = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    after[order], end[order] = np.arange(1, len(flat) + 1), np.repeat(first + times, times)
    component = component.copy()
    a, b = [], []
    for me in range(len(n) - 1):
        may = component[me + 1 :] != component[me]
        if side[me] >= 0:
            may &= side[me + 1 :] != side[me]
        if not may.any():
            continue
        own = slice(borders[me], borders[me + 1])
        later = [holders[s:e] for s, e in zip(after[own].tolist(), end[own].tolist()) if s < e]
        if not later:
            continue
        common = np.bincount(np.concatenate(later), minlength=len(n))[me + 1 :]
        k = np.flatnonzero(may & (7 * common >= 3 * (n[me].astype(np.int64) + n[me + 1 :]))) + me + 1
        if len(k):
            some, first_of = np.unique(component[k], return_index=True)
            a += [me] * len(some)
            b += k[first_of].tolist()
            component[np.isin(component, some)] = component[me]  # connected from here on
    return np.array(a, np.int64), np.array(b, np.int64)


def linked(classes: DataFrame, light: int) -> DataFrame:
    """(node, component) of the keys of classes that link with others, component being the least key that links reach."""
    every = runtime.checkpointed(entries(classes, light))
    several = every.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("token")
    lists = runtime.checkpointed(every.join(several, "token"))
    runtime.release(every)
    # pivots: a token's last bits choose one of PIVOTS orders of classes
    order = F.struct(F.xxhash64("key", F.col("token").bitwiseAND(PIVOTS - 1)).alias("h"), F.col("key").alias("p_key"), F.col("n").alias("p_n"), F.col("place").alias("p_place"))
    pivot = lists.groupBy("token").agg(F.min(order).alias("p")).select("token", "p.*")
    fits = may_link(F.col("n"), F.col("place"), F.col("p_n"), F.col("p_place")).alias("fits")
    others = runtime.checkpointed(lists.join(pivot, "token").where("key <> p_key").select("token", "key", F.col("n").alias("weight"), "p_key", fits))
    runtime.release(lists)
    compared = runtime.checkpointed(others.where("fits").select(F.least("key", "p_key").alias("a"), F.greatest("key", "p_key").alias("b")).distinct())
    found = runtime.checkpointed(verified(compared, classes))
    labels = components(found)
    # a list's pivot has met all of its members, so that the others are left
    open_ = runtime.checkpointed(cells.open_members(others.select("token", "key", "weight"), labels))
    runtime.release(others, compared)
    rest = cells.merged(open_)
    more = cells.links(rest, classes.select("key", "n", "shingles"), _linked_in_cell)
    out = runtime.checkpointed(joined(labels, more))
    runtime.release(found, open_, rest, more)
    return out


def join(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id."""
    runtime.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = runtime.checkpointed(signatures(docs))
    sets = rows.where("bucket IS NULL").drop("bucket", "n")
    classes = runtime.checkpointed(sets.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first")))
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    may = runtime.checkpointed(candidates(docs, total, common_shingles(rows)))
    cost = may.agg(F.sum("met") / F.sum("entries")).first()[0]
    found = linked(may, boundary(cost or 0.0))
    named = classes.join(found, classes.s1 == found.node, "left").select("s1", "s2", "n_shingles", "first", F.coalesce("component", "s1").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = runtime.checkpointed(named.join(ids, "component").select("s1", "s2", "n_shingles", "component_id"))
    runtime.release(classes, may, found)
    out = sets.join(ids, ["s1", "s2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: that of the component's doc_id; of several rows of that id, one whose text comes
    first by hash. Documents without words are components of their own."""
    kept = join(docs).groupBy("doc_id").agg(F.min("component_id").alias("component_id")).where("doc_id <=> component_id").select(F.col("doc_id").alias(_free("_kept", docs)))
    own, place = kept.columns[0], _free("_place", docs)
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[own]))
    order = W.partitionBy(own).orderBy(F.xxhash64(docs["text"]), docs["text"])
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*docs.columns)


def _free(name: str, df: DataFrame) -> str:
    """The name, or one like it that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(runtime.documents(spark, sf_dir))
