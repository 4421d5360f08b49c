"""Operator 8: document fingerprints by a randomised edit embedding.

All texts share one table of random bits. A pointer walks over a text's characters: at step j the character under it is
given out, and the pointer moves on if the bit for (j, character) is set. Two texts that agree up to an edit walk alike
until it and soon again after it, so that a small edit distance becomes a small Hamming distance of what they give out.
The fingerprint keeps SAMPLES characters of it (as one of 15 symbols each), at every 2^t-th step, t by the text's length;
fingerprints of unlike t are compared at the steps they share.

Many texts walk at once, one numpy operation a step. `near_groups` finds near copies: bands of sampled symbols are the
keys of lists of fingerprints, and the likeness of whole fingerprints verifies a list's members, first against one pivot of
each list, then all that lie in different components against each other (see `cells`), so that no two fingerprints that
share a band and are alike stay apart; where lists are compared as one, alike ones that share a band with a third may be
linked too. `near_group` is the least doc_id of a document's component.

Defined cases: null texts count as empty; an empty text's fingerprint has no symbols, two empty texts have likeness 1, and
empty texts are near to each other only. Likeness is the share of agreeing symbols among steps where either text has one,
less what unrelated texts share by chance. Documents come in order of doc_id, then of the text's hash for repeated doc_ids;
after the last comes the first. A single document is its own next one. Equal rows have equal fingerprints and groups, and an
empty table gives no rows. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import cells, runtime
from .components import components, joined
from .wordhash import mix, signed

SEED = 8
PERIOD = 4096
SAMPLES = 256
BY_CHANCE = 0.1
BANDS, BAND_SYMBOLS = 20, 10
#: A text walks on for twice its length on average. If that is more samples than these, a near text may be over the change of t.
COARSE_FROM = 100
NEAR = 0.75
#: What a worker holds at a time.
FLUSH_CHARS, FLUSH_ROWS = 4_000_000, 4000


class Walker:
    def __init__(self):
        bits = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (PERIOD, 257), dtype=np.int64).astype(np.uint8)
        bits[:, 256] = 0  # the end of a text
        self.bits = bits
        self.symbols = np.append(np.arange(256) * 7 % 15 + 1, 0).astype(np.uint8)

    @staticmethod
    def codes(text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return (points * np.uint32(2654435761) >> np.uint32(11) & np.uint32(255)).astype(np.uint16)

    def fingerprints(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """(t, symbols) of each text."""
        sizes = np.array([len(x) for x in texts], np.int64)
        if not len(sizes):
            return []
        order = np.argsort(-sizes, kind="stable")
        end = np.array([256], np.uint16)
        flat = np.concatenate([y for i in order for y in (self.codes(texts[i]), end)])
        at = np.concatenate([[0], np.cumsum(sizes[order] + 1)[:-1]])
        last = at + sizes[order]
        # the least t for which SAMPLES steps of 2^t reach three times the length
        shifts = np.maximum(0, np.ceil(np.log2(np.maximum(1, 3 * sizes[order]) / SAMPLES))).astype(np.int64)
        out = np.zeros((len(texts), SAMPLES), np.uint8)
        active = int((sizes > 0).sum())
        # from_row[b]: the first row whose t is at most b
        from_row = [int((shifts > b).sum()) for b in range(int(shifts.max()) + 2)]
        deepest = len(from_row) - 1
        step = 0
        rows = np.arange(len(texts))
        while active:
            here = at[:active]
            seen = flat.take(here)
            low = deepest if step == 0 else min(deepest, (step & -step).bit_length() - 1)
            first = from_row[low]
            if first < active:
                place = step >> shifts[first:active]
                fits = place < SAMPLES
                if fits.all():
                    out[rows[first:active], place] = self.symbols.take(seen[first:])
                else:
                    out[rows[first:active][fits], place[fits]] = self.symbols.take(seen[first:][fits])
            here += self.bits[step % PERIOD].take(seen)
            step += 1
            if not step & 63:
                # a text is done at its end, or past its last sample
                going = np.flatnonzero((here < last[:active]) & (step >> shifts[:active] < SAMPLES))
                active = int(going[-1]) + 1 if len(going) else 0
        found: list = [None] * len(texts)
        for row, i in enumerate(order):
            found[i] = (int(shifts[row]), out[row])
        return found


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    if a[0] > b[0]:
        a, b = b, a
    x = a[1]
    if a[0] < b[0]:
        stride = 1 << (b[0] - a[0])
        x = np.zeros(SAMPLES, np.uint8)
        part = a[1][::stride]
        x[: len(part)] = part
    any_ = (x | b[1]) > 0
    total = int(any_.sum())
    if not total:
        return 1.0
    share = int(((x == b[1]) & any_).sum()) / total
    return round(max(0.0, (share - BY_CHANCE) / (1 - BY_CHANCE)), 6)


def written(f: tuple[int, np.ndarray]) -> str:
    """A fingerprint as text: t, then a hexadecimal digit for each symbol up to the last."""
    used = np.flatnonzero(f[1])
    n = int(used[-1]) + 1 if len(used) else 0
    return f"{f[0]:02d}:" + "".join("0123456789abcdef"[s] for s in f[1][:n].tolist())


_DIGIT = np.zeros(128, np.uint8)
_DIGIT[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)


def read(text: str) -> tuple[int, np.ndarray]:
    out = np.zeros(SAMPLES, np.uint8)
    out[: len(text) - 3] = _DIGIT[np.frombuffer(text[3:].encode(), np.uint8)]
    return int(text[:2]), out


def _picks() -> np.ndarray:
    # texts of t above 0 fill a third of the samples at least
    rng = np.random.Generator(np.random.PCG64(SEED + 1))
    return np.stack([rng.choice(SAMPLES // 3, BAND_SYMBOLS, replace=False) for _ in range(BANDS)])


def bands(fingerprints: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of bands (symbols at bit-sampled places), and of each the place of its fingerprint. As near texts may lie at
    either side of a change of t, the fingerprint of a text that is long for its t is also banded one t coarser."""
    t = np.array([f[0] for f in fingerprints], np.uint64)
    symbols = np.stack([f[1] for f in fingerprints]) if fingerprints else np.zeros((0, SAMPLES), np.uint8)
    coarse = np.zeros_like(symbols)
    coarse[:, : SAMPLES // 2] = symbols[:, ::2]
    long = np.flatnonzero((symbols[:, COARSE_FROM:] > 0).any(axis=1))
    numbers, places = [], []
    for of, shift, rows in ((symbols, t, np.arange(len(t))), (coarse, t + np.uint64(1), long)):
        for i, picked in enumerate(_picks()):
            some = of[rows][:, picked].astype(np.uint64)
            number = (some << np.arange(0, 4 * BAND_SYMBOLS, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            held = np.flatnonzero(number)  # an empty text has no bands
            numbers.append(mix(number[held] << np.uint64(16) ^ shift[rows][held] << np.uint64(8) ^ np.uint64(i)))
            places.append(rows[held])
    return signed(np.concatenate(numbers)), np.concatenate(places)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by Myers' bit vectors in whole-text integers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = all_, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & all_, plus & x
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & all_, down << 1 & all_
        plus, minus = down | ~((eq | minus) | up) & all_, up & (eq | minus)
    return score


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_FINISHED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STREAMED = f"{_FINISHED}, part int, role int, text string"


def _row(doc: int, text: str, new: str, own, other, nxt) -> tuple:
    return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, nxt)


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row of docs the columns RESULT. The texts are dealt once, compressed, by ranges of doc_id; a range's last document
    gets its next one, the first of a later range, by a join of one row for each range."""
    runtime.small_batches(docs.sparkSession)

    def packed(batches):
        for batch in batches:
            data = [zlib.compress(x.encode("utf-8", "surrogatepass"), 1) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], names=["doc_id", "h", "packed"])

    text = runtime.text_or_empty()
    moved = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(packed, "doc_id long, h long, packed binary")
    dealt = moved.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h").select("doc_id", "packed")

    def run(batches):
        walker, part = Walker(), TaskContext.get().partitionId()
        ids: list[int] = []
        texts: list[str] = []

        def flush():
            new = [edited(texts[i], texts[i + 1]) for i in range(len(texts) - 1)]
            found = walker.fingerprints(texts + new)
            own, other = found[: len(texts)], found[len(texts) :]
            return [(*_row(ids[i], texts[i], new[i], own[i], other[i], own[i + 1]), part, 0, None) for i in range(len(new))]

        blank = (None,) * 6
        chars = 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = zlib.decompress(data.as_buffer()).decode("utf-8", "surrogatepass")
                if not texts:
                    yield _table([(doc, *blank, part, 2, value)], _STREAMED)
                ids.append(doc)
                texts.append(value)
                chars += len(value)
                if chars > FLUSH_CHARS or len(texts) > FLUSH_ROWS:
                    yield _table(flush(), _STREAMED)
                    ids, texts = ids[-1:], texts[-1:]
                    chars = len(texts[0])
        if texts:
            yield _table(flush(), _STREAMED)
            yield _table([(ids[-1], *blank, part, 1, texts[-1])], _STREAMED)

    streamed = runtime.checkpointed(dealt.mapInArrow(run, _STREAMED))
    firsts = streamed.where("role = 2").select("part", F.col("text").alias("next_text"))
    lasts = streamed.where("role = 1").select("doc_id", "text", "part")
    # one row for each range
    order = W.orderBy("part")
    parts = firsts.select("part").withColumn("next_part", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())))
    edges = lasts.join(parts, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def finish(batches):
        walker = Walker()
        for batch in batches:
            rows = []
            for doc, text, following in zip(*(c.to_pylist() for c in batch.columns)):
                new = edited(text, following)
                rows.append(_row(doc, text, new, *walker.fingerprints([text, new, following])))
            yield _table(rows, _FINISHED)

    return streamed.where("role = 0").select(*RESULT).unionByName(edges.mapInArrow(finish, _FINISHED))


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, named)], names=[name for name, _ in named])


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of pairs of fingerprints of one t (rows of symbols)."""
    any_ = (a | b) > 0
    share = ((a == b) & any_).sum(axis=1) / np.maximum(1, any_.sum(axis=1))
    return (share - BY_CHANCE) / (1 - BY_CHANCE)


def _alike_in_cell(table: pa.Table, component: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of alike members, as few pairs as connect all components that alike members connect."""
    found = [read(x) for x in table.column("fingerprint").to_pylist()]
    t = np.array([f[0] for f in found])
    symbols = np.stack([f[1] for f in found])
    coarse = np.zeros_like(symbols)
    coarse[:, : SAMPLES // 2] = symbols[:, ::2]
    component = component.copy()
    a, b = [], []
    for me in range(len(found)):
        for own, other in ((symbols, t[me]), (coarse, t[me] + 1)):
            may = (component != component[me]) & (t == other)
            if other == t[me]:
                may[: me + 1] = False
            if side[me] >= 0:
                may &= side != side[me]
            k = np.flatnonzero(may)
            k = k[_alike(own[me][None], symbols[k]) >= NEAR] if len(k) else k
            some, first = np.unique(component[k], return_index=True)
            a += [me] * len(some)
            b += k[first].tolist()
            component[np.isin(component, some)] = component[me]  # connected from here on
    return np.array(a, np.int64), np.array(b, np.int64)


def near_groups(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fingerprint): the near_group of each fingerprint, whose key is its hash."""
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("key", F.xxhash64("fingerprint"))
    prints = runtime.checkpointed(prints)

    def banded(wanted: np.ndarray | None = None) -> DataFrame:
        only = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)  # of a fixed size

        def run(batches):
            for batch in batches:
                numbers, places = bands([read(x) for x in batch.column(1).to_pylist()])
                if only is not None:
                    some = runtime.in_bitmap(only.value, numbers.view(np.uint64))
                    numbers, places = numbers[some], places[some]
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(batch.column(0).to_numpy()[places])], names=["token", "key"])

        return prints.select("key", "fingerprint").mapInArrow(run, "token long, key long")

    # most bands have one fingerprint; those of others only move once more
    several = runtime.checkpointed(banded().groupBy("token").count().where("count > 1").select("token"))
    members = runtime.checkpointed(banded(runtime.token_bitmap(several, "token")).join(several, "token"))
    # the least key of a list is its pivot; each fingerprint meets the least pivot of its lists, so there is a pair for each
    pivots = members.groupBy("token").agg(F.min("key").alias("lo"))
    compared = members.join(pivots, "token").groupBy("key").agg(F.min("lo").alias("lo")).where("lo < key")
    compared = runtime.checkpointed(compared.select(F.col("lo").alias("a"), F.col("key").alias("b")))
    some = prints.select("key", "fingerprint")

    def alike(batches):
        for batch in batches:
            good = [likeness(read(x), read(y)) >= NEAR for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    both = compared.join(some.toDF("b", "b_print"), "b").join(some.toDF("a", "a_print"), "a").select("a", "b", "a_print", "b_print")
    found = runtime.checkpointed(both.mapInArrow(alike, "a long, b long"))
    labels = components(found)
    open_ = runtime.checkpointed(cells.open_members(members.select("token", "key"), labels).withColumn("weight", F.lit(SAMPLES)))
    lists = cells.merged(open_)
    more = cells.links(lists, some, _alike_in_cell)
    linked = joined(labels, more)
    named = prints.join(linked, prints.key == linked.node, "left").select("key", "first", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("near_group"))
    out = runtime.checkpointed(named.join(least, "component").select("key", "near_group"))
    runtime.release(prints, several, members, compared, found, open_, lists, more)
    return out


def with_groups(docs: DataFrame) -> DataFrame:
    """with_edits(docs) and near_group: the least doc_id of the documents whose fingerprints are connected by likeness."""
    rows = with_edits(docs)
    groups = near_groups(rows.select("doc_id", "fingerprint"))
    return rows.withColumn("key", F.xxhash64("fingerprint")).join(groups, "key").select(*RESULT, "near_group")


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_groups(runtime.documents(spark, sf_dir))
