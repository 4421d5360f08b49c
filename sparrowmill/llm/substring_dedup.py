"""Operator 9: repeated substrings on the de Bruijn graph of token k-mers.

Words are tokens and a window of WINDOW words is a k-mer, an edge of the graph between the runs of words that it starts and
ends with. Each edge has a source: its place in the document of the smallest doc_id that holds it. An edge is repeated where
it also occurs in another document. Repeated edges that follow each other in a document as their sources do are a path
without branches there: such stretches are compacted to one row of the document's and the source's coordinates. Spark joins
bring each path the words at its source, and a document's words are held against them, so no word goes by hashes alone.

Windows are dealt by hash to parts, packed as bytes. What many documents hold is pre-aggregated: a task reads FLUSH_WORDS
words at a time, and of a window's occurrences in them only those of the smallest doc_id go to the part, as for the others
that one is a source already; their paths are compacted and their words compared at once. So no part has more entries of a
window than there are flushes, whatever group of copies or common passage there is.

A word is removed if a window over it also starts in a document with a smaller doc_id. Removing is done on the texts;
documents with paths are joined with them, others never move.

Defined cases: null and empty texts have no words; the result's hash is then that of the empty string. Texts under WINDOW
words keep all. Repeated rows of one doc_id are each judged, and not against each other. Windows repeated within one
document are kept. A null doc_id counts as smaller than all others. An empty table gives no rows. Other columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime
from .wordhash import WordHasher, signed

WINDOW = 50
FLUSH_WORDS = 1 << 20
PART_BYTES = 16 << 20  # of text for each part
LEAST_PARTS = 64
KEPT_BYTES = 7  # of a window's hash, within its part
LOWEST = -(1 << 63)


def _bytes(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrays of so many numbers each, out of one, as bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _paths(place: np.ndarray, source: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where maximal stretches begin in which places and their sources go on by one within one `of`, and their lengths."""
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1] + 1) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    return begin, np.diff(begin, append=len(place))


def _equal(a: list[bytes], at: int, b: list[bytes], from_: int, windows: int) -> list[tuple[int, int]]:
    """The runs (first window, number) of a path whose words are those of its source: all of it, but for clashing hashes."""
    n = windows + WINDOW - 1
    if a[at : at + n] == b[from_ : from_ + n]:
        return [(at, windows)]
    return [(at + i, 1) for i in range(windows) if a[at + i : at + i + WINDOW] == b[from_ + i : from_ + i + WINDOW]]


class Flush:
    """The windows of some whole documents."""

    def __init__(self, hasher: WordHasher, ids: list[int], keys: list[int], texts: list[bytes]):
        self.ids, self.keys = np.array(ids, np.int64), np.array(keys, np.int64)
        hashes, self.borders = hasher.words(texts)
        n = len(hashes)
        self.place = self.doc = np.zeros(0, np.int64)
        self.window, self.words = np.zeros(0, np.uint64), texts
        if n < WINDOW:
            return
        doc = np.repeat(np.arange(len(texts)), np.diff(self.borders))
        whole = doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]
        self.place = np.flatnonzero(whole)
        self.doc = doc[self.place]
        self.window = hasher.runs(hasher.prefix(hashes), np.arange(n - WINDOW + 1), WINDOW)[self.place]

    def sources(self) -> np.ndarray:
        """For each window the place of the same one in the document of smallest doc_id, or -1 if that is its own doc_id."""
        order = np.lexsort((self.ids[self.doc], self.window))
        w = self.window[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
        of = np.repeat(order[first], np.diff(first, append=len(w)))
        out = np.full(len(w), -1)
        later = self.ids[self.doc[order]] > self.ids[self.doc[of]]
        out[order[later]] = self.place[of[later]]
        return out

    def own_paths(self, sources: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, first window, number of windows) of verified paths whose sources are in this flush."""
        some = np.flatnonzero(sources >= 0)
        begin, sizes = _paths(self.place[some], sources[some], self.doc[some])
        out = []
        words = b"\n".join(self.words).split() if len(some) else []
        for b, n in zip(begin.tolist(), sizes.tolist()):
            i = some[b]
            doc = int(self.doc[i])
            out += ((doc, at - int(self.borders[doc]), k) for at, k in _equal(words, int(self.place[i]), words, int(sources[i]), n))
        return out


_PACKED = ("part", "ids", "keys", "counts", "windows", "starts")


def scattered(texts: DataFrame, bits: int) -> DataFrame:
    """texts (doc_id, key, text): the windows that this flush has no source for by parts (the first `bits` bits of their
    hash), a row for each flush and part, as bytes: documents' ids and keys, how many of their windows are here, KEPT_BYTES of
    each window's hash, and its start as the distance from the one before. Verified paths are rows of a part with a negative number,
    with their numbers of windows in `windows`."""

    def pack(flush: Flush, number: int) -> pa.RecordBatch:
        sources = flush.sources()
        rows = []
        if paths := flush.own_paths(sources):
            doc, start, n = np.array(paths, np.int64).T
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            counts = np.diff(first, append=len(doc))
            rows.append((number, flush.ids[doc[first]].tobytes(), flush.keys[doc[first]].tobytes(), counts.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), start.astype(np.int32).tobytes()))
        left = np.flatnonzero(sources < 0)
        window, doc = flush.window[left], flush.doc[left]
        start = flush.place[left] - flush.borders[doc]
        part = (window >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part.astype(np.int16) if bits < 15 else part, kind="stable")
        border = np.searchsorted(part[order], np.arange((1 << bits) + 1))
        for p in range(1 << bits):
            seg = order[border[p] : border[p + 1]]
            if not len(seg):
                continue
            d, s = doc[seg], start[seg]
            first = np.flatnonzero(np.diff(d, prepend=-1))
            step = np.diff(s, prepend=0)
            step[first] = s[first]
            counts = np.diff(first, append=len(seg)).astype(np.int32)
            short = window[seg].view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
            rows.append((p, flush.ids[d[first]].tobytes(), flush.keys[d[first]].tobytes(), counts.tobytes(), short.tobytes(), step.astype(np.int32).tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=list(_PACKED))

    def run(batches):
        hasher = WordHasher()
        ids, keys, held, size = [], [], [], 0
        number = -1 - (TaskContext.get().partitionId() << 24)
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch.column(2))):
                ids.append(LOWEST if doc is None else doc)
                keys.append(key)
                held.append(text)
                size += len(text) // 6
                if size >= FLUSH_WORDS:
                    yield pack(Flush(hasher, ids, keys, held), number)
                    ids, keys, held, size, number = [], [], [], 0, number - 1
        if held:
            yield pack(Flush(hasher, ids, keys, held), number)

    return texts.select("doc_id", "key", "text").mapInArrow(run, "part long, ids binary, keys binary, counts binary, windows binary, starts binary")


def repeated(packed: DataFrame, bits: int) -> DataFrame:
    """Per document (key) of a part: as bytes, the starts of its windows that a document of a smaller id holds, and the key
    and start of each one's source; or the starts of verified paths, with their numbers of windows, and no sources."""
    names = ["key", "starts", "windows", "source_keys", "source_starts"]

    def run(part, table):
        part = part[0].as_py()
        ids, keys, counts, starts = (_joined(table.column(c), t) for c, t in (("ids", np.int64), ("keys", np.int64), ("counts", np.int32), ("starts", np.int32)))
        doc = np.repeat(np.arange(len(keys)), counts)
        if part < 0:
            n = _joined(table.column("windows"), np.int32)
            none = _binaries(np.zeros(0, np.int64), np.zeros(len(keys), np.int64))
            return pa.table([pa.array(keys), _binaries(starts, counts), _binaries(n, counts), none, none], names=names)
        short = _joined(table.column("windows"), np.uint8).reshape(-1, KEPT_BYTES)
        window = np.zeros((len(short), 8), np.uint8)
        window[:, :KEPT_BYTES] = short
        window = window.view(np.uint64).ravel()
        # starts are distances within a document
        total = np.cumsum(starts.astype(np.int64))
        before = np.cumsum(counts) - counts
        start = (total - np.repeat(np.where(before > 0, total[before - 1], 0) if len(total) else before, counts)).astype(np.int32)
        order = np.lexsort((ids[doc], window))
        w = window[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
        of = np.repeat(order[first], np.diff(first, append=len(w)))
        later = ids[doc[order]] > ids[doc[of]]
        hit, of = order[later], of[later]
        back = np.argsort(doc[hit], kind="stable")
        hit, of = hit[back], of[back]
        begin = np.flatnonzero(np.diff(doc[hit], prepend=-1))
        sizes = np.diff(begin, append=len(hit))
        none = _binaries(np.zeros(0, np.int32), np.zeros(len(begin), np.int64))
        return pa.table([pa.array(keys[doc[hit[begin]]]), _binaries(start[hit], sizes), none, _binaries(keys[doc[of]], sizes), _binaries(start[of], sizes)], names=names)

    return packed.groupBy("part").applyInArrow(run, "key long, starts binary, windows binary, source_keys binary, source_starts binary")


def compacted(found: DataFrame) -> DataFrame:
    """Rows (key, start, windows, source_key, source_start) of each document's paths; source_key is null if a path's words
    have been compared already."""
    lists = found.groupBy("key").agg(*(F.collect_list(c).alias(c) for c in ("starts", "windows", "source_keys", "source_starts")))
    names = ["key", "start", "windows", "source_key", "source_start"]

    def run(batches):
        for batch in batches:
            parts: list[tuple] = []
            for key, starts, windows, keys, places in zip(*(c.to_pylist() for c in batch.columns)):
                for s, n in zip(starts, windows):
                    if n:
                        s, n = np.frombuffer(s, np.int32), np.frombuffer(n, np.int32)
                        parts.append((key, s, n, np.zeros(len(s), np.int64), np.full(len(s), -1, np.int32)))
                every = [(np.frombuffer(s, np.int32), np.frombuffer(k, np.int64), np.frombuffer(p, np.int32)) for s, k, p in zip(starts, keys, places) if k]
                if not every:
                    continue
                s, k, p = (np.concatenate([e[i] for e in every]) for i in range(3))
                s, at = np.unique(s, return_index=True)  # rows that are alike have sent the same windows
                k, p = k[at], p[at]
                begin, n = _paths(s, p, k)
                parts.append((key, s[begin], n.astype(np.int32), k[begin], p[begin]))
            key = np.repeat(np.array([x[0] for x in parts], np.int64), [len(x[1]) for x in parts])
            columns = [np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64) for i in range(1, 5)]
            known = columns[3] < 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int64), mask=known), pa.array(columns[3].astype(np.int32), mask=known)], names=names
            )

    return lists.mapInArrow(run, "key long, start int, windows int, source_key long, source_start int")


def with_sources(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """Per key its paths as an array of (start, windows, words), words being those at the source, or null."""
    open_ = paths.where("source_key IS NOT NULL")
    # a table of its own, so that a join with a source of very many paths can be split
    held = runtime.checkpointed(runtime.IdFilter(open_, "source_key").passing(texts.select("key", "text"), "key").dropDuplicates(["key"]))

    def run(batches):
        last, words = None, []
        for batch in batches:
            out = []
            for text, start, windows in zip(*(batch.column(i) for i in (3, 4, 2))):
                if (value := text.as_py()) != last:
                    last, words = value, value.encode("utf-8", "surrogatepass").split()
                out.append(b" ".join(words[start.as_py() : start.as_py() + windows.as_py() + WINDOW - 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["key", "start", "windows", "words"])

    joined = open_.join(held.withColumnRenamed("key", "source_key"), "source_key").select("key", "start", "windows", "text", "source_start")
    cut = joined.mapInArrow(run, "key long, start int, windows int, words binary")
    known = paths.where("source_key IS NULL").select("key", "start", "windows", F.lit(None).cast("binary").alias("words"))
    return cut.unionByName(known).groupBy("key").agg(F.collect_list(F.struct("start", "windows", "words")).alias("paths"))


def kept_words(text: bytes, paths: list[tuple[int, int, bytes | None]]) -> tuple[list[bytes], int]:
    """The words that no path covers, and the number of all words. A path of k windows covers k + WINDOW - 1 words; one with
    words covers those windows only that are equal to them."""
    found = text.split()
    if not paths:
        return found, len(found)
    change = np.zeros(len(found) + 1, np.int64)
    for start, windows, words in paths:
        for at, n in [(start, windows)] if words is None else _equal(found, start, words.split(), 0, windows):
            change[at] += 1
            change[at + n + WINDOW - 1] -= 1
    open_ = np.cumsum(change[:-1]) == 0
    return [found[i] for i in np.flatnonzero(open_).tolist()], len(found)


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and kept (the words kept, joined by a space)."""
    runtime.small_batches(docs.sparkSession)
    text = runtime.text_or_empty()
    # rows of one doc_id with unlike texts have coordinates of their own
    texts = docs.select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), text).alias("key"), text.alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(LEAST_PARTS, size // PART_BYTES).bit_length() - 1
    paths = runtime.checkpointed(compacted(repeated(scattered(texts, bits), bits)))
    spans = runtime.checkpointed(with_sources(paths, texts))
    near = runtime.IdFilter(spans, "key")
    flagged = near.marked(texts, "key", "_touched")

    def run(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for value, some in zip(_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words, n = kept_words(value, [(x["start"], x["windows"], x["words"]) for x in some or ()])
                counts.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept string"
    whole = flagged.where("NOT _touched").select("doc_id", "text", F.lit(None).cast(spans.schema["paths"].dataType).alias("paths"))
    touched = flagged.where("_touched").drop("_touched").join(spans, "key", "left").select("doc_id", "text", "paths")
    return whole.mapInArrow(run, schema).unionByName(touched.mapInArrow(run, schema))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(runtime.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
