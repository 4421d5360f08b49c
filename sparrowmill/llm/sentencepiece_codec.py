"""Operator 1: SentencePiece encoding and decoding.

An Aho-Corasick automaton over all pieces reads a text once. At each position the automaton's output links list every
piece that ends there, longest first; each relaxes the best score of its end (a Viterbi search over the unigram lattice).
A character that is no piece of its own costs UNKNOWN_PENALTY below the worst score and is spelled with byte pieces.

The lattice falls apart at places that no piece crosses: before a run of word marks, and around characters that occur in
no longer piece. These places are read off the vocabulary, so segments are searched alone and their results kept in a
bounded cache; the result is that of one search over the whole text.

Defined cases: a null text is encoded as an empty one, and an empty text has no ids. Equal scores keep the longer last
piece. Decoding gives the text back, except that a word mark (U+2581) in it comes back as a space. Rows repeat as they
do in the input; columns that the operator doesn't read pass through, and its own columns replace any of the same name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import runtime

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_SEGMENTS = 400_000
CACHED_LENGTH = 64
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffers message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a SentencePiece model file's bytes."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces: list[tuple[str, float, int]] = []
        prefix, squeeze, charsmap = 1, 1, b""
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, b"\0" * 4))[0], got.get(3, NORMAL)))
            elif number == 3:
                got = dict(_fields(value))
                prefix, squeeze, charsmap = got.get(3, 1), got.get(4, 1), got.get(2, b"")
        if charsmap or squeeze:
            raise ValueError("only models with identity normalisation that keep all spaces are supported")
        self.dummy = MARK if prefix else ""
        scores = [s for _, s, kind in self.pieces if kind == NORMAL]
        self.unknown_score = min(scores) - UNKNOWN_PENALTY
        top = max(scores)
        self.byte_ids = [0] * 256
        self.unknown_id = 0
        self.byte_fallback = False
        self.automaton = ahocorasick.Automaton()
        self.as_bytes: list[bytes] = []
        inner, mark_inside = set(), False
        self.single = set()
        for i, (piece, score, kind) in enumerate(self.pieces):
            self.as_bytes.append(b"" if kind in (CONTROL, UNKNOWN) else piece.encode())
            if kind == BYTE:
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.as_bytes[i], self.byte_fallback = i, bytes([value]), True
            elif kind == UNKNOWN:
                self.unknown_id, self.as_bytes[i] = i, " ⁇ ".encode()
            elif kind in (NORMAL, USER) and piece:
                self.automaton.add_word(piece, (len(piece), score if kind == NORMAL else len(piece) * top - 0.1, i))
                if len(piece) == 1:
                    self.single.add(piece)
                else:
                    inner.update(piece)
                    mark_inside |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.lengths = [len(piece) for piece, _, _ in self.pieces]
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in inner))
        some = f"[{alone}]|" if alone else ""
        self.segments = re.compile(f"(?s).+" if mark_inside else f"{some}{MARK}*[^{MARK}{alone}]+|{MARK}+").findall
        self.byte_set = frozenset(self.byte_ids) if self.byte_fallback else frozenset()
        self.known: dict[str, tuple[int, ...]] = {}

    def search(self, text: str) -> tuple[int, ...]:
        """The best segmentation of one segment."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        came = [-1] * (n + 1)
        odd = [] if self.single.issuperset(text) else [i for i, c in enumerate(text) if c not in self.single]
        unknown = self.unknown_score
        done = 0
        for last, (length, score, piece) in self.automaton.iter(text):
            while done < len(odd) and odd[done] < last:
                i = odd[done]
                if best[i] + unknown > best[i + 1]:
                    best[i + 1], came[i + 1] = best[i] + unknown, -1
                done += 1
            total = best[last + 1 - length] + score
            if total > best[last + 1]:
                best[last + 1] = total
                came[last + 1] = piece
        for i in odd[done:]:
            if best[i] + unknown > best[i + 1]:
                best[i + 1], came[i + 1] = best[i] + unknown, -1
        out: list[int] = []
        end = n
        while end:
            piece = came[end]
            start = end - (self.lengths[piece] if piece >= 0 else 1)
            if piece >= 0:
                out.append(piece)
            elif self.byte_fallback:
                out.extend(self.byte_ids[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown_id)
            end = start
        return tuple(reversed(out))

    def encode(self, text: str) -> array:
        ids = array("i")
        if not text:
            return ids
        known, extend = self.known, ids.extend
        for segment in self.segments(self.dummy + text.replace(" ", MARK)):
            found = known.get(segment)
            if found is None:
                found = self.search(segment)
                if len(segment) <= CACHED_LENGTH:
                    if len(known) >= CACHE_SEGMENTS:
                        known.clear()
                    known[segment] = found
            extend(found)
        return ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and worker process; its cache of segments lives on from task to task."""
    kept = sys.__dict__.setdefault("_sparrowmill_codecs", {})
    key = hashlib.sha256(model).digest()
    if key not in kept:
        kept.clear()
        kept[key] = PieceCodec(model)
    return kept[key]


def load_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file is read by the driver and travels with the tasks (its size is that of one vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def _encoded(worker: PieceCodec, texts) -> pa.ListArray:
    flat, offsets = array("i"), array("i", [0])
    for value in texts:
        flat.extend(worker.encode(value.as_py() or ""))
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()))


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of piece ids for its texts."""
    spark = docs.sparkSession
    runtime.small_batches(spark)
    model = spark.sparkContext.broadcast(load_model(model_path))
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        worker = codec(model.value)
        for batch in batches:
            column = _encoded(worker, batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """Per document its ids, their count and digest, and what decoding them gives back. One worker does both, as each holds
    a codec and its cache."""
    runtime.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def run(batches):
        worker = codec(model.value)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_chars", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip")}
            column = _encoded(worker, batch.column(1))
            for value, found in zip(batch.column(1), column):
                text, ids = value.as_py() or "", found.values.to_numpy()
                listed = ids.tolist()
                back = worker.decode(listed)
                rows["n_chars"].append(len(text))
                rows["n_tokens"].append(len(listed))
                rows["n_byte_tokens"].append(sum(map(worker.byte_set.__contains__, listed)))
                rows["ids_sha256"].append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                rows["round_trip"].append(back == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.values()), column], names=["doc_id", *rows, "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids array<int>")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(runtime.documents(spark, sf_dir))
