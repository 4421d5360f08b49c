"""Operator 3: secret scans with a recursive decoding worklist.

Each text is a layer. A layer is searched with the base patterns; then every encoded stretch in it (percent escapes,
Unicode escapes, base64 in one line or several, and compressed data within base64) gives a further layer, until no new layer
appears. A layer that was seen before in its document, with the same content from the same place, isn't taken up again, which ends cycles;
equal layers from other places are layers of their own. Each layer keeps, for every one of its characters, the span of the
document it came from, so that a secret found deep inside is reported at each stretch of the document that encodes it.

Defined cases: null and empty texts have no spans. Spans are half-open, in code points, each once, ordered by start, then
by kind as in KINDS. Secrets that overlap in different kinds are all reported. Decoded bytes that are no UTF-8 stand as
U+FFFD in their layer, which is searched like any other (n_layers and max_depth count layers of printable text only); a
percent escape of such a byte stays as it is. Compressed data are read to their end, all gzip members of them; `truncated`
counts those that break off or are damaged before, of which what comes out is a layer (data damaged in their first member
are none). A decompressed layer is read twice, once for its digest, then in parts of about PART bytes, each ending behind a
character that no pattern can hold; so a worker holds a part, and more only of a run without any such character. As all of
the layer stands for one span, its parts give the same spans as the whole, and what they encode counts as a layer for each.
Repeated rows give equal results, and an empty table none. Kept columns of a result's name give way to it, in `redact` all
columns stay.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

KINDS = ("assign", "access", "hex")
PART, BLOCK = 16 << 20, 1 << 16
#: Of padded text of 16 characters at least: 12 bytes, as the shortest base match has, or a compressed 10 that hold 24.
MIN_BASE64 = 14

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 characters or more: a match begins where its run begins
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: What no match of the patterns holds.
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"'\x20:\\{}&#;%]""")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
#: Base64 in lines.
_LINES = re.compile(r"(?:[A-Za-z0-9+/_-]{%d,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}" % MIN_BASE64)
_SPACE = re.compile(r"[ \t\r\n]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of each base match."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


class Origin:
    """Where a layer's characters come from in the document: pieces (place in the layer, start, end), the first place 0.
    A piece with end None copies characters one to one; another stands as a whole for its span, and adjacent ones of one
    span are one piece."""

    def __init__(self, pieces: list[tuple[int, int, int | None]]):
        self.pieces = [p for i, p in enumerate(pieces) if not i or p[2] is None or p[1:] != pieces[i - 1][1:]]
        self.firsts = [p[0] for p in self.pieces]

    def _at(self, place: int) -> tuple[int, int]:
        first, start, end = self.pieces[bisect_right(self.firsts, place) - 1]
        return (start + place - first, start + place - first + 1) if end is None else (start, end)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._at(start)[0], self._at(end - 1)[1]


def _is_printable(text: str) -> bool:
    return "\ufffd" not in text and text.replace("\t", "").replace("\n", "").replace("\r", "").isprintable()


def _unescape(text: str, origin: Origin, pattern: re.Pattern, decode) -> tuple[str, Origin] | None:
    """The whole layer with each match of the pattern decoded."""
    out, pieces, size, at = [], [], 0, 0
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None:
            continue
        if m.start() > at:
            pieces += [(size + p - at, s, e) for p, s, e in _cut(origin, at, m.start())]
            out.append(text[at : m.start()])
            size += m.start() - at
        pieces += [(size + a, *origin.span(m.start() + b, m.start() + c)) for a, b, c in new[1]]
        out.append(new[0])
        size += len(new[0])
        at = m.end()
    if not at:
        return None
    if at < len(text):
        pieces += [(size + p - at, s, e) for p, s, e in _cut(origin, at, len(text))]
        out.append(text[at:])
    return "".join(out), Origin(pieces)


def _cut(origin: Origin, start: int, end: int) -> list[tuple[int, int, int | None]]:
    """The pieces of the places from start to end."""
    out = []
    i = bisect_right(origin.firsts, start) - 1
    while i < len(origin.pieces) and origin.firsts[i] < end:
        first, s, e = origin.pieces[i]
        out.append((max(first, start), s + max(0, start - first) if e is None else s, e))
        i += 1
    return out


def _percent(m: re.Match):
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
    out, places, size, at = [], [], 0, 0
    for c in text:
        if "\udc80" <= c <= "\udcff":
            c = m[0][at : at + 3]
            places += ((size + i, at + i, at + i + 1) for i in range(3))
            at += 3
        else:
            n = 3 * len(c.encode())
            places.append((size, at, at + n))
            at += n
        out.append(c)
        size += len(c)
    return ("".join(out), places) if size < at else None


def _unicode(m: re.Match):
    value = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
    if value > 0x10FFFF or 0xD800 <= value < 0xE000:
        return None
    return chr(value), [(0, 0, len(m[0]))]


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 1 and (data[0] << 8 | data[1]) % 31 == 0


def inflate(data: bytes, broken: list[bool]) -> Iterator[bytes]:
    """Decompressed gzip or zlib data, at most PART bytes at a time, of one member after the other; broken gets an entry if
    they break off. Raises zlib.error if the first member is damaged."""
    at = 0
    while _compressed(data[at : at + 2]):
        d, first = zlib.decompressobj(47), not at
        while not d.eof:
            block = data[at : at + BLOCK]
            try:
                out = d.decompress(block, PART)
            except zlib.error:
                if first:
                    raise
                broken.append(True)
                return
            at += len(block) - len(d.unconsumed_tail) - len(d.unused_data)
            if out:
                yield out
            elif not block and not d.eof:
                broken.append(True)
                return
        while data[at : at + 1] == b"\0":
            at += 1


def _parts(data: bytes) -> Iterator[str]:
    """Decompressed text in parts between which no match of a pattern lies."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held: list[str] = []
    size = 0
    for chunk in inflate(data, []):
        text = decoder.decode(chunk)
        size += len(text)
        at = 0
        if size >= PART:
            # held texts have no place to cut once they are PART long, so only new ones are searched
            place = next((i for i in range(len(text) - 1, -1, -1) if _APART.match(text, i)), None)
            if place is not None:
                at = place + 1
                yield "".join((*held, text[:at]))
                held, size = [], len(text) - at
        if at < len(text):
            held.append(text[at:])
    if held or size:
        yield "".join((*held, decoder.decode(b"", True)))


def opened(data: bytes) -> tuple[Iterator[str], bytes, bool, bool] | None:
    """Of compressed data the parts of their text, a digest, whether it is printable, and whether it breaks off; None if
    there is none. Raises zlib.error if the data aren't compressed."""
    decoder, digest, broken, first, n = codecs.getincrementaldecoder("utf-8")("replace"), hashlib.blake2b(digest_size=16), [], "", 0
    printable = True
    for chunk in inflate(data, broken):
        text = decoder.decode(chunk)
        printable = printable and _is_printable(text)
        digest.update(chunk)
        first, n = text if not n else "", n + 1
    first += decoder.decode(b"", True) if n == 1 else ""
    return (iter((first,)) if n == 1 else _parts(data), digest.digest(), printable, bool(broken)) if n else None


def _base64(token: str) -> bytes | None:
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int, int]:
    """Base spans, all spans, the number of layers beside the text, the deepest layer, and the truncated ones."""
    base = sorted(set(base_spans(text)))
    found = set(base)
    work: list[tuple[Iterator[str], Origin, int]] = [(iter((text,)), Origin([(0, 0, None)]), 0)]
    seen: set[tuple] = set()
    layers = deepest = cut = 0
    while work:
        parts, origin, depth = work[-1]
        layer = next(parts, None)
        if layer is None:
            work.pop()
            continue
        deepest = max(deepest, depth)
        if layer is not text:
            for start, kind, end in base_spans(layer):
                s, e = origin.span(start, end)
                found.add((s, kind, e))
        new: list[tuple[Iterator[str], bytes, bool, Origin]] = []
        if "%" in layer and (x := _unescape(layer, origin, _PERCENT, _percent)):
            new.append(_whole(*x))
        if ("\\" in layer or "&#" in layer) and (x := _unescape(layer, origin, _UNICODE, _unicode)):
            new.append(_whole(*x))
        for pattern in (_BASE64, _LINES) if "\n" in layer else (_BASE64,):
            for m in pattern.finditer(layer):
                data = _base64(m[0] if pattern is _BASE64 else _SPACE.sub("", m[0]))
                if not data:
                    continue
                where = Origin([(0, *origin.span(m.start(), m.end()))])
                if _compressed(data):
                    try:
                        if (got := opened(data)) is not None:
                            cut += got[3]
                            new.append((*got[:3], where))
                            continue
                    except zlib.error:
                        pass
                new.append(_whole(data.decode("utf-8", "replace"), where))
        for inner, digest, printable, where in new:
            key = (digest, *where.pieces)
            if key not in seen:
                seen.add(key)
                layers += printable
                work.append((inner, where, depth + printable))
    return base, sorted(found), layers, deepest, cut


def _whole(text: str, where: Origin) -> tuple[Iterator[str], bytes, bool, Origin]:
    return iter((text,)), hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), _is_printable(text), where


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, max_depth long, truncated long"


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep`, and what the scan finds in each text."""
    runtime.small_batches(docs.sparkSession)
    keep, kept = runtime.kept(docs, keep, FOUND)
    chosen = docs.select(*keep, F.col(text).alias("_text_to_scan"))

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for value in batch.column(batch.num_columns - 1):
                base, spans, layers, depth, cut = scan(value.as_py() or "")
                kinds = [k for _, k, _ in base]
                row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers, depth, cut)
                for column, x in zip(rows, row):
                    column.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(rows, types))], names=[*keep, *(x.split()[0] for x in FOUND.split(", "))])

    return chosen.mapInArrow(run, f"{kept}{FOUND}")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in the text replaced by the mark; overlapping spans become one mark. A column n_chars
    follows the text."""
    runtime.small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(value):
            if not value:
                return value
            out, at = [], 0
            spans = sorted((s, e) for s, _, e in scan(value)[1])
            i = 0
            while i < len(spans):
                start, end = spans[i]
                while i < len(spans) and spans[i][0] < end:
                    end = max(end, spans[i][1])
                    i += 1
                out += (value[at:start], mark)
                at = end
            return "".join(out) + value[at:]

        return texts.map(one)

    out = docs.withColumn(text, run(text))
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(runtime.documents(spark, sf_dir), ["doc_id"])
