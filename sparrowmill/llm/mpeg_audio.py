"""Operator 2: a media column of MPEG audio.

`mux` stores any bytes losslessly as a valid stream: an ID3v2.4 tag, a frame with a Xing table, then MPEG-1 Layer III
frames (mono, 48 kHz, with checksums) whose granules are silent, so that a decoder plays silence, and whose ancillary
bits hold the payload. The bit rate varies: full frames have 320 kbit/s, the last one the least rate that fits.

`parse` reads any MPEG-1, 2 or 2.5 stream of layers I to III: it resynchronises on frame headers (a header counts if the
next one follows it or the data end there), reads ID3v2, ID3v1, Xing, Info and VBRI tables, verifies the checksums of all
layers, and gives the exact duration as samples over rate, without the encoder's delay and padding where a table tells
them, and the byte offset of each frame.

Defined cases: null media are parsed as empty ones, with no frames and duration 0. Bytes between frames count as skipped.
A frame cut off at the end of the data is left out. Streams of mixed rates sum each frame's own duration. Repeated rows give
equal results, and an empty table none. Kept columns of a result's name give way to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

# Fixed values of the MPEG audio standards: kbit/s by (version 1 or 2, layer) and header index 1 to 14.
RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
# Bits of a Layer II subband's allocation, for the subbands that have so many: (bits, subbands) in order, by table.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}
# Fixed values end here.

SIDE, CHECK, HEAD = 17, 2, 4  # bytes of a mono frame's side information, checksum and header
OVERHEAD = HEAD + CHECK + SIDE
SAMPLES, RATE = 1152, 48000
PAYLOAD_UNIT = 64


def crc16(data: bytes, crc: int = 0xFFFF, bits: int | None = None) -> int:
    """The checksum of the first so many bits (all, if none are told)."""
    bits = 8 * len(data) if bits is None else bits
    for i in range(bits):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    kbits: int
    hertz: int
    size: int
    samples: int
    channels: int
    checked: bool


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The frame header in 32 bits; None if they are none (free-format rates count as none)."""
    if word in _headers:
        return _headers[word]
    out = None
    version = {3: 1, 2: 2, 0: 2.5}.get(word >> 19 & 3)
    layer, rate, hertz = 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 == 0x7FF and version and layer < 4 and 0 < rate < 15 and hertz < 3 and word & 3 != 2:
        kbits, hz, padding = RATES[min(2, int(version)), layer][rate - 1], HERTZ[version][hertz], word >> 9 & 1
        if layer == 1:
            samples, size = 384, (12000 * kbits // hz + padding) * 4
        else:
            samples = 576 if layer == 3 and version > 1 else 1152
            size = samples // 8 * 1000 * kbits // hz + padding
        out = Header(version, layer, kbits, hz, size, samples, 1 if word >> 6 & 3 == 3 else 2, not word >> 16 & 1)
    if len(_headers) < 4096:
        _headers[word] = out
    return out


def _side(h: Header) -> int:
    """Bytes of Layer III side information."""
    return (32 if h.channels == 2 else 17) if h.version == 1 else (17 if h.channels == 2 else 9)


def _head(rate_index: int) -> bytes:
    head = struct.pack(">I", 0xFFFA0000 | rate_index << 12 | 1 << 10 | 3 << 6)
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


_SIZES = [k * 3 for k in RATES[1, 3]]
_HEADS = [_head(i + 1) for i in range(14)]
CAPACITY = _SIZES[-1] - OVERHEAD


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def pad(payload: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of PAYLOAD_UNIT."""
    return payload + bytes(-len(payload) % PAYLOAD_UNIT or (0 if payload else PAYLOAD_UNIT))


def mux(payload: bytes) -> bytes:
    """payload as an MPEG audio stream; its length stands in the tag."""
    frames, sizes = [], []
    for at in range(0, len(payload), CAPACITY):
        part = payload[at : at + CAPACITY]
        i = next(k for k, size in enumerate(_SIZES) if size - OVERHEAD >= len(part))
        frames += (_HEADS[i], part, bytes(_SIZES[i] - OVERHEAD - len(part)))
        sizes.append(_SIZES[i])
    table_frame = _SIZES[8]
    total = table_frame + sum(sizes)
    # each percent of the duration as a 256th of the bytes
    toc, at = bytearray(), [table_frame]
    for size in sizes:
        at.append(at[-1] + size)
    for percent in range(100):
        toc.append(min(255, at[percent * len(sizes) // 100] * 256 // total))
    xing = b"Xing" + struct.pack(">III", 7, len(sizes), total) + bytes(toc)
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    first = _HEADS[8] + xing
    return b"".join([b"ID3\4\0\0", _synchsafe(len(tag)), tag, first, bytes(table_frame - len(first)), *frames])


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    toc: bytes = b""
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    duration: Fraction = Fraction(0)
    checks_good: int = 0
    checks_bad: int = 0
    resyncs: int = 0
    skipped: int = 0


def _id3(data: bytes, out: Stream) -> int:
    """Reads an ID3v2 tag at the start; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    end, at, version = min(len(data), 10 + size), 10, data[3]
    if data[5] & 0x40 and at + 4 <= end:
        at += sum((b & 127) << s for b, s in zip(data[at : at + 4], (21, 14, 7, 0))) if version == 4 else 4 + int.from_bytes(data[at : at + 4])
    while at + 10 <= end and data[at] and version > 2:
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        n = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0))) if version == 4 else int.from_bytes(raw)
        body, at = data[at + 10 : min(end, at + 10 + n)], at + 10 + n
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            text = body[1:].decode(code, "replace").rstrip("\0")
            if name == "TXXX":
                key, _, text = text.partition("\0")
                name = f"TXXX:{key}"
            out.tags[name] = text
    return end + (10 if data[5] & 0x10 else 0)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads a Xing, Info or VBRI table in the frame at `at`."""
    end = min(len(data), at + h.size)
    for start in (at + HEAD + _side(h), at + HEAD + _side(h) + CHECK):
        if data[start : start + 4] in (b"Xing", b"Info") and start + 8 <= end:
            flags, p = int.from_bytes(data[start + 4 : start + 8]), start + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out.table[name], p = int.from_bytes(data[p : p + 4]), p + 4
            if flags & 4:
                out.toc, p = data[p : p + 100], p + 100
            if flags & 8:
                out.table["quality"], p = int.from_bytes(data[p : p + 4]), p + 4
            # an encoder's name of nine characters, and further on its delay and padding in samples, 12 bits each
            if p + 24 <= end and data[p : p + 4].isalnum():
                both = int.from_bytes(data[p + 21 : p + 24])
                out.table["delay"], out.table["padding"] = both >> 12, both & 0xFFF
            return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 58 <= end:
        out.table["bytes"], out.table["frames"] = struct.unpack(">II", data[at + 46 : at + 54])
        return True
    return False


def _bit(data: bytes, i: int) -> int:
    return data[i >> 3] >> (7 - (i & 7)) & 1


def protected_bits(body: bytes, word: int, h: Header) -> int:
    """How many bits behind a frame's checksum it covers, besides the header's last 16: the side information of Layer III, the
    allocations of Layer I, and those of Layer II with the choices of scale factors."""
    if h.layer == 3:
        return 8 * _side(h)
    bound = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32  # from there on both channels share allocations
    if h.layer == 1:
        return 4 * sum(h.channels if band < bound else 1 for band in range(32))
    rate = h.kbits // h.channels
    if h.version > 1:
        table = "low"
    elif rate >= 56 and (h.hertz == 48000 or rate <= 80):
        table = "a"
    elif h.hertz != 48000 and rate >= 96:
        table = "b"
    else:
        table = "c" if h.hertz != 32000 else "d"
    widths = [bits for bits, n in ALLOCATION[table] for _ in range(n)]
    at = choices = 0
    for band, bits in enumerate(widths):
        shared = band >= bound
        for _ in range(1 if shared else h.channels):
            if at + bits > 8 * len(body):
                return 8 * len(body)
            used = any(_bit(body, at + i) for i in range(bits))
            choices += 2 * used * (h.channels if shared else 1)
            at += bits
    return min(at + choices, 8 * len(body))


_checked: dict[tuple[int, bytes], bool] = {}


def _checksum_holds(data: bytes, at: int, word: int, h: Header) -> bool:
    body = data[at + HEAD + CHECK : at + h.size]
    bits = protected_bits(body, word, h)
    key = word, data[at + HEAD : at + HEAD + CHECK + (bits + 7) // 8]
    if key not in _checked:
        if len(_checked) > 4096:
            _checked.clear()
        _checked[key] = crc16(body, crc16(struct.pack(">H", word & 0xFFFF)), bits) == int.from_bytes(key[1][:CHECK])
    return _checked[key]


def parse(data: bytes) -> Stream:
    out, end = Stream(), len(data)
    at = _id3(data, out)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            out.tags.setdefault(name, data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip())
    synced, first = False, True
    while at + HEAD <= end:
        word = int.from_bytes(data[at : at + HEAD])
        h = header(word)
        if h is not None and not synced:
            follows = at + h.size
            if follows + HEAD <= end and header(int.from_bytes(data[follows : follows + HEAD])) is None:
                h = None
        if h is None or at + h.size > end:
            if synced or first:
                out.resyncs += 1
            synced = first = False
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        synced = True
        if first and h.layer == 3 and _table(data, at, h, out):
            first = False
            at += h.size
            continue
        first = False
        if h.checked:
            if _checksum_holds(data, at, word, h):
                out.checks_good += 1
            else:
                out.checks_bad += 1
        out.offsets.append(at)
        out.headers.append(h)
        at += h.size
    out.skipped += max(0, end - at)
    counts: dict[int, int] = {}
    for h in out.headers:
        counts[h.hertz] = counts.get(h.hertz, 0) + h.samples
    out.samples = sum(counts.values())
    out.duration = sum((Fraction(n, hertz) for hertz, n in counts.items()), Fraction(0))
    if counts and (silent := out.table.get("delay", 0) + out.table.get("padding", 0)):
        out.duration = max(Fraction(0), out.duration - Fraction(silent, out.headers[0].hertz))
    return out


def demux(data: bytes, stream: Stream | None = None) -> bytes:
    """The payload that `mux` stored."""
    stream = stream or parse(data)
    view = memoryview(data)
    body = b"".join(view[at + OVERHEAD : at + h.size] for at, h in zip(stream.offsets, stream.headers))
    return body[: int(stream.tags.get("TXXX:payload_bytes", len(body)))]


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column `media`: each text's padded bytes as a stream."""
    runtime.small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: mux(pad((x or "").encode("utf-8", "surrogatepass"))))

    return docs.withColumn(media, run(runtime.text_or_empty(text)))


def feature(s: Stream) -> str:
    """What the stream holds, in words: equal streams have equal features."""
    rates = sorted({h.kbits for h in s.headers})
    seek = zlib.crc32(b"".join(struct.pack(">q", x) for x in s.offsets))
    return (
        f"frames={len(s.offsets)};table_frames={s.table.get('frames', -1)};samples={s.samples};duration={s.duration};"
        f"kbits={rates[0] if rates else 0}-{rates[-1] if rates else 0};checks={s.checks_good}/{s.checks_good + s.checks_bad};"
        f"resyncs={s.resyncs};skipped={s.skipped};seek={seek:08x}"
    )


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, n_frames long, seek_offsets array<long>"


def inspect(stored: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns `keep`, and what reading each row's stream back gives."""
    keep, kept = runtime.kept(stored, keep, READ)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1):
                data = value.as_py() or b""
                s = parse(data)
                payload = demux(data, s)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(s), float(s.duration), len(s.offsets), s.offsets))
            names = [x.split()[0] for x in READ.split(", ")]
            columns = [pa.array(x) for x in zip(*rows)] if rows else []
            columns = [c.cast(pa.list_(pa.int64())) if pa.types.is_list(c.type) else c for c in columns]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *names])

    return stored.select(*keep, media).mapInArrow(run, f"{kept}{READ}")


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.documents(spark, sf_dir).select("doc_id", "text")
    stored = store(docs).withColumn("n_bytes", F.octet_length(runtime.text_or_empty()).cast("long"))
    return inspect(stored, ["doc_id", "n_bytes"])
