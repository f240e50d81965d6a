"""Media columns: texts stored as 8-bit PCM audio, read back through signature sniffing.

Sniffing runs one Aho-Corasick automaton over the stored bytes. It locates the magic bytes and end marks of all formats in
one pass; a validator for each format then confirms structure and lengths at that place. A confirmed format at offset 0
corrects the declared type; confirmed formats further in are embedded media and can be carved out. The work grows with the
bytes, however many magics they hold and wherever their blocks lead; only a gzip stream is inflated for each of its magics.

Edge cases: null and empty payloads are sniffed as unknown; truncated or inconsistent media aren't confirmed; of media
inside other confirmed media only the outer is carved; equal bytes give equal results; `sniffed` keeps all columns, and if
one has the name of a new column, the new one gets an underscore more.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_position, named_back, table, text_bytes

PAGE = 576
RATE = 8000


class Found(NamedTuple):
    kind: str
    start: int
    length: int
    media: tuple[int, int]  # place of the samples or the compressed body, absolute


POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
PART = 1 << 16


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; bit 31 is the constant term."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def _power(bits: int) -> int:
    """The polynomial x to the power `bits`."""
    out, square = 1 << 31, 1 << 30
    while bits:
        if bits & 1:
            out = _times(square, out)
        square, bits = _times(square, square), bits >> 1
    return out


class Scan:
    """A byte string with the places of all marks, and what validators at different places share.

    Chains of blocks are walked once: every place on a way remembers where it leads, so magics that lead into the same
    blocks cost no more than one of them. Checksums of long blocks are taken from those of the beginnings of the string.
    """

    def __init__(self, data: bytes, marks: ahocorasick.Automaton):
        self.b, self.u, self.n = data, np.frombuffer(data, np.uint8), len(data)
        found = [array("q") for _ in MARKS]
        for end, k in marks.iter(data.decode("latin-1")):
            found[k].append(end)
        self.places = [np.frombuffer(x, np.int64) + 1 - len(m) if len(x) else NOWHERE for x, m in zip(found, MARKS)]
        self.riff: dict[int, tuple[int, int]] = {}
        self.png: dict[int, tuple[int, int]] = {}
        self.gif: dict[int, int] = {}
        self.gif_data: dict[int, int] = {}
        self.jpeg: dict[int, tuple[int, int]] = {}
        self._rest: dict[str, np.ndarray] = {}
        self._sums = [0]

    def at(self, mark: bytes) -> np.ndarray:
        return self.places[MARKS.index(mark)]

    def has(self, places: np.ndarray, text: bytes) -> np.ndarray:
        """Whether the text stands at each place; the places must leave room for it."""
        out = np.ones(len(places), bool)
        for k, x in enumerate(text):
            out &= self.u[places + k] == x
        return out

    def number(self, places: np.ndarray, size: int) -> np.ndarray:
        """Little-endian numbers."""
        return sum(self.u[places + k].astype(np.int64) << 8 * k for k in range(size))

    def crc(self, a: int, b: int) -> int:
        if b - a <= PART:
            return zlib.crc32(self.b[a:b])
        return self._sum_to(b) ^ _times(_power(8 * (b - a)), self._sum_to(a))

    def _sum_to(self, to: int) -> int:
        while len(self._sums) <= to // PART:
            k = len(self._sums) - 1
            self._sums.append(zlib.crc32(self.b[k * PART : (k + 1) * PART], self._sums[-1]))
        return zlib.crc32(self.b[to // PART * PART : to], self._sums[to // PART])

    def next_zero(self, place: int) -> int:
        if "zeros" not in self._rest:
            self._rest["zeros"] = np.flatnonzero(self.u == 0)
        return _after(self._rest["zeros"], place)

    def next_marker(self, place: int) -> int:
        """The next 255 that isn't stuffed or a restart, as JPEG has it."""
        if "markers" not in self._rest:
            first, second = self.u[:-1], self.u[1:]
            self._rest["markers"] = np.flatnonzero((first == 255) & (second != 0) & ((second < 0xD0) | (second > 0xD7)))
        return _after(self._rest["markers"], place)


NOWHERE = np.zeros(0, np.int64)


def _after(places: np.ndarray, place: int) -> int:
    """The first of the sorted places from `place` on, or -1."""
    k = int(np.searchsorted(places, place))
    return int(places[k]) if k < len(places) else -1


# Each format has a test of all its magics at once, which leaves few of them, and a validator of one place.


def _wav_places(s: Scan, p: np.ndarray) -> np.ndarray:
    p = p[p + 44 <= s.n]
    p = p[s.has(p + 8, b"WAVE")]
    return p[p + 8 + s.number(p + 4, 4) <= s.n]


def _riff_data(s: Scan, pos: int) -> tuple[int, int]:
    """Places of the first data chunk on the way from `pos`, and of the last format chunk before it; -1 if there is none."""
    way, out = [], (-1, -1)
    while pos + 8 <= s.n:
        if pos in s.riff:
            out = s.riff[pos]
            break
        name, size = s.b[pos : pos + 4], struct.unpack_from("<I", s.b, pos + 4)[0]
        if name == b"data":
            out = s.riff[pos] = (pos, -1)
            break
        way.append((pos, name == b"fmt " and 16 <= size <= s.n - pos - 8))
        pos += 8 + size + size % 2
    for place, form in reversed(way):
        if form and out[1] < 0:
            out = (out[0], place)
        s.riff[place] = out
    return out


def _wav(s: Scan, at: int) -> Found | None:
    b = s.b
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    data, form = _riff_data(s, at + 12)
    if data < 0 or form < 0 or data + 8 > end:
        return None
    size = struct.unpack_from("<I", b, data + 4)[0]
    _, channels, rate, speed, frame, bits = struct.unpack_from("<HHIIHH", b, form + 8)
    if data + 8 + size > end or speed != rate * frame or frame != channels * (bits // 8) or not frame or size % frame:
        return None
    return Found("audio/wav", at, end - at, (data + 8, data + 8 + size))


def _png_places(s: Scan, p: np.ndarray) -> np.ndarray:
    p = p[p + 33 <= s.n]
    return p[s.has(p + 12, b"IHDR")]


def _png_end(s: Scan, pos: int) -> tuple[int, int]:
    """End of the last chunk on the way from `pos`, if all checksums are right, and place of the first image data; else -1."""
    way, out = [], (-1, -1)
    while pos + 12 <= s.n:
        if pos in s.png:
            out = s.png[pos]
            break
        size, name = struct.unpack_from(">I", s.b, pos)[0], s.b[pos + 4 : pos + 8]
        after = pos + 12 + size
        if after > s.n or s.crc(pos + 4, pos + 8 + size) != struct.unpack_from(">I", s.b, pos + 8 + size)[0]:
            s.png[pos] = out
            break
        if name == b"IEND":
            out = s.png[pos] = (after, -1)
            break
        way.append((pos, name == b"IDAT"))
        pos = after
    for place, image in reversed(way):
        if image and out[0] >= 0:
            out = (out[0], place)
        s.png[place] = out
    return out


def _png(s: Scan, at: int) -> Found | None:
    end, image = _png_end(s, at + 8)
    if end < 0:
        return None
    body = (at, end) if image < 0 else (image + 8, image + 8 + struct.unpack_from(">I", s.b, image)[0])
    return Found("image/png", at, end - at, body)


def _gif_places(s: Scan, p: np.ndarray) -> np.ndarray:
    p = p[p + 14 <= s.n]
    return p[(s.has(p + 4, b"7a")) | (s.has(p + 4, b"9a"))]


def _gif_blocks(s: Scan, pos: int) -> int:
    """The place after the data blocks that begin at `pos`."""
    way = []
    while pos < s.n and s.b[pos]:
        if pos in s.gif_data:
            pos = s.gif_data[pos] - 1
            break
        way.append(pos)
        pos += 1 + s.b[pos]
    for place in way:
        s.gif_data[place] = pos + 1
    return pos + 1


def _gif_end(s: Scan, pos: int) -> int:
    """The place after the trailer on the way from the block at `pos`, or -1."""
    way, out = [], -1
    while pos < s.n:
        if pos in s.gif:
            out = s.gif[pos]
            break
        way.append(pos)
        tag = s.b[pos]
        if tag == 0x3B:
            out = pos + 1
            break
        if tag == 0x21:
            pos = _gif_blocks(s, pos + 2)
        elif tag == 0x2C and pos + 10 < s.n:
            local = s.b[pos + 9]
            pos = _gif_blocks(s, pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            break
    for place in way:
        s.gif[place] = out
    return out


def _gif(s: Scan, at: int) -> Found | None:
    flags = s.b[at + 10]
    end = _gif_end(s, at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
    return Found("image/gif", at, end - at, (at + 13, end - 1)) if end >= 0 else None


def _jpeg_places(s: Scan, p: np.ndarray) -> np.ndarray:
    """Places whose first segment has a kind and a length, and another one behind it."""
    p = p[p + 6 <= s.n]
    p = p[(s.u[p + 3] >= 0xC0) & (s.u[p + 3] < 0xFF)]
    after = p + 4 + s.number(p + 5, 1) + 256 * s.number(p + 4, 1)
    p, after = p[after < s.n], after[after < s.n]
    return p[(after >= p + 6) & ((s.u[after] == 0xFF) | (s.u[p + 3] == 0xDA))]


def _jpeg_end(s: Scan, pos: int) -> tuple[int, int]:
    """The place after the end mark on the way from the segment at `pos`, and where the last scan's data begin; -1 if there is none."""
    way, out = [], (-1, -1)
    while 0 <= pos and pos + 2 <= s.n and s.b[pos] == 0xFF:
        if pos in s.jpeg:
            out = s.jpeg[pos]
            break
        mark = s.b[pos + 1]
        if mark == 0xD9:
            out = s.jpeg[pos] = (pos + 2, -1)
            break
        size = struct.unpack_from(">H", s.b, pos + 2)[0] if pos + 4 <= s.n else 0
        if size < 2:
            s.jpeg[pos] = out
            break
        scan = mark == 0xDA
        way.append((pos, pos + 2 + size if scan else -1))
        pos = s.next_marker(pos + 2 + size) if scan else pos + 2 + size
    for place, body in reversed(way):
        if body >= 0 and out[1] < 0 <= out[0]:
            out = (out[0], body)
        s.jpeg[place] = out
    return out


def _jpeg(s: Scan, at: int) -> Found | None:
    end, body = _jpeg_end(s, at + 2)
    return Found("image/jpeg", at, end - at, (body, end - 2)) if body >= 0 else None


def _bmp_places(s: Scan, p: np.ndarray) -> np.ndarray:
    p = p[p + 54 <= s.n]
    p = p[s.number(p + 6, 4) == 0]
    return p[np.isin(s.number(p + 14, 4), (40, 52, 56, 108, 124))]


def _bmp(s: Scan, at: int) -> Found | None:
    size, _, start, head = struct.unpack_from("<IIII", s.b, at + 2)
    if not 14 + head <= start <= size or at + size > s.n:
        return None
    width, height, planes, bits, packed = struct.unpack_from("<iiHHI", s.b, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or size < start + (width * bits + 31) // 32 * 4 * abs(height):
        return None
    return Found("image/bmp", at, size, (at + start, at + size))


def _pdf_places(s: Scan, p: np.ndarray) -> np.ndarray:
    """Places with a version, an end mark behind them and a cross-reference between."""
    p = p[p + 6 <= s.n]
    digit = s.u[p + 5]
    p = p[(digit >= 48) & (digit <= 57)]
    ends, refs = s.at(b"%%EOF"), s.at(b"startxref")
    p = p[np.searchsorted(ends, p) < len(ends)]
    last = np.searchsorted(refs, ends[np.searchsorted(ends, p)] - len(b"startxref"), "right") - 1
    return p[(last >= 0) & (refs[last] >= p)] if len(refs) else NOWHERE


def _pdf(s: Scan, at: int) -> Found | None:
    end = _after(s.at(b"%%EOF"), at)
    return Found("application/pdf", at, end + 5 - at, (at, end))


def _gzip_places(s: Scan, p: np.ndarray) -> np.ndarray:
    p = p[p + 18 <= s.n]
    flags = s.u[p + 3]
    p, named = p[(flags & 0xE0) == 0], (flags[(flags & 0xE0) == 0] & 24) > 0
    return p[~named | (p < s.b.rfind(b"\0"))]


def _gzip(s: Scan, at: int) -> Found | None:
    b, flags, body = s.b, s.b[at + 3], at + 10
    if flags & 4:
        body += 2 + struct.unpack_from("<H", b, body)[0]
    for bit in (8, 16):  # a name and a note, each up to a zero
        if flags & bit:
            body = s.next_zero(body) + 1
            if not body:
                return None
    body += 2 if flags & 2 else 0
    if body + 8 > s.n:
        return None
    inflate, left, pos, step = zlib.decompressobj(31), b"", at, 512
    try:
        while not inflate.eof:
            part = left or b[pos : pos + step]
            if not left:
                pos, step = pos + len(part), min(2 * step, PART)
            if not part:
                return None
            inflate.decompress(part, 1 << 20)
            left = inflate.unconsumed_tail
    except zlib.error:
        return None
    end = pos - len(inflate.unused_data)
    return Found("application/gzip", at, end - at, (body, end - 8))


def _zip_places(s: Scan, p: np.ndarray) -> np.ndarray:
    """Places whose next end record gives a directory that begins where it says, and ends at the record."""
    ends = s.at(b"PK\x05\x06")
    p = p[np.searchsorted(ends, p) < len(ends)]
    end = ends[np.searchsorted(ends, p)]
    room = end + 22 <= s.n
    p, end = p[room], end[room]
    size, offset, note = s.number(end + 12, 4), s.number(end + 16, 4), s.number(end + 20, 2)
    right = (offset + size == end - p) & (size >= 4) & (end + 22 + note <= s.n)
    p, offset = p[right], offset[right]
    return p[s.has(p + offset, b"PK\x01\x02")]


def _zip(s: Scan, at: int) -> Found | None:
    end = _after(s.at(b"PK\x05\x06"), at)
    offset, note = struct.unpack_from("<IH", s.b, end + 16)
    return Found("application/zip", at, end + 22 + note - at, (at, at + offset))


#: Public signatures of the formats.
SIGNATURES = {
    b"RIFF": (_wav_places, _wav),
    b"\x89PNG\r\n\x1a\n": (_png_places, _png),
    b"GIF8": (_gif_places, _gif),
    b"\xff\xd8\xff": (_jpeg_places, _jpeg),
    b"BM": (_bmp_places, _bmp),
    b"%PDF-": (_pdf_places, _pdf),
    b"\x1f\x8b\x08": (_gzip_places, _gzip),
    b"PK\x03\x04": (_zip_places, _zip),
}
MARKS = (*SIGNATURES, b"%%EOF", b"startxref", b"PK\x05\x06")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, mark in enumerate(MARKS):
        found.add_word(mark.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(data: bytes, marks: ahocorasick.Automaton) -> list[Found]:
    """Confirmed media in order of place; none inside another."""
    s = Scan(data, marks)
    asked = [(int(at), check) for (places, check), p in zip(SIGNATURES.values(), s.places) if len(p) for at in places(s, p)]
    out: list[Found] = []
    free = 0
    for at, check in sorted(asked, key=lambda x: x[0]):
        if at >= free and (found := check(s, at)):
            out.append(found)
            free = at + found.length
    return out


def wav_bytes(samples: bytes) -> bytes:
    """Unsigned 8-bit mono PCM."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def read_wav(data: bytes, magic: ahocorasick.Automaton) -> tuple[Found, bytes]:
    found = sniff(data, magic)
    if not found or found[0].start or found[0].kind != "audio/wav":
        raise ValueError("the stored bytes are no valid audio")
    return found[0], data[slice(*found[0].media)]


def features(found: Found, samples: bytes, inner: list[Found]) -> str:
    """Sniffed type, number of samples, level, zero crossings, and the kinds of embedded media."""
    wave = np.frombuffer(samples, np.uint8)
    step = 1 << 20
    total = square = crossings = 0
    for a in range(0, len(wave), step):
        part = wave[a : a + step + 1].astype(np.int64) - 128
        crossings += int(np.count_nonzero((part[1:] < 0) != (part[:-1] < 0)))
        part = part[:step]
        total, square = total + int(part.sum()), square + int((part * part).sum())
    kinds = ",".join(f"{x.kind}@{x.start}+{x.length}" for x in inner) or "none"
    return f"{found.kind};samples={len(wave)};mean={total / len(wave):.6f};rms={(square / len(wave)) ** 0.5:.6f};crossings={crossings};embedded={kinds}"


def payload(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // PAGE)) * PAGE - len(text))


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text as a media row: digests of the payload as read back, of the stored form, and its features; with `keep_media` also the stored form."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magic = automaton()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for text in text_bytes(part.column(1)):
                    media = wav_bytes(payload(text))
                    found, back = read_wav(media, magic)
                    inner = sniff(back, magic)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(found, back, inner), *[media] * keep_media))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(make, MEDIA_SCHEMA + ", media binary" * keep_media)


def sniffed(rows: DataFrame, data_col: str, declared_col: str) -> DataFrame:
    """`rows` with `media_type` (the confirmed type, else the declared one), `type_corrected` and `embedded` (carved media).

    A new column whose name is taken gets underscores at its end.
    """
    kind = "struct<media_type:string,type_corrected:boolean,embedded:array<struct<kind:string,start:long,media:binary>>>"

    @F.arrow_udf(kind)
    def look(data: pa.Array, declared: pa.Array) -> pa.Array:
        magic = automaton()
        out = []
        for raw, said in zip(data, declared):
            raw, said = raw.as_py() or b"", said.as_py()
            found = sniff(raw, magic)
            outer = found[0] if found and not found[0].start else None
            # media within the outer one are looked for in its body
            inner = [x for x in found if x.start]
            if outer:
                a, b = outer.media
                inner = [x._replace(start=x.start + a) for x in sniff(raw[a:b], magic)] + inner
            real = outer.kind if outer else said
            out.append({"media_type": real, "type_corrected": real != said, "embedded": [{"kind": x.kind, "start": x.start, "media": raw[x.start : x.start + x.length]} for x in inner]})
        return pa.array(out, pa.struct([("media_type", pa.string()), ("type_corrected", pa.bool_()), ("embedded", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("media", pa.binary())])))]))

    names, new = rows.columns, []
    for c in ("media_type", "type_corrected", "embedded"):
        while c in names + new:
            c += "_"
        new.append(c)
    held = rows.select(*by_position(rows), look(F.col(data_col), F.col(declared_col)).alias("found"))
    return held.select(*named_back(names), *[F.col(f"found.{f}").alias(c) for f, c in zip(("media_type", "type_corrected", "embedded"), new)])


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
