"""Media columns: what bytes are, and what is inside them, told by signatures.

An Aho-Corasick automaton finds every magic number of the table below in one pass over the bytes. A validator of
the format then reads the structure behind the magic number and tells the length, or refuses. A column's declared
type is corrected by what stands at its start, and valid media further inside are carved out with their lengths.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import id_text, utf8, with_id_of

#: Magic number -> (type, offset of the magic number from the start of its medium).
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("audio/wav", 0),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("audio/ogg", 0),
    b"ID3": ("audio/mpeg", 0),
    b"ftyp": ("video/mp4", 4),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
}
UNKNOWN = "application/octet-stream"


def _u32(b: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(f"{order}I", b, at)[0] if at + 4 <= len(b) else -1


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = _u32(b, p, ">"), b[p + 4 : p + 8]
        if first and (kind != b"IHDR" or n != 13) or not kind.isalpha() or p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != _u32(b, p + 8 + n, ">"):
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker = b[p + 1]
        if marker in (0x01, *range(0xD0, 0xD8)):
            p += 2
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data runs to the next marker that is neither stuffing nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] == 0xD9:
                return p + 2 - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _bmp(b: bytes, at: int) -> int | None:
    n, data, header = _u32(b, at + 2), _u32(b, at + 10), _u32(b, at + 14)
    return n if header in (12, 40, 52, 56, 108, 124) and 14 + header <= data <= n <= len(b) - at and b[at + 6 : at + 10] == b"\0\0\0\0" else None


def _wav(b: bytes, at: int) -> int | None:
    n = _u32(b, at + 4) + 8
    if b[at + 8 : at + 12] != b"WAVE" or not 12 <= n <= len(b) - at:
        return None
    kinds, p = [], at + 12
    while p + 8 <= at + n:
        kinds.append(b[p : p + 4])
        p += 8 + _u32(b, p + 4) + (_u32(b, p + 4) & 1)
    return n if b"fmt " in kinds and b"data" in kinds and p - at in (n, n + 1) else None


def _flac(b: bytes, at: int) -> int | None:
    """The stream has no length: it is taken to the end, if its metadata blocks are whole."""
    p = at + 4
    if b[p : p + 1] not in (b"\x00", b"\x80") or b[p + 1 : p + 4] != b"\x00\x00\x22":
        return None
    while p + 4 <= len(b):
        last, p = b[p] & 0x80, p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
        if last:
            return len(b) - at if p <= len(b) else None
    return None


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    if not b[p + 5 : p + 6] or not b[p + 5] & 2:  # only the first page of a stream begins a medium
        return None
    while b[p : p + 4] == b"OggS" and p + 27 <= len(b) and b[p + 4] == 0:
        table = b[p + 27 : p + 27 + b[p + 26]]
        size = 27 + b[p + 26] + sum(table)
        if len(table) != b[p + 26] or p + size > len(b):
            return None
        last, p = b[p + 5] & 4, p + size
        if last:
            return p - at
    return None


def _id3(b: bytes, at: int) -> int | None:
    size = b[at + 6 : at + 10]
    if at + 10 > len(b) or b[at + 3] not in (2, 3, 4) or any(x & 0x80 for x in size):
        return None
    n = 10 + sum(x << s for x, s in zip(size, (21, 14, 7, 0), strict=True))
    return n if n <= len(b) - at else None


def _mp4(b: bytes, at: int) -> int | None:
    p, kinds = at, []
    while p + 8 <= len(b) and (n := _u32(b, p, ">")) >= 8 and p + n <= len(b) and b[p + 4 : p + 8].isalnum():
        kinds.append(b[p + 4 : p + 8])
        p += n
    return p - at if at >= 0 and b"moov" in kinds else None


def _pdf(b: bytes, at: int) -> int | None:
    end = b.next(b"%%EOF", at)
    return end + 5 - at if end >= 0 and b[at + 5 : at + 6].isdigit() and 0 <= b.next(b"startxref", at) < end else None


def _zip(b: bytes, at: int) -> int | None:
    end = b.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = _u32(b, end + 12), _u32(b, end + 16), struct.unpack_from("<H", b, end + 20)[0]
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else None


class Content(bytes):
    """Bytes that find the places of a mark once, however many media ask for the next one."""

    def next(self, mark: bytes, at: int) -> int:
        """The first place of mark from ``at`` on, or -1."""
        places = self.__dict__.get(mark)
        if places is None:
            places = self.__dict__[mark] = [m.start() for m in re.finditer(re.escape(mark), self)]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "audio/flac": _flac,
    "audio/ogg": _ogg, "audio/mpeg": _id3, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip,
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, (kind, offset) in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind, offset))
    a.make_automaton()
    return a


def sniff(content: bytes, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every valid medium in content, in order; what lies inside an earlier one of equal or larger reach is found too."""
    out, content = [], Content(content)
    for last, (n, kind, offset) in found.iter(content.decode("latin-1")):
        start = last - n + 1 - offset
        if start >= 0 and (length := VALIDATORS[kind](content, start)):
            out.append((start, length, kind))
    return sorted(set(out))


def judge(content: bytes, declared: object, found: ahocorasick.Automaton) -> tuple[str, bool, int, list[dict]]:
    """(type, whether that was declared, length, media carved further inside): the largest valid medium at the start decides."""
    media = sniff(content, found)
    here = max((m for m in media if m[0] == 0), key=lambda m: m[1], default=(0, len(content), UNKNOWN))
    return here[2], declared == here[2], here[1], [{"offset": o, "length": n, "type": k} for o, n, k in media if o]


SNIFFED = "type string, declared_ok boolean, length long, carved array<struct<offset:long,length:long,type:string>>"


def sniff_media(media: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """media's other columns with type (corrected), declared_ok, length (of the medium at the start; all bytes if none is) and carved (valid media further inside).

    Null or empty content has type 'application/octet-stream', length 0 and nothing carved; a null declared type is
    never right. Of media that begin at one place the longest decides. Long content is read whole, in one pass over
    its signatures. Repeated rows repeat; an empty table gives an empty one. Columns named like the results are
    replaced; content and declared are left out.
    """
    rest = [f for f in media.schema.fields if f.name not in (content, declared, "type", "declared_ok", "length", "carved")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], SNIFFED])

    def sniffed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton()
        for batch in batches:
            rows = [judge(bytes(raw) if raw is not None else b"", said, found) for raw, said in zip(batch[content], batch[declared], strict=True)]
            out = batch[[f.name for f in rest]].reset_index(drop=True)
            out[["type", "declared_ok", "length", "carved"]] = pd.DataFrame(rows, columns=["type", "declared_ok", "length", "carved"], index=out.index)
            yield out

    return media.select(*[f"`{f.name}`" for f in rest], content, declared).mapInPandas(sniffed, schema)


UNIT = 192
RATE = 8000


def payload_of(text: object) -> bytes:
    """The text's UTF-8 bytes with spaces up to a positive multiple of UNIT."""
    raw = utf8(text)
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def as_wav(samples: bytes) -> bytes:
    """8-bit mono PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def wav_samples(content: bytes) -> bytes:
    """The data chunk, found by walking the chunks."""
    p = 12
    while content[p : p + 4] != b"data":
        p += 8 + _u32(content, p + 4) + (_u32(content, p + 4) & 1)
    return content[p + 8 : p + 8 + _u32(content, p + 4)]


#: What the texts' media are declared to be, and how the samples of a type are read.
DECLARED, READERS = "application/octet-stream", {"audio/wav": wav_samples}
DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores each text as an 8-bit WAV that is declared to be DECLARED, judges the stored bytes, and reads them back as what they are.

    feature: declared type, '>', corrected type, '+', length; then ';type@offset+length' for each medium carved out of
    the text. Null text is empty, so equal to an empty one; long texts are stored whole; rows are handled one by one,
    so repeated rows repeat; only doc_id and text are read, whatever other columns are called; an empty table gives an
    empty one.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                content = as_wav(payload_of(text))
                kind, _, length, carved = judge(content, DECLARED, found)
                back = READERS[kind](content[:length])
                feature = ";".join([f"{DECLARED}>{kind}+{length}", *[f"{m['type']}@{m['offset']}+{m['length']}" for m in carved]])
                rows.append((len(utf8(text)), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(content), hashlib.sha256(content).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return with_id_of(docs.select(id_text(docs).alias("doc_id"), "text").mapInPandas(digests, f"doc_id string, {DIGEST}"), docs)
