"""MP4: boxes, sample tables to access units, audio configuration, tags, and a writer of one audio track."""

from __future__ import annotations

import struct
from collections.abc import Iterator

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst"}
#: Item -> tag.
TAGS = {b"\xa9nam": "TITLE", b"\xa9ART": "ARTIST", b"\xa9alb": "ALBUM", b"\xa9day": "DATE", b"\xa9gen": "GENRE", b"\xa9cmt": "COMMENT", b"aART": "ALBUMARTIST", b"\xa9wrt": "COMPOSER", b"\xa9too": "ENCODER", b"cprt": "COPYRIGHT", b"desc": "DESCRIPTION", b"\xa9lyr": "LYRICS"}
_ITEM = {v: k for k, v in TAGS.items()}
ASC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def boxes(content: bytes, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """(path joined by '/', body begin, body end) of every box, depth first."""
    p, end = start, len(content) if end is None else end
    while p + 8 <= end:
        n, kind = struct.unpack_from(">I4s", content, p)
        head = 8
        if n == 1 and p + 16 <= end:
            n, head = struct.unpack_from(">Q", content, p + 8)[0], 16
        elif n == 0:
            n = end - p
        if n < head or p + n > end:
            return
        here = path + b"/" + kind
        yield here, p + head, p + n
        if kind in CONTAINERS or kind == b"meta" or path.endswith(b"ilst"):
            yield from boxes(content, p + head + (4 if kind == b"meta" else 0), p + n, here)
        p += n


def _u32s(content: bytes, a: int, n: int) -> list[int]:
    return list(struct.unpack_from(f">{n}I", content, a))


def sample_table(content: bytes, found: dict[bytes, tuple[int, int]], base: bytes = b"/moov/trak/mdia/minf/stbl") -> list[tuple[int, int]]:
    """(offset, size) of each sample: runs of samples per chunk, chunk offsets, sizes."""
    a, _ = found[base + b"/stsz"]
    fixed, n = _u32s(content, a + 4, 2)
    sizes = [fixed] * n if fixed else _u32s(content, a + 12, n)
    a, _ = found[base + b"/stsc"]
    flat = _u32s(content, a + 8, 3 * _u32s(content, a + 4, 1)[0])
    runs = list(zip(flat[::3], flat[1::3], strict=True))
    if base + b"/co64" in found:
        a, _ = found[base + b"/co64"]
        offsets = list(struct.unpack_from(f">{_u32s(content, a + 4, 1)[0]}Q", content, a + 8))
    else:
        a, _ = found[base + b"/stco"]
        offsets = _u32s(content, a + 8, _u32s(content, a + 4, 1)[0])
    out, k = [], 0
    for i, (first, per_chunk) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
        for chunk in range(first, last + 1):
            at = offsets[chunk - 1]
            for size in sizes[k : k + per_chunk]:
                out.append((at, size))
                at += size
            k += per_chunk
    return out


def _descriptor(b: bytes, p: int) -> tuple[int, int, int]:
    """(tag, body begin, length)."""
    tag, n, p = b[p], 0, p + 1
    while True:
        n, more, p = n << 7 | b[p] & 0x7F, b[p] & 0x80, p + 1
        if not more:
            return tag, p, n


def audio_config(asc: bytes) -> dict:
    """Object type, sample rate and channels of an AudioSpecificConfig."""
    bits, at = int.from_bytes(asc.ljust(9, b"\0"), "big"), 72

    def take(n: int) -> int:
        nonlocal at
        at -= n
        return bits >> at & ((1 << n) - 1)

    kind = take(5)
    kind = 32 + take(6) if kind == 31 else kind
    code = take(4)
    rate = take(24) if code == 15 else ASC_RATES[code] if code < len(ASC_RATES) else 0
    return {"object_type": kind, "sample_rate": rate, "channels": take(4)}


def build_audio_config(object_type: int, rate: int, channels: int) -> bytes:
    return (object_type << 11 | ASC_RATES.index(rate) << 7 | channels << 3).to_bytes(2, "big")


def parse_esds(body: bytes) -> bytes:
    """The decoder configuration inside an elementary-stream descriptor."""
    tag, p, _ = _descriptor(body, 4)
    if tag == 3:
        flags = body[p + 2]
        p += 3 + (2 if flags & 0x80 else 0) + (1 + body[p + 3] if flags & 0x40 else 0) + (2 if flags & 0x20 else 0)
        tag, p, _ = _descriptor(body, p)
    if tag != 4:
        raise ValueError("no decoder configuration")
    tag, p, n = _descriptor(body, p + 13)
    return body[p : p + n] if tag == 5 else b""


def header(content: bytes) -> dict:
    """Track fields, tags, covers, and (offset, size) of the access units."""
    every = list(boxes(content))
    found = {path: (a, b) for path, a, b in reversed(every)}
    base = b"/moov/trak/mdia"
    if base + b"/mdhd" not in found:
        raise ValueError("no audio track")
    a, _ = found[base + b"/mdhd"]
    scale, duration = (struct.unpack_from(">IQ", content, a + 20) if content[a] else struct.unpack_from(">II", content, a + 12))
    a, b = found[base + b"/minf/stbl/stsd"]
    entry = next(boxes(content, a + 8, b))
    out = {"codec": entry[0][1:].decode("latin-1"), "channels": struct.unpack_from(">H", content, entry[1] + 16)[0], "sample_rate": struct.unpack_from(">I", content, entry[1] + 24)[0] >> 16, "time_scale": scale, "duration": duration}
    for path, x, y in boxes(content, entry[1] + 28, entry[2]):
        if path == b"/esds":
            out["config"] = parse_esds(content[x:y])
            out |= audio_config(out["config"])
    a, _ = found[base + b"/minf/stbl/stts"]
    deltas = _u32s(content, a + 8, 2 * _u32s(content, a + 4, 1)[0])
    out["ticks"] = sum(n * d for n, d in zip(deltas[::2], deltas[1::2], strict=True))
    out["samples"] = sample_table(content, found)
    tags, covers = [], 0
    for path, x, y in every:
        item = path.split(b"/")[-2:]
        if len(item) == 2 and item[1] == b"data" and b"/ilst/" in path:
            value = content[x + 8 : y]
            if item[0] == b"covr":
                covers += 1
            elif item[0] in (b"trkn", b"disk"):
                tags.append(("TRACKNUMBER" if item[0] == b"trkn" else "DISCNUMBER", str(struct.unpack_from(">H", value, 2)[0])))
            else:
                tags.append((TAGS.get(item[0], f"MP4:{item[0].decode('latin-1')}"), value.decode("utf-8", "replace")))
    return out | {"tags": tags, "covers": covers}


def access_units(content: bytes) -> list[bytes]:
    return [content[a : a + n] for a, n in header(content)["samples"]]


def _box(kind: bytes, *body: bytes) -> bytes:
    joined = b"".join(body)
    return struct.pack(">I4s", len(joined) + 8, kind) + joined


def build(units: list[bytes], rate: int, channels: int, frame: int = 1024, tags: list[tuple[str, str]] = (), per_chunk: int = 0) -> bytes:
    """One AAC track: ftyp, moov, mdat. A single chunk, or chunks of per_chunk units; offsets of 64 bits only where they are needed."""
    per = per_chunk or max(1, len(units))
    groups = [units[i : i + per] for i in range(0, len(units), per)]
    asc = build_audio_config(2, rate, channels)
    full = lambda kind, *body: _box(kind, b"\0\0\0\0", *body)
    inner = bytes([4, 13 + 2 + len(asc), 0x40, 0x15]) + b"\0" * 11 + bytes([5, len(asc)]) + asc
    esds = full(b"esds", bytes([3, 3 + len(inner) + 3]) + b"\0\1\0" + inner + bytes([6, 1, 2]))
    entry = _box(b"mp4a", b"\0" * 6 + struct.pack(">H", 1) + b"\0" * 8 + struct.pack(">HHI", channels, 16, 0) + struct.pack(">I", rate << 16), esds)
    runs = [(1, per)] + ([(len(groups), len(groups[-1]))] if len(groups) > 1 and len(groups[-1]) != per else [])
    items = b"".join(_box(_ITEM[k], _box(b"data", struct.pack(">II", 1, 0) + v.encode())) for k, v in tags if k in _ITEM)
    ftyp = _box(b"ftyp", b"M4A \0\0\0\0M4A isom")
    total = sum(map(len, units))

    def moov(first: int) -> bytes:
        offsets, at = [], first
        for g in groups:
            offsets.append(at)
            at += sum(map(len, g))
        wide = at > 0xFFFFFFFF
        stbl = _box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, len(units), frame)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", f, n, 1) for f, n in runs)), full(b"stsz", struct.pack(">II", 0, len(units)), *(struct.pack(">I", len(u)) for u in units)),
            full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), *(struct.pack(">Q" if wide else ">I", o) for o in offsets)),
        )
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, frame * len(units), 0x55C4, 0))
        track = _box(b"trak", _box(b"mdia", mdhd, _box(b"minf", stbl)))
        meta = _box(b"udta", full(b"meta", _box(b"ilst", items))) if items else b""
        return _box(b"moov", track, meta)

    first = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(first) + struct.pack(">I4s", total + 8, b"mdat") + b"".join(units)
