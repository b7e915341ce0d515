"""Opus packets: what the table of contents tells, and the sizes of the frames inside."""

from __future__ import annotations

#: By configuration // 4 for the first three, frame durations in units of 2.5 ms.
SILK, HYBRID, CELT = (4, 8, 16, 24), (4, 8), (1, 2, 4, 8)
BANDWIDTHS = ("narrow", "medium", "wide", "superwide", "full")


def toc(first: int) -> dict:
    """Mode, bandwidth, duration of a frame (microseconds), channels and frame-count code of a packet's first byte."""
    config = first >> 3
    if config < 12:
        mode, band, units = "silk", BANDWIDTHS[config // 4], SILK[config % 4]
    elif config < 16:
        mode, band, units = "hybrid", BANDWIDTHS[3 + (config - 12) // 2], HYBRID[config % 2]
    else:
        mode, band, units = "celt", ("narrow", "wide", "superwide", "full")[(config - 16) // 4], CELT[config % 4]
    return {"mode": mode, "bandwidth": band, "frame_us": units * 2500, "channels": 2 if first & 4 else 1, "code": first & 3}


def samples_per_frame(first: int, rate: int) -> int:
    return toc(first)["frame_us"] * rate // 1_000_000


def _length(b: bytes, p: int) -> tuple[int, int]:
    """(length, bytes it takes); one byte below 252, else two."""
    if p >= len(b):
        raise ValueError("a frame's length is missing")
    if b[p] < 252:
        return b[p], 1
    if p + 1 >= len(b):
        raise ValueError("a frame's length is cut off")
    return b[p + 1] * 4 + b[p], 2


def parse_packet(b: bytes) -> dict:
    """toc, and sizes of the frames; raises ValueError for a packet that breaks the rules of its code."""
    if not b:
        raise ValueError("an empty packet")
    t, p, end = toc(b[0]), 1, len(b)
    if t["code"] == 0:
        sizes = [end - p]
    elif t["code"] == 1:
        if (end - p) % 2:
            raise ValueError("two equal frames of odd total size")
        sizes = [(end - p) // 2] * 2
    elif t["code"] == 2:
        n, used = _length(b, p)
        p += used
        sizes = [n, end - p - n]
    else:
        if end < 2:
            raise ValueError("no frame count")
        count, variable, padded, p = b[1] & 0x3F, b[1] & 0x80, b[1] & 0x40, 2
        if not count or count * t["frame_us"] > 120_000:
            raise ValueError("no frames, or over 120 ms of them")
        while padded:
            if p >= end:
                raise ValueError("padding is cut off")
            n, p = b[p], p + 1
            end -= 254 if n == 255 else n
            padded = n == 255
        if variable:
            sizes = []
            for _ in range(count - 1):
                n, used = _length(b, p)
                p += used
                sizes.append(n)
            sizes.append(end - p - sum(sizes))
        else:
            if (end - p) % count:
                raise ValueError("equal frames do not fill the packet")
            sizes = [(end - p) // count] * count
    if any(n < 0 or n > 1275 for n in sizes):
        raise ValueError("a frame's size is out of range")
    return t | {"sizes": sizes, "duration_us": t["frame_us"] * len(sizes)}
