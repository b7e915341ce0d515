"""Headers of video bitstreams: units and their types, picture sizes. No pictures are decoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annexb(stream: bytes) -> Iterator[bytes]:
    """Units between start codes (three or four bytes)."""
    at = stream.find(b"\0\0\1")
    while at >= 0:
        following = stream.find(b"\0\0\1", at + 3)
        unit = stream[at + 3 : following if following >= 0 else len(stream)]
        yield unit.rstrip(b"\0") if following >= 0 else unit
        at = following


def unescaped(unit: bytes) -> bytes:
    """Without the bytes that keep start codes out of a unit."""
    out, zeros = bytearray(), 0
    for b in unit:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


class Bits:
    """Reads fixed and exponential-Golomb numbers, the highest bit first. Past the end there are zeros."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, n: int) -> int:
        self.left -= n
        return (self.value >> self.left if self.left >= 0 else self.value << -self.left) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 32:
                raise ValueError("a number is too long")
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


def _skip_scaling(b: Bits, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + b.se()) & 255
        last = following or last


def h264_sps(unit: bytes) -> dict:
    """Profile, level, chroma format, bit depth and cropped size of a sequence parameter set."""
    b = Bits(unescaped(unit)[1:])
    profile, _, level, number = b.u(8), b.u(8), b.u(8), b.ue()
    chroma, depth, separate = 1, 8, 0
    if profile in (100, 110, 122, 244, 44, 83, 86, 118, 128):
        chroma = b.ue()
        separate = b.u(1) if chroma == 3 else 0
        depth = b.ue() + 8
        b.ue(), b.u(1)
        if b.u(1):
            for i in range(8 if chroma != 3 else 12):
                if b.u(1):
                    _skip_scaling(b, 16 if i < 6 else 64)
    b.ue()
    order = b.ue()
    if order == 0:
        b.ue()
    elif order == 1:
        b.u(1), b.se(), b.se()
        for _ in range(b.ue()):
            b.se()
    references, _ = b.ue(), b.u(1)
    width, height, frames_only = b.ue() + 1, b.ue() + 1, b.u(1)
    if not frames_only:
        b.u(1)
    b.u(1)
    left = right = top = bottom = 0
    if b.u(1):
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
    sub = (1, 1) if chroma in (0, 3) or separate else (2, 2 if chroma == 1 else 1)
    y = sub[1] * (2 - frames_only)
    return {"id": number, "profile": profile, "level": level, "chroma": chroma, "depth": depth, "references": references, "width": width * 16 - sub[0] * (left + right), "height": height * 16 * (2 - frames_only) - y * (top + bottom)}


def h265_sps(unit: bytes) -> dict:
    """Profile, level, chroma format, bit depth and cropped size of a sequence parameter set."""
    b = Bits(unescaped(unit)[2:])
    b.u(4)
    layers = b.u(3)
    b.u(1)
    b.u(3)
    profile = b.u(5)
    b.u(32), b.u(48)
    level = b.u(8)
    present = [(b.u(1), b.u(1)) for _ in range(layers)]
    if layers:
        for _ in range(layers, 8):
            b.u(2)
    for has_profile, has_level in present:
        b.u(88 * has_profile), b.u(8 * has_level)
    number, chroma = b.ue(), b.ue()
    if chroma == 3:
        b.u(1)
    width, height = b.ue(), b.ue()
    sub = {1: (2, 2), 2: (2, 1)}.get(chroma, (1, 1))
    if b.u(1):
        left, right, top, bottom = b.ue(), b.ue(), b.ue(), b.ue()
        width, height = width - sub[0] * (left + right), height - sub[1] * (top + bottom)
    return {"id": number, "profile": profile, "level": level, "chroma": chroma, "depth": b.ue() + 8, "width": width, "height": height}


def units(stream: bytes, codec: str) -> list[dict]:
    """Type, size and, of parameter sets, picture size of every unit of an H.264 or H.265 stream."""
    out = []
    for unit in annexb(stream):
        if not unit:
            continue
        kind = unit[0] & 31 if codec == "h264" else unit[0] >> 1 & 63
        row = {"type": kind, "size": len(unit), "keyframe": kind == 5 if codec == "h264" else 16 <= kind <= 21}
        if (codec, kind) in (("h264", 7), ("h265", 33)):
            row |= {k: v for k, v in (h264_sps if codec == "h264" else h265_sps)(unit).items() if k in ("profile", "level", "width", "height")}
        out.append(row)
    return out


def vp9_frames(packet: bytes) -> list[bytes]:
    """The frames of a superframe; one frame for a packet without an index."""
    last = packet[-1] if packet else 0
    if last & 0xE0 == 0xC0:
        count, width = (last & 7) + 1, (last >> 3 & 3) + 1
        size = 2 + count * width
        if len(packet) >= size and packet[-size] == last:
            out, at = [], 0
            for i in range(count):
                n = int.from_bytes(packet[len(packet) - size + 1 + i * width :][:width], "little")
                out.append(packet[at : at + n])
                at += n
            return out
    return [packet]


def vp9_header(frame: bytes) -> dict:
    """Profile, kind and, of key frames, size of an uncompressed header."""
    b = Bits(frame)
    if b.u(2) != 2:
        raise ValueError("not a VP9 frame")
    profile = b.u(1) | b.u(1) << 1
    if profile == 3:
        b.u(1)
    if b.u(1):
        return {"profile": profile, "shown_again": b.u(3), "keyframe": False}
    key, shown, _ = not b.u(1), bool(b.u(1)), b.u(1)
    out = {"profile": profile, "keyframe": key, "shown": shown}
    if key:
        if b.u(24) != 0x498342:
            raise ValueError("no sync code")
        depth = (10 + 2 * b.u(1)) if profile >= 2 else 8
        space = b.u(3)
        if space != 7:
            b.u(1)
            if profile & 1:
                b.u(3)
        elif profile & 1:
            b.u(1)
        out |= {"depth": depth, "width": b.u(16) + 1, "height": b.u(16) + 1}
    return out


def _leb128(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(8):
        if at + i >= len(data):
            break
        value |= (data[at + i] & 0x7F) << (7 * i)
        if not data[at + i] & 0x80:
            return value, at + i + 1
    raise ValueError("a length is cut off")


def av1_units(data: bytes) -> list[dict]:
    """Type and body of every open bitstream unit; units without a size reach to the end."""
    out, at = [], 0
    while at < len(data):
        head = data[at]
        start = at + 1 + (head >> 2 & 1)
        n, start = _leb128(data, start) if head & 2 else (len(data) - start, start)
        out.append({"type": head >> 3 & 15, "body": data[start : start + n]})
        at = start + n
    return out


def av1_sequence(body: bytes) -> dict:
    """Profile, level and largest size of a sequence header (those without timing information, and still pictures)."""
    b = Bits(body)
    profile, still, reduced = b.u(3), b.u(1), b.u(1)
    if reduced:
        level = b.u(5)
    else:
        if b.u(1):
            raise ValueError("timing information is not read")
        delays = b.u(1)
        level = None
        for i in range(b.u(5) + 1):
            b.u(12)
            this = b.u(5)
            if this > 7:
                b.u(1)
            if delays and b.u(1):
                b.u(4)
            level = this if i == 0 else level
    wide, high = b.u(4) + 1, b.u(4) + 1
    return {"profile": profile, "still": bool(still), "level": level, "width": b.u(wide) + 1, "height": b.u(high) + 1}


VIDEO = "struct<codec:string,profile:int,level:int,chroma:int,depth:int,width:int,height:int,key:boolean,error:string>"


def _told(codec: str, data: bytes) -> dict:
    if codec in ("h264", "h265"):
        sps = next((u for u in units(data, codec) if "width" in u), None)
        if sps is None:
            raise ValueError("no sequence parameter set")
        return sps | {"key": any(u["keyframe"] for u in units(data, codec))}
    if codec == "vp9":
        return vp9_header(vp9_frames(data)[0])
    if codec == "av1":
        found = next((u for u in av1_units(data) if u["type"] == 1), None)
        if found is None:
            raise ValueError("no sequence header")
        return av1_sequence(found["body"])
    raise ValueError(f"no codec is named {codec}")


def video_headers(streams: DataFrame, codec: str = "codec", data: str = "data") -> DataFrame:
    """streams with ``video``: what the first header of each H.264, H.265, VP9 or AV1 stream tells; a broken one tells its error."""
    names = [x.split(":")[0] for x in VIDEO.removeprefix("struct<").removesuffix(">").split(",")]

    @F.pandas_udf(VIDEO)
    def told(codecs: pd.Series, raw: pd.Series) -> pd.DataFrame:
        rows = []
        for c, b in zip(codecs, raw, strict=True):
            try:
                rows.append({"codec": c} | {k: v for k, v in _told(c, bytes(b or b"")).items() if k in names})
            except Exception as e:  # noqa: BLE001  whatever a damaged stream leads to is told in its row
                rows.append({"codec": c, "error": f"{type(e).__name__}: {e}"})
        out = pd.DataFrame(rows, columns=names)
        out = out.astype(object).where(out.notna(), None)
        return out.astype({k: "Int32" for k in ("profile", "level", "chroma", "depth", "width", "height")} | {"key": "boolean"})

    return streams.withColumn("video", told(codec, data))


#: Bytes of a column's row.
COLUMN = 128


def detiled(plane: bytes, width: int, rows: int, column_height: int, first: int = 0) -> bytes:
    """A plane that lies in columns of COLUMN bytes, each of column_height rows, as rows of ``width`` bytes; first: the row in each column where it begins. What the plane does not hold is 0."""
    columns = -(-width // COLUMN)
    at = np.arange(columns)[None, :, None] * (COLUMN * column_height) + (first + np.arange(rows))[:, None, None] * COLUMN + np.arange(COLUMN)[None, None, :]
    held = np.frombuffer(plane, np.uint8)
    out = np.where(at < len(held), held[np.minimum(at, max(len(held) - 1, 0))] if len(held) else 0, 0)
    return out.reshape(rows, columns * COLUMN)[:, :width].astype(np.uint8).tobytes()


def detiled_nv12(luma: bytes, chroma: bytes, width: int, height: int, column_height: int, coded_height: int) -> tuple[bytes, bytes]:
    """Both planes of a picture; chroma lies behind the coded rows of luma in the same columns if both are one buffer, which equal lengths tell."""
    return detiled(luma, width, height, column_height), detiled(chroma, width, height // 2, column_height, coded_height if len(luma) == len(chroma) else 0)
