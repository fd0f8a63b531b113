"""What the first bytes of an image say of it: size and orientation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first bytes of a PNG, the markers of a JPEG that carry nothing, those that look like a frame and aren't, and the EXIF tag of the orientation.
PNG = bytes.fromhex("89504E470D0A1A0A")
BARE, NO_FRAME, TAG = (0xD8, 0xD9, 0x01), (0xC4, 0xC8, 0xCC), 0x0112
#: The turn, clockwise, that an orientation asks for; mirrored ones have none.
TURNS = {1: 0, 3: 180, 6: 90, 8: 270}


def _u16(b: bytes, at: int, order: str = "big") -> int:
    return int.from_bytes(b[at : at + 2], order)


def _jpeg_size(b: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 3 < len(b):
        if b[at] != 0xFF or b[at + 1] == 0xFF:
            at += 1
        elif b[at + 1] in BARE:
            at += 2
        elif 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in NO_FRAME:
            return (_u16(b, at + 7), _u16(b, at + 5)) if at + 9 <= len(b) else None
        elif (n := _u16(b, at + 2)) < 2:
            return None
        else:
            at += 2 + n
    return None


def size_of(b: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG or a JPEG; None of anything else, of a broken one, and where one is 0."""
    if b is None:
        return None
    found = None
    if len(b) >= 24 and b[:8] == PNG and b[12:16] == b"IHDR":
        found = int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        found = found if min(found) > 0 else None
    if found is None and len(b) >= 4 and b[:2] == b"\xff\xd8":
        found = _jpeg_size(b)
    return found if found and min(found) > 0 else None


def orientation_of(b: bytes | None) -> int | None:
    """The EXIF orientation of a JPEG; None without one."""
    if b is None or len(b) < 4 or b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at < len(b) - 1 and b[at] == 0xFF:
        if b[at + 1] in (0xD8, 0xD9):
            at += 2
            continue
        if b[at + 1] == 0xDA or at + 4 > len(b):
            return None
        if b[at + 1] == 0xE1 and b[at + 4 : at + 8] == b"Exif":
            tiff = at + 10
            order = {b"II": "little", b"MM": "big"}.get(b[tiff : tiff + 2])
            if tiff + 8 > len(b) or order is None:
                return None
            first = tiff + int.from_bytes(b[tiff + 4 : tiff + 8], order)
            entries = range(_u16(b, first, order)) if first + 2 <= len(b) else ()
            for e in (first + 2 + 12 * i for i in entries):
                if e + 12 > len(b):
                    break
                if _u16(b, e, order) == TAG:
                    return _u16(b, e + 8, order)
            return None
        at += 2 + _u16(b, at + 2)
    return None


def dimensions(content: str) -> Column:
    """Struct (width, height) of a file's content, nulls if it is no image that says so; Python, as segments follow one another."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for each in it:
            yield pd.DataFrame([size_of(b) or (None, None) for b in each], columns=["width", "height"], dtype="Int64")

    return F.pandas_udf(run, "struct<width:long,height:long>")(content)


def exif_orientation(content: str) -> Column:
    """The EXIF orientation of a file's content, null without one."""
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in it:
            yield pd.Series([orientation_of(b) for b in each], dtype="Int64")

    return F.pandas_udf(run, "long")(content)


def turn(orientation: Column) -> Column:
    """The clockwise turn in degrees that an orientation asks for; null without one, or if it is mirrored."""
    out = F.lit(None).cast("long")
    for tag, degrees in TURNS.items():
        out = F.when(orientation == tag, degrees).otherwise(out)
    return out.cast("long")


def sharpened(centre: Column, up: Column, down: Column, left: Column, right: Column, amount: float) -> Column:
    """A value sharpened against its four neighbours, held to 0 to 255; amount 0 changes nothing, 100 sharpens fully."""
    t = amount / 100
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (1 + 4 * t) * centre - t * (up + down + left + right)))
