"""Dates, orientation and place from the first bytes of image files.

An image holds its camera's notes as a TIFF structure: a JPEG in a segment named
``Exif``, a PNG or WebP in a chunk, a TIFF as itself. A directory (IFD) is a
count of entries of twelve bytes: tag, type, count, and the value or where it
lies. Every offset is held against the bytes that there are, and a directory is
read once, so that truncated, hostile and cyclic files end like any other.
Files are read in Arrow batches, of each only its first ``HEAD`` bytes.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmark.functions.text import exif_timestamp, name_timestamp

HEAD = 1 << 18
#: Numbers of the tags that are read, and the sizes of the types.
ORIENTATION, DATE_TIME, ORIGINAL, EXIF_IFD, GPS_IFD = 0x0112, 0x0132, 0x9003, 0x8769, 0x8825
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_MOST = 1 << 16


def tiff_of(head: bytes) -> bytes | None:
    """The TIFF structure in the first bytes of a file, as far as they go."""
    if head[:4] in (b"II*\0", b"MM\0*"):
        return head
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(head) and head[at] == 0xFF:
            marker = head[at + 1]
            if marker == 0xFF:  # filling
                at += 1
                continue
            if marker == 0xD9 or marker == 0xDA:
                return None
            if marker == 0x01 or 0xD0 <= marker <= 0xD7:
                at += 2
                continue
            size = int.from_bytes(head[at + 2 : at + 4], "big")
            if size < 2:
                return None
            if marker == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
                return head[at + 10 : at + 2 + size]
            at += 2 + size
    elif head[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(head):
            size = int.from_bytes(head[at : at + 4], "big")
            if head[at + 4 : at + 8] == b"eXIf":
                return head[at + 8 : at + 8 + size]
            at += 12 + size
    elif head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(head):
            size = int.from_bytes(head[at + 4 : at + 8], "little")
            if head[at : at + 4] == b"EXIF":
                found = head[at + 8 : at + 8 + size]
                return found[6:] if found[:6] == b"Exif\0\0" else found
            at += 8 + size + size % 2
    return None


class Notes:
    """The directories of a TIFF structure; ``order`` is None where there is none."""

    def __init__(self, tiff: bytes):
        self.tiff = tiff
        self.order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
        self.seen: set[int] = set()
        if self.order and (len(tiff) < 8 or self._int(2, 2) != 42):
            self.order = None

    def _int(self, at: int, size: int) -> int:
        return int.from_bytes(self.tiff[at : at + size], "little" if self.order == "<" else "big")

    def first(self) -> dict[int, object]:
        return self.directory(self._int(4, 4)) if self.order else {}

    def directory(self, at: object) -> dict[int, object]:
        """Tag to value of the directory ``at``; what lies outside of the bytes is left out, and so is a directory that was read before."""
        if not isinstance(at, int) or not 8 <= at <= len(self.tiff) - 2 or at in self.seen:
            return {}
        self.seen.add(at)
        out: dict[int, object] = {}
        for k in range(min(self._int(at, 2), (len(self.tiff) - at - 2) // 12)):
            entry = at + 2 + 12 * k
            tag, kind, count = self._int(entry, 2), self._int(entry + 2, 2), self._int(entry + 4, 4)
            size = _SIZE.get(kind, 0) * count
            if not size or size > _MOST or tag in out:
                continue
            where = entry + 8 if size <= 4 else self._int(entry + 8, 4)
            if where + size <= len(self.tiff):
                out[tag] = self._value(kind, count, where)
        return out

    def _value(self, kind: int, count: int, where: int):
        raw = self.tiff[where : where + _SIZE[kind] * count]
        if kind == 2:
            return raw.rstrip(b"\0").decode("latin-1")
        if kind == 7:
            return raw
        if kind in (5, 10):
            parts = struct.unpack(f"{self.order}{2 * count}{'I' if kind == 5 else 'i'}", raw)
            values = tuple(a / b if b else math.nan for a, b in zip(parts[::2], parts[1::2], strict=True))
        else:
            values = struct.unpack(f"{self.order}{count}{_CODE[kind]}", raw)
        return values[0] if count == 1 else values


def _degrees(parts: object, ref: object, negative: str) -> float | None:
    if not isinstance(parts, tuple) or len(parts) < 3:
        return None
    found = parts[0] + parts[1] / 60 + parts[2] / 3600
    return None if not math.isfinite(found) else -found if isinstance(ref, str) and ref.upper() == negative else found


def notes_of(head: bytes | None) -> tuple[str | None, str | None, int | None, float | None, float | None]:
    """(date, original, orientation, lat, lon) as they stand; null where absent or unreadable.

    ``date`` is the original date of the first directory, else its date; ``original`` that of the camera's own directory.
    Latitude and longitude come together or not at all.
    """
    notes = Notes(tiff_of(head or b"") or b"")
    main = notes.first()
    camera, gps = notes.directory(main.get(EXIF_IFD)), notes.directory(main.get(GPS_IFD))
    text = lambda v: v if isinstance(v, str) and v else None
    turn = main.get(ORIENTATION)
    lat, lon = _degrees(gps.get(2), gps.get(1), "S"), _degrees(gps.get(4), gps.get(3), "W")
    if lat is None or lon is None:
        lat = lon = None
    return text(main.get(ORIGINAL)) or text(main.get(DATE_TIME)), text(camera.get(ORIGINAL)), turn if isinstance(turn, int) and 1 <= turn <= 8 else None, lat, lon


def read_exif(files: DataFrame) -> DataFrame:
    """(path, date, original, orientation, lat, lon) of ``files`` (path, content)."""

    def read(frames):
        for pdf in frames:
            rows = [notes_of(None if head is None else bytes(head)) for head in pdf["head"]]
            out = pd.DataFrame(rows, columns=["date", "original", "orientation", "lat", "lon"])
            yield out.assign(path=pdf["path"].to_numpy(), orientation=out["orientation"].astype("Int32"))[["path", "date", "original", "orientation", "lat", "lon"]]

    return files.select("path", F.substring("content", 1, HEAD).alias("head")).mapInPandas(read, "path string, date string, original string, orientation int, lat double, lon double")


def taken_at(media_type: Column, date: Column, name: Column, created: Column, modified: Column) -> Column:
    """When a file was taken: the camera's date (of images), else that in its name, else when it was created, else changed."""
    camera = F.when(media_type == "image", exif_timestamp(F.trim(date)))
    return F.coalesce(camera, name_timestamp(name), created, modified)
