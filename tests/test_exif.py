"""The walker of camera notes on made files of both byte orders, truncated, hostile and cyclic ones."""

import struct

import pytest
from pyspark.sql import functions as F

from cairnmark.sources import exif as E


def tiff(order, main, camera=(), gps=(), loops=False):
    """A TIFF structure of directories of (tag, kind, count, raw bytes)."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    parts, at = [], 8
    lists = [list(main), list(camera), list(gps)]
    starts = []
    for entries, more in zip(lists, (bool(camera) + bool(gps), 0, 0), strict=True):
        starts.append(at)
        at += 2 + 12 * (len(entries) + more) + 4 + sum(len(r) for *_, r in entries if len(r) > 4)
    if camera:
        lists[0].append((E.EXIF_IFD, 4, 1, struct.pack(order + "I", starts[0] if loops else starts[1])))
    if gps:
        lists[0].append((E.GPS_IFD, 4, 1, struct.pack(order + "I", starts[2])))
    for start, entries in zip(starts, lists, strict=True):
        body, data, where = struct.pack(order + "H", len(entries)), b"", start + 2 + 12 * len(entries) + 4
        for tag, kind, count, raw in entries:
            body += struct.pack(order + "HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", where + len(data)))
            data += raw if len(raw) > 4 else b""
        parts.append(body + b"\0\0\0\0" + data)
    return mark + struct.pack(order + "I", 8) + b"".join(parts)


def notes(order):
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    rational = lambda tag, *v: (tag, 5, len(v), b"".join(struct.pack(order + "II", *x) for x in v))
    main = [(E.ORIENTATION, 3, 1, struct.pack(order + "H", 6)), text(E.DATE_TIME, "2024:05:06 07:08:09")]
    return tiff(order, main, [text(E.ORIGINAL, "2023:01:02 03:04:05")], [text(1, "s"), rational(2, (10, 1), (30, 1), (900, 100)), text(3, "E"), rational(4, (20, 1), (0, 1), (36, 10))])


WANT = ("2024:05:06 07:08:09", "2023:01:02 03:04:05", 6, pytest.approx(-(10 + 0.5 + 9 / 3600)), pytest.approx(20 + 3.6 / 3600))


def jpeg(body):
    other = b"\xff\xe0\x00\x06JFIF"
    return b"\xff\xd8" + other + b"\xff" + b"\xff\xe1" + struct.pack(">H", len(body) + 8) + b"Exif\0\0" + body + b"\xff\xda\0\0pixels"


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("wrap", [
    lambda t: t, jpeg, lambda t: b"\x89PNG\r\n\x1a\n" + b"\0\0\0\x02IHDRxx....." [:14] + struct.pack(">I", len(t)) + b"eXIf" + t + b"crc.",
    lambda t: b"RIFF....WEBP" + b"VP8X" + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(t)) + t,
])
def test_formats(order, wrap):
    assert E.notes_of(wrap(notes(order))) == WANT


@pytest.mark.parametrize("order", "<>")
def test_truncated_anywhere(order):
    whole = jpeg(notes(order))
    seen = {E.notes_of(whole[:n]) for n in range(len(whole) - 10)}
    assert (None,) * 5 in seen and all(len(x) == 5 for x in seen)


def test_cyclic_directories_and_hostile_counts():
    assert E.notes_of(tiff("<", [(E.DATE_TIME, 2, 2, b"x\0")], [(1, 3, 1, b"\1\0")], loops=True))[:2] == ("x", None)
    assert E.notes_of(b"II*\0\x08\0\0\0" + b"\xff\xff" + b"\x32\x01\x02\0\xff\xff\xff\xff\0\0\0\0" * 3) == (None,) * 5
    assert E.notes_of(b"II*\0\xff\xff\xff\xff") == (None,) * 5 and E.notes_of(b"\xff\xd8\xff\xe1\0\0") == (None,) * 5
    assert E.notes_of(tiff("<", [(E.ORIENTATION, 3, 1, b"\x09\0")], (), [(2, 5, 3, struct.pack("<6I", 1, 0, 1, 1, 1, 1)), (4, 5, 2, struct.pack("<4I", 1, 1, 1, 1))])) == (None,) * 5
    assert E.notes_of(tiff(">", [(E.ORIGINAL, 2, 5, b"orig\0"), (E.DATE_TIME, 2, 5, b"date\0")]))[0] == "orig"


def test_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(notes("<")))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    (tmp_path / "c.tif").write_bytes(notes(">"))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in E.read_exif(files).collect()}
    assert tuple(got["a.jpg"])[1:] == WANT == tuple(got["c.tif"])[1:] and tuple(got["b.jpg"])[1:] == (None,) * 5
    assert E.read_exif(spark.createDataFrame([("x", None)], "path string, content binary")).first().date is None


def test_sources_of_dates(spark):
    rows = [(1, "image", "2024:05:06 07:08:09", "IMG_20230102_101112.jpg", "c", "m"), (2, "video", "2024:05:06 07:08:09", "IMG_20230102_101112.mp4", "c", "m"), (3, "image", "bad", "x.jpg", "c", "m"), (4, "image", None, "x.jpg", None, "m"), (5, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, t string, d string, n string, c string, m string")
    got = {r.id: r.at for r in df.select("id", E.taken_at(*map(F.col, "tdncm")).alias("at")).collect()}
    assert got == {1: "2024-05-06T07:08:09Z", 2: "2023-01-02T10:11:12Z", 3: "c", 4: "m", 5: None}
