"""Paths, dates, sizes and places as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scheme(path: Column) -> Column:
    return F.regexp_extract(path, "^([a-z]+):", 1)


def normal_prefix(path: Column) -> Column:
    """Without scheme, with forward slashes, without slashes at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^(local|disk):", ""), "/+$", "")


def human_bytes(n: Column) -> Column:
    """Units of 1024 with one decimal, ties to even; a dash for null."""
    out = F.format_string("%.1f GB", F.bround(n / F.lit(1024.0**3), 1))
    out = F.when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / F.lit(1024.0**2), 1))).otherwise(out)
    out = F.when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / F.lit(1024.0), 1))).otherwise(out)
    return F.when(n.isNull(), "-").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


def human_duration(sec: Column) -> Column:
    hours, minutes, rest = F.floor(sec / 3600), F.floor(sec % 3600 / 60), sec % 60
    return F.concat(hours.cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"), F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))


def name_timestamp(name: Column) -> Column:
    """ISO time from a file name: yyyymmdd_hhmmss, yyyy-mm-dd hh.mm.ss or a date alone, after a camera's prefix."""
    bare = F.regexp_replace(name, "^(IMG|VID|WA|PANO)[-_]?", "")
    full = r"^(\d{4})[-_]?(\d{2})[-_]?(\d{2})[-_ T](\d{2})[-_.:]?(\d{2})[-_.:]?(\d{2})"
    day = r"^(\d{4})[-_]?(\d{2})[-_]?(\d{2})"
    part = lambda p, i: F.regexp_extract(bare, p, i)
    date = lambda p: F.concat_ws("-", part(p, 1), part(p, 2), part(p, 3))
    return F.when(bare.rlike(full), F.concat(date(full), F.lit("T"), F.concat_ws(":", part(full, 4), part(full, 5), part(full, 6)), F.lit("Z"))).when(bare.rlike(day), F.concat(date(day), F.lit("T00:00:00Z")))


def exif_timestamp(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}"), F.concat(F.regexp_replace(F.substring(text, 1, 10), ":", "-"), F.lit("T"), F.substring(text, 12, 8), F.lit("Z")))


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    return F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1) * (d + m / 60.0 + s / 3600.0)


def place_key(lat: Column, lon: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f,%.{digits}f", lat, lon)


def repaired_date(text: Column) -> Column:
    """Date of ``d.m.yyyy`` with a lost point or a space for one."""
    fixed = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", "."), r"^(\d{1,2})\.(\d{2})(\d{4})$", "$1.$2.$3")
    return F.try_to_timestamp(fixed, F.lit("d.M.yyyy")).cast("date")


def safe_segment(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}\-_. ]", "_"))


def sample_times(duration: Column) -> Column:
    """Times at 5, 50 and 95 per cent of a video, kept within it and apart by 0.05 s."""
    end = F.greatest(duration - 0.05, F.lit(0.0))
    times = F.array(*[F.round(F.least(F.greatest(duration * p, F.lit(0.0)), end), 3) for p in (0.05, 0.5, 0.95)])
    return F.aggregate(times, F.array().cast("array<double>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) > 0.05), F.array_append(acc, t)).otherwise(acc))


def unrotated(x: Column, y: Column, w: Column, h: Column, turn: Column, width: Column, height: Column) -> Column:
    """A box found in an image turned clockwise by ``turn`` degrees, in the original image of the given size."""
    box = lambda *v: F.struct(*[e.cast("long").alias(k) for e, k in zip(v, "xywh", strict=True)])
    return F.when(turn == 90, box(y, height - x - w, h, w)).when(turn == 180, box(width - x - w, height - y - h, w, h)).when(turn == 270, box(width - y - h, x, h, w)).otherwise(box(x, y, w, h))


def rotated(x: Column, y: Column, w: Column, h: Column, turn: Column, width: Column, height: Column) -> Column:
    """A box of an image of the given size after the image is turned clockwise by ``turn`` degrees."""
    box = lambda *v: F.struct(*[e.cast("long").alias(k) for e, k in zip(v, "xywh", strict=True)])
    return F.when(turn == 90, box(height - y - h, x, h, w)).when(turn == 180, box(width - x - w, height - y - h, w, h)).when(turn == 270, box(y, width - x - w, h, w)).otherwise(box(x, y, w, h))


def last_counter(log: Column, name: str) -> Column:
    """The number of the last ``name=number`` in a log; null without one."""
    return F.try_element_at(F.regexp_extract_all(log, F.lit(f"{name}=([0-9]+)"), 1), F.lit(-1)).cast("long")


def tail(log: Column, most: int) -> Column:
    return F.right(log, F.lit(most))


def bucket(path: Column, depth: int = 3) -> Column:
    """The first ``depth`` segments of a path."""
    return F.substring_index(path, "/", depth)


def in_hidden_folder(path: Column) -> Column:
    """The folder that holds the file begins with an underscore."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)).startswith("_"), F.lit(False))


def to_json_array(vector: Column) -> Column:
    """A vector as JSON text."""
    return F.to_json(vector)


def vector_of_json(text: Column) -> Column:
    """The numbers of a JSON array; null for other texts, for empty arrays and where a number is missing or none."""
    found = F.from_json(text, "array<double>")
    sound = (F.size(found) > 0) & ~F.exists(found, lambda x: x.isNull() | F.isnan(x))
    return F.when(sound, found)


def scaled_back(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box (x, y, w, h) found at ``scale``, in the whole image and cut at its edges; null where nothing over a pixel wide and high is left.

    Halves are rounded to the even pixel. A scale of 1, or that is no scale, leaves the box as it is.
    """
    at = [F.greatest(F.lit(0), F.rint(v / scale).cast("long")) for v in (x, y, w, h)]
    wide, high = F.least(at[2], F.greatest(F.lit(0), width - at[0])), F.least(at[3], F.greatest(F.lit(0), height - at[1]))
    inside = (at[0] < width) & (at[1] < height) & (wide > 1) & (high > 1)
    same = (scale == 1) | (scale <= 0)
    box = lambda a, b, c, d: F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"), c.cast("long").alias("w"), d.cast("long").alias("h"))
    return F.when(same, box(x, y, w, h)).when(inside, box(at[0], at[1], wide, high))
