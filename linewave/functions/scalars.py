"""Scalar expressions: rounding, colours, formats, task states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """Nearest multiple of 10**-digits, ties to even; never a negative zero."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale + F.lit(0.0)


def clamp(x: Column, low, high) -> Column:
    """``x`` limited to low..high; null if ``x`` is null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb`` of three 0..255 values."""
    two = lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and whole seconds, truncated: ``1 ч 02 м 03 с``."""
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d ч %02d м %02d с", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)


def output_code(image: Column, text: Column) -> Column:
    """0 for both outputs, 1 for the image alone, 10 for the text alone, 11 for none."""
    return F.when(image, F.lit(0)).otherwise(F.lit(10)) + F.when(text, F.lit(0)).otherwise(F.lit(1))


def colours_selected(colour1: Column, colour2: Column) -> Column:
    """True where both colours are there and not empty."""
    return F.coalesce(colour1.isNotNull() & (F.size(colour1) > 0) & colour2.isNotNull() & (F.size(colour2) > 0), F.lit(False))


def task_status(has_image: Column, n_scales: Column, colours: Column) -> Column:
    """What a task still waits for."""
    return (
        F.when(~F.coalesce(has_image, F.lit(False)), F.lit("waiting image"))
        .when(F.coalesce(n_scales, F.lit(0)) == 0, F.lit("waiting scales"))
        .when(colours, F.lit("ready to compute"))
        .otherwise(F.lit("ready to configure"))
    )


def cropped_name(path: Column) -> Column:
    """Path of a cropped copy, in the same folder: ``_cropped`` before the extension, unless the name has it already.

    An extension follows the last dot of the name, leading dots left out; it is not searched for the word.
    """
    suffix = F.regexp_extract(path, r"[^/\\.][^/\\]*(\.[^./\\]*)$", 1)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(suffix))
    named = F.lower(F.regexp_extract(stem, r"([^/\\]*)$", 1)).contains("cropped")
    return F.when(named, path).otherwise(F.concat(stem, F.lit("_cropped"), suffix))


def is_image_name(path: Column) -> Column:
    """Whether a path ends like an image that is read, in upper or lower case."""
    return path.rlike(r"(?i)\.(png|jpe?g|bmp)$")


def scale_label(scale: Column, whole: bool) -> Column:
    """``3`` for scales of a range, ``3.0`` for scales of a file."""
    return scale.cast("long").cast("string") if whole else scale.cast("string")
