"""Boxes and regions, said once for columns (COLUMNS) and for plain numbers in a worker (NUMBERS). A box has ``x, y, width,
height``, a detection ``cx, cy, w, h``."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import functions as F

MIN_SIDE = 16


class Arithmetic(NamedTuple):
    least: Callable
    greatest: Callable
    #: Cut to an integer, negative values to 0.
    whole: Callable
    number: Callable


COLUMNS = Arithmetic(F.least, F.greatest, lambda c: F.greatest(F.lit(0), c.cast("long")), F.lit)
NUMBERS = Arithmetic(min, max, lambda v: max(0, int(v)), lambda v: v)


def eye_sides(box: Any, w: Any, h: Any, by: Arithmetic) -> tuple:
    """``x, y, width, height`` of the upper 40 % of the face box without a tenth at each side, in the image; it counts from
    MIN_SIDE pixels a side on."""
    none, least = by.number(0), by.number(MIN_SIDE)
    left, top = by.least(by.greatest(box["x"], by.number(0.0)), w), by.least(by.greatest(box["y"], by.number(0.0)), h)
    wide, high = by.least(box["width"], w - left), by.least(box["height"], h - top)
    x, y = by.whole(left + wide * 0.1), by.whole(top)
    across = by.least(by.greatest(by.whole(wide * 0.8), least), by.greatest(by.whole(w) - x, none))
    down = by.least(by.greatest(by.whole(high * 0.4), least), by.greatest(by.whole(h) - y, none))
    return x, y, across, down


def crop_sides(box: Any, w: Any, h: Any, by: Arithmetic) -> tuple:
    """The face box with a quarter more at each side, in the image, at least one pixel."""
    dx, dy, none, one = box["width"] * 0.25, box["height"] * 0.25, by.number(0.0), by.number(1)
    x1, y1 = by.whole(by.greatest(box["x"] - dx, none)), by.whole(by.greatest(box["y"] - dy, none))
    x2, y2 = by.whole(by.least(box["x"] + box["width"] + dx, w)), by.whole(by.least(box["y"] + box["height"] + dy, h))
    return x1, y1, by.greatest(x2 - x1, one), by.greatest(y2 - y1, one)


def original_sides(d: Any, t: Any, by: Arithmetic) -> tuple:
    """A detection's box in the original image; ``t``: scale, pad_x, pad_y, orig_width, orig_height."""
    low = lambda c, s, pad: by.greatest(by.number(0.0), (d[c] - t[pad]) / t["scale"] - d[s] / t["scale"] / 2)
    high = lambda c, s, pad, most: by.least(t[most], (d[c] - t[pad]) / t["scale"] + d[s] / t["scale"] / 2)
    x, y = low("cx", "w", "pad_x"), low("cy", "h", "pad_y")
    return x, y, high("cx", "w", "pad_x", "orig_width") - x, high("cy", "h", "pad_y", "orig_height") - y
