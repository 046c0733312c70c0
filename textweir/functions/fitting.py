"""Fitting text into a box: wrapping, a cascade of ever stronger measures, truncation; a stand-in for font metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_width

# Fixed values.
MIN_SIZE, SPACINGS, TRACKING, MAX_OVERFLOW = 8.0, (1.10, 1.05, 1.0), (-0.002, -0.005), 0.15
FIRST_SPACING = 1.15
MAX_SIZE, PADDING, LEADING, SHRINK = 72.0, 0.85, 1.2, 0.9
_wide = re.compile("[一-鿿㐀-䶿　-〿぀-ヿ가-힯豈-﫿＀-｠]")
RESULT = "font_size double, line_spacing double, letter_spacing double, overflow boolean, truncated boolean, fitted string"


def width(text: str, size: float) -> float:
    wide = len(_wide.findall(text))
    return (wide + 0.5 * (len(text) - wide)) * size


def wrap(text: str, size: float, room: float) -> list[str]:
    """Lines by words; a word wider than the room is cut."""
    lines = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.split(" "):
            while width(word, size) > room and len(word) > 1:
                if line:
                    lines.append(line)
                    line = ""
                n = max(1, next((k for k in range(len(word), 0, -1) if width(word[:k], size) <= room), 1))
                lines.append(word[:n])
                word = word[n:]
            joined = f"{line} {word}" if line else word
            if line and width(joined, size) > room:
                lines.append(line)
                line = word
            else:
                line = joined
        lines.append(line)
    return lines


def height(text: str, size: float, spacing: float, room: float) -> float:
    return len(wrap(text, size, room)) * size * spacing


def truncate(text: str, size: float, spacing: float, room: float, tall: float) -> str:
    """The longest run of whole words that fits with an ellipsis behind it."""
    words = text.split(" ")
    low, high = 0, len(words)
    while low < high:
        mid = (low + high + 1) // 2
        if height(" ".join(words[:mid]) + "…", size, spacing, room) <= tall:
            low = mid
        else:
            high = mid - 1
    return " ".join(words[:low]).rstrip() + "…"


def fit(text: str, wide: float, tall: float, size: float, below: float) -> tuple[float, float, float, bool, bool, str]:
    """Smaller type, tighter lines, tighter letters, some overflow into white space, truncation: the first that is enough."""
    start = max(size, MIN_SIZE)
    if height(text, start, FIRST_SPACING, wide) <= tall:
        return start, FIRST_SPACING, 0.0, False, False, text
    low, high = MIN_SIZE, start
    while high - low >= 0.5:
        mid = (low + high) / 2
        low, high = (mid, high) if height(text, mid, FIRST_SPACING, wide) <= tall else (low, mid)
    if height(text, low, FIRST_SPACING, wide) <= tall:
        return low, FIRST_SPACING, 0.0, False, False, text
    for spacing in SPACINGS:
        if height(text, MIN_SIZE, spacing, wide) <= tall:
            return MIN_SIZE, spacing, 0.0, False, False, text
    for track in TRACKING:
        if height(text, MIN_SIZE, 1.0, wide - track * MIN_SIZE * len(text)) <= tall:
            return MIN_SIZE, 1.0, track, False, False, text
    if below > 0 and height(text, MIN_SIZE, 1.0, wide) <= tall + min(tall * MAX_OVERFLOW, below):
        return MIN_SIZE, 1.0, TRACKING[-1], True, False, text
    return MIN_SIZE, 1.0, TRACKING[-1], False, True, truncate(text, MIN_SIZE, 1.0, wide, tall)


def starting_size(tall: Column, lines: Column) -> Column:
    """The type size that so many lines leave room for in a box, within bounds."""
    return F.greatest(F.lit(MIN_SIZE), F.least(F.lit(MAX_SIZE), tall / lines * PADDING / LEADING))


def shrink(text: str, wide: float, tall: float, size: float) -> tuple[float, bool]:
    """(size, fits): type made smaller by a tenth until unwrapped lines fit, the least size at last."""
    lines = text.split("\n")
    while size >= MIN_SIZE:
        if max(width(x, size) for x in lines) <= wide and size * LEADING * len(lines) <= tall:
            return size, True
        size *= SHRINK
    return max(size, MIN_SIZE), False


def shrink_fit(text: Column, wide: Column, tall: Column, start: Column) -> Column:
    """As ``shrink``, in closed form: the first power of the factor at which both the widest line and all lines fit; a struct (size, fits)."""
    lines = F.split(text, "\n")
    unit = F.array_max(F.transform(lines, lambda x: text_width(x, 1.0)))
    most = F.least(F.when(unit > 0, wide / unit).otherwise(F.lit(float("inf"))), tall / (F.size(lines) * LEADING))
    step = lambda k: start * F.pow(F.lit(SHRINK), k)
    k = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.lit(61), lambda a, i: F.when((a > 60) & ((step(i) <= most) | (step(i) < MIN_SIZE)), i).otherwise(a))
    size = step(k)
    return F.struct(F.greatest(size, F.lit(MIN_SIZE)).alias("size"), ((size >= MIN_SIZE) & (size <= most)).alias("fits"))


def _fit_batch(text: pd.Series, wide: pd.Series, tall: pd.Series, size: pd.Series, below: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fit(t or "", w, h, s, b) for t, w, h, s, b in zip(text, wide, tall, size, below)], columns=[c.split()[0] for c in RESULT.split(", ")])


def fit_cascade(text: str, wide: str, tall: str, size: str, below: str) -> Column:
    """The fit of each row as a struct, in Arrow batches."""
    return F.pandas_udf(_fit_batch, RESULT)(text, wide, tall, size, below)
