"""String functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(s: Column, chars: str | None = None, side: str = "both") -> Column:
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side](s, F.lit(chars or " "))


def pad(s: Column, width: int, side: str = "left", fill: str = " ") -> Column:
    """Pads to a width and never cuts; with both sides the left gets the smaller half."""
    if side == "left":
        out = F.lpad(s, width, fill)
    elif side == "right":
        out = F.rpad(s, width, fill)
    else:
        out = F.rpad(F.lpad(s, width - F.ceil((width - F.length(s)) / 2).cast("int"), F.lit(fill)), width, fill)
    return F.when(F.length(s) >= width, s).otherwise(out)


def contains(s: Column, pattern: str, case: bool = True) -> Column:
    return F.contains(s, F.lit(pattern)) if case else F.contains(F.lower(s), F.lit(pattern.lower()))


def cut(s: Column, start: int | None = None, stop: int | None = None) -> Column:
    """Characters from a zero-based start up to stop."""
    start = start or 0
    if start < 0 or (stop is not None and stop < 0):
        raise ValueError("positions count from the left")
    return F.substring(s, F.lit(start + 1), F.lit(max(0, stop - start)) if stop is not None else F.length(s))


def replace(s: Column, pattern: str, replacement: str) -> Column:
    return F.replace(s, F.lit(pattern), F.lit(replacement))


def concat(*parts: Column) -> Column:
    """Null if any part is."""
    return F.concat(*[p.cast("string") for p in parts])
