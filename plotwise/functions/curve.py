"""Grid and Hilbert-curve arithmetic as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER = 16
CELLS = 1 << ORDER
GRID = 256
_TINY = 2.2250738585072014e-308
#: Bits of either axis that one table look-up takes.
_STEP = 4


def quantize(v: Column, lo: Column | float, hi: Column | float) -> tuple[Column, Column]:
    """(cell, clamped): the nearest of 65 536 cells of [lo, hi], and whether the value lay outside; a non-finite one goes to cell 0, clamped."""
    scaled = (v - lo) / (F.lit(hi) - lo) * float(CELLS - 1)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    held = F.greatest(F.lit(0.0), F.least(F.lit(float(CELLS - 1)), scaled))
    return F.when(finite, F.floor(held + 0.5)).otherwise(F.lit(0)).cast("long"), ~finite | (scaled < 0) | (scaled > CELLS - 1)


@lru_cache
def _turns() -> tuple[list[int], list[int]]:
    """The curve as a machine of four states, _STEP bits of both axes at a time.

    A state says whether the quadrant's axes are swapped and whether they are reversed.  Forward: at state, x, y stands place * 4 + next state;
    back: at state, place stands (x, y) * 4 + next state."""
    side = 1 << _STEP
    forward, back = [0] * (4 * side * side), [0] * (4 * side * side)
    for state in range(4):
        for x in range(side):
            for y in range(side):
                swapped, reversed_, place = state & 1, state >> 1, 0
                for bit in range(_STEP - 1, -1, -1):
                    a, b = (x >> bit & 1) ^ reversed_, (y >> bit & 1) ^ reversed_
                    rx, ry = (b, a) if swapped else (a, b)
                    place = place << 2 | (3 * rx ^ ry)
                    if not ry:
                        swapped, reversed_ = swapped ^ 1, reversed_ ^ rx
                forward[(state * side + x) * side + y] = place << 2 | reversed_ << 1 | swapped
                back[state * side * side + place] = (x << _STEP | y) << 2 | reversed_ << 1 | swapped
    return forward, back


def _walk(table: list[int], digits: list[Column], scale: int) -> list[Column]:
    """The outputs of the machine, the highest digits first; plain array look-ups, so they stay within generated code."""
    cells, out, state = F.lit(table), [], F.lit(0)
    for digit in digits:
        found = F.get(cells, (state * scale + digit).cast("int"))
        out.append(F.shiftright(found, 2))
        state = found.bitwiseAND(F.lit(3))
    return out


def hilbert(x: Column, y: Column, order: int = ORDER) -> Column:
    """Place on the Hilbert curve of a cell; the order is a multiple of four."""
    side = 1 << _STEP
    digits = [F.shiftright(x, b).bitwiseAND(F.lit(side - 1)) * side + F.shiftright(y, b).bitwiseAND(F.lit(side - 1)) for b in range(order - _STEP, -1, -_STEP)]
    place = F.lit(0).cast("long")
    for part in _walk(_turns()[0], digits, side * side):
        place = place * (side * side) + part
    return place


def hilbert_cell(d: Column, order: int = ORDER) -> Column:
    """struct(x, y) of a place on the curve."""
    side = 1 << _STEP
    digits = [F.shiftright(d, 2 * b).bitwiseAND(F.lit(side * side - 1)) for b in range(order - _STEP, -1, -_STEP)]
    x = y = F.lit(0).cast("long")
    for part in _walk(_turns()[1], digits, side * side):
        x, y = x * side + F.shiftright(part, _STEP), y * side + part.bitwiseAND(F.lit(side - 1))
    return F.struct(x.alias("x"), y.alias("y"))


def grid_cell(v: Column, lo: Column | float, hi: Column | float, cells: int = GRID) -> Column:
    """Cell of a value on a grid axis, truncating; outside values go to the edge cells, and an axis without span has cell 0 only."""
    span = F.greatest(F.lit(hi) - lo, F.lit(_TINY))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(cells - 1)), (v - lo) / span * float(cells - 1))).cast("int")


def centroid(bbox: str = "bbox") -> tuple[Column, Column]:
    return (F.col(f"{bbox}.xmin") + F.col(f"{bbox}.xmax")) / 2, (F.col(f"{bbox}.ymin") + F.col(f"{bbox}.ymax")) / 2
