"""Map tiles as interleaved grid keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tile keys of 2 * 24 bits stay exact in any number type of 53 bits.
MAX_ZOOM = 24


def check_zoom(zoom: int) -> None:
    if not 0 <= zoom <= MAX_ZOOM:
        raise ValueError(f"zoom must lie between 0 and {MAX_ZOOM}")


def grid_cell(degrees: Column, lowest: float, span: float, zoom: int) -> Column:
    """The cell of a coordinate among 2^zoom equal ones; the upper edge belongs to the last cell.
    Null outside of the map."""
    cells = 1 << zoom
    cell = F.floor((degrees - F.lit(lowest)) / F.lit(span) * F.lit(float(cells)))
    inside = degrees.between(lowest, lowest + span)
    return F.when(inside, F.least(cell, F.lit(cells - 1)).cast("long"))


def interleaved(x: Column, y: Column, zoom: int) -> Column:
    """One number with the bits of `x` on even and those of `y` on odd places, so that the parent
    of a tile is its key shifted by two bits."""
    key = F.lit(0).cast("long")
    for bit in range(zoom):
        for cell, place in ((x, 2 * bit), (y, 2 * bit + 1)):
            key = key + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(1).cast("long"), place)
    return key


def tile_key(lat: Column, long: Column, zoom: int) -> Column:
    """The tile of a place at `zoom`, from 4^zoom tiles of equal degrees; null off the map."""
    check_zoom(zoom)
    return interleaved(grid_cell(long, -180.0, 360.0, zoom), grid_cell(lat, -90.0, 180.0, zoom), zoom)
