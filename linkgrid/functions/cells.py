"""Hierarchical cell ids as BIGINT column expressions.

The grid is equal-angle: at resolution ``r`` a cell spans ``180 / 2**(r + 5)`` degrees both
ways. Layout: bits 52-55 resolution, bits 26-51 latitude index, bits 0-25 longitude index,
bits 59-62 zero. A public H3 id keeps 1 in bits 59-62 and its resolution in the same place, so
``cell_resolution`` and ``cell_parent`` take both kinds. Everything here is JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESOLUTION = 5
REGION_RESOLUTION = 4
WIDE_RESOLUTION = 3

_INDEX_BITS = 26
_INDEX_MASK = (1 << _INDEX_BITS) - 1
_RES_SHIFT = 52
_MODE_SHIFT = 59
_H3_MODE = 1


def cell_step(res: int) -> float:
    """Edge of a cell in degrees."""
    return 180.0 / (1 << (res + 5))


def cell_of(lat: Column, lon: Column, res: int = RESOLUTION) -> Column:
    """Cell id of a point; NULL when a coordinate is NULL. Longitude wraps, latitude clamps."""
    rows, step = 1 << (res + 5), cell_step(res)
    row = F.floor((lat + 90.0) / step)
    row = F.least(F.greatest(row, F.lit(0).cast("bigint")), F.lit(rows - 1).cast("bigint"))
    col = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / step)
    col = F.least(col, F.lit(2 * rows - 1).cast("bigint"))
    point = F.lit(res << _RES_SHIFT).bitwiseOR(F.shiftleft(row, _INDEX_BITS)).bitwiseOR(col)
    return F.when(lat.isNotNull() & lon.isNotNull(), point)


def cell_resolution(cell: Column) -> Column:
    return F.shiftright(cell, _RES_SHIFT).bitwiseAND(F.lit(15)).cast("int")


def is_h3(cell: Column) -> Column:
    return F.shiftright(cell, _MODE_SHIFT).bitwiseAND(F.lit(15)) == _H3_MODE


def _row(cell: Column) -> Column:
    return F.shiftright(cell, _INDEX_BITS).bitwiseAND(F.lit(_INDEX_MASK))


def _col(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_INDEX_MASK))


def cell_parent(cell: Column, res: int) -> Column:
    """Ancestor at ``res``; the cell itself when it has that resolution; NULL when it is coarser."""
    depth = cell_resolution(cell) - res
    shift = F.greatest(depth, F.lit(0))
    own = (
        F.lit(res << _RES_SHIFT)
        .bitwiseOR(F.shiftleft(F.call_function("shiftright", _row(cell), shift), _INDEX_BITS))
        .bitwiseOR(F.call_function("shiftright", _col(cell), shift))
    )
    # An H3 parent changes the resolution field and sets the unused child digits to ones.
    unused = (1 << (3 * (15 - res))) - 1
    cleared = cell.bitwiseAND(F.lit(~(15 << _RES_SHIFT)))
    h3 = cleared.bitwiseOR(F.lit(res << _RES_SHIFT)).bitwiseOR(F.lit(unused))
    return (
        F.when(depth == 0, cell).when((depth > 0) & is_h3(cell), h3).when(depth > 0, own)
    )


def _centre(cell: Column, index: Column, origin: float) -> Column:
    """NULL for an H3 id: its centre comes from a table, see operators/centres.py."""
    step = F.lit(180.0) / F.pow(F.lit(2.0), cell_resolution(cell) + 5)
    return F.when(~is_h3(cell), F.lit(origin) + (index.cast("double") + 0.5) * step)


def cell_lat(cell: Column) -> Column:
    """Centre latitude of a cell of our own grid."""
    return _centre(cell, _row(cell), -90.0)


def cell_lon(cell: Column) -> Column:
    """Centre longitude of a cell of our own grid."""
    return _centre(cell, _col(cell), -180.0)


def ancestors(cell: Column, resolutions: tuple[int, ...] = (REGION_RESOLUTION, WIDE_RESOLUTION)) -> Column:
    """Array of the cell and its strictly coarser ancestors, for one-scan roll-ups."""
    parents = [
        F.when(cell_resolution(cell) > res, cell_parent(cell, res)) for res in resolutions
    ]
    return F.array_compact(F.array(cell, *parents))


def parse_cell(text: Column) -> Column:
    """Decimal or hex text to a cell id; NULL unless 0 < id < 2**63."""
    clean = F.lower(F.trim(text))
    digits = F.regexp_replace(clean, "^(0x)?0*", "")
    decimal = clean.rlike("^[+-]?[0-9]+$")
    as_decimal = F.when(decimal, clean.try_cast("bigint"))
    hexable = ~decimal & clean.rlike("^(0x)?[0-9a-f]+$") & (F.length(digits) <= 16)
    as_hex = F.when(hexable, F.conv(digits, 16, 10).try_cast("bigint"))
    value = F.coalesce(as_decimal, as_hex)
    return F.when(value > 0, value)
