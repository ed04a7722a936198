"""Column expressions over the bits of H3 indexes, held as longs.

An index is, from the top: a zero bit, 4 bits of mode (1: cell, 2: directed edge), 3 reserved bits (an
edge's direction), 4 bits of resolution, 7 bits of base cell, and 15 digits of 3 bits, 7 where unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODE_CELL, MODE_EDGE = 1, 2
#: Base cells that are pentagons.  They have no children in direction 1.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
STEP = 6
#: The bits of all digits.
_DIGITS = (1 << 45) - 1


def _field(c: Column, shift: int, mask: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(F.lit(mask)).cast("int")


def mode(c: Column) -> Column:
    return _field(c, 59, 15)


def resolution(c: Column) -> Column:
    return _field(c, 52, 15)


def base_cell(c: Column) -> Column:
    return _field(c, 45, 127)


def edge_direction(c: Column) -> Column:
    return _field(c, 56, 7)


def digit(c: Column, res: int) -> Column:
    """The digit of a resolution from 1 to 15."""
    return _field(c, 3 * (15 - res), 7)


def parent(c: Column, res: int) -> Column:
    """The ancestor at a coarser or equal resolution; null where the cell is coarser already."""
    low = (1 << 3 * (15 - res)) - 1
    up = c.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(res << 52 | low))
    return F.when(resolution(c) >= res, up)


def _right(c: Column, n: Column) -> Column:
    return F.call_function("shiftright", c, n)


def _unused(c: Column) -> Column:
    """The mask of the digits that a cell's resolution leaves."""
    return _right(F.lit(_DIGITS), 3 * resolution(c))


def is_pentagon(c: Column) -> Column:
    return base_cell(c).isin(*PENTAGONS) & (c.bitwiseAND(F.lit(_DIGITS)) == _unused(c))


def is_cell(c: Column) -> Column:
    """A valid cell: mode, reserved bits, base cell, used digits below 7 and unused ones 7, no deleted subtree."""
    used = _right(c.bitwiseAND(F.lit(_DIGITS)), 45 - 3 * resolution(c))
    # a digit is 7 where its three bits meet
    seven = used.bitwiseAND(F.shiftright(used, 1)).bitwiseAND(F.shiftright(used, 2)).bitwiseAND(F.lit(_DIGITS // 7))
    # the first digit that isn't 0 is 1 where the highest bit is the lowest of its three; a pentagon has no such subtree
    deleted = base_cell(c).isin(*PENTAGONS) & (used != 0) & ((F.length(F.bin(used)) - 1) % 3 == 0)
    head = (c > 0) & (mode(c) == MODE_CELL) & (edge_direction(c) == 0) & (base_cell(c) < 122)
    return head & (c.bitwiseAND(_unused(c)) == _unused(c)) & (seven == 0) & ~deleted


def edge_origin(e: Column) -> Column:
    """The cell that a directed edge starts in."""
    return e.bitwiseAND(F.lit(~(15 << 59 | 7 << 56))).bitwiseOR(F.lit(MODE_CELL << 59))


def _children(df: DataFrame, cell: str, res: int, out: str) -> DataFrame:
    c = F.col(cell)
    depth = F.lit(res) - resolution(c)
    df = df.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.round(F.pow(F.lit(7.0), depth)).cast("long") - 1)))
    # the number's digits to base 7, read as digits to base 8, are three bits each
    packed = F.conv(F.conv(F.col("__k").cast("string"), 10, 7), 8, 10).cast("long")
    shift = 3 * (15 - res)
    head = c.bitwiseAND(F.bitwise_not(_unused(c))).bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(res << 52 | (1 << shift) - 1))
    df = df.withColumn(out, head.bitwiseOR(F.shiftleft(packed, shift))).drop("__k")
    return df.where(is_cell(F.col(out)))


def children(df: DataFrame, cell: str, res: int, out: str = "child") -> DataFrame:
    """A row for each descendant at a finer or equal resolution, in a column beside the others.

    Cells that are finer already have no row.  More than STEP resolutions are taken in steps, so that no
    row makes more than 7 ** STEP at once.
    """
    depth = F.lit(res) - resolution(F.col(cell))
    near = _children(df.where((depth >= 0) & (depth <= STEP)), cell, res, out)
    if res <= STEP:
        return near
    midway = children(df.where(depth > STEP), cell, res - STEP, "__midway")
    return near.unionByName(_children(midway, "__midway", res, out).drop("__midway"))


def to_resolution(df: DataFrame, cell: str, res: int) -> DataFrame:
    """Cells of any resolution as cells of one: kept, replaced with the ancestor or with all descendants.

    Repeated cells stay repeated; rows whose cell isn't valid go.
    """
    valid = df.where(is_cell(F.col(cell)))
    up = valid.where(resolution(F.col(cell)) >= res).withColumn(cell, parent(F.col(cell), res))
    down = children(valid.where(resolution(F.col(cell)) < res), cell, res, "__child").withColumn(cell, F.col("__child")).drop("__child")
    return up.unionByName(down)


def distinct_at(df: DataFrame, cell: str, res: int) -> DataFrame:
    """The distinct cells of to_resolution, as one column."""
    return to_resolution(df.select(cell), cell, res).distinct()
