"""Hash functions on vertex ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Fixed values: (sign of the added term, constant, shift) of the six mixing
# steps, and the seeds of the colouring rounds.
MIX = (
    ("+", 0x7ED55D16, "<<", 12),
    ("^", 0xC761C23C, ">>", 19),
    ("+", 0x165667B1, "<<", 5),
    ("^", 0xD3A2646C, "<<", 9),
    ("+", 0xFD7046C5, "<<", 3),
    ("^", 0xB55A4F09, ">>", 16),
)
SEED = 1012
SEED_STEP = 1043


def mix32_py(value: int, seed: int) -> int:
    """The 32-bit mix for a Python int (used for the seeds and in tests)."""
    a = (value ^ seed) & MASK
    for op, const, way, by in MIX:
        left = (a + const) if op == "+" else (a ^ const)
        a = (left + ((a << by) if way == "<<" else (a >> by))) & MASK
    return a


def mix32(value: Column, seed: int) -> Column:
    """The same mix on the low 32 bits of a bigint column."""
    a = value.cast("bigint").bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(seed & MASK).cast("bigint"))
    for op, const, way, by in MIX:
        c = F.lit(const).cast("bigint")
        left = (a + c) if op == "+" else a.bitwiseXOR(c)
        moved = F.shiftleft(a, by) if way == "<<" else F.shiftright(a, by)
        a = (left + moved).bitwiseAND(F.lit(MASK).cast("bigint"))
    return a


def mix32_sql(value: str, seed: int) -> str:
    """The same mix as a SQL expression."""
    a = f"xor(({value})::BIGINT & {MASK}, {seed & MASK}::BIGINT)"
    for op, const, way, by in MIX:
        left = f"({a} + {const})" if op == "+" else f"xor({a}, {const}::BIGINT)"
        a = f"(({left} + ({a} {way} {by})) & {MASK})"
    return a


def uniform(seed: int, *cols: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A value in [low, high) that depends only on the seed and the columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    unit = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
    return F.lit(low) + unit * F.lit(high - low)
