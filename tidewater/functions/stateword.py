"""The 32-bit state word of a page as expressions: three flags and a count of readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the word: valid, busy, dirty, and the bits of the count.
VALID = 0x80000000
BUSY = 0x40000000
DIRTY = 0x20000000
COUNT = 0x1FFFFFFF
# The names of the upper two bits, by their number.
SUBSTATES = ("NV_NB", "NV_B", "V_NB", "V_B")


def pack(valid: Column, busy: Column, dirty: Column, readers: Column) -> Column:
    """The word as BIGINT; a reader count beyond its bits is cut to them."""
    flags = [F.when(c, F.lit(bit)).otherwise(F.lit(0)).cast("bigint") for c, bit in ((valid, VALID), (busy, BUSY), (dirty, DIRTY))]
    return readers.cast("bigint").bitwiseAND(F.lit(COUNT)).bitwiseOR(flags[0]).bitwiseOR(flags[1]).bitwiseOR(flags[2])


def readers(word: Column) -> Column:
    return word.bitwiseAND(F.lit(COUNT))


def substate(word: Column) -> Column:
    """The name of the upper two bits."""
    return F.element_at(F.array(*map(F.lit, SUBSTATES)), (F.shiftright(word, 30).bitwiseAND(F.lit(3)) + 1).cast("int"))


def loaded(word: Column) -> Column:
    """A busy word without data becomes valid: both flags change at once."""
    return word.bitwiseXOR(F.lit(VALID | BUSY))


def not_busy(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0xFFFFFFFF ^ BUSY))
