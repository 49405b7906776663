"""Alignment flag bits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public SAM specification.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, FIRST, LAST = 0x10, 0x20, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800

#: Bit and label, in bit order; the fragment bits are labelled apart.
LABELS = ((PAIRED, "paired"), (PROPER, "properly paired"), (UNMAPPED, "unmapped"), (MATE_UNMAPPED, "mate unmapped"), (REVERSE, "reverse strand"), (MATE_REVERSE, "mate reverse strand"))
LATE_LABELS = ((SECONDARY, "secondary"), (QC_FAIL, "QC fail"), (DUPLICATE, "duplicate"), (SUPPLEMENTARY, "supplementary"))


def has(flag: Column, bits: int) -> Column:
    """Any of ``bits`` is set."""
    return flag.bitwiseAND(F.lit(bits)) != 0


def has_all(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) == bits


def with_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseOR(F.lit(bits))


def without_bits(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(~bits))


def passes(flag: Column, required: int = 0, excluded: int = 0) -> Column:
    """All required bits are set and no excluded one."""
    return has_all(flag, required) & ~has(flag, excluded)


def fragment(flag: Column) -> Column:
    """0 unknown, 64 first, 128 last, 192 middle."""
    return flag.bitwiseAND(F.lit(FIRST | LAST))


def explain(flag: Column) -> Column:
    """The flag's labels as an array; a paired read also has its place in the fragment."""
    place = F.when(fragment(flag) == FIRST, "first fragment").when(fragment(flag) == LAST, "last fragment").when(fragment(flag) == FIRST | LAST, "middle fragment").otherwise("unknown fragment")
    early = [F.when(has(flag, b), label) for b, label in LABELS]
    late = [F.when(has(flag, b), label) for b, label in LATE_LABELS]
    return F.array_compact(F.array(*early, F.when(has(flag, PAIRED), place), *late))


def parse(text: str) -> int:
    """A flag in decimal, or in hex after 0x or 0X."""
    value = int(text, 16) if text[:2].lower() == "0x" else int(text)
    if not 0 <= value <= 0xFFFF:
        raise ValueError(f"flag {text} is not within 0 and 65535")
    return value
