"""Base and quality strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET, MAX_PHRED = 33, 93


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(F.upper(seq)))


def phreds(qual: Column) -> Column:
    """array<int> of phred values; '*' and null are empty."""
    codes = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - OFFSET)
    return F.when(qual.isNull() | (qual == "*") | (qual == ""), F.array().cast("array<int>")).otherwise(codes)


def quality_sum(qual: Column, least: int = 15) -> Column:
    """Sum of the phred values of ``least`` or more; '*' gives 0."""
    return F.aggregate(F.filter(phreds(qual), lambda q: q >= least), F.lit(0), lambda a, q: a + q)


def quality_mean(qual: Column, first: Column, last: Column) -> Column:
    """Mean ASCII code of an inclusive 0-based stretch; 0 where it starts outside."""
    part = F.substring(qual, (first + 1).cast("int"), (last - first + 1).cast("int"))
    codes = F.transform(F.split(part, ""), lambda c: F.ascii(c))
    whole = F.aggregate(codes, F.lit(0), lambda a, q: a + q) / F.length(part)
    return F.when((first < 0) | (first >= F.length(qual)) | (last < first), F.lit(0.0)).otherwise(whole)


def bin_map(bounds: list[int], how: str = "low", custom: dict[int, int] | None = None) -> tuple[str, str]:
    """From and to characters for ``translate``: each phred value to its bin's.

    ``bounds`` starts the second and later bins (the first starts at 0, the last ends at 93). A bin's value is its low end, its
    high end, or their mean in ASCII; ``custom`` maps bin starts to values, and keeps values below its first start.
    """
    if custom:
        starts = sorted(custom)
        value = lambda q: custom[max(s for s in starts if s <= q)] if q >= starts[0] else q
    else:
        starts = [0, *bounds]
        if starts != sorted(set(starts)) or starts[-1] > MAX_PHRED:
            raise ValueError(f"bin bounds must rise within 1 and {MAX_PHRED}: {bounds}")
        ends = [s - 1 for s in starts[1:]] + [MAX_PHRED]

        def value(q: int) -> int:
            lo, hi = next((a, b) for a, b in zip(starts, ends, strict=True) if a <= q <= b)
            return {"low": lo, "high": hi, "mid": (lo + hi + 2 * OFFSET) // 2 - OFFSET}[how]

    every = range(MAX_PHRED + 1)
    return "".join(chr(q + OFFSET) for q in every), "".join(chr(value(q) + OFFSET) for q in every)


def bin_quality(qual: Column, bounds: list[int] = (), how: str = "low", custom: dict[int, int] | None = None) -> Column:
    """Binned qualities; '*' stays."""
    a, b = bin_map(list(bounds), how, custom)
    return F.when(qual == "*", qual).otherwise(F.translate(qual, a, b))


def trim(text: Column, left: Column, right: Column, fill: str) -> Column:
    """``left`` and ``right`` characters replaced by ``fill``; all of them where the text is shorter than both."""
    n = F.length(text)
    inner = F.concat(F.repeat(F.lit(fill), left), F.substring(text, left + 1, n - left - right), F.repeat(F.lit(fill), right))
    return F.when(text == "*", text).when(n < left + right, F.repeat(F.lit(fill), n)).otherwise(inner)


def use_equals(seq: Column, ref: Column, offsets: Column) -> Column:
    """Bases equal to the reference's at their offset become '='."""
    letters = F.split(seq, "")
    pick = lambda c, o: F.when(o.isNotNull() & (F.upper(c) == F.upper(F.substring(ref, o + 1, F.lit(1)))), "=").otherwise(c)
    return F.array_join(F.zip_with(letters, offsets, pick), "")


def use_bases(seq: Column, ref: Column, offsets: Column) -> Column:
    """'=' becomes the reference's base at its offset."""
    letters = F.split(seq, "")
    pick = lambda c, o: F.when((c == "=") & o.isNotNull(), F.substring(ref, o + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.zip_with(letters, offsets, pick), "")


def phred_of(mismatches: Column, total: Column) -> Column:
    """Empirical quality: -10 log10 of the add-one mismatch rate, rounded half up."""
    return F.floor(-10 * F.log10((mismatches + 1) / (total + 1)) + 0.5).cast("int")
