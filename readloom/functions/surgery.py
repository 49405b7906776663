"""Cigar changes in plain Python, for the Arrow functions; nothing here holds a Spark object, so it travels to executors."""

from __future__ import annotations

import re

#: Operations that use up reference and query bases.
REF_OPS, QUERY_OPS, MATCH_OPS = "MDN=X", "MIS=X", "M=X"
ALL_OPS = "MIDNSHP=X"
PATTERN = "([0-9]+)([MIDNSHP=X])"


def parse(cigar: str | None) -> list[tuple[int, str]]:
    return [(int(n), o) for n, o in re.findall(PATTERN, cigar or "")]


def text(parts: list[tuple[int, str]]) -> str:
    """Neighbouring equal operations join, empty ones go; nothing left is '*'."""
    out: list[list] = []
    for n, o in parts:
        if n <= 0:
            continue
        if out and out[-1][1] == o:
            out[-1][0] += n
        else:
            out.append([n, o])
    return "".join(f"{n}{o}" for n, o in out) or "*"


def _clip_front(parts: list[tuple[int, str]], bases: int) -> tuple[list[tuple[int, str]], int]:
    """Soft-clip so that ``bases`` query bases (those already soft-clipped included) are clipped; and the reference bases passed.

    Insertions, deletions, skips and pads that the new clip touches go with it.
    """
    hard = [p for p in parts[:1] if p[1] == "H"]
    rest, done, moved, i = parts[len(hard) :], 0, 0, 0
    rest = [list(p) for p in rest]
    while i < len(rest):
        n, o = rest[i]
        if done >= bases and (o in MATCH_OPS or o in "SH"):
            break
        if o == "H":
            break
        if o in MATCH_OPS:
            take = min(n, bases - done)
            done, moved = done + take, moved + take
            rest[i][0] -= take
            if rest[i][0]:
                break
        elif o in "IS":
            done += n
        elif o in "DN":
            moved += n
        i += 1
    return [*hard, (done, "S"), *[(n, o) for n, o in rest[i:]]], moved


def whole_clip(parts: list[tuple[int, str]]) -> str:
    """All query bases soft-clipped; hard clips stay."""
    n = sum(k for k, o in parts if o in QUERY_OPS)
    lead, trail = (parts[:1] if parts and parts[0][1] == "H" else []), (parts[-1:] if len(parts) > 1 and parts[-1][1] == "H" else [])
    return text([*lead, (n, "S"), *trail])


def soft_clip(cigar: str, pos0: int, front: int, back: int) -> tuple[str, int]:
    """New cigar and position after clipping ``front`` and ``back`` query bases; nothing aligned left clips all where it is."""
    parts, given = parse(cigar), (parse(cigar), pos0)
    if front > 0:
        have = next((n for n, o in parts if o != "H"), 0) if parts and next((o for n, o in parts if o != "H"), "") == "S" else 0
        if front > have:
            parts, moved = _clip_front(parts, front)
            pos0 += moved
    if back > 0:
        turned = parts[::-1]
        have = next((n for n, o in turned if o != "H"), 0) if turned and next((o for n, o in turned if o != "H"), "") == "S" else 0
        if back > have:
            turned, _ = _clip_front(turned, back)
            parts = turned[::-1]
    if not any(o in MATCH_OPS and n > 0 for n, o in parts):
        return whole_clip(given[0]), given[1]
    return text(parts), pos0


def left_shift(cigar: str, seq: str) -> str:
    """Move each insertion or deletion between two matches left as far as the bases before it repeat its unit."""
    parts = [list(p) for p in parse(cigar)]
    for i in range(1, len(parts) - 1):
        n, o = parts[i]
        if o not in "ID" or parts[i - 1][1] not in MATCH_OPS or parts[i + 1][1] not in MATCH_OPS:
            continue
        at = sum(m for m, p in parts[:i] if p in QUERY_OPS)
        room, shift = parts[i - 1][0], 0
        # An insertion's unit is in the read; a deletion's must be the bases before it, as the read has them after it.
        while shift < room - 1:
            a = at - shift - 1
            b = a + n if o == "I" else a + n
            if b >= len(seq) or a < 0 or seq[a].upper() != seq[b].upper() or seq[a].upper() == "N":
                break
            shift += 1
        if o == "D":
            shift = 0 if shift < n else shift
        parts[i - 1][0] -= shift
        parts[i + 1][0] += shift
    return text([tuple(p) for p in parts])


def mismatch_clip(cigar: str, seq: str, ref: str, threshold: float) -> tuple[int, int]:
    """Query bases to clip at each end: the longest end stretches whose share of mismatches is above ``threshold``.

    ``ref`` has the reference bases of the alignment from its start. Both ends are walked towards each other until they meet.
    """
    good, q, r = [], 0, 0
    for n, o in parse(cigar):
        if o in MATCH_OPS:
            good += [(q + i, seq[q + i].upper() == ref[r + i].upper() if r + i < len(ref) else True) for i in range(n)]
        if o in QUERY_OPS:
            q += n
        if o in REF_OPS:
            r += n
    front = back = 0
    bad_f = bad_b = 0
    for i in range((len(good) + 1) // 2):
        bad_f += not good[i][1]
        if not good[i][1] and bad_f / (i + 1) > threshold:
            front = good[i][0] + 1
        j = len(good) - 1 - i
        bad_b += not good[j][1]
        if not good[j][1] and bad_b / (i + 1) > threshold:
            back = q - good[j][0]
        if front + back >= q:
            break
    return (q, 0) if front + back >= q else (front, back)
