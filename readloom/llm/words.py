"""Word splitting and 64-bit word hashing over Arrow string columns, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time, which bounds the scratch arrays.
CHUNK = 1 << 20
#: Bytes of text in one slice of a record batch.
SLICE = 6 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(np.asarray(x, np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))


_BYTE = mixed(np.arange(256), 1) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _STEP, np.uint64)]))


_POW = _powers(256)


def byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.arange(256)
    spaced = ~((b == 32) | ((b >= 9) & (b <= 13)))
    alnum = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    lower = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    return spaced, alnum, lower


#: Word bytes between white space; word bytes that are digits, letters or beyond ASCII; A-Z to a-z.
SPACED, ALNUM, LOWER = byte_classes()
ASIS = np.arange(256, dtype=np.uint8)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's values back to back, and where each value begins and ends (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, at - at[0]


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in ``buf``, and for each value the number of its first word (one more entry at the end)."""
    inside = table[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    before = np.empty(len(buf), bool)
    if len(buf):
        before[0] = False
        before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(buf), bool)
    if len(buf):
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, after the byte mapping ``fold``; works through the words in bounded groups."""
    global _POW
    out = np.empty(len(begins), np.uint64)
    lengths = ends - begins
    total = np.concatenate([[0], np.cumsum(lengths)])
    if len(lengths) and lengths.max() >= len(_POW):
        _POW = _powers(int(lengths.max()) * 2)
    code = _BYTE[fold]
    i = 0
    with np.errstate(over="ignore"):
        while i < len(begins):
            j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, "right")) - 1)
            n = lengths[i:j]
            starts = total[i:j] - total[i]
            place = np.arange(total[j] - total[i]) - np.repeat(starts, n)
            out[i:j] = np.add.reduceat(code[buf[place + np.repeat(begins[i:j], n)]] * _POW[place], starts)
            i = j
        return _mixed(out + lengths.astype(np.uint64))


def hashed(column: pa.Array, table: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all values in order, and for each value the number of its first word (one more entry at the end)."""
    buf, offsets = flat(column)
    begins, ends, first = spans(buf, offsets, table)
    return hashes(buf, begins, ends, fold), first


def owners(first: np.ndarray) -> np.ndarray:
    """For each word, the number of the value that it is in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` consecutive words within a value (of all its words, if it has fewer, but not none), and the owners."""
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    own = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
    out = np.zeros(len(own), np.uint64)
    left = np.repeat(first[1:], count) - start
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    with np.errstate(over="ignore"):
        for d in range(n):
            out = _mixed(out * np.uint64(_STEP) + np.where(left > d, padded[start + d], np.uint64(0)))
    return out, own


def sliced(batches, column: str, limit: int = SLICE):
    """Record batches cut so that ``column`` has about ``limit`` bytes in each (a longer value stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, at = flat(col)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
