"""Benchmark decontamination with suffix arrays over the training words (operator 7)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

#: Bytes of benchmark text that one pass holds in every executor; a larger benchmark is searched in several passes.
BLOCK_BYTES = 16 << 20
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
#: A hit mark of a pass: word positions [begin, end) of a document.
SPAN = "array<struct<s:int,e:int>>"


class Suffixes:
    """The test side: the words of a block of benchmark items, the start of every window and each start's need in words."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.width = width
        h, first = words.hashed(pa.array([t for _, t in items], pa.string()), words.ALNUM, words.LOWER)
        size = np.diff(first)
        count = np.where(size >= width, size - width + 1, (size > 0).astype(size.dtype))
        item = np.repeat(np.arange(len(items)), count)
        start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count)
        need = np.minimum(size[item], width)
        self.ids = [i for i, _ in items]
        # Equal windows are searched once; ``owner`` lists the items of each.
        keys = np.zeros((len(item), width + 1), np.uint64)
        padded = np.concatenate([h, np.zeros(width, np.uint64)])
        for d in range(width):
            keys[:, d] = np.where(need > d, padded[start + d], 0)
        keys[:, width] = need
        if len(item):
            self.keys, which = np.unique(keys, axis=0, return_inverse=True)
        else:
            self.keys, which = keys, np.zeros(0, int)
        which = which.reshape(-1)
        pairs = np.unique(np.stack([which, item], 1), axis=0) if len(item) else np.zeros((0, 2), int)
        self.owner = pairs[:, 1]
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))
        # And where each window stands: the item, and the word of it that the window begins with.
        order = np.argsort(which, kind="stable")
        self.where, self.where_at = np.stack([item, start - first[item]], 1)[order], np.searchsorted(which[order], np.arange(len(self.keys) + 1))
        self.need = self.keys[:, width].astype(np.int64)
        # A training suffix that starts with none of these words or word pairs matches less than any window.
        self.bits = 20
        self.one = np.zeros(1 << self.bits, bool)
        self.two = np.zeros(1 << self.bits, bool)
        self.one[self._slot(self.keys[self.need == 1, 0])] = True
        many = self.need > 1
        self.two[self._slot(self._pair(self.keys[many, 0], self.keys[many, 1]))] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return a * np.uint64(0x9E3779B97F4A7C15) + b

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def shard(self, h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sorted suffixes of a shard: their start words in suffix order, and the words at each depth in that order.

        ``last`` gives for each word the end of its document. Suffixes are ordered by their first ``width`` words, which is
        as deep as a window reaches; one that no window can start with is left out.
        """
        padded = np.concatenate([h, np.zeros(self.width, np.uint64)])
        inside = np.arange(len(h)) + 1 < last
        starts = self.two[self._slot(self._pair(h, padded[1 : len(h) + 1]))] & inside
        if self.one.any():
            starts |= self.one[self._slot(h)]
        at = np.flatnonzero(starts)
        depth = [np.where(at + d < last[at], padded[at + d], np.uint64(0)) for d in range(self.width)]
        order = np.lexsort(depth[::-1])
        return at[order], [x[order] for x in depth]

    def search(self, depth: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range [lo, hi) of the shard's suffixes that begin with it, by binary search word by word."""
        n = len(depth[0])
        lo, hi = np.zeros(len(self.keys), np.int64), np.full(len(self.keys), n, np.int64)
        for d in range(self.width):
            live = np.flatnonzero((self.need > d) & (lo < hi))
            if not len(live):
                break
            x = self.keys[live, d]
            lo[live], hi[live] = _bound(depth[d], lo[live], hi[live], x, False), _bound(depth[d], lo[live], hi[live], x, True)
        return lo, hi


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of x[i] in column[lo[i]:hi[i]], for all i at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        v = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((v <= x) if right else (v < x))
        hi = np.where(open_ & ~up, mid, hi)
        lo = np.where(up, mid + 1, lo)


def _runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] numbers, then those from lo[1], and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _found(test: Suffixes, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place in the shard at which a window stands, and which window."""
    last = first[1:][words.owners(first)] if len(h) else np.zeros(0, np.int64)
    if len(h) and len(test.keys):
        at, depth = test.shard(h, last)
        if len(at):
            lo, hi = test.search(depth)
            found = np.flatnonzero(hi > lo)
            n = (hi - lo)[found]
            return at[_runs(lo[found], n)], np.repeat(found, n)
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _marks(test: Suffixes, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words are hit, and the items of each document that has any."""
    own = words.owners(first)
    edge = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set[int]] = {}
    place, window = _found(test, h, first)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + test.need[window], -1)
    for p in np.unique(own[place] * np.int64(max(len(test.keys), 1)) + window).tolist():
        d, w = divmod(p, len(test.keys))
        items.setdefault(d, set()).update(test.owner[test.owner_at[w] : test.owner_at[w + 1]].tolist())
    return np.cumsum(edge)[:-1] > 0, items


def _longest(test: Suffixes, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The verbatim matches that can't be made longer at either end: document, item, word of the item and of the document that
    they begin with, and length in words.

    Windows that follow one another both in the document and in the item are one match.
    """
    own = words.owners(first)
    place, window = _found(test, h, first)
    n = np.diff(test.where_at)[window]
    item, start = test.where[_runs(test.where_at[:-1][window], n)].T
    place, need = np.repeat(place, n), np.repeat(test.need[window], n)
    order = np.lexsort((place, place - start, item, own[place]))
    item, start, place, need = item[order], start[order], place[order], need[order]
    keys = (own[place], item, place - start, place - np.arange(len(place)))
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(place) else np.zeros(0, bool)
    a, z = np.flatnonzero(new), np.concatenate([np.flatnonzero(new)[1:], [len(new)]]).astype(np.int64)[: new.sum()] - 1
    return own[place[a]], item[a], start[a], place[a] - first[own[place[a]]], place[z] - place[a] + need[z]


def hits(docs: DataFrame, block: Suffixes, text: str, passing: list[str], spans: bool) -> DataFrame:
    """One row for each document: ``passing`` columns, n_words, n_hit, items (ids as strings); with ``spans`` also the hit words."""
    spark = docs.sparkSession
    shared = store.share(spark, block)  # bounded by BLOCK_BYTES of text
    kinds = [docs.schema[c] for c in passing]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", _w long, _h long, _items array<string>" + (f", _spans {SPAN}" if spans else "")

    def run(batches):
        test = shared()
        for b in words.sliced(batches, "_text"):
            h, first = words.hashed(b.column(b.schema.get_field_index("_text")), words.ALNUM, words.LOWER)
            (hit, items), n = _marks(test, h, first), b.num_rows
            run_ = np.concatenate([[0], np.cumsum(hit)])
            cols = [b.column(i) for i in range(len(kinds))]
            cols += [pa.array(np.diff(first).astype(np.int64)), pa.array((run_[first[1:]] - run_[first[:-1]]).astype(np.int64))]
            cols.append(pa.array([sorted({test.ids[i] for i in items.get(d, ()) if test.ids[i] is not None}) for d in range(n)], pa.list_(pa.string())))
            names = [f.name for f in kinds] + ["_w", "_h", "_items"]
            if spans:
                got = []
                for d in range(n):
                    x = hit[first[d] : first[d + 1]].astype(np.int8)
                    t = np.diff(np.concatenate([[0], x, [0]]))
                    got.append([{"s": int(s), "e": int(e)} for s, e in zip(np.flatnonzero(t == 1), np.flatnonzero(t == -1), strict=True)])
                cols.append(pa.array(got, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))))
                names.append("_spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(*[F.col(f"`{c}`") for c in passing], F.col(f"`{text}`").alias("_text")).mapInArrow(run, ddl)


def _blocks(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark in blocks of at most BLOCK_BYTES of text (a longer item alone), read one item at a time."""
    rows, held = [], 0
    for r in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        n = len((r[1] or "").encode())
        if rows and held + n > BLOCK_BYTES:
            yield rows
            rows, held = [], 0
        rows.append((r[0], r[1]))
        held += n
    yield rows


def matches(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The longest verbatim matches of ``width`` words or more between documents and benchmark items, and where they are.

    A row for each match that can't be made longer at either end: the columns of ``docs`` but the text, item_id (a string),
    item_start and doc_start (the number of the first matching word in each, from 0) and length (words). An item of fewer
    words than ``width`` matches as a whole. Columns of ``docs`` with these names give way. Null and empty texts match
    nothing; repeated documents and items each have their own matches; an item without an id has a null one.
    """
    docs, names = store.packed(docs, "item_id", "item_start", "doc_start", "length")
    text = f"p{names.index(text)}"
    passing = [docs.schema[c] for c in docs.columns if c != text]
    given = docs.select(*[f.name for f in passing], F.col(text).alias("_text"))
    ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in passing) + "item_id string, item_start long, doc_start long, length long"
    out = None
    for block in _blocks(benchmark, item_id, item_text):
        shared = store.share(docs.sparkSession, Suffixes(block, width))  # bounded by BLOCK_BYTES of text

        def run(batches, shared=shared):
            test = shared()
            for b in words.sliced(batches, "_text"):
                d, item, start, at, n = _longest(test, *words.hashed(b.column(b.num_columns - 1), words.ALNUM, words.LOWER))
                cols = [b.column(i).take(pa.array(d)) for i in range(len(passing))]
                ids = pa.array([test.ids[i] for i in item.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, ids, *[pa.array(x.astype(np.int64)) for x in (start, at, n)]], names=[*[f.name for f in passing], "item_id", "item_start", "doc_start", "length"])

        got = given.mapInArrow(run, ddl)
        out = got if out is None else out.unionByName(got)
    shown = [F.col(f"p{i}").alias(c) for i, c in enumerate(names) if f"p{i}" != text]
    return out.select(*shown, "item_id", "item_start", "doc_start", "length")


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, min_items: int = 2, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False) -> DataFrame:
    """Mark documents that hold benchmark text.

    Method: each task sorts the suffixes of its documents' words into a suffix array (a shard) and finds every benchmark
    suffix's first ``width`` words in it by binary search; the matching range gives the places of the verbatim matches.
    Overlapping windows join to the longest ones, which ``matches`` lists with their places. Nothing is shuffled for a
    benchmark of up to BLOCK_BYTES.

    Returns every column of ``docs`` but the text (that too with ``keep_text``), and: n_words, n_hit, n_items, items_sha256,
    contaminated; columns of these names give way.
    Null and empty texts have no words; null items and items without words match nothing; a null item id isn't counted in
    n_items (its windows still count as hits); ids that repeat count once; repeated documents are each marked.
    """
    docs, names = store.packed(docs, *RESULTS)
    text = f"p{names.index(text)}"
    passing = [c for c in docs.columns if c != text or keep_text]
    shown = [c for i, c in enumerate(names) if f"p{i}" in passing]
    blocks = _blocks(benchmark, item_id, item_text)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        out = hits(docs, Suffixes(block, width), text, passing, False).withColumn("_items", F.array_sort("_items"))
    else:
        out = _several(docs, [block, after], blocks, width, text, passing)
    return out.select(
        *[F.col(p).alias(c) for p, c in zip(passing, shown, strict=True)],
        F.col("_w").alias("n_words"),
        F.col("_h").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_items") >= min_items).alias("contaminated"),
    )


def _several(docs: DataFrame, held: list, more, width: int, text: str, passing: list[str]) -> DataFrame:
    """A benchmark of many blocks: a pass for each, whose hit spans are joined for each document. Equal rows share a key and an answer."""
    keyed = docs.withColumn("_key", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256))
    parts = None
    for block in [*held, *more]:
        got = hits(keyed, Suffixes(block, width), text, ["_key"], True)
        parts = got if parts is None else parts.unionByName(got)
    spans = F.array_sort(F.flatten(F.collect_list("_spans")))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["end"], x["s"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    sums = parts.groupBy("_key").agg(F.max("_w").alias("_w"), spans.alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    sums = sums.withColumn("_h", F.aggregate("_spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long"))
    return keyed.select("_key", *[F.col(f"`{c}`") for c in passing]).join(sums.select("_key", "_w", "_h", "_items"), "_key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that ``find_leaks`` marks as contaminated, in their own columns."""
    docs, names = store.packed(docs)
    text = f"p{names.index(options.pop('text', 'text'))}"
    marked = find_leaks(docs, benchmark, text=text, keep_text=True, **options)
    return marked.filter(~F.col("contaminated")).select(*store.unpacked(names))
