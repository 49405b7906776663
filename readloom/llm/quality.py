"""Quality scores from a factorisation machine over hashed words, structure and metadata (operator 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

#: Labelled rows of each class that the fit takes at most: those whose hashed id is smallest.
FIT_ROWS = 4000
WORD_SLOTS = 1 << 16
RANK = 8
BINS = 24
#: Structure statistics, each cut into BINS bins with a weight and a factor of its own.
STATS = ("log_words", "word_length", "symbols", "digits", "capitals", "log_lines", "line_words", "repeated_lines", "distinct_words", "symbol_tails", "log_bytes", "beyond_ascii")
SLOTS = WORD_SLOTS + len(STATS) * BINS
META_SLOTS = 64


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _structure(buf: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The STATS of each text, one column each, as bin numbers."""

    def share(mask):
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[at[1:]] - run[at[:-1]]).astype(float)

    size = np.diff(at).astype(float)
    n = np.diff(first).astype(float)
    is_symbol = ~words.ALNUM & (np.arange(256) > 32)
    letters = share(words.SPACED[buf])
    lengths = np.concatenate([[0], np.cumsum(ends - begins)])
    tail = np.zeros(len(begins) + 1)
    if len(begins):
        tail[1:] = np.cumsum(is_symbol[buf[ends - 1]] & ~np.isin(buf[ends - 1], np.frombuffer(b".,", np.uint8)))
    # Lines: their hashes are sums of word hashes weighted by place, so repeats are counted without making strings.
    line_of = np.concatenate([[0], np.cumsum(buf == 10)])
    lines = (line_of[at[1:]] - line_of[at[:-1]] + (size > 0)).astype(float)
    repeats = np.zeros(len(n))
    if len(begins):
        own = words.owners(first)
        key = line_of[begins]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - starts[which]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            lh = np.add.reduceat(h * place, starts)
        o = own[starts]
        order = np.lexsort((lh, o))
        same = np.concatenate([[False], (lh[order][1:] == lh[order][:-1]) & (o[order][1:] == o[order][:-1])])
        repeats = np.bincount(o[order][same], minlength=len(n)).astype(float)
    unit = [
        np.log2(n + 1) / 16, _ratio(lengths[first[1:]] - lengths[first[:-1]], n) / 16, _ratio(share(is_symbol[buf]), letters) * 2, _ratio(share((buf >= 48) & (buf <= 57)), letters) * 4,
        _ratio(share((buf >= 65) & (buf <= 90)), letters) * 2, np.log2(lines + 1) / 10, np.log2(_ratio(n, lines) + 1) / 10, _ratio(repeats, lines), _ratio(distinct, n),
        _ratio(tail[first[1:]] - tail[first[:-1]], n), np.log2(size + 1) / 20, _ratio(share(buf >= 128), letters),
    ]
    return np.stack([np.clip((x * BINS).astype(np.int64), 0, BINS - 1) for x in unit], 1)


def features(texts: pa.Array, meta: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots, values and where each text's begin (one more entry at the end), in CSR form."""
    buf, at = words.flat(texts)
    begins, ends, first = words.spans(buf, at, words.SPACED)
    h = words.hashes(buf, begins, ends, words.LOWER)
    rows = len(first) - 1
    slot = (h >> np.uint64(48)).astype(np.int64) % WORD_SLOTS
    key = words.owners(first) * np.int64(WORD_SLOTS) + slot
    cell, count = np.unique(key, return_counts=True)
    row = cell // WORD_SLOTS
    distinct = np.bincount(row, minlength=rows).astype(float)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, rows))
    value = value / norm[row] if len(row) else value
    bins = _structure(buf, at, begins, ends, first, h, distinct)
    extra = [WORD_SLOTS + k * BINS + bins[:, k] for k in range(len(STATS))]
    for k, column in enumerate(meta):
        size = np.array([-1 if v is None or v != v else np.log2(abs(float(v)) + 1) for v in column.to_pylist()])
        extra.append(SLOTS + k * META_SLOTS + np.clip((size * 2).astype(np.int64) + 1, 0, META_SLOTS - 1))
    slots = np.concatenate([cell % WORD_SLOTS, *extra])
    values = np.concatenate([value, np.full(rows * len(extra), 0.5)])
    owner = np.concatenate([row, *[np.arange(rows)] * len(extra)])
    order = np.argsort(owner, kind="stable")
    return slots[order], values[order], np.searchsorted(owner[order], np.arange(rows + 1))


class Machine:
    """A factorisation machine for a binary label, trained with AdaGrad on the logistic loss."""

    def __init__(self, slots: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(slots, np.float32), (rng.normal(0, 0.02, (slots, rank))).astype(np.float32)

    def margin(self, slots, values, at):
        """Linear-time pairwise sum: 1/2 of the sum over factors of (sum v x)^2 - sum (v x)^2."""
        n = len(at) - 1
        own = np.repeat(np.arange(n), np.diff(at))
        vx = self.v[slots] * values[:, None].astype(np.float32)
        total = np.add.reduceat(vx, at[:-1], axis=0) if n else np.zeros((0, self.v.shape[1]))
        square = np.add.reduceat(vx * vx, at[:-1], axis=0) if n else total
        return self.bias + np.bincount(own, self.w[slots] * values, n) + 0.5 * (total * total - square).sum(1), own, vx, total

    def probability(self, slots, values, at):
        return 1 / (1 + np.exp(-np.clip(self.margin(slots, values, at)[0], -40, 40)))

    def fit(self, slots, values, at, label, epochs: int = 10, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 11):
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(len(self.w), 1e-3), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(label))
            for b in range(0, len(order), batch):
                rows = order[b : b + batch]
                n = np.diff(at)[rows]
                take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n)
                s, x = slots[take], values[take]
                z, own, vx, total = self.margin(s, x, np.concatenate([[0], np.cumsum(n)]))
                slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) / len(rows)
                u, back = np.unique(s, return_inverse=True)
                per = slope[own] * x
                dw = np.bincount(back, per, len(u)) + decay * self.w[u]
                dv = np.stack([np.bincount(back, per * (total[own, f] - vx[:, f]), len(u)) for f in range(vx.shape[1])], 1).astype(np.float32) + decay * self.v[u]
                gw[u] += dw**2
                gv[u] += dv**2
                gb += slope.sum() ** 2
                self.w[u] -= (rate * dw / np.sqrt(gw[u])).astype(np.float32)
                self.v[u] -= rate * 0.3 * dv / np.sqrt(gv[u])
                self.bias -= rate * slope.sum() / np.sqrt(gb)
        return self


def sample_ids(labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """Up to ``rows`` labelled ids of each class outside the held-out fold, with their label: those whose hash is smallest.

    A null id or label is no label; of an id labelled more than once the larger label counts.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (store.crc_fold(F.col("doc_id"), folds) != 0))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).withColumn("_h", F.xxhash64("doc_id"))
    of = lambda k: store.smallest(own.filter(F.col("_label") == k), "_h", rows, "doc_id")
    return of(0).unionByName(of(1)).select("doc_id", "_label")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = FIT_ROWS, metadata: tuple[str, ...] = ("n_chars",)) -> Machine | float:
    """Fit on at most ``rows`` labelled documents of each class; their features, not their texts, come to the driver.

    Where only one class is labelled (or none), the result is that class's constant score (or 0.5).
    """
    wanted = F.broadcast(sample_ids(labels, label, rows))  # at most 2 * rows ids
    some = docs.select("doc_id", F.col("text").alias("_text"), *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(metadata)]).join(wanted, "doc_id")
    names = [f"_m{i}" for i in range(len(metadata))]

    def run(batches):
        for b in words.sliced(batches, "_text"):
            get = lambda n, b=b: b.column(b.schema.get_field_index(n))
            s, x, at = features(get("_text"), [get(n) for n in names])
            lists = lambda v, at=at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([get("doc_id").cast(pa.int64()), get("_label"), lists(s.astype(np.int32)), lists(x.astype(np.float32))], names=["id", "y", "s", "x"])

    got = some.mapInArrow(run, "id long, y int, s array<int>, x array<float>").toArrow().sort_by([("id", "ascending")])
    y = got["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy()
    at = np.concatenate([[0], np.cumsum([len(v) for v in got["s"]])])
    return Machine(SLOTS + META_SLOTS * len(metadata)).fit(flat("s").astype(np.int64), flat("x").astype(float), at, y)


def score(docs: DataFrame, model: Machine | float, *, threshold: float = 0.3, metadata: tuple[str, ...] = ("n_chars",), text: str = "text") -> DataFrame:
    """Every column of ``docs`` (but those named like the results), and score (0 to 1) and predicted (1 from ``threshold`` on) of its whole text; null counts as empty."""
    shared = store.share(docs.sparkSession, model)  # (SLOTS + META_SLOTS * columns) * (RANK + 1) floats
    own, shown = store.packed(docs, "score", "predicted")
    place = {c: f"p{i}" for i, c in enumerate(shown)}
    passing = own.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passing) + ", score double, predicted int"
    names = [f"_m{i}" for i in range(len(metadata))]

    def run(batches):
        model = shared()
        for b in words.sliced(batches, "_text", 1 << 21):
            get = lambda n, b=b: b.column(b.schema.get_field_index(n))
            p = np.full(b.num_rows, model) if isinstance(model, float) else model.probability(*features(get("_text"), [get(n) for n in names]))
            p = np.clip(np.nan_to_num(p.astype(float), nan=0.5), 0, 1)
            kept = [b.column(i) for i in range(len(passing))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*passing.names, "score", "predicted"])

    extra = [F.col(place[text]).alias("_text"), *[F.col(place[c]).cast("double").alias(n) for c, n in zip(metadata, names, strict=True)]]
    return own.select("*", *extra).mapInArrow(run, ddl).select(*store.unpacked(shown), "score", "predicted")
