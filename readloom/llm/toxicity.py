"""Toxicity from compression lengths under two zstandard dictionaries (operator 6)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality, store, words

#: Labelled rows of each class that the fit takes at most.
FIT_ROWS = 4000
#: Bytes that a window has at least (1: each word is one), and bytes of the dictionary part that both classes share.
WINDOW, COMMON_BYTES = 1, 8192
#: Bytes of shared content that are compressed after each window.
ANCHOR = 48
#: Windows whose distance a task remembers.
MEMORY = 200_000
#: Toxic segments in the toxic dictionary at most, the documents that each must be in, and its least log-likelihood ratio.
SEGMENTS, MIN_DOCS, MIN_RATIO = 400, 3, 20.0
#: Windows of labelled ordinary text that the shared dictionary part is trained on, at most.
SHARED_WINDOWS = 8000
LOW = bytes(words.LOWER.tolist())
GAPS = bytes(32 if not a else i for i, a in enumerate(words.ALNUM.tolist()))


def folded(text: bytes) -> bytes:
    """Lower-case ASCII words (and all beyond ASCII), one space before and after each."""
    inner = b" ".join(text.translate(LOW).translate(GAPS).split())
    return b" " + inner + b" " if inner else b""


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of about ``size`` bytes that end with a word; each begins and ends with a space."""
    out, i, n = [], 0, len(text) - 1
    while i < n:
        j = i + size
        if j < n:
            k = text.find(b" ", j)
            j = n if k < 0 else k
        else:
            j = n
        out.append(text[i : j + 1])
        i = j
    return out


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(9, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how)


def distances(text: bytes, ordinary, toxic, anchor: bytes, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct window the bytes that the toxic dictionary saves over the ordinary one, and how often it is there.

    Both compress the window with ``anchor`` after it, the end of the content that they share: zstandard stores a few bytes
    as they are, so without a longer match beside it a short one would save nothing.
    """
    d, n = [], []
    for w, k in Counter(windows(text)).items():
        v = memory.get(w)
        if v is None:
            v = len(ordinary.compress(w + anchor)) - len(toxic.compress(w + anchor))
            if len(memory) >= MEMORY:
                memory.clear()
            memory[w] = v
        d.append(v)
        n.append(k)
    return np.array(d, float), np.array(n, float)


def summary(d: np.ndarray, n: np.ndarray) -> list[float]:
    """FEATURES numbers of a text's windows: the largest distances, and how many reach each length, in all and for each window."""
    size = max(n.sum(), 1.0)
    order = np.argsort(-d, kind="stable")[:3]
    top = np.repeat(d[order], np.minimum(n[order], 3).astype(int))[:3]
    over = [float(n[d >= t].sum()) for t in (2, 3, 4, 5)]
    return [top[0] if len(top) else 0.0, top.sum(), (d * n).sum() / size, *np.log1p(over), *[np.log1p(1000 * v / size) for v in over], np.log1p(size)]


FEATURES = 12


class Model:
    """The two dictionaries and the calibration of window distances to a probability."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weights, self.bias = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Ridge logistic regression by Newton's method."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        w, hold = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + hold, z.T @ (p - y) + hold @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.bias = w[:-1], w[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def _tokens(text: bytes) -> set[bytes]:
    """Words and their beginnings of 5 bytes or more that end between characters, up to 24 bytes."""
    out = set()
    for w in set(text.split()):
        out.add(w)
        out.update(w[:k] for k in range(5, min(len(w), 24)) if w[k] & 0xC0 != 0x80)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = FIT_ROWS) -> Model | float:
    """Fit on at most ``rows`` labelled documents of each class: half of them give the dictionaries, half the calibration.

    The ordinary dictionary is trained by zstandard on ordinary windows. The toxic one is the same content with toxic
    segments before it: the words and word beginnings that are in significantly more toxic than ordinary documents, so
    that only those make the two lengths differ. Where only one class is labelled, the result is a constant score.
    """
    wanted = F.broadcast(quality.sample_ids(labels, label, rows))  # at most 2 * rows ids
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2
    some = store.keep(docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(wanted, "doc_id").withColumn("_half", half.cast("int")), "toxic-fit")

    def tokens(batches):
        for b in words.sliced(batches, "_text"):
            for t, y in zip(b.column(0), b.column(1), strict=True):
                got = sorted(_tokens(folded(t.as_py() or b"")))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array([y.as_py()] * len(got), pa.int32())], names=["token", "y"])

    first = some.filter("_half = 0").select("_text", "_label")
    size = {r[0]: r[1] for r in some.groupBy("_half", "_label").count().select(F.concat_ws("-", "_half", "_label"), "count").collect()}
    n0, n1 = size.get("0-0", 0), size.get("0-1", 0)
    if not (n0 and n1 and size.get("1-0") and size.get("1-1")):
        store.drop(docs.sparkSession, some)
        total = {k: sum(v for key, v in size.items() if key.endswith(k)) for k in ("0", "1")}
        return total["1"] / (total["0"] + total["1"]) if total["0"] + total["1"] else 0.5
    a, b = F.sum("y").cast("double"), F.sum(1 - F.col("y")).cast("double")
    counts = first.mapInArrow(tokens, "token binary, y int").groupBy("token").agg(a.alias("a"), b.alias("b")).filter(F.col("a") >= MIN_DOCS)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rate = (F.col("a") + F.col("b")) / (n0 + n1)
    ratio = 2 * (part(F.col("a"), n1 * rate) + part(F.col("b"), n0 * rate) + part(n1 - F.col("a"), n1 * (1 - rate)) + part(n0 - F.col("b"), n0 * (1 - rate)))
    counts = counts.withColumn("g", ratio).filter((F.col("g") >= MIN_RATIO) & (F.col("a") / n1 > F.col("b") / n0))
    found = [(bytes(r.token), r.a) for r in counts.orderBy(F.desc("g"), "token").limit(SEGMENTS).collect()]
    # The beginning of a longer segment that is in nearly as many documents adds nothing.
    segments = [w for w, n in found if not any(v != w and v.startswith(w) and m >= 0.8 * n for v, m in found)]

    def samples(batches):
        for b in words.sliced(batches, "_text"):
            got = []
            for t in b.column(0):
                got += windows(folded(t.as_py() or b""), 64)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["w"])

    ordinary = [bytes(r.w) for r in first.filter("_label = 0").mapInArrow(samples, "w binary").withColumn("h", F.xxhash64("w")).distinct().orderBy("h", "w").limit(SHARED_WINDOWS).collect()]
    try:
        common = zstandard.train_dictionary(COMMON_BYTES, ordinary).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        common = b"".join(ordinary)[:COMMON_BYTES]
    common = common or b" " * 16
    model = Model(common, b"".join(b" " + w for w in reversed(segments)) + b" " + common)
    rest = _summaries(some.filter("_half = 1").select("_text", "_label", "doc_id"), model, ["_label", "doc_id"]).toPandas().sort_values("doc_id", kind="stable")
    model.calibrate(np.array(rest["_x"].tolist(), float), rest["_label"].to_numpy(float))
    store.drop(docs.sparkSession, some)
    return model


def _summaries(docs: DataFrame, model: Model, passing: list[str]) -> DataFrame:
    shared = store.share(docs.sparkSession, model)  # two dictionaries of a bounded size
    fields = [docs.schema[c] for c in passing]

    def run(batches):
        m = shared()
        ordinary, toxic, memory = compressor(m.ordinary), compressor(m.toxic), {}
        anchor = m.ordinary[-ANCHOR:]
        for b in words.sliced(batches, "_text"):
            get = lambda n, b=b: b.column(b.schema.get_field_index(n))
            x = [summary(*distances(folded(t.as_py() or b""), ordinary, toxic, anchor, memory)) for t in get("_text")]
            yield pa.RecordBatch.from_arrays([*[get(f.name) for f in fields], pa.array(x, pa.list_(pa.float64()))], names=[*passing, "_x"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _x array<double>")


def score(docs: DataFrame, model: Model | float, *, threshold: float = 0.5, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only with ``keep_text``, none named like the results), score (0 to 1) and predicted (1 from ``threshold`` on).

    The whole text is scored in windows; a null or empty one has none, and so gets the score of a text without toxic windows.
    """
    docs, names = store.packed(docs, "score", "predicted")
    text = f"p{names.index(text)}"
    passing = [c for c in docs.columns if keep_text or c != text]
    shown = [F.col(f"p{i}").alias(c) for i, c in enumerate(names) if f"p{i}" in passing]
    if isinstance(model, float):
        return docs.select(*shown, F.lit(model).alias("score"), F.lit(int(model >= threshold)).alias("predicted"))
    given = docs.select(*passing, F.col(text).cast("binary").alias("_text"))
    z = sum(((F.col("_x")[i] - float(model.mean[i])) * float(model.weights[i] / model.scale[i]) for i in range(FEATURES)), F.lit(float(model.bias)))
    scored = _summaries(given, model, passing).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return scored.select(*shown, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
