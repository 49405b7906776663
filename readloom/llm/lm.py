"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

#: Classes of tokens that the neural model predicts: the HEAD most frequent tokens, each its own class, and CLUSTERS of the rest,
#: by a hash of a token's last three bytes, which is the first byte of the token's number.
HEAD, CLUSTERS = 384, 256
#: Length of the vectors, and tokens of context.
DIM, CONTEXT = 24, 3
#: Training tokens whose counts every executor holds: the most frequent ones (16 bytes each). The others are joined.
KNOWN = 1 << 17
#: The end of a text, as a token.
END = np.uint64(0x5851F42D4C957F2D)
#: Noise samples for a batch, positions in a batch.
NOISE, BATCH = 40, 2048
#: Step sizes of the two rounds of training, and the positions of each task that the first one uses.
RATES, WARM = (0.1, 0.05), 1 << 17
#: Distinct tokens that a counting task holds before it gives them out.
HOLD = 400_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and then its end, and where each text's tokens begin (one more entry at the end)."""
    buf, offsets = words.flat(column)
    begins, ends, first = words.spans(buf, offsets, words.SPACED)
    h = words.hashes(buf, begins, ends, words.LOWER)
    tail = np.zeros(len(h), np.uint64)
    for k in range(1, 4):
        tail = tail * np.uint64(256) + np.where(ends - begins >= k, words.LOWER[buf[np.maximum(ends - k, 0)]], 0).astype(np.uint64)
    h = (h >> np.uint64(8)) | (words.mixed(tail, 6) & np.uint64(0xFF << 56))
    n = len(first) - 1
    return np.insert(h, first[1:], END), first + np.arange(n + 1)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def count(docs: DataFrame, text: str) -> DataFrame:
    """token (hash), c: how often each token is in all texts."""

    def run(batches):
        held, size = [], 0

        def out():
            k = np.concatenate([x[0] for x in held])
            c = np.concatenate([x[1] for x in held])
            u, at = np.unique(k, return_inverse=True)
            return u, np.bincount(at, c, len(u)).astype(np.int64)

        for b in words.sliced(batches, "_text"):
            h, _ = tokens(b.column(0))
            u, c = np.unique(h, return_counts=True)
            held.append((u, c))
            size += len(u)
            if size > 2 * HOLD:
                held = [out()]
                size = len(held[0][0])
                if size > HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(held[0][0])), pa.array(held[0][1])], names=["token", "c"])
                    held, size = [], 0
        if held:
            u, c = out()
            yield pa.RecordBatch.from_arrays([pa.array(_signed(u)), pa.array(c)], names=["token", "c"])

    return docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Model:
    """Token counts of the head, totals, and the log-bilinear network over token classes.

    P(token | context) = P(class | context) * P(token | class). The classes are the HEAD most frequent tokens and CLUSTERS of
    all others (an unseen token has one too); within a class tokens have add-one shares, one of them for the unseen.
    P(class | context) is proportional to exp(q . r_class + b_class) with q = the sum over context places of c_place * v_class.
    """

    def __init__(self, known: np.ndarray, counts: np.ndarray, total: int, distinct: int, mass: np.ndarray, seed: int = 5):
        order = np.argsort(known)
        self.known, self.counts = known[order], counts[order]
        self.total, self.distinct = total, distinct
        head = known[np.lexsort((known, -counts))][:HEAD]
        self.head = np.sort(head)
        self.classes = len(self.head) + CLUSTERS
        #: Add-one mass of each cluster (head classes: their own token's).
        self.mass = mass
        rng = np.random.default_rng(seed)
        self.v = rng.normal(0, 0.1, (self.classes + 1, DIM)).astype(np.float32)  # the last: before the text
        self.r = rng.normal(0, 0.1, (self.classes, DIM)).astype(np.float32)
        self.place = np.ones((CONTEXT, DIM), np.float32) / CONTEXT
        self.b = np.zeros(self.classes, np.float32)

    def class_of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.head, h), max(len(self.head) - 1, 0))
        cluster = len(self.head) + (h >> np.uint64(56)).astype(np.int64)
        return np.where(self.head[at] == h, at, cluster) if len(self.head) else cluster

    def contexts(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each token the classes of the CONTEXT tokens before it in its text, nearest first."""
        place = np.arange(len(c)) - np.repeat(first[:-1], np.diff(first))
        return np.stack([np.where(place > k, np.concatenate([np.full(k + 1, self.classes), c])[: len(c)], self.classes) for k in range(CONTEXT)], 1)

    def query(self, ctx: np.ndarray) -> np.ndarray:
        return sum(self.v[ctx[:, k]] * self.place[k] for k in range(CONTEXT))

    def noise(self) -> np.ndarray:
        return self.unigram / self.unigram.sum()

    def train(self, c: np.ndarray, ctx: np.ndarray, rate: float, epochs: int = 1, seed: int = 3, state: list | None = None) -> list:
        """NCE with noise shared by a batch: tell the true class from NOISE draws of the unigram, by matrix products.

        AdaGrad's sums of squares are the result, and go on from ``state``.
        """
        rng = np.random.default_rng(seed)
        edges = np.cumsum(self.noise())
        log_kp = np.log(NOISE * self.noise() + 1e-12).astype(np.float32)
        state = state or [np.full(x.shape, 1e-4, np.float32) for x in (self.v, self.r, self.b, self.place)]
        size = min(BATCH, max(128, len(c) // 64))
        c, ctx = c.astype(np.int16), np.ascontiguousarray(ctx.T.astype(np.int16))  # short keys sort in linear time

        def step(x, g2, i, grad):
            g2[i] += grad * grad
            x[i] -= rate * grad / np.sqrt(g2[i])

        def summed(i, grad):
            order = np.argsort(i, kind="stable")
            i = i[order]
            at = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            return i[at], np.add.reduceat(grad[order], at, axis=0)

        def sigmoid(x):
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            return np.reciprocal(x, out=x)

        with np.errstate(over="ignore"):
            for _ in range(epochs):
                order = rng.permutation(len(c)).astype(np.int32)
                for s in range(0, len(order), size):
                    i = order[s : s + size]
                    x, y = ctx[:, i], c[i]
                    near = [self.v[x[k]] for k in range(CONTEXT)]
                    q = near[0] * self.place[0]
                    for k in range(1, CONTEXT):
                        q += near[k] * self.place[k]
                    z = np.minimum(np.searchsorted(edges, rng.random(NOISE) * edges[-1]), self.classes - 1).astype(np.int16)
                    ry, rz = self.r[y], self.r[z]
                    gt = sigmoid(np.einsum("ij,ij->i", q, ry) + (self.b - log_kp)[y]) - 1
                    fake = q @ rz.T
                    fake += (self.b - log_kp)[z]
                    gf = sigmoid(fake)
                    gt /= len(i)
                    gf /= len(i)
                    dq = gf @ rz
                    dq += gt[:, None] * ry
                    # The bias is a column of the gradient beside the class's vector.
                    own, grad = summed(np.concatenate([y, z]), np.concatenate([np.hstack([gt[:, None] * q, gt[:, None]]), np.hstack([gf.T @ q, gf.sum(0)[:, None]])]))
                    vi, vg = summed(x.reshape(-1), np.concatenate([dq * self.place[k] for k in range(CONTEXT)]))
                    pg = np.stack([np.einsum("ij,ij->j", dq, near[k]) for k in range(CONTEXT)])
                    step(self.r, state[1], own, grad[:, :-1])
                    step(self.b, state[2], own, grad[:, -1])
                    step(self.v, state[0], vi, vg)
                    step(self.place, state[3], slice(None), pg)
        return state

    def class_log(self, c: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Normalised natural-log class probabilities; the normaliser of each distinct context comes from one matrix product."""
        base = self.classes + 1
        key = ctx @ (base ** np.arange(CONTEXT))
        u, at = np.unique(key, return_inverse=True)
        out = np.empty(len(u), np.float64)
        q = np.empty((len(u), DIM), np.float32)
        # While no logit can overflow, the largest need not be taken off first. Blocks of 512 stay in the CPU's cache.
        reach = float(np.abs(self.b).max() + np.sqrt((self.r**2).sum(1).max()) * CONTEXT * np.sqrt((self.v**2).sum(1).max()) * np.abs(self.place).max())
        turned, ones = np.ascontiguousarray(self.r.T), np.ones(self.classes, np.float32)
        z = np.empty((512, self.classes), np.float32)
        for s in range(0, len(u), 512):
            x = u[s : s + 512, None] // base ** np.arange(CONTEXT) % base
            q[s : s + 512] = self.query(x)
            y = np.matmul(q[s : s + 512], turned, out=z[: len(x)])
            y += self.b
            top = np.zeros((len(y), 1), np.float32) if reach < 60 else y.max(1, keepdims=True)
            if reach >= 60:
                y -= top
            out[s : s + 512] = np.log(np.exp(y, out=y) @ ones) + top[:, 0]
        return np.einsum("ij,ij->i", q[at], self.r[c]).astype(float) + self.b[c] - out[at]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the tokens that every executor knows, and which those are."""
        if not len(self.known):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        there = self.known[at] == h
        return np.where(there, self.counts[at], 0), there


def _averaged(docs: DataFrame, model: Model, text: str, rate: float, upto: int | None = None) -> int:
    """One round of local NCE in every task; the tasks' parameters are averaged by their positions. Returns the number of positions.

    Every position of every training text is a positive. A first round with ``upto`` only brings the tasks' parameters, which
    start alike, to one neighbourhood, so that the averages of the round over everything make sense: it stops in each task
    after that many positions (or goes over fewer again), and so grows with the tasks.
    """
    spark = docs.sparkSession
    shared = store.share(spark, model)
    shapes = [x.shape for x in (model.v, model.r, model.place)]

    def run(batches):
        m = shared()
        seen, cs, xs, state = 0, [], [], None

        def learn():
            n = sum(map(len, cs))
            return m.train(np.concatenate(cs), np.concatenate(xs), rate, epochs=min(20, max(1, (upto or 0) // n)), seed=seen % 1000, state=state)

        for b in words.sliced(batches, "_text"):
            h, first = tokens(b.column(0))
            c = m.class_of(h)
            cs.append(c)
            xs.append(m.contexts(c, first))
            seen += len(c)
            if not upto and sum(map(len, cs)) > 50 * BATCH:
                state = learn()
                cs, xs = [], []
            if upto and seen >= upto:
                break
        if cs and sum(map(len, cs)):
            learn()
        if seen:
            flat = np.concatenate([m.v.astype(float), m.r.astype(float), m.place.astype(float), np.pad(m.b.astype(float), (0, -len(m.b) % DIM)).reshape(-1, DIM)])
            rows = [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), float(seen)))]
            yield pa.RecordBatch.from_arrays([*rows, *[pa.array(flat[:, j] * seen) for j in range(DIM)]], names=["i", "n", *[f"x{j}" for j in range(DIM)]])

    got = docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "i int, n double, " + ", ".join(f"x{j} double" for j in range(DIM)))
    got = got.groupBy("i").agg(F.sum("n").alias("n"), *[(F.sum(f"x{j}") / F.sum("n")).alias(f"x{j}") for j in range(DIM)]).toPandas().sort_values("i")
    if not len(got):
        return 0
    flat = got[[f"x{j}" for j in range(DIM)]].to_numpy()
    cut = np.cumsum([s[0] for s in shapes])
    model.v, model.r, model.place = (flat[a:b].astype(np.float32) for a, b in zip([0, *cut[:2]], cut, strict=True))
    model.b = flat[cut[2] :].reshape(-1)[: model.classes].astype(np.float32)
    return int(got["n"].iloc[0])


def fit(docs: DataFrame, *, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of the training texts ``docs``, and the kept table of all token counts.

    Counts cover every training token, and the network is trained by NCE in every task over all of them. Null and empty texts
    are one token, the end; very long ones are cut nowhere; repeated rows count as often as they are there; without texts
    the model knows no token, and gives each the share of an unseen one. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = store.keep(count(docs, text), "lm-counts")
    cluster = F.shiftrightunsigned("token", 56).cast("int")
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count of the tokens that everyone knows, from the numbers of tokens by count: no task orders all tokens.
    by_count = table.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(KNOWN + 1).collect()
    upto = np.cumsum([r.n for r in by_count] or [0])
    fit_in = int((upto <= KNOWN).sum()) if by_count else 0
    least = by_count[fit_in - 1].c if fit_in else (1 << 62)
    known = table.filter(F.col("c") >= least).toArrow()
    h, c = known["token"].to_numpy().view(np.uint64), known["c"].to_numpy()
    model = Model(h, c, total, distinct, np.zeros(0))
    n = len(model.head)
    # Add-one mass of the clusters: all tokens that are not in the head, and one more in each for the unseen.
    sums = np.zeros(CLUSTERS)
    heads = spark.createDataFrame([(int(x),) for x in _signed(model.head)], "token long")
    for r in table.join(F.broadcast(heads), "token", "left_anti").groupBy(cluster.alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        sums[r.k] = r.m
    sums += 1.0
    own = np.zeros(n)
    own[np.searchsorted(model.head, h[np.isin(h, model.head)])] = c[np.isin(h, model.head)] + 1
    model.mass = np.concatenate([own, sums])
    model.unigram = np.maximum(model.mass, 1e-3)
    model.b = np.log(model.unigram / model.unigram.sum()).astype(np.float32)
    for rate, upto in zip(RATES, (WARM, None), strict=True):
        _averaged(docs, model, text, rate, upto)
    return model, table


def score(docs: DataFrame, model: Model, table: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each text: the columns ``keep``, n_tokens, n_known, train_tokens, base_score and score (both log10).

    A null text counts as empty: its only token is the end. Columns of ``docs`` other than those to keep are ignored, whatever
    their names; a kept one must not be named like a result. An empty table gives no rows.
    Tokens that executors don't all know are looked up in the count table by a join on the token; its sums go back to the
    texts by their key, the hash of the kept columns and the text. Rows that are the same in both are scored alike.
    """
    shared = store.share(docs.sparkSession, model)  # KNOWN * 16 bytes, and the network
    shown, keep = keep, tuple(f"p{i}" for i in range(len(keep)))
    docs = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(shown, keep, strict=True)], F.col(f"`{text}`").alias("_text"))
    text = "_text"
    fields = [docs.schema[c] for c in keep]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    log_all = float(np.log10(model.total + model.distinct + 1.0))

    def run(batches):
        m = shared()
        cluster_log = np.log10(np.maximum(m.mass, 1e-300))
        for b in words.sliced(batches, "_text", words.SLICE // 2):
            get = lambda n, b=b: b.column(b.schema.get_field_index(n))
            h, first = tokens(get("_text"))
            own = words.owners(first)
            c, there = m.look_up(h)
            cls = m.class_of(h)
            log_c = np.where(there, np.log10(c + 1.0), 0.0)
            # Within its class a token has the share (c + 1) / mass; in the head that is all of it.
            in_head = cls < len(m.head)
            net = m.class_log(cls, m.contexts(cls, first)) / np.log(10)
            net += np.where(in_head, 0.0, log_c - cluster_log[cls])
            n = b.num_rows
            sums = [np.bincount(own, w, n) for w in (log_c, net)]
            rows = [get("_key"), *[get(f.name) for f in fields], pa.array(np.diff(first).astype(np.int64)), pa.array(np.bincount(own, there, n).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])]
            names = ["_key", *keep, "n_tokens", "n_known", "log_c", "net"]
            nothing = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, *nothing], names=[*names, "token", "tf"])
            rest = np.flatnonzero(~there)
            if len(rest):
                order = rest[np.lexsort((h[rest], own[rest]))]
                new = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (h[order][1:] != h[order][:-1])])
                at = np.flatnonzero(new)
                tf = np.diff(np.concatenate([at, [len(order)]]))
                who = order[at]
                k = get("_key").to_numpy()[own[who]]
                blank = [pa.nulls(len(who), f.type) for f in b.schema if f.name in keep]
                yield pa.RecordBatch.from_arrays([pa.array(k), *blank, *[pa.nulls(len(who), pa.int64())] * 2, *[pa.nulls(len(who), pa.float64())] * 2, pa.array(_signed(h[who])), pa.array(tf.astype(np.int64))], names=[*names, "token", "tf"])

    ddl = "_key long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, n_known long, log_c double, net double, token long, tf long"
    given = docs.select(key.alias("_key"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    parts = store.keep(given.mapInArrow(run, ddl), "lm-parts")
    rare = parts.filter("token is not null").select("_key", "token", "tf").join(table, "token")
    # An unseen token adds log10(0 + 1) = 0 to both sums, and isn't known, so only tokens in the table add anything.
    rare = rare.groupBy("_key").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("l"))
    # Rows with equal keys put their rare tokens in as often as they are there.
    whole = parts.filter("token is null").drop("token", "tf")
    times = whole.groupBy("_key").agg(F.count(F.lit(1)).alias("times"))
    out = whole.join(times.join(rare, "_key", "left"), "_key")
    known = F.coalesce(F.col("k") / F.col("times"), F.lit(0.0))
    extra = F.coalesce(F.col("l") / F.col("times"), F.lit(0.0))
    return out.select(
        *[F.col(p).alias(c) for c, p in zip(shown, keep, strict=True)],
        "n_tokens",
        (F.col("n_known") + F.round(known).cast("long")).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("log_c") + extra - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("net") + extra).alias("score"),
    )
