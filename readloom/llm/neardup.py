"""Near-duplicate documents: ProbMinHash bands, exact verification, connected classes (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash, store, words

THRESHOLD = 0.8
#: Members and shingles of a block of a candidate group, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
TEXT = ["_h1", "_h2"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """_h1, _h2: 128 bits that name a text."""
    return docs.withColumn("_h1", F.xxhash64(F.col(f"`{text}`"))).withColumn("_h2", F.xxhash64(F.lit(7), F.col(f"`{text}`")))


def sketches(docs: DataFrame, doc_id: str, text: str, weights: str) -> DataFrame:
    """_id, _h1, _h2, n (distinct shingles) and the band keys of each document."""

    def run(batches):
        for b in words.sliced(batches, "_text", 1 << 21):
            column = b.column(b.schema.get_field_index("_text"))
            h, first = words.hashed(column, words.SPACED, words.ASIS)
            g, own, count = minhash.shingles(h, first)
            w = np.ones(len(g)) if weights == "presence" else count.astype(float)
            keys = np.zeros((b.num_rows, minhash.BANDS), np.uint64)
            n = np.bincount(own, minlength=b.num_rows)
            # Registers for a few hundred texts at a time.
            for s in range(0, b.num_rows, 512):
                e = min(s + 512, b.num_rows)
                lo, hi = np.searchsorted(own, [s, e])
                keys[s:e] = minhash.band_keys(minhash.sketch(g[lo:hi], own[lo:hi] - s, w[lo:hi], e - s))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * minhash.BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(n.astype(np.int64)), bands], names=["_id", *TEXT, "n", "bands"])

    given = _keyed(docs, text).select(F.col(f"`{doc_id}`").cast("long").alias("_id"), *TEXT, F.col(f"`{text}`").alias("_text"))
    return store.keep(given.mapInArrow(run, "_id long, _h1 long, _h2 long, n long, bands array<long>"), "sketches")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of the undirected edges (a, b); nodes without edges aren't listed.

    Each round takes the least label among a node's neighbours, lets labels' own nodes take it too, and follows it one step;
    rounds end when no label changes. Labels are kept tables, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    both = store.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    label = store.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "cc-labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("low"))
        own = label.join(near, label["node"] == near["a"]).select("node", "root", F.least("root", "low").alias("low"))
        hooked = own.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        best = own.select("node", "root", "low").join(hooked, "node", "left").select("node", "root", F.least("low", F.coalesce("hook", "low")).alias("low"))
        best = store.keep(best, "cc-best")
        to = best.select(F.col("node").alias("_n"), F.col("low").alias("_l"))
        new = store.keep(best.join(to, best["low"] == to["_n"], "left").select("node", F.least("low", F.coalesce("_l", "low")).alias("root"), F.col("root").alias("old")), "cc-labels")
        changed = new.filter("root <> old").limit(1).count()
        store.drop(spark, label, best)
        label = new.select("node", "root")
        label.kept_at = new.kept_at
        if not changed:
            store.drop(spark, both)
            return label


def links(left: pa.Table, right: pa.Table, threshold: float) -> tuple[list[int], list[int]]:
    """Enough pairs of similar sets, one from each side, to join all components that such pairs join (they have columns node, root, set)."""
    a, b = left["set"].combine_chunks(), right["set"].combine_chunks()
    sizes = [np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (a, b)]
    flat = [x.flatten().to_numpy() for x in (a, b)]
    u, at = np.unique(np.concatenate(flat), return_inverse=True)
    ia, ib = at[: len(flat[0])], at[len(flat[0]) :]
    ca, cb = np.bincount(ia, minlength=len(u)), np.bincount(ib, minlength=len(u))
    own = [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
    often = (ca * cb > 64) & (ca > 0) & (cb > 0)
    # Shingles of many members by matrix products of 0/1 columns, the others pair by pair.
    cols = np.flatnonzero(often)
    place = np.full(len(u), -1)
    for s in range(0, len(cols), 4096):
        part = cols[s : s + 4096]
        place[:] = -1
        place[part] = np.arange(len(part))
        m = []
        for i, o, n in ((ia, own[0], sizes[0]), (ib, own[1], sizes[1])):
            x = np.zeros((len(n), len(part)), np.float32)
            hit = place[i] >= 0
            x[o[hit], place[i][hit]] = 1
            m.append(x)
        shared += m[0] @ m[1].T
    few = ~often & (ca > 0) & (cb > 0)
    oa, ob = np.flatnonzero(few[ia]), np.flatnonzero(few[ib])
    oa, ob = oa[np.argsort(ia[oa], kind="stable")], ob[np.argsort(ib[ob], kind="stable")]
    lo, hi = np.searchsorted(ib[ob], ia[oa]), np.searchsorted(ib[ob], ia[oa], "right")
    n = hi - lo
    x, y = np.repeat(own[0][oa], n), own[1][ob][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    np.add.at(shared, (x, y), 1)
    root = [left["root"].to_numpy(), right["root"].to_numpy()]
    whole = sizes[0][:, None] + sizes[1][None, :] - shared
    i, j = np.nonzero((shared >= (threshold - 1e-7) * whole) & (root[0][:, None] != root[1][None, :]))
    exact = shared[i, j].astype(np.float64) / whole[i, j] >= threshold
    up: dict[int, int] = {}

    def find(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    out_a, out_b = [], []
    for p, q in zip(root[0][i[exact]].tolist(), root[1][j[exact]].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            up[max(p, q)] = min(p, q)
            out_a.append(p)
            out_b.append(q)
    return out_a, out_b


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, weights: str = "presence", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _h1, _h2, class_id, class_size, first: the class of near copies of each document.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles (words between white space, as they
    are; a shorter text is one shingle) is ``threshold`` or more; classes are the connected components. Equal texts are
    sketched by each document but compared as one. A link is a matter of the sets: with ``weights`` "presence" every shingle
    weighs 1, the probability Jaccard that the sketches estimate is the sets' Jaccard, and no link is missed for its weights.
    Texts that share a band are candidates; each is compared with the first
    of its bucket, and then, in blocks, with the others of that one's group that this has not put in its component, so a
    large bucket isn't expanded into its pairs and no candidate link between components is left out. ``weights`` "count"
    makes the sketches estimate the similarity weighted by the shingles' counts; verification is the same.

    class_id is the smallest id of the class. ``first`` marks one text of the class, with that id. A null or empty text (or
    one of white space) has no shingles and is a class of its own; null ids come last; repeated rows are in one class.
    """
    spark = docs.sparkSession
    s = sketches(docs, doc_id, text, weights)
    held = [s]
    texts = s.filter("n > 0").groupBy(*TEXT).agg(F.min("_id").alias("id"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    texts = store.keep(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    held.append(texts)
    banded = texts.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("band", "hub")
    star = store.keep(banded.join(hubs, "band").filter("node <> hub").select("hub", "node").distinct(), "stars")
    held.append(star)

    # The shingle sets of all candidates, from one document of each text.
    wanted = star.select("node").unionByName(star.select(F.col("hub").alias("node"))).distinct()
    wanted = texts.join(wanted, "node").select("node", F.col("id").alias("_wid"), F.col("_h1").alias("_w1"), F.col("_h2").alias("_w2"))
    given = _keyed(docs, text).select(F.col(f"`{doc_id}`").cast("long").alias("_id"), *TEXT, F.col(f"`{text}`").alias("_text"))
    given = given.join(wanted, (F.col("_h1") == F.col("_w1")) & (F.col("_h2") == F.col("_w2")) & F.col("_id").eqNullSafe(F.col("_wid"))).select("node", "_text")

    def sets(batches):
        for b in words.sliced(batches, "_text", 1 << 21):
            h, first = words.hashed(b.column(1), words.SPACED, words.ASIS)
            g, own, _ = minhash.shingles(h, first)
            at = np.searchsorted(own, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(g.view(np.int64)))], names=["node", "set"])

    shingled = store.keep(given.mapInArrow(sets, "node long, set array<long>").dropDuplicates(["node"]), "shingle-sets")
    held.append(shingled)
    hub_sets = shingled.select(F.col("node").alias("hub"), F.col("set").alias("hub_set"))
    both = star.join(shingled, "node").join(hub_sets, "hub").withColumn("shared", F.size(F.array_intersect("set", "hub_set")))
    alike = F.col("shared") / (F.size("set") + F.size("hub_set") - F.col("shared")) >= threshold
    near = store.keep(both.filter(alike).select(F.col("hub").alias("a"), F.col("node").alias("b")), "links")
    held.append(near)
    root = components(near)
    held.append(root)

    # Groups of a hub that hold more than its component (and more than a pair that was compared): the others against all.
    labelled = star.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_hub = root.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    labelled = labelled.join(of_hub, "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub")).withColumn("other", F.col("root") != F.col("hub_root"))
    labelled = store.keep(labelled.join(texts.select("node", "n"), "node"), "groups")
    held.append(labelled)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = labelled.groupBy("hub").agg(F.count(F.lit(1)).alias("all"), count(F.col("other")).alias("others"), F.sum("n").alias("n"), F.sum(F.when(F.col("other"), F.col("n"))).alias("n_others"))
    blocks = lambda size, n: F.ceil(F.greatest(F.col(size) / BLOCK, F.col(n) / BLOCK_SHINGLES)).cast("int")
    sums = sums.filter("others > 0 and `all` > 1").select("hub", blocks("others", "n_others").alias("ib"), blocks("all", "n").alias("jb"))
    work = labelled.join(sums, "hub").join(shingled, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = work.filter("other").select(*[F.col(c).alias(c) for c in ("hub", "node", "root", "set")], deal("ib").alias("i"), every("jb").alias("j"))
    right = work.select("hub", "node", "root", "set", deal("jb").alias("j"), every("ib").alias("i"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        got = links(a, b, threshold) if a.num_rows and b.num_rows else ([], [])
        return pa.table({"a": pa.array(got[0], pa.int64()), "b": pa.array(got[1], pa.int64())})

    more = left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub", "i", "j")).applyInArrow(meet, "a long, b long")
    joined = components(more)
    held.append(joined)
    over = joined.select(F.col("node").alias("root"), F.col("root").alias("over"))
    # A component that a later link joined to others may consist of one text, which ``root`` doesn't list.
    final = root.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    lone = over.join(root.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("over").alias("root"))
    final = final.unionByName(lone)
    named = store.keep(texts.join(final, "node", "left").select(*TEXT, F.coalesce("root", "node").alias("root"), "id"), "roots")
    held.append(named)
    placed = s.join(named, TEXT, "left")
    order = F.struct(F.col("id").isNull(), F.col("id"), "_h1", "_h2")
    best = named.groupBy("root").agg(F.min(order).alias("best"), F.min("id").alias("class_id"))
    sizes = s.filter("n > 0").groupBy(*TEXT).agg(F.count(F.lit(1)).alias("c")).join(named, TEXT).groupBy("root").agg(F.sum("c").alias("class_size"))
    # A table of its own, so that Spark can split a class that very many documents are in.
    best = store.keep(best.join(sizes, "root"), "class-heads")
    held.append(best)
    placed = placed.join(best, "root", "left")
    is_first = F.col("root").isNull() | ((F.col("_h1") == F.col("best._h1")) & (F.col("_h2") == F.col("best._h2")) & F.col("_id").eqNullSafe(F.col("class_id")))
    out = store.keep(placed.select("_id", *TEXT, F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), is_first.alias("first"), F.col("root").isNull().alias("alone")), "classes")
    store.drop(spark, *held)
    return out


def drop_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id. Documents without words all stay."""
    docs, names = store.packed(docs)
    doc_id, text = (f"p{names.index(c)}" for c in (doc_id, text))
    found = classes(docs, doc_id=doc_id, text=text, **options)
    keyed = _keyed(docs, text).withColumn("_id", F.col(f"`{doc_id}`").cast("long"))
    same = lambda other: F.col("_id").eqNullSafe(other["_k"]) & (F.col("_h1") == other["_k1"]) & (F.col("_h2") == other["_k2"])
    renamed = lambda df: df.select(F.col("_id").alias("_k"), F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"))
    gone = renamed(found.filter("not first"))
    again = renamed(found.filter("first and not alone").groupBy("_id", *TEXT).count().filter("count > 1"))
    # What goes grows with the documents, so it is never broadcast: the plan is the same at every size.
    once = keyed.join(gone.hint("merge"), same(gone), "left_anti")
    # A row that is there twice, with its id and text, stays once.
    if not again.limit(1).count():
        return once.select(*store.unpacked(names))
    again = store.keep(again, "repeated-rows")
    plain = once.join(again, same(again), "left_anti")
    repeated = once.join(again, same(again), "left_semi").dropDuplicates(["_id", *TEXT])
    return plain.unionByName(repeated).select(*store.unpacked(names))
