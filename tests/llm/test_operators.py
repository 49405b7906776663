"""Each operator against a brute-force version, and its defined results for nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import decontaminate, lines, lm, minhash, mixing, neardup, neighbours, quality, toxicity, urls, warc, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, size int"
VOCAB = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta", "vo", "zi") for b in ("n", "sa", "rel", "tion", "um", "ix")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, "mine", 7) for i, t, s in rows], SCHEMA)


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(1)
    same, long = prose(rng, 70), prose(rng, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, same, "b"), (4, same, None), (4, same, None), (5, long, "c"), (6, "Ünï cödé\u3000wörd", "a"), (None, None, None), (7, "one", "c"), (8, "one", "c")]


def test_word_hashes_split_like_a_pattern():
    rng = random.Random(2)
    texts = ["", None, "a", " a  b\tc\n", "Zoë,x9--y", "\u2003wide", "a\x0bb\x1cc"] + ["".join(rng.choice("aB9 ,\n\té日") for _ in range(rng.randrange(60))) for _ in range(200)]
    for table, fold, pattern in ((words.SPACED, words.ASIS, r"[^\x20\x09-\x0D]+"), (words.ALNUM, words.LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, first = words.hashed(pa.array(texts), table, fold)
        name = {}
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for i, t in enumerate(texts):
            found = re.findall(pattern, (t or "").translate(low) if fold is words.LOWER else t or "")
            got = h[first[i] : first[i + 1]].tolist()
            assert len(found) == len(got)
            for w, x in zip(found, got, strict=True):
                assert name.setdefault(w, x) == x
        assert len(set(name.values())) == len(name)
    sliced = pa.array(texts).slice(3, 5)
    assert np.array_equal(words.hashed(sliced, words.SPACED, words.ASIS)[0], words.hashed(pa.array(texts[3:8]), words.SPACED, words.ASIS)[0])


# 1 mixing


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 1 + int(rng.paretovariate(1.2) * 5) % 300), rng.choice(["hot"] * 5 + ["b", "c", "d", None])) for i in range(1500)]
    got = mixing.mix(docs(spark, rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([(s, size[s]) for s in order]), strict=True))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
        taken[r.source] += r.taken
    for s in order:
        assert taken[s] == pytest.approx(goal[s], rel=0.004), s
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_targets_reshare():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)], (5, 2, 1), 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([], (5, 2, 1)) == [] and mixing.targets([("a", 0), ("b", 10)]) == pytest.approx([0, 15])


def test_mix_odd_rows(spark):
    d = docs(spark, odd_rows())
    got = mixing.mix(d).collect()
    assert len(got) == len(odd_rows()) and all(r.taken == 0 for r in got if r["size"] == 0)
    plan = sorted((str(r.doc_id), r.taken) for r in got if r.copies and r["size"])
    out = mixing.expand(d).filter("size > 0")
    assert sorted((str(r.doc_id), r.taken) for r in out.filter("copy_no = 1").collect()) == plan
    assert mixing.mix(docs(spark, [])).count() == 0


# 2 neighbours


def brute_neighbours(x, ids, q, k):
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = u @ u[q]
    s[ids == ids[q]] = -9
    return [int(ids[i]) for i in np.lexsort((ids, -np.round(s, 12)))[:k]]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.7 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:900] = x[100]  # a vector that many rows share
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(v, v.filter("vec_id % 50 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = total = 0
    xd, ids = x.astype(float), np.arange(len(x))
    for q in range(0, 3000, 50):
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in own]
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert r.score == pytest.approx(xd[q] @ xd[r.vec_id] / np.sqrt((xd[q] ** 2).sum() * (xd[r.vec_id] ** 2).sum()), abs=1e-12)
        hits, total = hits + len({r.vec_id for r in own} & set(brute_neighbours(xd, ids, q, 5))), total + 5
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, [1.0]), (1, [1.0, 1.0]), (8, [1.0, 1.0]), (50, [2.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(v, v.filter("vec_id % 50 = 0"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [(0, 1, 50), (0, 2, 1), (0, 3, 8), (50, 1, 0), (50, 2, 1), (50, 3, 8)]
    assert neighbours.nearest(v.filter("vec_id < 0"), v).count() == 0


def test_neighbours_small_groups_get_all_they_ask_for(spark):
    rng = np.random.default_rng(8)
    far = np.repeat(np.eye(64) * 10, 3, axis=0) + 0.01 * rng.normal(size=(192, 64))
    x = np.concatenate([far, np.ones((1500, 64)) + 0.01 * rng.normal(size=(1500, 64))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(v, v.filter("vec_id < 48 or vec_id % 50 = 0")).groupBy("query_id").count().collect()
    assert len(got) == 48 + 1692 // 50 and {r["count"] for r in got} == {5}


def test_neighbours_repeated_ids_extreme_and_other_lengths(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [1e200, 0.0]), (3, [5e-324, 5e-324])] + [(4, [1.0, float(i)]) for i in range(40)] + [(100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.0]), (102, [3.0, 0.0, 0.0]), (103, [2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(v, v.filter("vec_id in (0, 1, 100, 103)"), k=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 12)))
    got = {k: sorted(x) for k, x in got.items()}
    assert got[0] == [(1, 3, 1.0), (2, 4, 1.0)] and got[1] == [(1, 2, 1.0), (2, 4, 1.0)]
    assert got[100] == [(1, 101, 1.0), (2, 102, round(1 / 14**0.5, 12))] and 103 not in got


def test_partitions_are_balanced():
    x = np.random.default_rng(1).normal(size=(512, 8))
    part = neighbours.balanced(neighbours.graph(x / np.linalg.norm(x, axis=1, keepdims=True), 8), 8)
    assert np.bincount(part).tolist() == [64] * 8


# 3 lines


def brute_lines(rows, least=50):
    """Delete every line that lies in a run of enough words of which a copy begins earlier."""
    order = sorted((r for r in rows if r[1]), key=lambda r: r[0])
    where = {}
    gone = {i: set() for i, _ in order}
    for i, t in order:
        ls = t.split("\n")
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(ls[a:b])
                if sum(len(x.split()) for x in run) >= least:
                    if where.setdefault(run, (i, a)) < (i, a):
                        gone[i] |= set(range(a, b))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in order}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([0, 3, 9, 20, 30, 60])) for _ in range(12)]
    passage = [prose(rng, 20) for _ in range(4)]
    rows = []
    for i in range(60):
        body = [rng.choice(pool) if rng.random() < 0.5 else prose(rng, 8) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.4:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randrange(2) :]
        rows.append((i, "\n".join(body), "s"))
    want = brute_lines([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r.text for r in lines.drop_copies(docs(spark, rows)).collect()}
    assert {i: got[i] for i in want} == want


def test_lines_odd_rows(spark):
    d = docs(spark, odd_rows())
    got = lines.drop_copies(d)
    assert got.columns == [*d.columns, "n_lines", "n_removed"] and got.count() == d.count()
    by = [(r.doc_id, r.text, r.n_removed) for r in got.collect()]
    same = odd_rows()[3][1]
    # The null id is last, so its copy goes; the row that is there twice is one document.
    assert (None, "", 1) in by and by.count((4, same, 0)) == 2 and (1, None, 0) in by and (2, "", 0) in by
    assert lines.drop_copies(docs(spark, [])).count() == 0
    assert lines.drop_copies(d.withColumns({"N_LINES": F.lit("x"), "_cuts": F.lit(1), "_d": F.lit(2)})).columns == [*d.columns, "_cuts", "_d", "n_lines", "n_removed"]


@pytest.mark.parametrize("first", [1, None])
def test_lines_of_repeated_rows(spark, first):
    rng = random.Random(16)
    passage, alone = [prose(rng, 20) for _ in range(5)], "\n".join(prose(rng, 20) for _ in range(5))
    shared = lambda: "\n".join([prose(rng, 9), *passage, prose(rng, 9)])
    early, late = shared(), shared()
    got = lines.drop_copies(docs(spark, [(first, early, "s")] * 2 + [(2, late, "s")] * 3 + [(3, alone, "s")] * 2)).collect()
    kept, cut = [(2, late), (first, early)][:: 1 if first is None else -1]
    bare = cut[1].split("\n")
    want = {kept: 0, (cut[0], f"{bare[0]}\n{bare[-1]}"): 5, (3, alone): 0}
    assert {(r.doc_id, r.text): r.n_removed for r in got} == want and len(got) == 7


def test_lines_run_without_python(spark):
    got = lines.drop_copies(docs(spark, odd_rows()))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


# 4 near duplicates


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for j in range(len(rows)):
        for i in range(j):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((d, min(least[find(i)])) for i, (d, _, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for _ in range(40):
        base = prose(rng, rng.choice([4, 30, 80, 200])).split()
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 40) + 2)):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((i, " ".join(w), "s"))
            i += 1
            if rng.random() < 0.3:
                base = w
    got = neardup.classes(docs(spark, rows))
    assert sorted((r._id, r.class_id) for r in got.collect()) == brute_classes(rows)
    kept = neardup.drop_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute_classes(rows)})


def test_near_duplicates_odd_rows(spark):
    d = docs(spark, odd_rows())
    got = sorted((str(r._id), str(r.class_id), r.class_size) for r in neardup.classes(d).collect())
    assert got.count(("4", "4", 3)) == 2 and ("None", "4", 3) in got and ("7", "7", 2) in got and ("8", "7", 2) in got and ("1", "1", 1) in got and ("2", "2", 1) in got
    kept = sorted(str(r.doc_id) for r in neardup.drop_copies(d.withColumn("_h1", F.lit("mine")).filter("_h1 = 'mine'")).collect())
    assert kept == sorted(["1", "2", "3", "4", "5", "6", "7", "None"])
    assert neardup.drop_copies(docs(spark, [])).count() == 0


def test_probminhash_estimates_weighted_similarity():
    rng = np.random.default_rng(6)
    g = words.mixed(np.arange(300))
    w = rng.integers(1, 6, 300).astype(float)
    other = np.where(np.arange(300) < 200, w, w[::-1])
    a = minhash.sketch(g, np.zeros(300, int), w, 1, 4096)[0]
    b = minhash.sketch(g, np.zeros(300, int), other, 1, 4096)[0]
    # Probability Jaccard: the sum over elements of 1 / sum of the larger ratios.
    want = sum(1 / np.maximum(w / w[i], other / other[i]).sum() for i in range(300))
    assert (a == b).mean() == pytest.approx(want, abs=0.03)


def test_links_by_block():
    rng = random.Random(7)
    base = [rng.getrandbits(60) for _ in range(100)]
    sets = [sorted(set(base[: 100 - k] + [rng.getrandbits(60) for _ in range(k)])) for k in (0, 2, 5, 30, 60)]
    t = pa.table({"node": pa.array(range(5)), "root": pa.array(range(5)), "set": pa.array(sets, pa.list_(pa.int64()))})
    a, b = neardup.links(t, t, 0.8)
    assert {0, 1, 2} == set(a) | set(b)


# 5 language model


def test_language_model(spark):
    rng = random.Random(8)
    succ = {w: [rng.choice(VOCAB) for _ in range(3)] for w in VOCAB}

    def text(n):
        w = [rng.choice(VOCAB)]
        for _ in range(n):
            w.append(rng.choice(succ[w[-1]]))
        return " ".join(w)

    rows = [(i, text(60), "s") for i in range(300)] + [(1000, None, "s"), (1001, "", "s"), (1002, "Zzz unseen KA kasa", "s"), (1003, text(50), "s"), (1003, text(50), "s")]
    d = docs(spark, rows).select("doc_id", "text")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    model, table = lm.fit(d.filter(~F.col("doc_id").isin(*held)))
    got = lm.score(d, model, table).collect()
    assert len(got) == len(rows)
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    c = Counter(w for i, t, _ in rows if i not in held for w in token(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, _ in rows:
        want[(i, len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t)), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.doc_id in held]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.9


def test_language_model_joins_rare_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 5)
    rng = random.Random(9)
    d = docs(spark, [(i, prose(rng, 40), "s") for i in range(40)] + [(3, "ka", "s"), (3, "ka", "s")]).select("doc_id", "text")
    model, table = lm.fit(d)
    few = lm.score(d, model, table).collect()
    monkeypatch.setattr(lm, "KNOWN", 1 << 17)
    assert len(model.known) <= 5 and all(r.n_known == r.n_tokens for r in few)
    assert all(r.score < 0 for r in few)


def test_language_model_trains_on_every_position(spark):
    rng = random.Random(11)
    d = docs(spark, [(i, prose(rng, 60), "s") for i in range(30)] + [(30, None, "s"), (31, "", "s")]).select("doc_id", "text")
    model, _ = lm.fit(d)
    assert lm._averaged(d, model, "text", 0.05) == model.total == 30 * 61 + 2
    assert lm._averaged(d.limit(0), model, "text", 0.05) == 0


def test_language_model_is_normalised(spark):
    rng = random.Random(10)
    d = docs(spark, [(i, prose(rng, 60), "s") for i in range(60)]).select("doc_id", "text")
    model, table = lm.fit(d)
    for ctx in ([model.classes] * lm.CONTEXT, [3, 4, 5][: lm.CONTEXT]):
        k = np.arange(model.classes)
        p = np.exp(model.class_log(k, np.tile(ctx, (len(k), 1))))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    # Within classes: the shares of all tokens, and in each cluster one for the unseen.
    rows = table.toPandas()
    h = rows["token"].to_numpy().view(np.uint64)
    mass = np.bincount(model.class_of(h), rows["c"] + 1, model.classes)
    mass[len(model.head) :] += 1
    assert np.allclose(mass, model.mass)


def test_language_model_of_nothing(spark):
    empty = docs(spark, []).select("doc_id", "text")
    model, table = lm.fit(empty)
    assert lm.score(empty, model, table).count() == 0
    assert lm.score(docs(spark, [(1, "a b", "s")]).select("doc_id", "text"), model, table).first().n_known == 0


# 6 and 8 classifiers


def labelled(spark, seed, bad):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        t, y = prose(rng, rng.randrange(5, 80)).split(), rng.random() < 0.3
        if y:
            for _ in range(3):
                t.insert(rng.randrange(len(t) + 1), rng.choice(bad))
        rows.append((i, " ".join(t), "s"))
        labels.append((i, int(y), int(y)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def held_out_accuracy(got, labels):
    y = {i: v for i, v, _ in labels}
    out = [(r.predicted, y[r.doc_id]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum(a == b for a, b in out) / len(out)


def test_toxicity(spark):
    d, labels, y = labelled(spark, 11, ["stupid", "moron", "trash"])
    model = toxicity.fit(d, labels)
    got = toxicity.score(d.select("doc_id", "text"), model).collect()
    assert held_out_accuracy(got, y) > 0.9 and all(0 <= r.score <= 1 for r in got)
    # Only labels outside the held-out fold count.
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(d.select("doc_id", "text"), toxicity.fit(d, other)).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)


def test_quality(spark):
    d, labels, y = labelled(spark, 12, ["***", "@@@!", "$$"])
    model = quality.fit(d, labels)
    got = quality.score(d.select("doc_id", "text", "n_chars"), model).collect()
    assert held_out_accuracy(got, y) > 0.9 and all(0 <= r.score <= 1 for r in got)


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    m = quality.Machine(50, 4)
    m.w, m.v = rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32)
    slots, x = np.array([1, 5, 9, 2, 5]), rng.normal(size=5)
    got = m.margin(slots, x, np.array([0, 3, 5]))[0]
    for (a, b), z in zip(((0, 3), (3, 5)), got, strict=True):
        want = sum(m.w[slots[i]] * x[i] for i in range(a, b)) + sum(m.v[slots[i]] @ m.v[slots[j]] * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert z == pytest.approx(want, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_odd_rows(spark, module, label):
    d, labels, _ = labelled(spark, 13, ["stupid", "moron"])
    model = module.fit(d, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 1), (5, 0, 0)], labels.schema)))
    odd = docs(spark, odd_rows())
    got = module.score(odd, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert module.score(docs(spark, []), model).count() == 0
    one = module.fit(d, labels.filter(f"{label} = 1"))
    assert one == 1.0 and module.score(odd, one).filter("score = 1.0").count() == len(odd_rows())
    assert module.fit(d, labels.filter("doc_id < 0")) == 0.5


def test_windows_cover_the_text():
    t = toxicity.folded("Some text, with words; and a veeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeery long one".encode())
    w = toxicity.windows(t, 16)
    assert b"".join(x[:-1] for x in w) + b" " == t and toxicity.windows(b"") == []


# 7 decontamination


def brute_leaks(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {}
    for i, t in items:
        w = find(t)
        for k in range(len(w) - min(8, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + min(8, len(w))]), set()).add(i)
    out = Counter()
    for d, t, _ in rows:
        w, hit, found = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in own if i is not None}
        out[(d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)] += 1
    return out


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(14)
    items = [(i, prose(rng, rng.choice([3, 7, 8, 12, 30]))) for i in range(12)] + [(20, None), (21, ""), (None, prose(rng, 10)), (3, prose(rng, 9)), (22, "?!"), (23, "solo")]
    rows = odd_rows()
    for i in range(100, 160):
        parts = [prose(rng, rng.randrange(1, 30))]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items[:12])[1] if rng.random() < 0.8 else "Solo").split()
            a = rng.randrange(len(w))
            parts += [", ".join(w[a:]).upper() if rng.random() < 0.5 else " ".join(w), prose(rng, 3)]
        rows.append((i, " ".join(parts), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows).select("doc_id", "text")
    got = decontaminate.find_leaks(d, bench)
    assert Counter(tuple(r) for r in got.collect()) == brute_leaks(rows, items)
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark, []).columns and clean.count() == sum(n for k, n in brute_leaks(rows, items).items() if not k[-1])
    assert decontaminate.find_leaks(docs(spark, []).select("doc_id", "text"), bench).count() == 0
    assert decontaminate.find_leaks(d, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_pipeline_drops_one_leaked_item(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    items = [prose(rng, 20), prose(rng, 20)]
    spark.createDataFrame([(1, items[0]), (None, items[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, prose(rng, 40), "s") for i in range(3)] + [(10 + k, f"{prose(rng, 9)} {t} {prose(rng, 9)}", "s") for k, t in enumerate(items)]
    got = corpus_pipeline.drop_leaks(spark, docs(spark, rows), str(tmp_path))
    assert got.columns == docs(spark, []).columns and sorted(r.doc_id for r in got.collect()) == [0, 1, 2]


# 9 urls


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/x?y=/es/", "a.example.org", "/x", "org/", "allow"),
        ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        ("https://m.example.org/en/15#f", "m.example.org", "/en/15", "example.org/en/1", "block"),
        ("x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
        ("x://b.com/de/?q", "b.com", "/de/", "com/de/", "block"),
        ("x://b.com", "b.com", "", None, "allow"),
        ("x://com?/de/", "com", "", None, "allow"),
        ("no host", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("a\nb://C.net/p\nq", "c.net", "/p\nq", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")
    r = urls.judge(pages).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_distrust_spreads_against_links(spark):
    link = lambda *to: "".join(f'<a href="{t}">' for t in to)
    rows = [(1, "http://good.org/", link("http://friend.net/a", "//pal.net")), (2, "http://bad.com/de/1", ""), (3, "http://feeder.net/", link("http://bad.com/x", "HTTP://bad.com/y", "/own")), (4, "http://friend.net/", None), (5, "http://pal.net/", "x"), (6, "http://lone.net/", link("/only")), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", None: "allow"}
    assert urls.judge(pages.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", urls.judge(pages)._jdf.queryExecution().executedPlan().toString())


def test_pagerank_equals_power_iteration(spark):
    rng = np.random.default_rng(5)
    e = {(a, b) for a, b in rng.integers(0, 12, (40, 2)).tolist() if a != b and a < 10}
    m = np.zeros((12, 12))
    for a, b in e:
        m[b, a] = 1 + (a + b) % 3
    m = m / np.where(m.sum(0) > 0, m.sum(0), 1)
    s = np.zeros(12)
    s[[1, 4]] = 1, 3
    r = s.copy()
    for _ in range(urls.ROUNDS):
        r = urls.DAMPING * m @ r + (1 - urls.DAMPING) * s
    edges = spark.createDataFrame([(str(a), str(b), float(1 + (a + b) % 3)) for a, b in e], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("1", 1.0), ("4", 3.0)], "node string, seed double")
    got = {int(x.node): x["rank"] for x in urls.spread(edges, seeds).collect()}
    assert all(got.get(i, 0) == pytest.approx(r[i], abs=1e-9) for i in range(12))


# 10 WARC


def test_warc_round_trip(spark):
    big, odd = "x" * 150, "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: 1", big), (9, None, None), (7, "u", "short"), (8, "u", "short"), (3, "again", big), (None, "n", big), (11, "z", odd), (12, "z", odd), (None, "m", "q" * 120), (None, "m", "q" * 120), (13, "long", "ab" * 1_000_000)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, digest string")
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    least = {}
    for p, _, t in rows:
        if p is not None:
            least[t] = min(p, least.get(t, p))
    want = []
    for p, _, t in rows:
        b = (t or "").encode()
        to = least.get(t) if len(b) >= 100 and p != least.get(t) else None
        want.append((str(p), len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_in_any_chunks():
    recs = [warc.record(i, f"u{i}", b"p" * i, "d", None if i % 3 else 1) for i in range(20)]
    import gzip
    import io

    for raw in (gzip.compress(b"".join(recs)), b"".join(gzip.compress(r) for r in recs)):
        assert list(warc.records(warc.inflated(io.BytesIO(raw)))) == recs
    for n in (1, 7, 1000):
        whole = b"".join(recs)
        assert list(warc.records(whole[i : i + n] for i in range(0, len(whole), n))) == recs
    with pytest.raises(ValueError):
        list(warc.records([b"".join(recs)[:-9]]))


def test_warc_cut_archives_are_errors(spark, tmp_path):
    import gzip
    import io

    recs = [warc.record(i, f"u{i}", b"p" * 300, "d", None) for i in range(20)]
    whole = gzip.compress(b"".join(recs))
    members = [gzip.compress(r) for r in recs]
    for raw in (whole[:-8], whole[: len(whole) // 2], b"".join(members)[:-3], b""):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(warc.inflated(io.BytesIO(raw))))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members[:-1]))
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), 20)], "path string, records long")
    with pytest.raises(Exception, match="19 records, 20 were written"):
        warc.normalise(archives, f"{tmp_path}/out").count()
    assert warc.normalise(archives.select("path"), f"{tmp_path}/out").first().records == 19


def test_warc_inflates_in_bounded_pieces():
    import gzip
    import io

    raw = gzip.compress(bytes(60 << 20))
    sizes = [len(x) for x in warc.inflated(io.BytesIO(raw))]
    assert sum(sizes) == 60 << 20 and max(sizes) <= warc.INFLATED


def brute_matches(a, b, width):
    """Maximal common word runs of a document and an item, as (item start, document start, length)."""
    out, width = set(), min(width, len(b))
    for i in range(len(b)):
        for j in range(len(a)):
            if b[i] == a[j] and (i == 0 or j == 0 or b[i - 1] != a[j - 1]):
                n = 0
                while i + n < len(b) and j + n < len(a) and b[i + n] == a[j + n]:
                    n += 1
                if n >= width > 0:
                    out.add((i, j, n))
    return out


def test_longest_matches_and_their_places(spark, monkeypatch):
    rng = random.Random(12)
    few = VOCAB[:3]
    items = [("a", prose(rng, 30)), ("b", " ".join(rng.choice(few) for _ in range(25))), ("c", "one two three"), ("d", None), (None, prose(rng, 12)), ("a", prose(rng, 9)), ("e", "ka " * 12)]
    texts = [None, "", prose(rng, 40), " ".join(rng.choice(few) for _ in range(60)), "x One, TWO three y one two three", items[0][1], prose(rng, 5) + " " + items[0][1][20:] + " " + items[4][1], "ka " * 20, " ".join(items[0][1].split()[:7])]
    d = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate([*texts, texts[5]])], "doc_id long, text string, item_id string, length int")
    item = spark.createDataFrame(items, "item_id string, text string")
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = Counter((i, k, *m) for i, t in enumerate([*texts, texts[5]]) for k, w in items for m in brute_matches(tokens(t), tokens(w), 8))
    for size in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.matches(d, item)
        assert got.columns == ["doc_id", "item_id", "item_start", "doc_start", "length"]
        assert Counter(map(tuple, got.collect())) == want and len(want) > 20
