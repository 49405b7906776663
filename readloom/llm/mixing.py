"""Mixing sources to target weights by entropy balancing (operator 1)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, repeating; the share of all sizes; a target's and a document's largest multiple.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
#: The divergence of a document counts with its size to this power: at 1 every document of a source gets one rate, at 0 the
#: tilt is exponential in the plain size.
SIZE_POWER = 0.9
#: Documents in a rounding block, about.
BLOCK = 20000
#: A source's words come this near its target, as a share of it, if its documents are small enough; rounds that try for it.
NEAR, REPAIRS = 0.002, 4
#: Sources whose totals (a few numbers each) the driver may hold.
MAX_SOURCES = 1_000_000


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Split ``share`` of all sizes by weight; what a source can't take beyond ``cap`` times its size is reshared by weight."""
    size = np.array([n for _, n in totals], float)
    weight = np.array([weights[i % len(weights)] for i in range(len(totals))], float)
    out, left, open_ = np.zeros(len(size)), share * size.sum(), np.ones(len(size), bool)
    while open_.any():
        part = left * weight[open_] / weight[open_].sum()
        over = part > cap * size[open_]
        where = np.flatnonzero(open_)
        if not over.any():
            out[where] = part
            break
        out[where[over]] = cap * size[where[over]]
        left -= out[where[over]].sum()
        open_[where[over]] = False
    return out.tolist()


def solve(cells: DataFrame, sources: list, goal: list[float], cap: float = CAP, rounds: int = 60) -> dict:
    """Newton's method on the convex dual: the tilt of each source whose rates meet its token constraint.

    Over documents i of source s the rates minimise the divergence sum(v_i (r_i ln r_i - r_i)) from rate 1 under
    sum(r_i size_i) = target_s and r_i <= cap, so r_i = min(cap, exp(tilt_s z_i)) with z_i = size_i / v_i. Each round is one
    distributed aggregate over the (source, size) cells, which gives every source its constraint's gap (the dual's gradient)
    and slope (its curvature); a bracket keeps each step safe. Sources at their cap have every rate at the cap and no tilt.
    """
    spark = cells.sparkSession
    at = np.zeros(len(sources))
    low, high = np.full(len(sources), -np.inf), np.full(len(sources), np.inf)
    open_ = np.ones(len(sources), bool)
    goal = np.array(goal)
    place = {s: i for i, s in enumerate(sources)}
    for _ in range(rounds):
        if not open_.any():
            break
        now = spark.createDataFrame([(sources[i], float(at[i])) for i in np.flatnonzero(open_)], "source string, tilt double")
        eta = F.col("tilt") * F.col("z")
        free = F.when(eta < float(np.log(cap)), F.exp(eta))
        tokens = F.col("n") * F.col("size")
        got = cells.join(now, cells["source"].eqNullSafe(now["source"])).drop(now["source"])
        for r in got.groupBy("source").agg(F.sum(tokens * F.coalesce(free, F.lit(float(cap)))).alias("sum"), F.sum(tokens * free * F.col("z")).alias("slope")).collect():
            i = place[r.source]
            gap, slope = r.sum - goal[i], r.slope or 0.0
            if abs(gap) <= 1e-9 * max(goal[i], 1):
                open_[i] = False
                continue
            low[i], high[i] = (at[i], high[i]) if gap < 0 else (low[i], at[i])
            step = at[i] - gap / slope if slope > 0 else np.nan
            if not low[i] < step < high[i]:
                step = (low[i] + high[i]) / 2 if np.isfinite(low[i]) and np.isfinite(high[i]) else at[i] + (1 if gap < 0 else -1) * max(1.0, abs(at[i]))
            if step == at[i] or high[i] - low[i] < 1e-12 * max(1.0, abs(at[i])):
                open_[i] = False
            at[i] = step
    return dict(zip(sources, np.round(at, 9).tolist(), strict=True))  # the last bits depend on the order of the sums


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The copies that the mix takes of each document, in whole numbers up to ``cap``.

    Returns a row for each document: doc_id, size (words; null text: 0), source, source_size, target, rate, copies, taken
    (words, repeats counted). Rates come from ``solve``; systematic sampling along the sizes of a source rounds them, so that
    its words are off by less than its largest document, and small documents then take or leave a copy to come nearer.
    Equal rows may get different copies, but the numbers of copies are the same in each run. A null source is a source, the
    last; an empty one takes nothing; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    own = store.keep(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size")), "mix-sizes")
    cells = own.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = sorted(((r.source, r.total) for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total")).limit(MAX_SOURCES + 1).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets(totals, weights, share, cap)
    count = {r.source: r.n for r in cells.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    full = [n > 0 and g >= cap * n for (_, n), g in zip(totals, goal, strict=True)]
    open_ = [(s, n, g) for (s, n), g, f in zip(totals, goal, full, strict=True) if not f and n > 0]
    power = 1.0 - SIZE_POWER
    # z is 1 for a document of the mean size.
    means = spark.createDataFrame([(s, float(n) / count[s]) for s, n, _ in open_], "source string, mean double")
    pairs = store.keep(cells.join(means, cells["source"].eqNullSafe(means["source"])).select(cells["source"], "size", "n", F.pow(F.col("size") / F.col("mean"), F.lit(power)).alias("z")), "mix-cells")
    tilt = solve(pairs, [s for s, _, _ in open_], [g for _, _, g in open_], cap)
    plan = [(s, int(n), float(g), f, float(tilt.get(s, 0.0)), float(n) / max(count[s], 1) or 1.0) for (s, n), g, f in zip(totals, goal, full, strict=True)]
    by_source = spark.createDataFrame(plan, "source string, source_size long, target double, full boolean, tilt double, mean double")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.pow(F.col("size") / F.col("mean"), F.lit(power)))))
    rated = own.join(by_source, own["source"].eqNullSafe(by_source["source"])).drop(by_source["source"]).withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))

    # Systematic sampling in order of size: a document takes as many copies as its stretch of the summed rates has whole numbers.
    # Sums run within blocks of one source and size band, and blocks are chained by their totals.
    band = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    rated = rated.withColumn("band", band).withColumn("hash", F.xxhash64("doc_id", "size"))
    bands = rated.groupBy("source", "band").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("parts"))
    rated = rated.join(bands.withColumnsRenamed({"source": "_s", "band": "_b"}), F.col("source").eqNullSafe(F.col("_s")) & (F.col("band") == F.col("_b"))).drop("_s", "_b")
    rated = store.keep(rated.withColumn("part", F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int")).drop("parts"), "mix-rated")
    block = Window.partitionBy("source", "band", "part").orderBy("size", "hash", "doc_id")
    chain = Window.partitionBy("source").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rated.groupBy("source", "band", "part").agg(F.sum(F.col("rate").cast("decimal(20,12)")).alias("sum"))
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(chain), F.lit(0))).select(F.col("source").alias("_s"), F.col("band").alias("_b"), F.col("part").alias("_p"), "base")
    placed = rated.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("band") == F.col("_b")) & (F.col("part") == F.col("_p"))).drop("_s", "_b", "_p")
    exact = F.col("rate").cast("decimal(20,12)")
    end = F.col("base") + F.sum(exact).over(block.rowsBetween(Window.unboundedPreceding, 0)) + F.lit("0.5").cast("decimal(2,1)")
    placed = placed.withColumn("end", end).withColumn("copies", (F.floor("end") - F.floor(F.col("end") - exact)).cast("int"))
    placed = store.keep(placed.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(int(cap)), F.col("copies")))).drop("end", "base"), "mix-placed")
    used = [own, pairs, rated]
    for _ in range(REPAIRS):
        nearer = _repair(placed, int(cap))
        if nearer is None:
            break
        used.append(placed)
        placed = nearer
    store.drop(spark, *used)
    return placed.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _repair(placed: DataFrame, cap: int) -> DataFrame | None:
    """One more or one less copy for some small documents of each source that is off its target; None where none is.

    A document of up to an eighth of the gap (or the gap, in the last rounds' small sources) changes while the changes' sum
    stays within the gap; the order is by falling size within blocks chained as before, so no source is in a single task.
    """
    spark = placed.sparkSession
    off = placed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.first("target").alias("goal")).withColumn("gap", F.col("goal") - F.col("got"))
    off = [(r.source, float(r.gap)) for r in off.filter(F.abs("gap") > NEAR * F.col("goal")).collect()]
    if not off:
        return None
    gaps = spark.createDataFrame(off, "_s string, gap double")
    joined = placed.join(gaps, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    up = F.col("gap") > 0
    can = F.coalesce((F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & F.when(up, F.col("copies") < cap).otherwise(F.col("copies") > 0), F.lit(False))
    # Large documents first, so that small ones fill what is left.
    joined = joined.withColumn("can", can.cast("int"))
    block = Window.partitionBy("source", "band", "part").orderBy(F.desc("size"), "hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chain = Window.partitionBy("source").orderBy(F.desc("band"), "part").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("can") * F.col("size")
    sums = joined.filter("can = 1").groupBy("source", "band", "part").agg(F.sum("size").alias("sum"))
    # A band goes before smaller ones only with as much as fits: blocks beyond the gap are skipped as wholes, later smaller ones may fit in a later round.
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(chain), F.lit(0))).select(F.col("source").alias("_s"), F.col("band").alias("_b"), F.col("part").alias("_p"), "base")
    run = joined.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("band") == F.col("_b")) & (F.col("part") == F.col("_p")), "left").drop("_s", "_b", "_p")
    run = run.withColumn("run", F.col("base") + F.sum(weight).over(block))
    change = F.when((F.col("can") == 1) & (F.col("run") <= F.abs("gap")), F.when(up, 1).otherwise(-1)).otherwise(0)
    out = store.keep(run.withColumn("copies", F.col("copies") + change).select(*placed.columns), "mix-nearer")
    return out


def expand(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with copy_no (from 1), size, source_size, target, copies, taken.

    Columns of those names give way. Documents of which no copy is taken are left out. Rows are matched by id and size; where several rows share both, the
    copies of all of them are dealt in order.
    """
    given = {k: options.pop(k, k) for k in ("doc_id", "text", "source")}
    docs, names = store.packed(docs, "size", "source_size", "target", "copies", "taken", "copy_no")
    at = {k: f"p{names.index(c)}" for k, c in given.items()}
    plan = mix(docs, **at, **options)
    size = F.coalesce(F.regexp_count(F.col(at["text"]), F.lit(WORD)), F.lit(0)).cast("long")
    key = lambda i, s: F.sha2(F.to_json(F.struct(F.coalesce(F.col(i).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(s), F.lit("")).alias("s"), F.col(s).isNull().alias("n"), F.col(i).isNull().alias("m"), F.col("size"))), 256)
    own = Window.partitionBy("_key")
    left = docs.withColumn("size", size).withColumn("_key", key(at["doc_id"], at["source"])).withColumn("_turn", F.row_number().over(own.orderBy(F.xxhash64(at["text"]))))
    right = plan.withColumn("_key", key("doc_id", "source")).withColumn("_turn", F.row_number().over(own.orderBy("copies")))
    joined = left.join(right.filter("copies > 0").select("_key", "_turn", "source_size", "target", "copies", "taken"), ["_key", "_turn"])
    return joined.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*store.unpacked(names), "size", "source_size", "target", "copies", "taken", "copy_no")
