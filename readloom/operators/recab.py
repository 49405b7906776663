"""Recalibration of base qualities by covariates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bases as bs
from ..functions import cigar as cg
from ..functions import flags as fl
from ..functions.bases import OFFSET
from ..functions.flags import LAST, REVERSE
from ..functions.surgery import MATCH_OPS, PATTERN, REF_OPS

CELL = ["rg", "qual", "cycle", "second", "prev", "cur"]
EXCLUDED, MIN_QUALITY, MAX_QUALITY = 0xF04, 5, 50
#: The previous base of the first cycle.
NONE_BEFORE = "K"
#: Places of a table of qualities that every executor may hold (a byte each), and cells that the driver may read; larger ones are joined.
DENSE, CELLS = 1 << 27, 1 << 22
#: Reference bases of a chunk, at least.
CHUNK = 1024


def eligible(excluded: int = EXCLUDED) -> Column:
    """Reads that build the table: no excluded bit, mapq known and not 0, on a known reference, one quality for each base."""
    return ~fl.has(F.col("flag"), excluded) & ~F.col("mapq").isin(0, 255) & (F.col("ref_id") >= 0) & (F.length("seq") == F.length("qual"))


# What tasks run refers to plain values only, not to modules: the package travels by value, and a module's UDFs hold a session.
_CODE = np.full(256, 9, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of ASCII strings back to back."""
    _, ends, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _sequenced(flag: pa.Array, seq: pa.Array, qual: pa.Array) -> dict:
    """Bases of reads back to back, with as many qualities: n of each read, and flat arrays; codes are 0-3 for ACGT, 4 for none before."""
    n = pc.binary_length(seq).to_numpy(zero_copy_only=False).astype(np.int64)
    f = flag.to_numpy(zero_copy_only=False).astype(np.int64)
    base, phred = _CODE[_bytes(seq)], _bytes(qual).astype(np.int64) - OFFSET
    back = np.repeat(f & REVERSE > 0, n)
    pos = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
    cycle = np.where(back, np.repeat(n, n) - 1 - pos, pos)
    # The base sequenced before: on the left of a forward read's base, on the right of a reverse read's.
    earlier = np.clip(np.arange(len(base)) + np.where(back, 1, -1), 0, max(len(base) - 1, 0))
    cur = np.where(back & (base < 4), 3 - base, base)
    return {"n": n, "phred": phred, "back": back, "cycle": cycle, "earlier": earlier, "cur": cur, "prev": np.where(cycle == 0, 4, np.where(cur[earlier] < 4, cur[earlier], 9)), "second": np.repeat(f & LAST > 0, n).astype(np.int64)}


def _place(group, phred, cycles, cycle, second, prev, cur):
    """The number of a cell."""
    return ((((group * 94 + phred) * cycles + cycle) * 2 + second) * 5 + prev) * 4 + cur


def explode_bases(reads: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each base in the order of sequencing: cycle from 0, cur, prev, qual, ref_pos and prev_pos (null if not aligned).

    A reverse read runs backwards with complemented bases. Previous values come by index from the read's own arrays, so
    nothing is sorted or shuffled.
    """
    back = fl.has(F.col("flag"), fl.REVERSE)
    seq = F.when(back, bs.reverse_complement(F.col("seq"))).otherwise(F.upper("seq"))
    turn = lambda a: F.when(back, F.reverse(a)).otherwise(a)
    packed = F.arrays_zip(F.split(seq, "").alias("cur"), turn(bs.phreds(F.col("qual"))).alias("qual"), turn(cg.ref_offsets(F.col("cigar"))).alias("off"))
    r = reads.select(*dict.fromkeys([*keep, "pos0"]), fl.has(F.col("flag"), fl.LAST).alias("second"), packed.alias("_b"))
    x = r.select(*dict.fromkeys([*keep, "pos0"]), "second", "_b", F.posexplode("_b").alias("cycle", "_x"))
    last = F.when(F.col("cycle") > 0, F.try_element_at("_b", F.col("cycle")))
    return x.select(*dict.fromkeys([*keep, "pos0"]), "second", "cycle", F.col("_x.cur").alias("cur"), F.col("_x.qual").alias("qual"), (F.col("pos0") + F.col("_x.off")).alias("ref_pos"), F.coalesce(last["cur"], F.lit(NONE_BEFORE)).alias("prev"), (F.col("pos0") + last["off"]).alias("prev_pos"))


def _chunks(ref: DataFrame, sites: DataFrame | None, length: int, reach: int) -> DataFrame:
    """ref_id, chunk, bases, known: stretches of ``length`` + ``reach`` places, so that a read lies whole in the chunk of its start.

    A place without a reference base is N; ``known`` has 1 at known sites and 0 elsewhere.
    """
    rows = ref.select("ref_id", F.col("pos").cast("long").alias("pos"), F.upper("base").alias("base"))
    if sites is not None:
        rows = rows.unionByName(sites.select("ref_id", F.col("pos0").cast("long").alias("pos"), F.lit(None).cast("string").alias("base")))
    own = F.floor(F.col("pos") / length)
    rows = rows.withColumn("chunk", F.explode(F.when(F.col("pos") - own * length < reach, F.array(own, own - 1)).otherwise(F.array(own)))).filter("chunk >= 0")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        bases, known = np.full(length + reach, ord("N"), np.uint8), np.full(length + reach, ord("0"), np.uint8)
        at, base = t["pos"].to_numpy() - key[1].as_py() * length, t["base"].to_pylist()
        for i, c in zip(at.tolist(), base, strict=True):
            if c is None:
                known[i] = ord("1")
            elif c in ("A", "C", "G", "T"):
                bases[i] = ord(c)
        return pa.table({"ref_id": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int64()), "bases": [bases.tobytes().decode()], "known": [known.tobytes().decode()]})

    return rows.withColumn("ref_id", F.col("ref_id").cast("int")).groupBy("ref_id", "chunk").applyInArrow(build, "ref_id int, chunk long, bases string, known string")


def covariates(reads: DataFrame, ref: DataFrame, *, sites: DataFrame | None = None, min_quality: int = MIN_QUALITY, excluded: int = EXCLUDED, keep_prev_site: bool = False, keep_prev_gap: bool = False, max_span: int | None = None) -> DataFrame:
    """Matches and mismatches for each cell (rg, qual, cycle, second, prev, cur).

    ``ref`` has ref_id, pos, base. A base counts if it is aligned, of ``min_quality`` or more, over an unambiguous reference
    base, not at a known site, and (unless told otherwise) its previous base is the neighbour on the reference and not at a
    known site either. Each read meets its stretch of the reference once, by the chunk of its start; its bases are compared
    there and summed by cell before the only other shuffle, so no base is shuffled. ``max_span`` is the number of reference
    bases that a read spans at most, found by a pass over the reads where it isn't given.
    """
    own = reads.filter(eligible(excluded))
    span = cg.ref_span(F.col("cigar"))
    reach = max_span or own.agg(F.max(span)).first()[0] or 1
    length = max(CHUNK, 1 << (reach - 1).bit_length())
    own = own.withColumn("_span", F.when(span > reach, F.raise_error(F.lit(f"a read spans more than {reach} reference bases"))).otherwise(span))
    own = own.withColumn("ref_id", F.col("ref_id").cast("int")).withColumn("chunk", F.floor(F.col("pos0") / length))
    met = own.join(_chunks(ref, sites, length, reach), ["ref_id", "chunk"])
    part = lambda c: F.substring(c, (F.col("pos0") - F.col("chunk") * length + 1).cast("int"), F.col("_span"))
    met = met.select("rg", "flag", "cigar", "seq", "qual", part("bases").alias("bases"), part("known").alias("known"))
    gap, site = not keep_prev_gap, not keep_prev_site
    ddl = "rg string, qual int, cycle int, second boolean, prev string, cur string, matches long, mismatches long"

    def count(batches):
        memo: dict = {}

        def offsets(cigar: str | None, n: int) -> np.ndarray:
            if (cigar, n) not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[cigar, n] = _offsets(cigar, n)
            return memo[cigar, n]

        for batch in batches:
            if not batch.num_rows:
                continue
            rg, flag, cigar, seq, qual, bases, known = batch.columns
            x = _sequenced(flag, seq, qual)
            n = x["n"]
            off = np.concatenate([offsets(c, k) for c, k in zip(cigar.to_pylist(), n.tolist(), strict=True)])
            own = np.repeat(np.arange(len(n)), n)
            size = pc.binary_length(bases).to_numpy(zero_copy_only=False).astype(np.int64)
            at = (np.cumsum(size) - size)[own] + np.maximum(off, 0)
            first = x["cycle"] == 0
            before = np.where(first, -1, off[x["earlier"]]) if len(off) else off
            free = _bytes(known) == ord("0")
            ref = _CODE[_bytes(bases)]
            inside = np.flatnonzero((off >= 0) & (off < size[own]) & (x["phred"] >= min_quality) & (x["cur"] < 4) & (first | (x["prev"] < 4)))
            inside = inside[(ref[at[inside]] < 4) & free[at[inside]]]
            if gap:
                inside = inside[first[inside] | ((before[inside] >= 0) & (np.abs(off[inside] - before[inside]) == 1))]
            if site:
                inside = inside[(before[inside] < 0) | free[at[inside] - off[inside] + np.maximum(before[inside], 0)]]
            if not len(inside):
                continue
            names = pc.dictionary_encode(rg, null_encoding="encode")
            y = {k: v[inside] for k, v in x.items() if k != "n"}
            cycles = int(x["cycle"].max()) + 1
            r = ref[at[inside]]
            key, back = np.unique(_place(names.indices.to_numpy()[own[inside]].astype(np.int64), y["phred"], cycles, y["cycle"], y["second"], y["prev"], y["cur"]), return_inverse=True)
            total = np.bincount(back)
            same = np.bincount(back, np.where(y["back"], 3 - r, r) == y["cur"]).astype(np.int64)
            key, cur = divmod(key, 4)
            key, prev = divmod(key, 5)
            key, second = divmod(key, 2)
            key, cycle = divmod(key, cycles)
            group, phred = divmod(key, 94)
            letters = pa.array(list("ACGT" + NONE_BEFORE))
            cells = [names.dictionary.take(pa.array(group)), *[pa.array(v.astype(np.int32)) for v in (phred, cycle)], pa.array(second.astype(bool)), letters.take(pa.array(prev)), letters.take(pa.array(cur)), pa.array(same), pa.array(total - same)]
            yield pa.RecordBatch.from_arrays(cells, names=[*CELL, "matches", "mismatches"])

    return met.mapInArrow(count, ddl).groupBy(*CELL).agg(F.sum("matches").alias("matches"), F.sum("mismatches").alias("mismatches"))


def _offsets(cigar: str | None, n: int) -> np.ndarray:
    """Of each of a read's n bases the offset from the alignment's start, -1 where it isn't aligned."""
    out, at = [np.zeros(0, np.int64)], 0
    for size, op in re.findall(PATTERN, cigar or "*"):
        if op in MATCH_OPS:
            out.append(np.arange(at, at + int(size)))
        elif op in "IS":
            out.append(np.full(int(size), -1))
        if op in REF_OPS:
            at += int(size)
    got = np.concatenate(out)[:n]
    return np.concatenate([got, np.full(n - len(got), -1)]).astype(np.int64)


def empirical(cells: DataFrame) -> DataFrame:
    return cells.withColumn("q_emp", bs.phred_of(F.col("mismatches"), F.col("matches") + F.col("mismatches")))


def table_lines(cells: DataFrame) -> DataFrame:
    """The table as text: rg,qual,cycle,prevcur,total,mismatches,q; cycles count from 1 and are negative in second reads."""
    cycle = F.when(F.col("second"), -(F.col("cycle") + 1)).otherwise(F.col("cycle") + 1)
    return empirical(cells).select(F.concat_ws(",", "rg", F.col("qual").cast("string"), cycle.cast("string"), F.concat("prev", "cur"), (F.col("matches") + F.col("mismatches")).cast("string"), F.col("mismatches").cast("string"), F.col("q_emp").cast("string")).alias("value"))


def apply(reads: DataFrame, cells: DataFrame, *, max_quality: int = MAX_QUALITY, min_quality: int = MIN_QUALITY, excluded: int = 0, quality: str = "q_emp") -> DataFrame:
    """``reads`` with recalibrated qualities: each base takes its cell's ``quality``, at most ``max_quality``.

    ``quality`` names the empirical quality or a column of ``cells``. Bases below ``min_quality`` and those without a cell keep
    theirs; so do reads with an excluded bit. Cells are few (read groups by qualities by cycles by base pairs): where a dense
    table of them has up to DENSE places, executors get it whole, and every read's qualities are replaced in place, without a
    shuffle. A larger table is joined base by base.
    """
    q = (empirical(cells) if quality == "q_emp" else cells).select(*CELL, F.least(F.col(quality), F.lit(max_quality)).cast("int").alias("_q"))
    got = q.filter(F.col("rg").isNotNull() & F.col("qual").between(0, 93)).limit(CELLS + 1).toArrow()
    groups = sorted(set(got["rg"].to_pylist()))
    cycles = (pc.max(got["cycle"]).as_py() or 0) + 1
    size = max(len(groups) * 94 * cycles * 2 * 5 * 4, 1)
    if size > DENSE or got.num_rows > CELLS:
        return _apply_joined(reads, q, min_quality, excluded)
    table = np.full(size, -1, np.int8)
    if got.num_rows:
        code = pa.array(list("ACGT" + NONE_BEFORE))
        place = lambda c, values: pc.index_in(got[c], value_set=values).to_numpy().astype(np.int64)
        second = got["second"].to_numpy().astype(np.int64)
        table[_place(place("rg", pa.array(groups)), got["qual"].to_numpy(), cycles, got["cycle"].to_numpy(), second, place("prev", code), place("cur", code))] = got["_q"].to_numpy()
    held, names = reads.sparkSession.sparkContext.broadcast(table), pa.array(groups, pa.string())

    def turned(rg: pa.Array, flag: pa.Array, seq: pa.Array, qual: pa.Array) -> pa.Array:
        """New quality strings of reads whose bases and qualities are as many."""
        x = _sequenced(flag, seq, qual)
        n, phred = x["n"], x["phred"]
        group = np.repeat(pc.index_in(rg, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), n)
        ok = (x["cur"] < 4) & (x["prev"] < 5) & (x["cycle"] < cycles) & (phred >= max(min_quality, 0)) & (phred < 94) & (group >= 0)
        at = np.where(ok, _place(group, phred, cycles, x["cycle"], x["second"], x["prev"], x["cur"]), 0)
        new = np.where(ok, held.value[at], -1)
        text = np.where(new >= 0, new, phred).astype(np.uint8) + np.uint8(OFFSET)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(n), pa.py_buffer(ends.tobytes()), pa.py_buffer(text.tobytes()))

    @F.arrow_udf(T.StringType())
    def renewed(rg: pa.Array, flag: pa.Array, seq: pa.Array, qual: pa.Array) -> pa.Array:
        fine = pc.fill_null(pc.and_(pc.equal(pc.binary_length(seq), pc.binary_length(qual)), pc.not_equal(qual, "*")), False)
        fine = pc.and_(fine, pc.equal(pc.bit_wise_and(pc.cast(flag, pa.int64()), pa.scalar(excluded, pa.int64())), 0)) if excluded else fine
        return pc.replace_with_mask(qual, fine, turned(*[x.filter(fine) for x in (rg, flag, seq, qual)]))

    return reads.withColumn("qual", renewed("rg", "flag", "seq", "qual")).select(*reads.columns)


def _apply_joined(reads: DataFrame, q: DataFrame, min_quality: int, excluded: int) -> DataFrame:
    """``apply`` for a table of cells that is too large to be held."""
    fine = ~fl.has(F.col("flag"), excluded) & (F.length("seq") == F.length("qual")) & (F.col("qual") != "*")
    b = explode_bases(reads.filter(fine), ["rec_idx", "rg"])
    new = b.join(q, CELL, "left").select("rec_idx", "cycle", F.when((F.col("qual") < min_quality) | F.col("_q").isNull(), F.col("qual")).otherwise(F.col("_q")).alias("q"))
    strings = new.groupBy("rec_idx").agg(F.array_sort(F.collect_list(F.struct("cycle", "q"))).alias("_s"))
    joined = reads.join(strings, "rec_idx", "left")
    letters = F.array_join(F.transform("_s", lambda s: F.char(s["q"] + bs.OFFSET)), "")
    turned = F.when(fl.has(F.col("flag"), fl.REVERSE), F.reverse(letters)).otherwise(letters)
    return joined.select(*[F.when(F.col("_s").isNull(), F.col("qual")).otherwise(turned).alias("qual") if c == "qual" else F.col(c) for c in reads.columns])


def logistic_fit(cells: DataFrame, rounds: int = 30, tolerance: float = 1e-6) -> dict:
    """Logistic regression of the mismatch share on 1, qual, cycle, second, prev and cur, by Newton's method.

    Each round is one distributed aggregate of the gradient and curvature sums; only those 6 + 21 numbers reach the driver.
    Returns weights, covariance and rounds.
    """
    code = lambda c: F.instr(F.lit("ACGT" + NONE_BEFORE), F.col(c)) - 1
    x = [F.lit(1.0), F.col("qual").cast("double"), F.col("cycle").cast("double"), F.col("second").cast("double"), code("prev").cast("double"), code("cur").cast("double")]
    names = [f"x{i}" for i in range(len(x))]
    d = cells.select(*[c.alias(n) for c, n in zip(x, names, strict=True)], (F.col("matches") + F.col("mismatches")).cast("double").alias("n"), F.col("mismatches").cast("double").alias("y"))
    w, used = np.zeros(len(x)), 0
    info = np.eye(len(x))
    for _ in range(rounds):
        z = sum((F.col(n) * float(v) for n, v in zip(names, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        e = d.withColumn("_r", F.col("y") - F.col("n") * p).withColumn("_c", F.col("n") * p * (1 - p))
        pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        got = e.agg(*[F.sum(F.col("_r") * F.col(n)).alias(f"g{n}") for n in names], *[F.sum(F.col("_c") * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i, j in pairs]).first()
        grad = np.array([got[f"g{n}"] or 0.0 for n in names])
        for i, j in pairs:
            info[i, j] = info[j, i] = got[f"h{i}_{j}"] or 0.0
        info = info + np.eye(len(x)) * 1e-9
        step = np.linalg.solve(info, grad)
        w, used = w + step, used + 1
        if np.abs(step).sum() < tolerance:
            break
    return {"weights": w.tolist(), "covariance": np.linalg.inv(info).tolist(), "rounds": used}


def predicted_quality(weights: list[float], blended: int = 0) -> Column:
    """The regression's quality of a cell.

    With ``blended`` above 0 (whatever its size) half of the cell's share of mismatches is added to half of the logit times
    that share, and their sum is the logit of a match. 9999 is refused: what it means isn't defined.
    """
    if blended == 9999:
        raise ValueError("9999 isn't a weight for a blended model")
    code = lambda c: F.instr(F.lit("ACGT" + NONE_BEFORE), F.col(c)) - 1
    x = [F.lit(1.0), F.col("qual"), F.col("cycle"), F.col("second").cast("int"), code("prev"), code("cur")]
    match = -sum((c * float(v) for c, v in zip(x, weights, strict=True)), F.lit(0.0))
    if blended > 0:
        match = F.col("mismatches") / (F.col("matches") + F.col("mismatches")) * (1 + match) / 2
    p = 1 / (1 + F.exp(match))
    return F.floor(-10 * F.log10(p) + 0.5).cast("int")


def model_lines(fit: dict) -> list[str]:
    """A regression as text: effect, variance and standard error of each covariate."""
    names = ("intercept", "quality", "cycle", "second_read", "previous_base", "base")
    return [f"{n}\t{w:.6g}\t{fit['covariance'][i][i]:.6g}\t{fit['covariance'][i][i] ** 0.5:.6g}" for i, (n, w) in enumerate(zip(names, fit["weights"], strict=True))]
