"""Does a weight vector explain a score? Masking, variants, curves, stability and placebos.

A study table has one row per window: `(keys.., window, seq array, sal array)`. The model is a
user function that scores a sequence.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.arrays import bind, total
from panelspark.operators.stats import exact_percentiles, topk_index
from panelspark.session import stage

# Set-up of the study.
KS = [1, 2, 3, 5, 8, 10, 15, 20, 25, 30]
TOPK, SHIFTS, SEED = 5, [-3, -1, 1, 3], 123
EPS_SUM = 1e-9


def last_query_weights(attention) -> Column:
    """(heads, queries, keys) weights to one vector: mean over heads of the last query's row."""
    a = F.col(attention) if isinstance(attention, str) else attention
    rows = F.transform(a, lambda head: F.element_at(head, -1))
    summed = F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), rows[0],
                         lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.size(a))


def saliency(weights) -> Column:
    """Weights divided by their sum."""
    w = F.col(weights) if isinstance(weights, str) else weights
    return bind(total(w) + EPS_SUM, lambda t: F.transform(w, lambda x: x / t))


def mask_positions(seq, idx, strategy: str = "mean", vector: bool = False) -> Column:
    """Replace the positions in `idx` (0-based) by the sequence mean or zero.

    With `vector` each element is itself a vector and the mean is element-wise.
    """
    s = F.col(seq) if isinstance(seq, str) else seq
    idx = F.col(idx) if isinstance(idx, str) else idx
    if strategy not in ("mean", "zero"):
        raise ValueError("strategy must be 'mean' or 'zero'")
    if vector:
        zeros = F.transform(s[0], lambda x: F.lit(0.0))
        rep = zeros if strategy == "zero" else F.transform(
            F.aggregate(s, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)),
            lambda x: x / F.size(s))
    else:
        rep = F.lit(0.0) if strategy == "zero" else total(s) / F.size(s)
    return bind(rep, lambda r: F.transform(
        s, lambda x, i: F.when(F.array_contains(idx, i), r).otherwise(x)))


def shift(seq, d: int) -> Column:
    """Circular shift to the right by d (to the left when negative)."""
    s = F.col(seq) if isinstance(seq, str) else seq
    n = F.size(s)
    return F.transform(s, lambda x, i: F.get(s, F.pmod(i - d, n)))


def hashed_order(n: Column, *seed: Column) -> Column:
    """Positions 0..n-1 in an order fixed by the seed, the same on every retry."""
    pos = F.sequence(F.lit(0), n - 1)
    keyed = F.transform(pos, lambda i: F.struct(F.md5(F.concat_ws(":", *[c.cast("string") for c in seed], i.cast("string"))
                                                      .cast("binary")).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda p: p["i"])


def shuffle(seq, *seed: Column) -> Column:
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.transform(hashed_order(F.size(s), *seed), lambda i: F.get(s, i))


def expand_variants(df: DataFrame, keys: list[str], ks: list[int] = KS,
                    shifts: list[int] = SHIFTS, strategy: str = "mean",
                    seed: int = SEED) -> DataFrame:
    """One row per (window, variant, k) with the sequence that variant feeds the model.

    Variants: `base`; `delete_top`, `delete_rand`, `delete_least` mask k positions; `all_masked`
    and `insert` (all but the top k masked); `leave_out` masks position k; `shift_d`, `shuffle`.
    """
    n = F.size("seq")
    whose = [F.col(k) for k in (*keys, "window")]
    top, least = topk_index("sal", 10**9), topk_index("sal", 10**9, largest=False)

    def plan(name, k, idx):
        return F.struct(F.lit(name).alias("variant"), F.lit(k).cast("int").alias("k"),
                        idx.cast("array<int>").alias("idx"))
    none, everything = F.array(), F.sequence(F.lit(0), n - 1)
    fixed = [plan("base", 0, none), plan("all_masked", 0, everything), plan("shuffle", 0, none),
             *[plan(f"shift_{d}", 0, none) for d in shifts]]
    for k in ks:
        rand = hashed_order(n, *whose, F.lit(seed), F.lit(k))
        fixed += [plan("delete_top", k, F.slice("_top", 1, k)),
                  plan("delete_rand", k, F.slice(rand, 1, k)),
                  plan("delete_least", k, F.slice("_least", 1, k)),
                  plan("insert", k, F.slice("_top", k + 1, 10**9))]
    each = F.transform(everything, lambda i: F.struct(
        F.lit("leave_out").alias("variant"), i.alias("k"), F.array(i).alias("idx")))
    out = df.withColumns({"_top": top, "_least": least}).select(
        *keys, "window", "seq", "sal", F.explode(F.concat(F.array(*fixed), each)).alias("p"))
    moved = F.when(F.col("p.variant") == "shuffle", shuffle("seq", *whose, F.lit(seed)))
    for d in shifts:
        moved = moved.when(F.col("p.variant") == f"shift_{d}", shift("seq", d))
    seq = moved.otherwise(mask_positions("seq", F.col("p.idx"), strategy))
    return out.select(*keys, "window", "p.variant", "p.k",
                      F.get("sal", F.when(F.col("p.variant") == "leave_out", F.col("p.k"))).alias("sal"),
                      seq.alias("seq"))


def score_variants(variants: DataFrame, keys: list[str],
                   fn: Callable[[list], list[float]], space: str = "difference") -> DataFrame:
    """Score every variant with `fn(list of sequences) -> list of scores` and compare.

    `delta` is the score minus the base score; for insertions it is the gain over everything
    masked. `space` records whether scores are in difference or price space.
    """
    types = dict(variants.dtypes)
    cols = [*keys, "window", "variant", "k", "sal"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", score double"

    def run(frames):
        for pdf in frames:
            yield pdf[cols].assign(score=pd.Series(fn(list(pdf["seq"])), index=pdf.index, dtype=float))

    w = Window.partitionBy(*keys, "window")
    def of(name):
        return F.max(F.when(F.col("variant") == name, F.col("score"))).over(w)
    out = variants.mapInPandas(run, schema)
    return out.withColumns({"base": of("base"), "_all": of("all_masked")}).withColumns({
        "delta": F.when(F.col("variant") == "insert", F.col("_all") - F.col("score"))
                  .otherwise(F.col("score") - F.col("base")),
        "space": F.lit(space)}).drop("_all")


def study_scores(df: DataFrame, keys: list[str], fn: Callable[[list], list[float]], ks: list[int] = KS,
                 shifts: list[int] = SHIFTS, strategy: str = "mean", seed: int = SEED, only: tuple[str, ...] | None = None,
                 space: str = "difference") -> DataFrame:
    """`expand_variants` and `score_variants` in one: a window goes to the task once, as its values and ranks.

    A masked variant is a threshold on a rank array (by weight, by least weight, by a hash), so nothing of
    it is written, shuffled or sent but its score, and `delta` is taken where the base score is. `only`
    names the variants wanted (`shift` means all shifts); all, if not given.
    """
    if strategy not in ("mean", "zero"):
        raise ValueError("strategy must be 'mean' or 'zero'")
    def wanted(name: str) -> bool:
        return only is None or name in only or name.startswith("shift_") and "shift" in only
    n, whose = F.size("seq"), [F.col(k) for k in (*keys, "window")]
    none = F.array().cast("array<int>")
    orders = {"_top": topk_index("sal", 10**9), "_least": topk_index("sal", 10**9, largest=False) if wanted("delete_least") else none,
              "_mixed": hashed_order(n, *whose, F.lit(seed)) if wanted("shuffle") else none,
              **{f"_rand{k}": hashed_order(n, *whose, F.lit(seed), F.lit(k)) for k in ks if wanted("delete_rand")}}
    types = dict(df.dtypes)
    src = df.select(*keys, "window", F.col("seq").cast("array<double>").alias("seq"), F.col("sal").cast("array<double>").alias("sal"),
                    *[e.cast("array<int>").alias(c) for c, e in orders.items()])
    cols = [*keys, "window"]
    schema = (", ".join(f"`{c}` {types[c]}" for c in cols) + ", variant string, k int, sal double, score double, "
              "base double, delta double, space string")

    def variants(r) -> list[tuple]:
        x, size = r["seq"], len(r["seq"])
        held = 0.0 if strategy == "zero" or not size else x.mean()
        out = [("base", 0, None, x), ("all_masked", 0, None, np.full(size, held))]

        def masked(name, k, places):
            y = x.copy()
            y[places] = held
            out.append((name, k, None, y))
        for k in ks:
            for name, order, part in (("delete_top", "_top", slice(k)), ("delete_rand", f"_rand{k}", slice(k)),
                                      ("delete_least", "_least", slice(k)), ("insert", "_top", slice(k, None))):
                if wanted(name):
                    masked(name, k, r[order][part])
        if wanted("leave_out"):
            for k in range(size):
                masked("leave_out", k, [k])
                out[-1] = ("leave_out", k, r["sal"][k], out[-1][3])
        out += [(f"shift_{d}", 0, None, np.roll(x, d)) for d in shifts if wanted(f"shift_{d}")]
        if wanted("shuffle"):
            out.append(("shuffle", 0, None, x[r["_mixed"]]))
        return out

    def run(frames, rows_at_once=256):
        for pdf in frames:
            for at in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[at:at + rows_at_once]
                per = [variants(r) for r in part.to_dict("records")]
                every = [v for vs in per for v in vs]
                score = np.asarray(fn([v[3] for v in every]), dtype=float)
                count = [len(vs) for vs in per]
                first = np.repeat(np.cumsum([0, *count[:-1]]), count)
                out = part[cols].loc[part.index.repeat(count)].reset_index(drop=True)
                name = np.array([v[0] for v in every], dtype=object)
                out = out.assign(variant=name, k=np.array([v[1] for v in every], dtype="int32"),
                                 sal=np.array([np.nan if v[2] is None else v[2] for v in every]), score=score, base=score[first],
                                 delta=np.where(name == "insert", score[np.minimum(first + 1, len(score) - 1)] - score, score - score[first]),
                                 space=space)
                keep = np.array([wanted(v) for v in name], dtype=bool)
                yield out[keep]

    scored = src.mapInPandas(run, schema)
    return scored.withColumn("sal", F.when(~F.isnan("sal"), F.col("sal")))


def average_rank(col: str, w_keys: list[str]) -> Column:
    """Rank with ties at their mean, within the keys."""
    w = Window.partitionBy(*w_keys)
    return F.rank().over(w.orderBy(col)) + (F.count(F.lit(1)).over(
        Window.partitionBy(*w_keys, col)) - 1) / 2


def spearman(df: DataFrame, keys: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Rank correlation per key; null for a constant side. A key's rows are one window's steps."""
    r = df.select(*keys, average_rank(a, keys).alias("_a"), average_rank(b, keys).alias("_b"))
    spread = (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0)
    return r.groupBy(*keys).agg(F.when(spread, F.corr("_a", "_b")).alias(name))


SUBSET_K = 10
BLOCK_SETS = 1024
MEMBERS_AT_ONCE = 4096


def jaccard_topk(df: DataFrame, keys: list[str], sets: str, k: int,
                 name: str = "jaccard") -> DataFrame:
    """Mean pairwise Jaccard of sets of size k; 1 for a single set.

    Equal sets are merged first, with their count, and no pair of sets becomes a row. The parameter k chooses
    between two exact ways: up to SUBSET_K shared subsets are counted (`_by_subsets`), beyond it 2^k subsets
    would be too many and blocks of distinct sets are multiplied (`_by_blocks`).
    """
    if k < 1:
        raise ValueError("k must be positive")
    sized = F.array_sort(F.array_distinct(sets))
    sized = F.when(F.size(sized) == k, sized).otherwise(F.raise_error(F.lit(f"sets must have {k} members")))
    merged = df.select(*keys, sized.alias("_s")).groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_sets"))
    out = (_by_subsets if k <= SUBSET_K else _by_blocks)(merged, keys, k)
    return out.select(*keys, F.when(F.col("_p") > 0, F.col("_j") / F.col("_p")).otherwise(F.lit(1.0)).alias(name))


def _by_subsets(merged: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, _j, _p): summed Jaccard and number of pairs, from counts of subsets.

    Each distinct set emits its 2^k subsets; a subset seen c times is shared by c(c-1)/2 pairs, so the
    subset counts give the number of pairs for each size of intersection by inclusion and exclusion.
    Work is linear in the distinct sets and combines map-side.
    """
    weight = [sum((-1) ** (m - j) * math.comb(m, j) * j / (2 * k - j) for j in range(m + 1))
              for m in range(k + 1)]
    bits = merged.select(*keys, "_s", "_sets", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))).alias("_m"))
    parts = F.array_compact(F.array(*[
        F.when(F.col("_m").bitwiseAND(F.lit(1 << i)) != 0, F.get("_s", F.lit(i))) for i in range(k)]))
    counts = bits.select(*keys, "_sets", parts.alias("_sub")).groupBy(*keys, "_sub").agg(
        F.sum("_sets").cast("double").alias("_c"))
    pairs = F.col("_c") * (F.col("_c") - 1) / 2
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weight]), F.size("_sub") + 1)
    return counts.groupBy(*keys).agg(F.sum(pairs * w).alias("_j"),
                                     F.max(F.when(F.size("_sub") == 0, pairs)).alias("_p"))


def _by_blocks(merged: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, _j, _p) from shared-member counts of blocks of distinct sets.

    Distinct sets are spread by hash over as many blocks as their number needs. A task gets two blocks,
    builds the incidence of their joint members and counts shared members by matrix products, some
    members at a time; only two sums leave it. Memory is bounded by the block, rows sent by distinct sets x blocks.
    """
    merged = stage(merged, "distinct-sets")
    many = merged.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("_blocks"))
    rows = merged.join(many, keys) if keys else merged.withColumn("_blocks", many.scalar())
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("_s"), F.col("_blocks")).cast("int"))
    # a block meets every other one once, and itself
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select(*keys, "_s", F.col("_sets").cast("double").alias("_sets"), F.least("_own", "_other").alias("_lo"),
                       F.greatest("_own", "_other").alias("_hi"), (F.col("_own") <= F.col("_other")).alias("_first"))
    kinds = dict(merged.dtypes)

    def sums(group, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(np.concatenate(pdf["_s"].to_numpy()), return_inverse=True)[1].reshape(len(pdf), k)
        count, first = pdf["_sets"].to_numpy(), pdf["_first"].to_numpy()
        within = group[-2] == group[-1]
        left, right = (at, at) if within else (at[first], at[~first])
        a, b = (count, count) if within else (count[first], count[~first])
        shared = np.zeros((len(left), len(right)), dtype="float32")
        for low in range(0, int(at.max()) + 1, MEMBERS_AT_ONCE):
            shared += _incidence(left, low) @ _incidence(right, low).T
        shared = shared.astype("float64")
        j = a @ (shared / (2 * k - shared)) @ b
        p = a.sum() * b.sum()
        if within:
            # ordered pairs, and each set with itself, are taken back
            j, p = (j - a.sum()) / 2, (p - a.sum()) / 2
        return pd.DataFrame([(*group[:-2], j, p)], columns=[*keys, "_j", "_p"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "_j double", "_p double"])
    per = rows.groupBy(*keys, "_lo", "_hi").applyInPandas(sums, schema)
    return per.groupBy(*keys).agg(F.sum("_j").alias("_j"), F.sum("_p").alias("_p"))


def _incidence(members: np.ndarray, low: int) -> np.ndarray:
    """Rows of sets, columns of the members numbered from `low` on."""
    out = np.zeros((len(members), MEMBERS_AT_ONCE), dtype="float32")
    row, col = np.nonzero((members >= low) & (members < low + MEMBERS_AT_ONCE))
    out[row, members[row, col] - low] = 1
    return out


def study_records(scored: DataFrame, keys: list[str], jaccard: DataFrame | None = None) -> DataFrame:
    """One record per window: curves over ks, placebo map, rank correlation, stability.

    The arrays collect one window's variants, a number fixed by the set-up.
    """
    ids = [*keys, "window"]
    curves = {"del_curve": "delete_top", "del_curve_rand": "delete_rand",
              "del_curve_inv": "delete_least", "ins_curve": "insert"}
    def pairs(variant):
        return F.array_sort(F.collect_list(F.when(F.col("variant") == variant, F.struct("k", "delta"))))
    placebo = F.col("variant").startswith("shift_") | (F.col("variant") == "shuffle")
    rec = scored.groupBy(*ids).agg(
        F.max("base").alias("base_crps"),
        *[pairs(v).alias(f"_{n}") for n, v in curves.items()],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(placebo, F.struct("variant", "delta"))))).alias("placebo"))
    rec = rec.withColumns({
        "ks": F.transform("_del_curve", lambda p: p["k"]),
        **{n: F.transform(f"_{n}", lambda p: p["delta"]) for n in curves}})
    rho = spearman(scored.filter("variant = 'leave_out'"), ids, "sal", "delta", "spearman")
    rec = rec.drop(*[f"_{n}" for n in curves]).join(rho, ids, "left")
    if jaccard is not None:
        return rec.join(jaccard, ids, "left")
    return rec.withColumn("jaccard", F.lit(1.0))


def curve_summary(records: DataFrame) -> DataFrame:
    """Mean and population deviation of each curve at each k, over all windows."""
    curves = ["del_curve", "del_curve_rand", "del_curve_inv", "ins_curve"]
    rows = F.flatten(F.array(*[_curve_rows(c) for c in curves]))
    x = records.select(F.explode(rows).alias("r")).select("r.*")
    return x.groupBy("curve", "k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                       F.count("v").alias("n"))


def _curve_rows(c: str) -> Column:
    return F.transform(c, lambda v, i: F.struct(F.lit(c).alias("curve"), F.get("ks", i).alias("k"), v.alias("v")))


def study_summary(records: DataFrame) -> DataFrame:
    """(measure, value): mean and median rank correlation, mean stability, mean of each placebo."""
    ok = records.filter(F.col("spearman").isNotNull() & ~F.isnan("spearman"))
    median = exact_percentiles(ok, [], "spearman", [0.5]).select(
        F.lit("spearman_median").alias("measure"), "value")
    means = records.agg(
        F.avg(F.when(~F.isnan("spearman"), F.col("spearman"))).alias("spearman_mean"),
        F.avg("jaccard").alias("jaccard_mean")).unpivot([], ["spearman_mean", "jaccard_mean"], "measure", "value")
    placebo = (records.select(F.explode("placebo").alias("name", "v")).groupBy("name")
               .agg(F.avg("v").alias("value"))
               .select(F.concat(F.lit("placebo_"), "name").alias("measure"), "value"))
    return means.unionByName(median).unionByName(placebo)
