"""The saliency study on embedding sequences with a deterministic scorer."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import rnd, table
from panelspark.operators import saliency as L
from panelspark.operators.stats import topk_index
from panelspark.session import stage

KS = [1, 2, 5, 10, 30]


def study(spark, sf):
    seq = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("window"), seq.alias("seq"),
        L.saliency(F.transform(seq, lambda x: F.abs(x))).alias("sal"))


def score(seqs):
    """Position-weighted energy of a sequence."""
    x = np.stack(seqs)
    return (x * x) @ np.arange(1, x.shape[1] + 1)


def scored(spark, sf, *only):
    return L.study_scores(study(spark, sf), [], score, KS, only=only or None)


D = "list_transform(embedding, lambda x: cast(x as double))"
ABS = "list_transform(embedding, lambda x: abs(cast(x as double)))"
ST = f"""st as (select vec_id w, {D} seq, list_transform({ABS}, lambda x: x / (list_sum({ABS}) + 1e-9)) sal, list_avg({D}) mn from embeddings),
po as (select w, i, seq[i] x, sal[i] s, mn, seq from st, generate_series(1, 64) g(i)),
rk as (select *, row_number() over (partition by w order by s desc, i) r_top, row_number() over (partition by w order by s, i) r_low from po),
bs as (select w, sum(i * x * x) base, sum(i * mn * mn) masked from po group by 1),
sh as (select w, row_number() over (partition by w order by md5(concat_ws(':', w, {L.SEED}, i - 1)), i) j, x from po)"""


@query("saliency", f"""with {ST} select w as "window", i - 1 pos, round(s, 9) s from po""")
def saliency(spark, sf):
    return study(spark, sf).select("window", F.posexplode("sal").alias("pos", "s")).select("window", "pos", rnd("s", 9).alias("s"))


@query("last_query_weights", f"""select vec_id as "window", i - 1 pos, round((abs(cast(embedding[i] as double)) + pow(cast(embedding[i] as double), 2)) / 2, 9) weight
from embeddings, generate_series(1, 64) g(i)""")
def last_query_weights(spark, sf):
    """Two heads of two queries; only the last query of each counts."""
    seq = F.col("embedding").cast("array<double>")
    a, b = F.transform(seq, lambda x: F.abs(x)), F.transform(seq, lambda x: x * x)
    att = F.array(F.array(b, a), F.array(a, b))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("window"), L.last_query_weights(att).alias("w"))
    return e.select("window", F.posexplode("w").alias("pos", "v")).select("window", "pos", rnd("v", 9).alias("weight"))


@query("mask_positions", f"""with {ST}, m as (select w, i, case when r_top <= 5 then mn else x end a, case when r_top <= 5 then 0 else x end z from rk)
select w as "window", round(sum(i * a), 6) + 0.0 mean_moment, round(sum(i * z), 6) + 0.0 zero_moment from m group by 1""")
def mask_positions(spark, sf):
    s = study(spark, sf).withColumn("idx", topk_index("sal", 5))
    def moment(strategy):
        m = F.transform(L.mask_positions("seq", "idx", strategy), lambda x, i: x * (i + 1))
        return rnd(F.aggregate(m, F.lit(0.0), lambda a, x: a + x))
    return s.select("window", moment("mean").alias("mean_moment"), moment("zero").alias("zero_moment"))


@query("circular_shift", f"""with {ST} select w as "window", round(sum(((i - 1 + 3) % 64 + 1) * x), 6) + 0.0 right3, round(sum(((i - 1 - 3 + 64) % 64 + 1) * x), 6) + 0.0 left3 from po group by 1""")
def circular_shift(spark, sf):
    def moment(d):
        m = F.transform(L.shift("seq", d), lambda x, i: x * (i + 1))
        return rnd(F.aggregate(m, F.lit(0.0), lambda a, x: a + x))
    return study(spark, sf).select("window", moment(3).alias("right3"), moment(-3).alias("left3"))


@query("shuffle_placebo", f"""with {ST} select w as "window", round(sum(x), 6) + 0.0 total, round(sum(j * x), 6) + 0.0 moment,
  round(max(case when j = 1 then x end), 6) + 0.0 leads, count(*) n from sh group by 1""")
def shuffle_placebo(spark, sf):
    """A seeded shuffle keeps the values of the window and puts them in the order of a hash."""
    s = study(spark, sf).withColumn("z", L.shuffle("seq", F.col("window"), F.lit(L.SEED)))
    moment = F.aggregate(F.transform("z", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return s.select("window", rnd(F.aggregate("z", F.lit(0.0), lambda a, x: a + x)).alias("total"), rnd(moment).alias("moment"),
                    rnd(F.get("z", F.lit(0))).alias("leads"), F.size("z").cast("long").alias("n"))


KLIST = ", ".join(map(str, KS))
CURVES = f"""{ST}, ks as (select unnest([{KLIST}]) k),
rr as (select w, k, i, x, mn, row_number() over (partition by w, k order by md5(concat_ws(':', w, {L.SEED}, k, i - 1)), i) r_rand from po, ks),
cr as (select w, k, sum(case when r_rand <= k then i * (mn * mn - x * x) else 0 end) del_rand from rr group by 1, 2),
cv as (select w, k, sum(case when r_top <= k then i * (mn * mn - x * x) else 0 end) del_top,
  sum(case when r_low <= k then i * (mn * mn - x * x) else 0 end) del_low,
  sum(case when r_top <= k then i * (mn * mn - x * x) else 0 end) ins from rk, ks group by 1, 2)"""


@query("deletion_insertion_curves", f"""with {CURVES}
select w as "window", k, 'delete_top' variant, round(del_top, 6) + 0.0 delta from cv union all
select w, k, 'delete_rand', round(del_rand, 6) + 0.0 from cr union all select w, k, 'delete_least', round(del_low, 6) + 0.0 from cv union all select w, k, 'insert', round(ins, 6) + 0.0 from cv""")
def deletion_insertion_curves(spark, sf):
    s = scored(spark, sf, "delete_top", "delete_rand", "delete_least", "insert")
    return s.select("window", "k", "variant", rnd("delta").alias("delta"))


@query("leave_one_out", f"""with {ST} select w as "window", i - 1 k, round(i * (mn * mn - x * x), 6) + 0.0 delta from po""")
def leave_one_out(spark, sf):
    return scored(spark, sf, "leave_out").select("window", "k", rnd("delta").alias("delta"))


@query("shift_placebos", f"""with {ST}, d as (select unnest([-3, -1, 1, 3]) d)
select w as "window", 'shift_' || d variant, round(sum(((i - 1 + d + 64) % 64 + 1) * x * x) - sum(i * x * x), 6) + 0.0 delta from po, d group by 1, d""")
def shift_placebos(spark, sf):
    s = scored(spark, sf, "shift")
    return s.select("window", "variant", rnd("delta").alias("delta"))


RHO = """ra as (select *, rank() over (partition by w order by s) + (count(*) over (partition by w, s) - 1) / 2.0 a,
  rank() over (partition by w order by i * (mn * mn - x * x)) + (count(*) over (partition by w, i * (mn * mn - x * x)) - 1) / 2.0 b from po),
rho as (select w, corr(a, b) rho from ra group by 1)"""


@query("spearman_saliency", f"""with {ST}, {RHO} select w as "window", round(rho, 5) rho from rho""")
def spearman_saliency(spark, sf):
    lo = scored(spark, sf, "leave_out")
    return L.spearman(lo, ["window"], "sal", "delta").select("window", rnd("rho", 5).alias("rho"))


SETS = f"""{ST}, se as (select w % 20 g, w, list(i) l from rk where r_top <= 5 group by 1, 2)"""


@query("jaccard_topk", f"""with {SETS},
pr as (select a.g, len(list_intersect(a.l, b.l)) n from se a join se b on a.g = b.g and a.w < b.w)
select g, round(avg(n / (10.0 - n)), 6) jaccard from pr group by 1""")
def jaccard_topk(spark, sf):
    s = study(spark, sf).select((F.col("window") % 20).alias("g"), topk_index("sal", 5).alias("top"))
    return L.jaccard_topk(s, ["g"], "top", 5).select("g", rnd("jaccard").alias("jaccard"))


@query("jaccard_top30", f"""with {ST}, se as (select w % 20 g, w, list(i) l from rk where r_top <= 30 group by 1, 2),
pr as (select a.g, len(list_intersect(a.l, b.l)) n from se a join se b on a.g = b.g and a.w < b.w)
select g, round(avg(n / (60.0 - n)), 6) jaccard from pr group by 1""")
def jaccard_top30(spark, sf):
    s = study(spark, sf).select((F.col("window") % 20).alias("g"), topk_index("sal", 30).alias("top"))
    return L.jaccard_topk(s, ["g"], "top", 30).select("g", rnd("jaccard").alias("jaccard"))


def _records(spark, sf):
    """Records of every window; stability compares the strongest weights with the largest signed values."""
    s = stage(scored(spark, sf), "variants")
    j = (study(spark, sf).select("window", F.explode(F.array(topk_index("sal", 5), topk_index("seq", 5))).alias("top")))
    return L.study_records(s, [], L.jaccard_topk(j, ["window"], "top", 5))


JACCARD = """xs as (select w, i, s, row_number() over (partition by w order by s desc, i) a, row_number() over (partition by w order by x desc, i) b from po),
jc as (select w, sum(case when a <= 5 and b <= 5 then 1 else 0 end) / (10.0 - sum(case when a <= 5 and b <= 5 then 1 else 0 end)) jaccard from xs group by 1)"""
CURVE = "select '{}' curve, k, round(avg({}), 6) + 0.0 mean, round(stddev_pop({}), 6) std, count(*) n from {} group by 2"


@query("study_curve_summary", f"with {CURVES}\n" + " union all ".join(CURVE.format(n, c, c, t) for n, c, t in (
    ("del_curve", "del_top", "cv"), ("del_curve_inv", "del_low", "cv"), ("ins_curve", "ins", "cv"), ("del_curve_rand", "del_rand", "cr"))))
def study_curve_summary(spark, sf):
    out = L.curve_summary(_records(spark, sf))
    return out.select("curve", "k", rnd("mean").alias("mean"), rnd("std").alias("std"), "n")


PLACEBOS = """d as (select unnest([-3, -1, 1, 3]) d),
pl as (select w, 'placebo_shift_' || d measure, sum(((i - 1 + d + 64) % 64 + 1) * x * x) - sum(i * x * x) v from po, d group by 1, 2
  union all select w, 'placebo_shuffle', sum(j * x * x) - max(base) from sh join bs using (w) group by 1)"""


@query("study_summary", f"""with {ST}, {RHO}, {JACCARD}, {PLACEBOS}
select 'spearman_mean' measure, round(avg(rho), 5) as value from rho union all select 'spearman_median', round(quantile_cont(rho, 0.5), 5) from rho
union all select measure, round(avg(v), 5) + 0.0 from pl group by 1 union all select 'jaccard_mean', round(avg(jaccard), 5) from jc""")
def study_summary(spark, sf):
    return L.study_summary(_records(spark, sf)).select("measure", rnd("value", 5).alias("value"))


RECORDS = f"""with {CURVES}, {RHO}, {JACCARD}, {PLACEBOS},
c as (select w, sum(k * del_top) a, sum(k * del_low) b, sum(k * ins) c from cv group by 1), r as (select w, sum(k * del_rand) r from cr group by 1),
p as (select w, sum(v) p, count(*) n from pl group by 1)
select w as "window", round(base, 6) + 0.0 base_crps, round(rho, 5) + 0.0 spearman, round(jaccard, 6) jaccard, {sum(KS)} k_sum,
  round(a, 5) + 0.0 del_moment, round(r, 5) + 0.0 rand_moment, round(b, 5) + 0.0 inv_moment, round(c, 5) + 0.0 ins_moment,
  round(p, 5) + 0.0 placebo_sum, n n_placebos from bs join rho using (w) join jc using (w) join c using (w) join r using (w) join p using (w)"""


def record_values(records, *more):
    """The content of study records as plain numbers: curves as sums weighted by k, placebos summed."""
    def moment(curve):
        return rnd(F.aggregate(F.zip_with("ks", curve, lambda k, v: k * v), F.lit(0.0), lambda a, v: a + v), 5)
    return records.select(
        F.col("window").cast("long").alias("window"), rnd("base_crps").alias("base_crps"), rnd("spearman", 5).alias("spearman"),
        rnd("jaccard").alias("jaccard"), F.aggregate("ks", F.lit(0), lambda a, k: a + k).alias("k_sum"),
        moment("del_curve").alias("del_moment"), moment("del_curve_rand").alias("rand_moment"), moment("del_curve_inv").alias("inv_moment"),
        moment("ins_curve").alias("ins_moment"),
        rnd(F.aggregate(F.map_values("placebo"), F.lit(0.0), lambda a, v: a + v), 5).alias("placebo_sum"),
        F.size("placebo").cast("long").alias("n_placebos"), *more)


@query("study_records", RECORDS)
def study_records(spark, sf):
    return record_values(_records(spark, sf))
