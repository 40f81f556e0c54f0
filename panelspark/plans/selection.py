"""Which covariates relate to the targets, and which of those repeat each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import stats as S
from panelspark.operators.indicators import difference
from panelspark.operators.segments import fills, running
from panelspark.schema import Series
from panelspark.session import stage


def select_covariates(features: DataFrame, targets: DataFrame, t: str = "t",
                      mode: str = "log_diff", relevant: float = 0.25, redundant: float = 0.85,
                      temp: float = 0.1) -> dict[str, DataFrame]:
    """Both inputs long `(t, feature, value)`; a feature's name must not be a target's.

    Dates common to both, filled and differenced per feature, one correlation matrix for
    everything; then relevance to any target, and redundancy among the relevant ones.
    """
    s = Series(("feature",), t)
    days = features.select(t).distinct().intersect(targets.select(t).distinct())
    kind = features.withColumn("side", F.lit("feature")).unionByName(targets.withColumn("side", F.lit("target")))
    names = kind.select("feature", "side").distinct()
    x = stage(kind.join(days, t, "left_semi").select(*s.keys, t, "value"), "common")
    # a feature missing on a common date gets a row first, so every series has the same dates
    # (the list of names is as long as one side of the matrix that is computed anyway)
    listed = names.agg(F.collect_list("feature")).scalar()
    full = days.select(t, F.explode(listed).alias("feature")).join(x, ["feature", t], "left")
    filled = stage(running(full, s, fills(s, ["value"])), "filled")
    diff = stage(difference(filled, s, ["value"], mode), "differences")
    corr = S.corr_matrix(diff, t)
    tagged = corr.join(names.select(F.col("feature").alias("f1"), F.col("side").alias("side1")), "f1")
    tagged = stage(tagged.join(names.select(F.col("feature").alias("f2"), F.col("side").alias("side2")), "f2"),
                   "correlations")
    own = tagged.filter("side1 = 'feature' and side2 = 'feature'").select("f1", "f2", "r")
    cross = tagged.filter("side1 = 'feature' and side2 = 'target'").select("f1", "f2", "r")
    survivors = S.relevant_features(cross, relevant)
    return {"feature_feature": own, "feature_target": cross,
            "feature_attention": S.row_softmax(own, temp=temp),
            "target_attention": S.row_softmax(cross, temp=temp),
            "survivors": survivors, "redundant": S.redundant_pairs(own, survivors, redundant)}
