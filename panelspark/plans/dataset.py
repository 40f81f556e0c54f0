"""From bars and daily news to the three aligned tables of one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.calendar import calendar_features
from panelspark.operators.align import dedupe_last, feature_name, min_history, reindex, to_long
from panelspark.operators.calendar import dense_vectors, fill_isolated, interpolate_time, shared_calendar
from panelspark.operators.indicators import INDICATORS, enrich
from panelspark.schema import DatasetSpec, Series
from panelspark.session import stage


def build_dataset(bars: DataFrame, spec: DatasetSpec, s: Series, news: DataFrame | None = None,
                  cutoff=None, min_start=None, order: list[str] | None = None,
                  tech: bool = True) -> dict[str, DataFrame]:
    """`target` (long OHLC), `global_features` (long), `news` (dense), `calendar_features`.

    Bars are enriched series by series, put on the shared calendar and interpolated in calendar
    time, all series in one plan; news stays on its days, with zero vectors in between. The
    enriched bars and the panel are written once and read by the branches.
    """
    ids = [spec.target_id, *spec.covariates]
    if spec.covariates:
        bars = bars.filter(F.col("id").isin(ids))
    if order:
        bars = dedupe_last(bars, [*s.keys, s.t], order)
    rich = stage(enrich(bars, s), "enriched")
    is_target = F.col("id") == spec.target_id
    target = rich.filter(is_target)
    if min_start is not None:
        rich = min_history(rich.filter(~is_target), s, min_start).unionByName(target)
    if news is not None:
        news = fill_isolated(news, s.t)
    days = stage(shared_calendar(target, news, s.t, cutoff=cutoff), "calendar")
    features = [*spec.bar_cols, *(INDICATORS if tech else [])]
    panel = stage(interpolate_time(reindex(rich.select(*s.keys, s.t, *features), s, days), s, features,
                                   whole_rows=True), "panel")
    wide_ok = ~F.col("feature").isin(*spec.bar_cols) | (F.col("id") != spec.target_id)
    out = {
        "target": panel.filter(is_target).select(s.t, "id", *spec.bar_cols),
        "global_features": to_long(panel, s, features).filter(wide_ok).select(
            s.t, feature_name("id", "feature").alias("feature"), "value"),
        "calendar_features": days.withColumns(calendar_features(s.t)),
    }
    if news is not None:
        on_calendar = days.join(news, s.t, "left")
        out["news"] = dense_vectors(on_calendar, "embedding") if "embedding" in news.columns else on_calendar
    return out
