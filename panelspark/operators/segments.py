"""Series work that never puts a whole series on one task.

A plain `Window.partitionBy(id)` sends every row of a series to one task, so a series that holds
a third of the data becomes the job. Two schemes replace it:

* running state (row numbers, sums, fills): rows are partitioned by (key, calendar bucket); one
  small row per bucket carries the state of all earlier buckets into it. Buckets themselves stand in
  runs of `FAN`, runs in runs of runs: the state is reduced up this tree and handed down it, so that
  no task holds all buckets of a series either;
* affine recurrences (exponential means): each row maps the state y to a * y + b; maps compose, first
  in a segment, then over segments in the same kind of tree;
* bounded look-back (rolling statistics, sliding windows): rows are numbered, cut into segments
  of a fixed number of rows, and each segment also receives the few rows before and after it
  that its frames reach into. Segment size is exact whatever the spacing of the rows;
* lagged products: the same segments as arrays, multiplied with themselves inside the task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.schema import Series
from panelspark.session import stage

BUCKET, ROW, SEG, OWN = "_bucket", "_row", "_seg", "_own"
SEGMENT_ROWS = 2048
FAN = 1024
FAN_MAPS = 256
PIECE = 16


def bucket_of(df: DataFrame, s: Series) -> Column:
    """The calendar piece a row falls in."""
    dtype = df.schema[s.t].dataType
    if isinstance(dtype, T.DateType):
        return F.trunc(s.t, s.bucket or "year")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc(s.bucket or "day", s.t)
    if isinstance(dtype, T.IntegralType):
        return F.expr(f"`{s.t}` div {int(s.bucket or 4096)}")
    raise TypeError(f"{s.t}: need a date, timestamp or integer, got {dtype.simpleString()}")


def bucket_step(df: DataFrame, s: Series) -> str:
    """SQL of the distance between neighbouring buckets."""
    dtype = df.schema[s.t].dataType
    if isinstance(dtype, T.IntegralType):
        return "1"
    unit = s.bucket or ("year" if isinstance(dtype, T.DateType) else "day")
    return f"interval 1 {unit}"


def by_bucket(s: Series) -> WindowSpec:
    """Order inside one bucket."""
    return Window.partitionBy(*s.keys, BUCKET).orderBy(s.t)


def so_far(s: Series) -> WindowSpec:
    """Inside one bucket: from its start to this row."""
    return by_bucket(s).rowsBetween(Window.unboundedPreceding, 0)


def from_here(s: Series) -> WindowSpec:
    """Inside one bucket: this row and those after it, nearest last.

    Ordered backwards so that the frame grows by one row at a time; a frame that ends at the last
    row is evaluated from scratch for every row.
    """
    return (Window.partitionBy(*s.keys, BUCKET).orderBy(F.desc(s.t))
            .rowsBetween(Window.unboundedPreceding, 0))


@dataclass(frozen=True)
class Carry:
    """What a bucket knows of the others: `how` (sum, min, max, first, last) of a part, over the buckets
    `side` (before, after, all) of it. Nulls are passed over; `then` turns the result into the state."""

    part: str
    how: str
    side: str = "before"
    then: Callable[[Column], Column] = lambda c: c


@dataclass(frozen=True)
class Running:
    """A running quantity: aggregates of one bucket, what is carried of them, row columns."""

    parts: dict[str, Column]
    state: dict[str, Carry] = field(default_factory=dict)
    cols: dict[str, Column] = field(default_factory=dict)


def bucket_number(df: DataFrame, s: Series) -> Column:
    """The calendar piece a row falls in as an integer: each piece has one of its own, and they rise with it."""
    bucket = bucket_of(df, s)
    if isinstance(df.schema[s.t].dataType, T.IntegralType):
        return bucket
    unit = (s.bucket or ("year" if isinstance(df.schema[s.t].dataType, T.DateType) else "day")).lower()
    days = {"year": 365, "quarter": 90, "month": 28, "week": 7, "day": 1}
    if unit in days:
        return F.floor(F.unix_date(bucket.cast("date")) / days[unit])
    seconds = {"hour": 3_600, "minute": 60, "second": 1}[unit]
    return F.floor(F.unix_seconds(bucket.cast("timestamp")) / seconds)


def _levels(table: DataFrame, at: str, fan: int) -> int:
    """Levels of runs above a table, so that the uppermost has at most `fan` rows of a key."""
    ends = table.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    span, levels = (ends.hi or 0) // fan - (ends.lo or 0) // fan, 0
    while span:
        levels, span = levels + 1, span // fan
    return levels


_OVER = {"sum": F.sum, "min": F.min, "max": F.max,
         "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}
_BOTH = {"sum": lambda near, far: F.coalesce(near + far, near, far), "min": F.least, "max": F.greatest,
         "first": lambda near, far: F.coalesce(near, far), "last": lambda near, far: F.coalesce(near, far)}


def _reduced(part: str, how: str, at: str) -> Column:
    if how in ("first", "last"):
        seen = F.when(F.col(part).isNotNull(), F.col(at))
        return (F.min_by if how == "first" else F.max_by)(part, seen)
    return _OVER[how](part)


def carried(table: DataFrame, keys: list[str], at: str, state: dict[str, Carry], levels: int) -> DataFrame:
    """The table with the state of each of its rows; `at` is an integer that orders the rows of a key.

    A run is FAN numbers of `at`. Each run becomes one row of the table above, whose state is found first.
    """
    parts = list(dict.fromkeys((c.part, c.how) for c in state.values()))
    run, top = f"_bucket_run{levels}", levels == 0
    group = keys if top else [*keys, run]
    # placed once: the row of the table above and the windows read the same exchange
    rows = table if top else table.withColumn(run, F.floor(F.col(at) / FAN)).repartition(*group)
    w = Window.partitionBy(*group).orderBy(at)
    frames = {"before": w.rowsBetween(Window.unboundedPreceding, -1),
              "after": Window.partitionBy(*group).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1),
              "all": w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)}
    if not top:
        above = rows.groupBy(*group).agg(*[_reduced(p, h, at).alias(f"{p}_{h}") for p, h in parts])
        above = carried(above, keys, run, {n: Carry(f"{c.part}_{c.how}", c.how, c.side) for n, c in state.items()}, levels - 1)
        above = above.select(*group, *[F.col(n).alias(f"_far{n}") for n in state])
    near = {}
    for n, c in state.items():
        # read backwards, the nearest of the later rows comes last
        how = {"first": "last", "last": "first"}.get(c.how, c.how) if c.side == "after" else c.how
        near[n] = _OVER[how](c.part).over(frames[c.side])
    if top:
        return rows.withColumns(near)
    rows = rows.withColumns({n: e for n, e in near.items() if state[n].side != "all"}).join(above, group)
    out = {n: F.col(f"_far{n}") if c.side == "all" else _BOTH[c.how](F.col(n), F.col(f"_far{n}")) for n, c in state.items()}
    return rows.withColumns(out).drop(run, *[f"_far{n}" for n in state])


def running(df: DataFrame, s: Series, *what: Running) -> DataFrame:
    """Add running quantities, all of them in one pass over the bucket table.

    The bucket table has one row per (key, bucket), combined map-side, and is written; the tree over it is
    as deep as its longest series needs. The input is read twice, once narrowed to what the aggregates
    need: pass a table, or `stage` an expensive plan first, and combine quantities in one call.
    """
    parts = {n: c for r in what for n, c in r.parts.items()}
    state = {n: c for r in what for n, c in r.state.items()}
    cols = {n: c for r in what for n, c in r.cols.items()}
    rows = df.withColumn(BUCKET, bucket_number(df, s))
    table = rows.groupBy(*s.keys, BUCKET).agg(*[c.alias(n) for n, c in parts.items()])
    if state:
        table = stage(table, "buckets")
        table = carried(table, s.keys, BUCKET, state, _levels(table, BUCKET, FAN))
    table = table.select(*s.keys, BUCKET, *[c.then(F.col(n)).alias(n) for n, c in state.items()])
    # explicit, so that rows already placed by key alone are not left in one task per series
    out = rows.repartition(*s.keys, BUCKET).join(table, [*s.keys, BUCKET])
    return out.withColumns(cols).drop(BUCKET, *[n for n in state if n.startswith("_")])


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def row_numbers(s: Series, row: str = ROW, count: str | None = None) -> Running:
    """1-based position in the series, and optionally the series length."""
    state = {"_before": Carry("_rows", "sum", then=or_zero)}
    if count:
        state[count] = Carry("_rows", "sum", "all")
    return Running({"_rows": F.count(F.lit(1))}, state,
                   {row: F.row_number().over(by_bucket(s)) + F.col("_before")})


def fills(s: Series, cols: list[str]) -> Running:
    """Last seen value, else the next one; both searches cross bucket borders."""
    parts, state, out = {}, {}, {}
    back, fore = so_far(s), from_here(s)
    for c in cols:
        seen = F.when(F.col(c).isNotNull(), F.col(s.t))
        parts[f"_l_{c}"], parts[f"_f_{c}"] = F.max_by(c, seen), F.min_by(c, seen)
        state[f"_in_{c}"] = Carry(f"_l_{c}", "last")
        state[f"_out_{c}"] = Carry(f"_f_{c}", "first", "after")
        out[c] = F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_in_{c}"),
                            F.last(c, ignorenulls=True).over(fore), F.col(f"_out_{c}"))
    return Running(parts, state, out)


def sums(s: Series, col: str, name: str) -> Running:
    """Cumulative sum along the series."""
    part, before = f"_part_{name}", f"_before_{name}"
    return Running(
        {part: F.sum(col)},
        {before: Carry(part, "sum", then=or_zero)},
        {name: F.sum(col).over(so_far(s)) + F.col(before)})


def number_rows(df: DataFrame, s: Series, row: str = ROW, count: str | None = None) -> DataFrame:
    return running(df, s, row_numbers(s, row, count))


def segmented(df: DataFrame, s: Series, back: int = 0, ahead: int = 0,
              size: int = SEGMENT_ROWS, row: str = ROW) -> DataFrame:
    """Cut each series into segments of `size` rows plus the rows their frames reach into.

    Adds `_seg` and `_own`; rows with `_own` false are context only and must be dropped by
    `own_rows` after the window expressions ran. Expects `row` from `number_rows`, or numbers
    the rows itself.
    """
    if row not in df.columns:
        df = number_rows(df, s, row)
    pos = F.col(row) - 1
    home = F.floor(pos / size)
    if back or ahead:
        seg = F.explode(F.sequence(F.greatest(F.floor((pos - ahead) / size), F.lit(0)),
                                   F.floor((pos + back) / size)))
    else:
        seg = home
    out = df.withColumn(SEG, seg).repartition(*s.keys, SEG)
    return out.withColumn(OWN, F.col(SEG) == home)


def in_segment(s: Series, row: str = ROW) -> WindowSpec:
    """Order inside one segment."""
    return Window.partitionBy(*s.keys, SEG).orderBy(row)


def own_rows(df: DataFrame, *drop: str) -> DataFrame:
    """Keep each row once, in its home segment."""
    return df.filter(OWN).drop(SEG, OWN, *drop)


# ── affine recurrences ──────────────────────────────────────────────────────
def _then(maps: Column, name: str, y: Column) -> Column:
    """The state after an array of maps."""
    return F.aggregate(maps, y, lambda acc, m: acc * m[f"a_{name}"] + m[f"b_{name}"])


def _together(maps: Column, name: str, start: Column) -> Column:
    """The one map that a map and then an array of maps compose to."""
    return F.aggregate(maps, start, lambda acc, m: F.struct(
        (acc["a"] * m[f"a_{name}"]).alias("a"), (acc["b"] * m[f"a_{name}"] + m[f"b_{name}"]).alias("b")))


def _identity() -> Column:
    return F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))


def _before(maps: DataFrame, keys: list[str], at: str, names: list[str], levels: int) -> DataFrame:
    """(keys, at, y_name): the state before each map of a table (keys, at, a_name, b_name), zero before the first.

    Runs of FAN_MAPS maps compose to one row of the table above, whose state is found first.
    """
    run = f"_run{levels}"
    group = keys if levels == 0 else [*keys, run]
    rows = maps if levels == 0 else maps.withColumn(run, F.floor(F.col(at) / FAN_MAPS))
    packed = rows.groupBy(*group).agg(F.sort_array(F.collect_list(
        F.struct(at, *[f"{x}_{n}" for n in names for x in "ab"]))).alias("_maps"))
    if levels == 0:
        packed = packed.withColumns({f"y_{n}": F.lit(0.0) for n in names})
    else:
        above = packed.select(*group, *[_together(F.col("_maps"), n, _identity()).alias(n) for n in names])
        above = above.select(*group, *[F.col(n)[x].alias(f"{x}_{n}") for n in names for x in "ab"])
        packed = packed.join(_before(above, keys, run, names, levels - 1), group)

    def state(m, i):
        return F.struct(m[at].alias(at), *[_then(F.slice(F.col("_maps"), F.lit(1), i), n, F.col(f"y_{n}")).alias(f"y_{n}")
                                           for n in names])
    return packed.select(*keys, F.explode(F.transform("_maps", state)).alias("_s")).select(*keys, "_s.*")


def states_before(rows: DataFrame, s: Series, maps: dict[str, tuple[Column, Column]], size: int = SEGMENT_ROWS,
                  row: str = ROW) -> DataFrame:
    """(key, segment, states): for each segment the state before each of its pieces of PIECE rows.

    `rows` are numbered; `maps` names the factor and the summand of each recurrence in a row, which
    start from zero before the first row. A segment's rows are one bounded array; what its pieces
    compose to is written, and the tree over the segments is as deep as the longest series needs.
    """
    names = list(maps)
    narrow = rows.select(*s.keys, F.floor((F.col(row) - 1) / size).alias(SEG), row,
                         *[c.cast("double").alias(f"{x}_{n}") for n, ab in maps.items() for x, c in zip("ab", ab)])
    packed = narrow.groupBy(*s.keys, SEG).agg(F.sort_array(F.collect_list(
        F.struct(row, *[f"{x}_{n}" for n in names for x in "ab"]))).alias("_maps"))

    def onward(n):
        """The maps from the segment's start to that of each piece, and to the segment's end."""
        pieces = F.sequence(F.lit(0), F.ceil(F.size("_maps") / PIECE).cast("int") - 1)
        return F.aggregate(pieces, F.array(_identity()), lambda acc, p: F.concat(acc, F.array(_together(
            F.slice(F.col("_maps"), p * PIECE + 1, F.lit(PIECE)), n, F.element_at(acc, -1)))))
    pieces = stage(packed.select(*s.keys, SEG, *[onward(n).alias(f"_p_{n}") for n in names]), "pieces")
    levels = _levels(pieces, SEG, FAN_MAPS)
    whole = pieces.select(*s.keys, SEG, *[F.element_at(f"_p_{n}", -1)[x].alias(f"{x}_{n}") for n in names for x in "ab"])
    first = pieces.join(_before(whole, s.keys, SEG, names, levels), [*s.keys, SEG])

    def states(n):
        return F.transform(f"_p_{n}", lambda m: m["a"] * F.col(f"y_{n}") + m["b"]).alias(f"_y_{n}")
    return first.select(*s.keys, SEG, *[states(n) for n in names])


def state_after(s: Series, name: str, a: Column, b: Column, size: int = SEGMENT_ROWS, row: str = ROW) -> Column:
    """The recurrence's state after a row of a segment that was joined with `states_before`."""
    place = F.col(row) - 1 - F.col(SEG) * size
    piece = F.floor(place / PIECE).cast("int")
    w = Window.partitionBy(*s.keys, SEG, piece).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    maps = F.collect_list(F.struct(a.cast("double").alias(f"a_{name}"), b.cast("double").alias(f"b_{name}"))).over(w)
    return F.when(place.between(0, size - 1), _then(maps, name, F.get(f"_y_{name}", piece)))


# ── lagged products ─────────────────────────────────────────────────────────
def series_totals(s: Series, col: str, name: str) -> Running:
    """On every row: the non-null count, mean, least and greatest value of the whole series, from the bucket table."""
    n, total = f"_n_{name}", f"_t_{name}"
    parts = {n: F.count(col), total: F.sum(F.col(col).cast("double")), f"_a_{name}": F.min(col), f"_z_{name}": F.max(col)}
    state = {f"_all{n}": Carry(n, "sum", "all"), f"_all{total}": Carry(total, "sum", "all"),
             f"_least_{name}": Carry(f"_a_{name}", "min", "all"), f"_most_{name}": Carry(f"_z_{name}", "max", "all")}
    return Running(parts, state, {
        f"{name}_count": F.col(f"_all{n}"), f"{name}_mean": F.try_divide(f"_all{total}", f"_all{n}"),
        f"{name}_min": F.col(f"_least_{name}"), f"{name}_max": F.col(f"_most_{name}")})


def lagged_products(df: DataFrame, s: Series, col: str, lags: list[int], carry: list[str],
                    size: int = SEGMENT_ROWS, row: str = ROW) -> DataFrame:
    """(keys, lag, total, carry): the sum of x(i) * x(i - lag) over each numbered series.

    Overlap-save: a segment's values and the last `max(lags)` values before it are one array, whose
    products with itself moved by each lag are summed inside the task; one exchange whatever the lags.
    Segments grow with the largest lag, so that a row is sent at most twice. A missing value
    counts as zero, and a lag as long as the series has the sum 0. `carry` names columns that are equal in
    all rows of a series.
    """
    if not lags or min(lags) < 0:
        raise ValueError("lags must be non-negative and not empty")
    reach = max(lags)
    size = max(size, reach)
    cut = segmented(df.select(*s.keys, row, F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("_x"), *carry),
                    s, back=reach, size=size, row=row)
    packed = cut.groupBy(*s.keys, SEG).agg(
        F.sort_array(F.collect_list(F.struct(row, "_x"))).alias("_rows"),
        F.count(F.when(~F.col(OWN), True)).cast("int").alias("_old"), *[F.first(c).alias(c) for c in carry])
    # a segment past the end of the series holds only what it was sent
    packed = packed.filter(F.size("_rows") > F.col("_old")).select(
        *s.keys, *carry, F.col("_rows._x").alias("_x"), "_old")

    def total(lag: Column) -> Column:
        start = F.greatest(F.col("_old"), lag)
        now = F.slice("_x", start + 1, F.greatest(F.size("_x") - start, F.lit(0)))
        then = F.slice("_x", start - lag + 1, F.greatest(F.size("_x") - start, F.lit(0)))
        return F.aggregate(F.zip_with(now, then, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    every = F.transform(F.array(*[F.lit(int(k)) for k in lags]),
                        lambda k: F.struct(k.alias("lag"), total(k).alias("total")))
    out = packed.select(*s.keys, *carry, F.explode(every).alias("_l")).select(*s.keys, *carry, "_l.*")
    return out.groupBy(*s.keys, "lag").agg(F.sum("total").alias("total"), *[F.first(c).alias(c) for c in carry])


def rolled(df: DataFrame, s: Series, exprs, back: int = 0, ahead: int = 0,
           size: int = SEGMENT_ROWS, beside: DataFrame | None = None) -> DataFrame:
    """Add columns computed over a bounded reach.

    `exprs(w)` gets the segment window and returns one dict of columns, or a list of dicts that
    are added one after the other. All of them share one exchange and one sort. `beside` holds one
    row per (key, segment) whose columns the expressions may use.
    """
    out = segmented(df, s, back, ahead, size)
    if beside is not None:
        out = out.join(beside, [*s.keys, SEG], "left")
    steps = exprs(in_segment(s))
    for step in steps if isinstance(steps, list) else [steps]:
        out = out.withColumns(step)
    extra = [] if beside is None else [c for c in beside.columns if c not in (*s.keys, SEG)]
    return own_rows(out, ROW, *extra)


def full_frame(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows including this one."""
    return w.rowsBetween(-(n - 1), 0)


def when_full(agg: Column, col: Column, w: WindowSpec, n: int) -> Column:
    """A rolling aggregate that is null until n non-null values are in the frame."""
    return F.when(F.count(col).over(full_frame(w, n)) == n, agg.over(full_frame(w, n)))
