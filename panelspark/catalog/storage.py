"""Sinks and sources, written and read back over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import SQL_DAY, bars_day, rnd, table
from panelspark.catalog.news import ART_SQL, TOPIC, articles
from panelspark.catalog.saliency import RECORDS, _records, record_values
from panelspark.operators import align as A
from panelspark.operators import news as N
from panelspark.operators.windows import assert_aligned
from panelspark.schema import numeric_only
from panelspark.session import shared_dir, stage
from panelspark.sources import sinks
from panelspark.sources.articles import flatten_articles, read_articles
from panelspark.sources.bars import read_bars, read_messy_bars, read_panel
from panelspark.sources.inspect import inspect_tables, require


def _path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


IDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRICES = ["open", "high", "low", "close"]


@query("store_long_panel", time="t", sql=f"""with {SQL_DAY}
select id, t, {", ".join(f"round({c}, 4) as {c}" for c in PRICES)}, volume from bars_day""")
def store_long_panel(spark, sf):
    """Written by series and read back whole."""
    path = _path(spark, "long-panel")
    sinks.write_long_panel(bars_day(spark, sf), path)
    require(spark, path, "write_long_panel")
    return read_panel(spark, path, IDS, [*PRICES, "volume"], t="t").select(
        "id", "t", *[rnd(c, 4).alias(c) for c in PRICES], "volume")


@query("store_wide_panel", time="t", sql=f"""with {SQL_DAY}
select t, {", ".join(f"round(max(case when id = '{i}' then close end), 4) as {i[2:].lower().replace(' ', '_')}" for i in IDS)} from bars_day group by t""")
def store_wide_panel(spark, sf):
    path = _path(spark, "wide-panel")
    sinks.write_wide_panel(bars_day(spark, sf), path, IDS)
    return spark.read.parquet(path).select("t", *[rnd(F.col(f"`{i}`"), 4).alias(i[2:].lower().replace(" ", "_")) for i in IDS])


@query("store_articles_by_day", f"""with {ART_SQL}
select doc_id, strftime(date, '%Y-%m-%d') as day, category, array_to_string(tags, '|') tags, md5(text) digest from arts""")
def store_articles_by_day(spark, sf):
    """One folder per day; writing some days again replaces just those."""
    path = _path(spark, "articles")
    kept = N.filter_articles(articles(spark, sf), TOPIC).select("doc_id", F.col("date").alias("day"), "category", "tags", "text")
    sinks.write_articles_json(kept, path, "day")
    again = spark.read.schema(kept.schema).json(path).filter("day < '2024-01-10'")
    again.write.parquet(path + "-again")
    sinks.write_articles_json(spark.read.parquet(path + "-again"), path, "day")
    back = spark.read.schema("doc_id bigint, day string, category string, tags array<string>, text string").json(path)
    return back.select("doc_id", "day", "category", F.array_join("tags", "|").alias("tags"), F.md5("text").alias("digest"))


@query("store_csv_table", """select l_returnflag flag, l_linestatus status, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by 1, 2""")
def store_csv_table(spark, sf):
    path = _path(spark, "table")
    out = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("l_quantity"), 2).alias("qty"))
    sinks.write_table(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("store_json_summary", """select count(*) n, round(avg(o_totalprice), 4) mean, round(max(o_totalprice), 4) top from orders""")
def store_json_summary(spark, sf):
    path = _path(spark, "summary")
    row = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.struct(
        rnd(F.avg("o_totalprice"), 4).alias("mean"), rnd(F.max("o_totalprice"), 4).alias("top")).alias("metrics"))
    sinks.write_summary(row, path)
    return spark.read.schema(row.schema).json(path).select("n", "metrics.mean", "metrics.top")


@query("append_study_records", f"select r.*, copy from ({RECORDS}) r, (select unnest([1, 2]) as copy)")
def append_study_records(spark, sf):
    """Records written, read, appended once more with another base score, and read back whole."""
    path = _path(spark, "records")
    sinks.append_records(_records(spark, sf), path)
    again = sinks.read_records(spark, path).withColumn("base_crps", -F.col("base_crps"))
    sinks.append_records(again, path)
    back = sinks.read_records(spark, path).withColumn("copy", F.when(F.col("base_crps") < 0, 2).otherwise(1))
    return record_values(back.withColumn("base_crps", F.abs("base_crps")), "copy")


@query("read_messy_csv", time="Date", sql="""select cast(o_orderdate as date) as "Date", o_totalprice as "Close" from orders where o_orderkey % 7 <> 0""")
def read_messy_csv(spark, sf):
    """Lines with a junk header and unparsable closes: those rows fall out."""
    path = _path(spark, "messy")
    o = table(spark, sf, "orders")
    lines = o.select(F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"),
                                 F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")),
                                 F.lit("x")).alias("line"))
    junk = spark.createDataFrame([("Price,Close,^NDX",), ("Date,,",)], "line string")
    junk.unionByName(lines).write.text(path)
    return read_messy_bars(spark, path, ["Date", "Close", "Volume"], ["Date", "Close"]).select("Date", "Close")


@query("read_nested_articles", """select cast(doc_id as varchar) id, coalesce('On the ' || source, '') headline, upper(source) news_desk, 2 n_subjects from documents""")
def read_nested_articles(spark, sf):
    path = _path(spark, "nested")
    d = table(spark, sf, "documents")
    kw = [F.struct(F.lit("subject").alias("name"), F.col(c).alias("value")) for c in ("source", "lang")]
    d.select(F.col("doc_id").cast("string").alias("_id"), F.col("text").alias("abstract"),
             F.struct(F.concat(F.lit("On the "), "source").alias("main")).alias("headline"),
             F.upper("source").alias("news_desk"), F.array(*kw).alias("keywords")).write.json(path)
    back = flatten_articles(read_articles(spark, path))
    return back.select("id", "headline", "news_desk", F.size("keywords").alias("n_subjects"))


@query("inspect_tables")
def inspect(spark, sf):
    return inspect_tables({n: table(spark, sf, n) for n in ("orders", "embeddings", "labels")})


@query("column_diff", """with a as (select column_name c from (describe documents)), b as (select column_name c from (describe labels))
select 'only_a' side, c as "column" from a where c not in (select c from b) union all
select 'only_b', c from b where c not in (select c from a)""")
def column_diff(spark, sf):
    return A.column_diff(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("numeric_only", "select doc_id, n_chars, lang from documents")
def numeric(spark, sf):
    return numeric_only(table(spark, sf, "documents"), keep=("lang",))


@query("read_bars", time="t", sql=f"""with {SQL_DAY}
select id, t, round(open, 4) as open, round(high, 4) high, round(low, 4) low, round(close, 4) as close, volume from bars_day""")
def read_bar_files(spark, sf):
    """A folder of bar CSV files with a header; the id is the file's name."""
    path = _path(spark, "bar-files")
    sinks.write_bar_files(bars_day(spark, sf).select("id", *[F.col(c).alias("Date" if c == "t" else c.capitalize()) for c in (
        "t", "open", "high", "low", "close", "volume")]), path)
    require(spark, path, "the bar download")
    out = read_bars(spark, path)
    return out.select("id", "t", *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("aligned_streams", time="t", sql=f"with {SQL_DAY} select id, t, round(close, 4) as close, volume from bars_day")
def aligned_streams(spark, sf):
    """Two streams of one key set, checked before they are put together."""
    b = stage(bars_day(spark, sf).select("id", "t", "close", "volume"), "streams")
    prices, volumes = b.select("id", "t", "close"), b.select("id", "t", "volume")
    assert_aligned(prices, volumes, ["id", "t"])
    return prices.join(volumes, ["id", "t"]).select("id", "t", rnd("close", 4).alias("close"), "volume")
