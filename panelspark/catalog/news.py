"""Articles, sentiment and daily news."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelspark.catalog import query
from panelspark.catalog.inputs import SQL_SCORED, rnd, scored, table
from panelspark.functions.text import article_text, gate, matched_keywords, matched_tags
from panelspark.functions.topics import Topic
from panelspark.operators import calendar as C
from panelspark.operators import news as N
from panelspark.operators.align import encode_label
from panelspark.session import stage
from panelspark.sources.articles import latest_batch

KEYWORDS = ["the", "the of", "and", "ing", "on", "or", "ther", "in that", "of", "er"]
TAGS_BROAD = ["src1", "src3", "tag2", "tag4", "tag5"]
TAGS_TIGHT = ["src2", "tag4"]
TOPIC = Topic(desks=("src1", "src2", "src3", "src4", "src5", "src6", "src7"), sections=("en", "es"),
              broad_tags=tuple(TAGS_BROAD), tight_tags=tuple(TAGS_TIGHT), keywords=tuple(KEYWORDS),
              specific_keywords=("the of", "ther", "in that"), specific_tags=("tag4", "src2"))


def articles(spark, sf):
    """Documents in the shape of raw articles: some without abstract, all with subject tags."""
    d = F.col("doc_id")
    day = F.expr("date_add(date'2024-01-01', cast(doc_id * doc_id % 61 as int))")
    def kw(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))
    return table(spark, sf, "documents").select(
        "doc_id", F.when(d % 11 != 0, F.col("text")).alias("abstract"),
        F.when(d % 22 != 0, F.concat(F.lit("On the "), "source")).alias("headline"),
        F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss").alias("pub_date"),
        F.upper("source").alias("news_desk"), F.col("lang").alias("section_name"),
        F.array(kw("Subject", F.col("source")), kw("glocations", F.lit("tag2")),
                kw("subject", F.concat(F.lit("tag"), (d % 7).cast("string")))).alias("keywords"))


B = r"[^\p{L}\p{N}_]"


def hit(kw: str, text: str = "lower(text)") -> str:
    return f"regexp_matches({text}, '(^|{B}){kw}s?({B}|$)')"


def listed(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


KW_SQL = "list_filter([" + ", ".join(f"case when {hit(k)} then '{k}' end" for k in sorted(KEYWORDS)) + "], lambda x: x is not null)"
ART_SQL = rf"""raw as (select doc_id, case when doc_id % 11 <> 0 then text end abstract,
  case when doc_id % 22 <> 0 then 'On the ' || source end headline,
  date '2024-01-01' + cast(doc_id * doc_id % 61 as int) date, source, lang, 'tag' || (doc_id % 7) tag from documents),
txt as (select *, coalesce(nullif(trim(replace(coalesce(abstract, ''), ',', '')), ''),
  nullif(trim(replace(coalesce(headline, ''), ',', '')), '')) text from raw),
passed as (select * from txt where (lower(source) in ({listed(TOPIC.desks)}) or lower(lang) in ({listed(TOPIC.sections)})) and text is not null),
tagged as (select *, {KW_SQL} kws,
  list_filter(list_distinct([source, tag]), lambda x: x in ({listed(TAGS_BROAD)})) broad,
  list_filter(list_distinct([source, tag]), lambda x: x in ({listed(TAGS_TIGHT)})) tight from passed),
kept as (select *, list_sort(list_distinct(list_concat(broad, tight))) tags,
  case when len(broad) > 0 and len(kws) >= 1 then 'both' when len(tight) > 0 then 'nyt_only'
       when len(kws) >= 2 then 'kw_only' end bucket from tagged),
arts as (select *, case when list_has_any(kws, [{listed(TOPIC.specific_keywords)}])
  or list_has_any(tags, [{listed(TOPIC.specific_tags)}]) then 'metal' else 'economy' end category
  from kept where bucket is not null)"""


@query("editorial_gate", f"""select doc_id, source, lang from documents
where lower(source) in ('src1', 'src3') or lower(lang) in ('es')""")
def editorial_gate(spark, sf):
    d = table(spark, sf, "documents")
    return d.filter(gate(F.upper("source"), F.upper("lang"), {"src1", "src3"}, {"es"})).select(
        "doc_id", "source", "lang")


@query("article_text", f"""with {ART_SQL} select doc_id, coalesce(length(text), 0) n, md5(text) digest from txt""")
def article_text_query(spark, sf):
    a = articles(spark, sf).withColumn("text", article_text(F.col("abstract"), F.col("headline")))
    return a.select("doc_id", F.coalesce(F.length("text").cast("long"), F.lit(0)).alias("n"), F.md5("text").alias("digest"))


@query("matched_keywords", f"""select doc_id, array_to_string({KW_SQL}, '|') hits from documents""")
def matched_keywords_query(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(matched_keywords(F.col("text"), KEYWORDS), "|").alias("hits"))


@query("matched_tags", f"""select doc_id, array_to_string(list_sort(list_filter(list_distinct([source, 'tag' || (doc_id % 7)]),
  lambda x: x in ({listed(TAGS_BROAD)}))), '|') tags from documents""")
def matched_tags_query(spark, sf):
    return articles(spark, sf).select(
        "doc_id", F.array_join(matched_tags(F.col("keywords"), TAGS_BROAD), "|").alias("tags"))


@query("filter_articles", f"""with {ART_SQL}
select doc_id, strftime(date, '%Y-%m-%d') date, bucket, category, array_to_string(kws, '|') keywords,
  array_to_string(tags, '|') tags, md5(text) digest from arts""")
def filter_articles(spark, sf):
    out = N.filter_articles(articles(spark, sf), TOPIC)
    return out.select("doc_id", "date", "bucket", "category", F.array_join("keywords", "|").alias("keywords"),
                      F.array_join("tags", "|").alias("tags"), F.md5("text").alias("digest"))


@query("article_slots", f"""with {ART_SQL}
select strftime(date, '%Y-%m-%d') date, row_number() over (partition by date order by
  case bucket when 'both' then 0 when 'nyt_only' then 1 else 2 end, doc_id) slot, doc_id, md5(text) digest from arts""")
def article_slots(spark, sf):
    """The wide headline table in its long form: day, position, text."""
    kept = stage(N.filter_articles(articles(spark, sf), TOPIC), "articles")
    out = N.order_articles(kept, seq="doc_id")
    return out.select("date", "slot", "doc_id", F.md5("text").alias("digest"))


@query("keyword_audit", f"""with {ART_SQL},
c as (select cast(unnest(generate_series(date '2024-01-01', date '2024-03-01', interval 1 day)) as date) date),
k as (select date, string_agg(w, '|' order by w) keywords from (select distinct date, unnest(kws) w from arts) group by 1),
g as (select date, string_agg(w, '|' order by w) tags from (select distinct date, unnest(tags) w from arts) group by 1)
select strftime(c.date, '%Y-%m-%d') date, coalesce(keywords, '') keywords, coalesce(tags, '') tags
from c left join k using (date) left join g using (date)""")
def keyword_audit(spark, sf):
    cal = C.calendar(spark, dt.date(2024, 1, 1), dt.date(2024, 3, 1), "date")
    cal = cal.select(F.date_format("date", "yyyy-MM-dd").alias("date"))
    return N.keyword_audit(N.filter_articles(articles(spark, sf), TOPIC), cal)


@query("corpus_summary", """with d as (select doc_id * doc_id % 61 k, count(*) n from documents group by 1)
select count(*) days_with_news, cast(sum(n) as bigint) total_articles, max(n) max_per_day from d""")
def corpus_summary(spark, sf):
    return N.corpus_summary(articles(spark, sf), "pub_date")


@query("latest_batch", time="date", sql="""with a as (select doc_id, date '2024-01-01' + cast(doc_id * doc_id % 61 as int) date,
  '2024-0' || (1 + doc_id % 4) batch_month from documents)
select doc_id, date, batch_month from (select *, max(batch_month) over (partition by date) m from a) where batch_month = m""")
def latest_batch_query(spark, sf):
    a = table(spark, sf, "documents").select(
        "doc_id", F.expr("date_add(date'2024-01-01', cast(doc_id * doc_id % 61 as int))").alias("date"),
        F.concat(F.lit("2024-0"), (1 + F.col("doc_id") % 4).cast("string")).alias("batch_month"))
    return latest_batch(a).select("doc_id", "date", "batch_month")


@query("daily_news", time="date", sql=f"""with {SQL_SCORED},
e as (select date, i, avg(cast(embedding[i] as double)) m from scored, generate_series(1, 64) g(i) group by 1, 2),
l as (select date, round(sum(m), 6) + 0.0 emb_sum, round(sum(m * i), 5) + 0.0 emb_moment from e group by 1),
p as (select date, avg(prob_positive) a, avg(prob_negative) b, avg(prob_neutral) c from scored group by 1)
select date, round(a, 6) prob_positive, round(b, 6) prob_negative, round(c, 6) prob_neutral, emb_sum, emb_moment,
  case when a >= b and a >= c then 'positive' when b >= c then 'negative' else 'neutral' end as label,
  cast(case when a >= b and a >= c then 1 when b >= c then -1 else 0 end as integer) code
from p join l using (date)""")
def daily_news(spark, sf):
    out = N.daily_news(scored(spark, sf), "date")
    moment = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("date", *[rnd(c).alias(c) for c in C.PROB_COLS],
                      rnd(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("emb_sum"),
                      rnd(moment, 5).alias("emb_moment"), "label", encode_label("label").alias("code"))


LOGIT_SQL = """lg as (select vec_id, date '2024-01-01' + cast(vec_id * vec_id % 61 as int) date,
  cast(embedding[1] as double) * 20 a, cast(embedding[2] as double) * 20 b, cast(embedding[3] as double) * 20 c from embeddings),
sm as (select *, exp(a - greatest(a, b, c)) ea, exp(b - greatest(a, b, c)) eb, exp(c - greatest(a, b, c)) ec from lg),
pr as (select *, ea / (ea + eb + ec) pa, eb / (ea + eb + ec) pb, ec / (ea + eb + ec) pc from sm),
vt as (select *, greatest(pa, pb, pc) conf, case when pa >= pb and pa >= pc then 'positive' when pb >= pc then 'negative' else 'neutral' end vote from pr),
dy as (select date, avg(pa) pa, avg(pb) pb, avg(pc) pc, avg(a) la, avg(b) lb, avg(c) lc,
  max(greatest(a, b, c)) - (sum(a + b + c) - max(greatest(a, b, c))) / (count(*) * 3 - 1) spike,
  arg_max(vote, (conf, -vec_id)) confident from vt group by 1),
lb as (select *, case when pa >= pb and pa >= pc then 'positive' when pb >= pc then 'negative' else 'neutral' end label_probs,
  case when la >= lb and la >= lc then 'positive' when lb >= lc then 'negative' else 'neutral' end label_logits from dy),
res as (select *, label_probs = label_logits agree, case when confident <> label_logits then 1 else 0 end conflict from lb)"""


def _both_methods(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.expr("date_add(date'2024-01-01', cast(vec_id * vec_id % 61 as int))").alias("date"),
        *[(F.get("embedding", F.lit(i)).cast("double") * 20).alias(n) for i, n in enumerate("abc")])
    return N.aggregate_sentiment(e, ["a", "b", "c"], order="vec_id")


@query("aggregate_sentiment", time="date", sql=f"""with {LOGIT_SQL}
select date, round(pa, 6) prob_positive, round(pb, 6) prob_negative, round(pc, 6) prob_neutral,
  round(exp(la) / (exp(la) + exp(lb) + exp(lc)), 6) soft_positive, label_probs, label_logits, agree from res""")
def aggregate_sentiment(spark, sf):
    return _both_methods(spark, sf).select(
        "date", *[rnd(c).alias(c) for c in (*C.PROB_COLS, "soft_positive")], "label_probs",
        "label_logits", "agree")


@query("compare_sentiment_methods", f"""with {LOGIT_SQL}, l as (select unnest(['positive', 'negative', 'neutral']) as label)
select l.label, round(avg(cast(label_probs = l.label as int)), 6) share_probs_all, round(avg(cast(label_logits = l.label as int)), 6) share_logits_all,
  round(avg(cast(label_probs = l.label as int)) filter (not agree), 6) share_probs_disagree,
  round(avg(cast(label_logits = l.label as int)) filter (not agree), 6) share_logits_disagree from l, res group by 1""")
def compare_sentiment_methods(spark, sf):
    out = N.compare_methods(_both_methods(spark, sf))
    return out.select("label", *[rnd(c).alias(c) for c in out.columns if c != "label"])


@query("spike_strength", time="date", sql=f"""with {LOGIT_SQL} select date, round(spike, 6) spike, agree from res""")
def spike_strength(spark, sf):
    return _both_methods(spark, sf).select("date", rnd("spike").alias("spike"), "agree")


@query("class_conflict", f"""with {LOGIT_SQL}
select agree, count(*) n, round(avg(conflict), 6) conflict_rate, round(avg(spike), 6) mean_spike from res group by 1""")
def class_conflict(spark, sf):
    return _both_methods(spark, sf).groupBy("agree").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("conflict")).alias("conflict_rate"),
        rnd(F.avg("spike")).alias("mean_spike"))


WORDS = {"positive": {"the", "on"}, "negative": {"and", "or"}, "neutral": {"of", "is"}}


@query("score_text", rf"""with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: x <> '') ws from documents),
n as (select doc_id, len(ws) total, 1 + len(list_filter(ws, lambda x: x in ('the', 'on'))) p, 1 + len(list_filter(ws, lambda x: x in ('and', 'or'))) g,
  1 + len(list_filter(ws, lambda x: x in ('of', 'is'))) u from w)
select doc_id, total n_tokens, round(p / (p + g + u), 6) prob_positive, round(g / (p + g + u), 6) prob_negative,
  round(u / (p + g + u), 6) prob_neutral from n""")
def score_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = N.score_text(d, N.lexicon_scorer(WORDS))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("long")
    return out.select("doc_id", total.alias("n_tokens"), *[rnd(c).alias(c) for c in C.PROB_COLS])


@query("melt_headlines", """select doc_id, slot, headline from (
  select doc_id, 1 slot, source headline from documents union all
  select doc_id, 2, case when doc_id % 2 = 0 then lang end from documents union all
  select doc_id, 3, case when doc_id % 3 = 0 then '' else 'x' || doc_id end from documents) x
where headline is not null and headline <> ''""")
def melt_headlines(spark, sf):
    d = F.col("doc_id")
    wide = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("News 1"), F.when(d % 2 == 0, F.col("lang")).alias("News 2"),
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("x"), d.cast("string"))).alias("News 3"))
    return N.melt_headlines(wide, "doc_id")
