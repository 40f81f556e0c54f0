"""Articles: filtering, ordering, scoring and daily aggregation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import article_text, gate, matched_keywords, matched_tags
from panelspark.functions.topics import Topic
from panelspark.operators.calendar import first_max_label
from panelspark.operators.segments import number_rows
from panelspark.schema import PROB_COLS, PROB_LABELS, Series

# Priority of the three buckets.
BUCKETS = ("both", "nyt_only", "kw_only")


# ── filter ──────────────────────────────────────────────────────────────────
def bucket(broad: Column, tight: Column, keywords: Column) -> Column:
    """Broad tag and a keyword; a tight tag alone; two keywords alone; else null."""
    n = F.size(keywords)
    return (F.when((F.size(broad) > 0) & (n >= 1), BUCKETS[0])
            .when(F.size(tight) > 0, BUCKETS[1]).when(n >= 2, BUCKETS[2]))


def category(keywords: Column, tags: Column, topic: Topic) -> Column:
    """The specific class if any specific keyword or tag matched, else the other one."""
    def lits(xs):
        return F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    hit = (F.arrays_overlap(keywords, lits(topic.specific_keywords))
           | F.arrays_overlap(tags, lits(topic.specific_tags)))
    return F.when(hit, topic.specific_name).otherwise(topic.other_name)


def filter_articles(df: DataFrame, topic: Topic) -> DataFrame:
    """Gate, text fallback, tag and keyword matches, bucket and category.

    Expects `abstract, headline, pub_date, news_desk, section_name, keywords`. The cheap gate
    runs before any text is searched.
    """
    found = F.struct(matched_tags(F.col("keywords"), topic.broad_tags).alias("broad"),
                     matched_tags(F.col("keywords"), topic.tight_tags).alias("tight"),
                     matched_keywords(F.col("text"), topic.keywords).alias("keywords"))
    out = (df.filter(gate(F.col("news_desk"), F.col("section_name"), topic.desks, topic.sections))
           .withColumns({"text": article_text(F.col("abstract"), F.col("headline")),
                         "date": F.substring(F.coalesce("pub_date", F.lit("")), 1, 10)})
           .filter((F.col("date") != "") & F.col("text").isNotNull())
           # a one-element explode pins the matches: filters below would otherwise be pushed
           # through the projection and search the whole text again for each use
           .withColumn("_found", F.explode(F.array(found)))
           .withColumn("bucket", bucket(F.col("_found.broad"), F.col("_found.tight"),
                                        F.col("_found.keywords")))
           .filter(F.col("bucket").isNotNull())
           .withColumns({"keywords": F.col("_found.keywords"),
                         "tags": F.array_sort(F.array_union("_found.broad", "_found.tight"))})
           .drop("_found"))
    kind = (category(F.col("keywords"), F.col("tags"), topic) if topic.split
            else F.lit(None).cast("string"))
    return out.withColumn("category", kind)


def order_articles(df: DataFrame, day: str = "date", seq: str = "seq",
                   name: str = "slot") -> DataFrame:
    """1-based position within the day: by bucket priority, then by arrival.

    Positions come from counts per (day, run of arrivals), so a day that holds most of the
    articles is still numbered by many tasks.
    """
    rank = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(i)) for i, b in enumerate(BUCKETS)])
    out = df.withColumn("_ord", F.shiftleft(rank.cast("long"), 56) + F.col(seq))
    return number_rows(out, Series((day,), "_ord"), name).drop("_ord")


def news_wide(df: DataFrame, max_width: int = 10_000, day: str = "date",
              text: str = "text", slot: str = "slot") -> DataFrame:
    """One row per day, columns `News 1..N`, N the busiest day; short days are padded.

    The long form of `order_articles` has no width limit; a day too wide for columns raises.
    """
    n = df.agg(F.max(slot)).first()[0] or 0
    if n > max_width:
        raise ValueError(f"busiest day has {n} articles; use the long form")
    out = df.groupBy(day).pivot(slot, list(range(1, n + 1))).agg(F.first(text))
    return out.select(F.col(day).alias("Date"),
                      *[F.coalesce(F.col(f"`{i}`"), F.lit("")).alias(f"News {i}")
                        for i in range(1, n + 1)])


def melt_headlines(df: DataFrame, day: str = "Date") -> DataFrame:
    """Wide headlines back to one row each, empty cells dropped, in column order."""
    cols = [c for c in df.columns if c != day]
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i + 1))])
    out = df.unpivot(day, cols, "column", "headline")
    return (out.filter("headline is not null and headline <> ''")
            .select(day, order[F.col("column")].alias("slot"), "headline"))


def keyword_audit(df: DataFrame, calendar: DataFrame, day: str = "date") -> DataFrame:
    """Sorted distinct keywords and tags per calendar day, joined by a bar; empty days stay.

    Matches are made distinct per day before they meet, so a day's list is bounded by the
    vocabulary, not by its articles.
    """
    def tagged(kind):
        return F.transform(kind, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))
    both = F.concat(tagged("keywords"), tagged("tags"))
    words = df.select(day, F.explode(both).alias("m")).select(day, "m.*").distinct()
    def joined(kind):
        hits = F.collect_list(F.when(F.col("kind") == kind, F.col("w")))
        return F.array_join(F.array_sort(hits), "|").alias(kind)
    lists = words.groupBy(day).agg(joined("keywords"), joined("tags"))
    return calendar.select(day).join(lists, day, "left").na.fill("", ["keywords", "tags"])


def corpus_summary(df: DataFrame, day: str = "date") -> DataFrame:
    per_day = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(F.count(F.lit(1)).alias("days_with_news"), F.sum("n").alias("total_articles"),
                       F.max("n").alias("max_per_day"))


# ── daily aggregation ───────────────────────────────────────────────────────
def mean_embedding(col: str) -> Column:
    """Element-wise mean as one aggregate with map-side partials."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(col))))


def daily_news(df: DataFrame, day: str = "date", vector: str | None = "embedding",
               probs=PROB_COLS, labels=PROB_LABELS) -> DataFrame:
    """Mean embedding, mean probabilities and the label of the largest mean, one row per day."""
    have = [p for p in probs if p in df.columns]
    aggs = [F.avg(p).alias(p) for p in have]
    if vector:
        aggs.append(mean_embedding(vector).alias(vector))
    out = df.groupBy(day).agg(*aggs)
    return out.withColumn("label", first_max_label([F.col(p) for p in have], labels)) if have else out


def softmax(logits: list[Column]) -> list[Column]:
    top = F.greatest(*logits)
    e = [F.exp(x - top) for x in logits]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def aggregate_sentiment(df: DataFrame, logits: list[str], day: str = "date",
                        order: str = "seq", labels=PROB_LABELS) -> DataFrame:
    """Both ways to one label per day, in one pass, and why they may differ.

    `label_probs` from mean probabilities, `label_logits` from the softmax of mean logits,
    `spike` the largest logit minus the mean of all others, `conflict` whether the most certain
    article votes against `label_logits`.
    """
    cols = [F.col(c).cast("double") for c in logits]
    k = len(cols)
    out = df.withColumns({f"_p{i}": p for i, p in enumerate(softmax(cols))})
    ps = [F.col(f"_p{i}") for i in range(k)]
    out = out.withColumns({"_conf": F.greatest(*ps), "_vote": first_max_label(ps, labels),
                           "_sum": sum(cols[1:], cols[0]), "_max": F.greatest(*cols)})
    n, top = F.count(F.lit(1)) * k, F.max("_max")
    day_rows = out.groupBy(day).agg(
        *[F.avg(p).alias(f"prob_{name}") for p, name in zip(ps, labels)],
        *[F.avg(c).alias(f"_l{i}") for i, c in enumerate(cols)],
        F.when(n > 1, (top - (F.sum("_sum") - top) / (n - 1))).alias("spike"),
        F.max_by("_vote", F.struct("_conf", (-F.col(order)).alias("o"))).alias("confident_label"))
    soft = softmax([F.col(f"_l{i}") for i in range(k)])
    return day_rows.withColumns({
        **{f"soft_{name}": p for name, p in zip(labels, soft)},
        "label_probs": first_max_label([F.col(f"prob_{name}") for name in labels], labels),
        "label_logits": first_max_label([F.col(f"_l{i}") for i in range(k)], labels),
    }).withColumns({
        "agree": F.col("label_probs") == F.col("label_logits"),
        "conflict": (F.col("confident_label") != F.col("label_logits")).cast("int"),
    }).drop(*[f"_l{i}" for i in range(k)])


def compare_methods(days: DataFrame, labels=PROB_LABELS) -> DataFrame:
    """Share of each label per method, over all days and over the days they disagree on."""
    dis = ~F.col("agree")
    def share(col, name, only=None):
        hit = (F.col(col) == name) if only is None else ((F.col(col) == name) & only)
        base = F.lit(True) if only is None else only
        return F.try_divide(F.sum(hit.cast("int")), F.sum(base.cast("int")))
    names = {"probs": "label_probs", "logits": "label_logits"}
    row = days.agg(*[share(c, name, only).alias(f"{name}|{m}|{tag}")
                     for name in labels for m, c in names.items()
                     for tag, only in (("all", None), ("disagree", dis))])
    structs = [F.struct(F.lit(name).alias("label"),
                        *[F.col(f"`{name}|{m}|{tag}`").alias(f"share_{m}_{tag}")
                          for m in names for tag in ("all", "disagree")]) for name in labels]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# ── scoring hook ────────────────────────────────────────────────────────────
SCORED = "embedding array<float>, probs map<string,double>"


def score_text(df: DataFrame, scorer: Callable[[], Callable[[list[str]], list[dict]]],
               text: str = "text", batch: int = 64, labels=PROB_LABELS) -> DataFrame:
    """Score texts with a user model; adds `embedding` and one probability column per label.

    `scorer()` runs once per task and returns a function from a list of texts to a list of
    `{"embedding": [...], "probs": {label: p}}`; `probs` may be absent for embedding-only models.
    Probabilities are placed by label name. A label set that is not the expected one raises.
    Rows are articles, so one crowded day is spread over all tasks; `batch` bounds memory.
    """
    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    expected = set(labels)

    def run(frames):
        model = scorer()
        for pdf in frames:
            embeddings, probs = [], []
            for i in range(0, len(pdf), batch):
                texts = pdf[text].iloc[i:i + batch].tolist()
                for r in model(texts):
                    p = r.get("probs")
                    if p is not None and set(p) != expected:
                        raise ValueError(f"labels {sorted(p)} are not {sorted(expected)}")
                    embeddings.append(r["embedding"])
                    probs.append(p)
            yield pdf.assign(embedding=pd.Series(embeddings, index=pdf.index, dtype=object),
                             probs=pd.Series(probs, index=pdf.index, dtype=object))

    out = df.mapInPandas(run, f"{fields}, {SCORED}")
    return out.withColumns({f"prob_{n}": F.col("probs")[n] for n in labels}).drop("probs")


def lexicon_scorer(words: dict[str, set[str]], dim: int = 4):
    """A deterministic scorer for tests: class shares from word counts, a tiny count vector."""
    import re
    token = re.compile(r"\w+")

    def build():
        def score(texts):
            out = []
            for t in texts:
                found = token.findall((t or "").lower())
                n = {k: 1 + sum(w in ws for w in found) for k, ws in words.items()}
                total = sum(n.values())
                vec = [0.0] * dim
                for w in found:
                    vec[len(w) % dim] += 1.0
                out.append({"embedding": vec, "probs": {k: v / total for k, v in n.items()}})
            return out
        return score
    return build
