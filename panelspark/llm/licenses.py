"""License scans with a positional index of rare words, in DataFrame functions alone.

A first pass counts, over all files, in how many files each word of the licence phrases and
templates stands. Of every phrase the word with the highest inverse document frequency is the one
that is looked up. In a file, the places of the looked-up words, moved by the word's place in the
phrase, are the only possible starts; there the whole phrase is verified. A template is aligned at
each start of its mandatory key phrase, and its score is the share of its words, weighted by
inverse document frequency, that stand at their relative places.

Everything stays in the file's own row: no shuffle but that of the word counts.

Defined results: null is read as empty; a text without words has zero words, no places (null first
and last) and empty labels; repeated rows give repeated results; places that overlap all count; with
an empty table no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and the labels that they give.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# Label, usual wording, and the key phrase in it that must be there.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "public domain"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]

LEAST_SHARE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Phrase = tuple[str, ...]


def base_phrases() -> list[tuple[str, Phrase]]:
    return [(label, tuple(p.split())) for label, p in BASE]


def templates() -> list[tuple[str, Phrase, Phrase, int]]:
    """(label, words, key phrase, the key phrase's place in the words)."""
    out = []
    for label, text, key in TEMPLATES:
        words, k = tuple(text.split()), tuple(key.split())
        at = next(i for i in range(len(words)) if words[i:i + len(k)] == k)
        out.append((label, words, k, at))
    return out


def vocabulary() -> list[str]:
    return sorted({w for _, p in base_phrases() for w in p} | {w for _, words, _, _ in templates() for w in words})


def words_of(text: Column) -> Column:
    """Lower-cased words of a text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of every licence word over all files.

    The counts are one row per licence word, a list fixed by the phrases and templates.
    """
    vocab = vocabulary()
    held = docs.select(F.array_intersect(words_of(F.col(text_col)), F.lit(vocab)).alias("w"))
    total, *counts = held.agg(F.count("*"), *(
        F.sum(F.array_contains("w", w).cast("long")) for w in vocab)).first()
    return {w: round(math.log((total + 1) / ((n or 0) + 1)), 6) for w, n in zip(vocab, counts)}


def _starts(hits: Column, words: Column, phrase: Phrase, weight: dict[str, float]) -> Column:
    """Places where the phrase's words stand consecutively: places of its rarest word, verified."""
    at = max(range(len(phrase)), key=lambda i: (weight[phrase[i]], -i))
    places = F.transform(F.filter(hits, lambda h: h["w"] == phrase[at]), lambda h: h["i"] - at)
    fits = lambda s: _all([s >= 0, *(F.get(words, s + i) == w for i, w in enumerate(phrase) if i != at)])
    return F.filter(places, fits)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _share(words: Column, start: Column, template: Phrase, weight: dict[str, float]) -> Column:
    """Weighted share of the template's words that stand at their places from `start` on."""
    whole = sum(weight[w] for w in template)
    if whole == 0:
        return F.lit(1.0)
    there = [F.when((start + i >= 0) & (F.get(words, F.greatest(start + i, F.lit(0))) == w), weight[w]).otherwise(0.0)
             for i, w in enumerate(template)]
    out = there[0]
    for c in there[1:]:
        out = out + c
    return F.round(out / whole, 6)


def _best_share(places: Column, at: int, words: Column, template: Phrase, weight: dict[str, float]) -> Column:
    """Largest share over the places of the template's key phrase, which is its word number `at`."""
    return F.coalesce(F.array_max(F.transform(places, lambda s: _share(words, s - at, template, weight))), F.lit(0.0))


def scan(docs: DataFrame, weight: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
         least: float = LEAST_SHARE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    base, more = base_phrases(), templates()
    phrases = list(dict.fromkeys([*(p for _, p in base), *(k for _, _, k, _ in more)]))
    rare = sorted({max(p, key=lambda w: (weight[w], -p.index(w))) for p in phrases})
    rows = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("_words"))
    words, hits = F.col("_words"), F.col("_hits")
    places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare))
    none = F.expr("cast(array() as array<struct<w:string,i:int>>)")
    rows = rows.withColumn("_hits", F.when(F.arrays_overlap(words, F.lit(rare)), places).otherwise(none))
    rows = rows.withColumns({f"_p{k}": _starts(hits, words, p, weight) for k, p in enumerate(phrases)})
    column = {p: F.col(f"_p{k}") for k, p in enumerate(phrases)}
    rows = rows.withColumns({f"_s{k}": _best_share(column[key], at, words, t, weight)
                             for k, (_, t, key, at) in enumerate(more)})
    found = F.concat(*(column[p] for _, p in base))
    labels = [F.when(F.size(column[p]) > 0, label) for label, p in base]
    own = [F.when(F.col(f"_s{k}") >= least, label) for k, (label, *_) in enumerate(more)]
    told = lambda cols: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*cols)))), ",")
    n = F.size(found).cast("long")
    return rows.select(
        id_col, F.size(words).cast("long").alias("n_words"), n.alias("n_base"),
        F.array_min(found).cast("long").alias("first_word"), F.array_max(found).cast("long").alias("last_word"),
        told(labels).alias("base_labels"), told([*labels, *own]).alias("labels"),
        F.greatest(F.when(n > 0, 1.0).otherwise(0.0), *(F.col(f"_s{k}") for k in range(len(more)))).alias("score"))


def oracle(id_col: str = "doc_id", table: str = "documents", least: float = LEAST_SHARE) -> str:
    """The same rows by brute force over all places, for DuckDB."""
    def at(i: str, phrase: Phrase, off: int = 0) -> str:
        return " and ".join(f"coalesce(w[{i} + {k + off + 1}] = '{x}', false)" for k, x in enumerate(phrase))

    base, more = base_phrases(), templates()
    bases = ", ".join(f"list_filter(range(len(w)), lambda i: {at('i', p)}) b{k}" for k, (_, p) in enumerate(base))
    shares = []
    for k, (_, t, key, off) in enumerate(more):
        whole = " + ".join(f"f['{x}']" for x in t)
        there = " + ".join(f"case when i + {j - off} >= 0 and w[greatest(i + {j - off}, 0) + 1] = '{x}' then f['{x}'] else 0.0 end"
                           for j, x in enumerate(t))
        shares.append(f"coalesce(list_max(list_transform(list_filter(range(len(w)), lambda i: {at('i', key)}), "
                      f"lambda i: round(case when {whole} = 0 then 1.0 else ({there}) / ({whole}) end, 6))), 0.0) s{k}")
    vocab = ", ".join(f"'{w}'" for w in vocabulary())
    told = lambda pairs: ("coalesce(array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(
        f"case when {c} then '{label}' end" for label, c in pairs) + "], lambda x: x is not null))), ','), '')")
    labels = [(label, f"len(b{k}) > 0") for k, (label, _) in enumerate(base)]
    own = [(label, f"s{k} >= {least}") for k, (label, *_) in enumerate(more)]
    every = "list_concat(list_concat(b0, b1), b2)"
    return f"""
with d as (
  select {id_col}, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from {table}),
df as (
  select v, (select count(*) from d) n, (select count(*) from d where list_contains(w, v)) c
  from (select unnest([{vocab}]) v)),
idf as (select map(list(v), list(round(ln((n + 1) / (c + 1)), 6))) f from df),
x as (select {id_col}, w, {bases}, {", ".join(shares)} from d, idf)
select {id_col}, cast(len(w) as bigint) n_words, cast(len({every}) as bigint) n_base,
  cast(list_min({every}) as bigint) first_word, cast(list_max({every}) as bigint) last_word,
  {told(labels)} base_labels, {told(labels + own)} labels,
  cast(greatest(case when len({every}) > 0 then 1.0 else 0.0 end, {", ".join(f"s{k}" for k in range(len(more)))}) as double) score
from x"""
