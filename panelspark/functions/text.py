"""Text predicates: keywords, tags, article text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def keyword_pattern(kw: str) -> str:
    """Whole-word pattern for a keyword with an optional plural s, borders counted in Unicode."""
    body = re.sub(r"([\\.\[\]{}()*+?^$|&#~\-])", r"\\\1", kw)
    # the border before the keyword is looked at behind it, so the search starts on the literal
    before = f"(?<!{WORD}{body})" if _is_word(kw[0]) else f"(?<={WORD}{body})"
    end, inner = f"(?!{WORD})", f"(?={WORD})"
    plural = f"s?{end}" if _is_word(kw[-1]) else f"(?:s{end}|{inner})"
    return f"{body}{before}{plural}"


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """Sorted keywords found in the text, each tested on its own so overlapping ones all count.

    Every pattern is a literal, compiled once, and runs only where a plain substring search
    already hit.
    """
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(k)) & low.rlike(keyword_pattern(k)), F.lit(k))
            for k in sorted(set(keywords))]
    return F.array_compact(F.array(*hits))


def matched_tags(keywords: Column, tags: list[str]) -> Column:
    """Sorted distinct subject values that are in the given set."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(tags))])
    subject = F.filter(keywords, lambda k: F.lower(F.coalesce(k["name"], F.lit(""))) == "subject")
    values = F.transform(subject, lambda k: F.coalesce(k["value"], F.lit("")))
    return F.coalesce(F.array_intersect(wanted, values), F.array().cast("array<string>"))


def clean_text(c: Column) -> Column:
    return F.trim(F.translate(F.coalesce(c, F.lit("")), ",", ""))


def article_text(abstract: Column, headline: Column) -> Column:
    """The abstract, or the headline when it is empty; null when both are."""
    return F.coalesce(F.nullif(clean_text(abstract), F.lit("")),
                      F.nullif(clean_text(headline), F.lit("")))


def in_set(c: Column, values) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).isin(sorted(values))


def gate(desk: Column, section: Column, desks, sections) -> Column:
    """Editorial gate: the desk or the section is in its set, whatever the case."""
    return in_set(desk, desks) | in_set(section, sections)
