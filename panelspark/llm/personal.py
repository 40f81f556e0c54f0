"""Personal data: base patterns, and candidates that boosted trees accept.

Base spans follow fixed patterns and checks and are always kept. Generators propose further,
overlapping spans of the same four kinds in looser forms (spelled-out addresses, numbers without an
international prefix, other separators). Boosted trees rate each by its format and its context; the
rating is calibrated on rows kept out of the fit, where each kind also gets its threshold, the lowest
rating from which on PRECISION of the held candidates are right. Candidates from their threshold on are taken, the
likelier first, when it overlaps no span taken before it. The text between base spans is scanned by
itself, and numbers are proposed as every window of consecutive groups of digits that fits a kind.

The trees learn from the corpus itself: spans that pass the base checks, and the same spans
rewritten in looser forms in their places, are positive; spans that fail the checks, and numbers of
other uses put in their places, are negative. At most MAX_DOCS documents are used, chosen by a hash
of their id, and MAX_SPANS rewritten spans of each; everything else reads whole texts.

Defined results: null is read as empty and has no span; matches that fail a check are dropped and
not retried; repeated rows give repeated results; without any candidate nothing is added; an empty
table gives no rows; extra columns are ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import boosting
from panelspark.llm.common import bounded_sample, map_rows, pieces, strings

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS = 4_000
MAX_SPANS = 20  # base spans of one document that the fit rewrites
SPREAD = 64
PRECISION = 0.99
THRESHOLD = 0.97  # for kinds without held rows

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits would start at the run's first digit, too.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, by start and kind."""
    out = _emails(text) if "@" in text else []
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# Looser forms. Each starts at a literal or at the first of a run, so that a scan is linear.
_AT = r"\s{0,3}[\[({<]\s{0,2}(?:at|AT|@)\s{0,2}[\])}>]\s{0,3}"
_DOT = r"(?:\.|\s{0,3}[\[({<]\s{0,2}(?:dot|DOT|\.)\s{0,2}[\])}>]\s{0,3})"
_LOOSE_MAIL = re.compile(rf"({_AT}|@)[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{1,6}}")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])"
                       r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_GROUP = re.compile(r"\(?[0-9]+\)?")
_BETWEEN = re.compile(r"[ ./ ‐-―-]{1,2}")
MAX_DIGITS = 19


def _numbers(text: str, low: int, high: int) -> Iterator[Span]:
    """Every window of consecutive groups of digits in text[low:high] whose digits number as a kind's do.

    A window holds at most MAX_DIGITS digits, so the windows are linear in the groups.
    """
    run: list[tuple[int, int, int, bool]] = []  # starts and ends of the groups before, their digits, whether one may start
    for m in _GROUP.finditer(text, low, high):
        start, end = m.span()
        if text[start] == "(" and text[start - 1:start].isalnum():
            start += 1
        n = end - start - (text[start] == "(") - (text[end - 1] == ")")
        closed = not text[end:end + 1].isalnum()
        if not closed and text[end - 1] == ")":
            end, closed = end - 1, True
        if run and not _BETWEEN.fullmatch(text, run[-1][1], start):
            run = []
        run.append((start, end, n, not text[start - 1:start].isalnum() or start == 0))
        if not closed:
            run = []
            continue
        total = 0
        for k in range(len(run) - 1, -1, -1):
            first, _, size, opens = run[k]
            total += size
            if total > MAX_DIGITS:
                run = run[k + 1:]
                break
            if opens:
                if 7 <= total <= 15:
                    yield first, 3, end
                if 13 <= total:
                    yield first, 2, end


def candidates(text: str, taken: Iterable[Span] = ()) -> Iterator[Span]:
    """Overlapping proposals of the generators in the text between the spans taken (by start), each once."""
    mails = "@" in text or "at" in text or "AT" in text
    ips = any(c in text for c in ("[.]", "(.)", " . ", ":"))
    low = 0
    for a, _, b in (*taken, (len(text), 0, 0)):
        if mails:
            for m in _LOOSE_MAIL.finditer(text, low, a):
                start = m.start()
                while start > low and m.start() - start < 64 and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                    start -= 1
                if start < m.start():
                    yield start, 0, m.end()
        if ips:
            for m in _LOOSE_IP.finditer(text, low, a):
                yield m.start(), 1, m.end()
        yield from _numbers(text, low, a)
        low = max(low, b)


_HINT = [re.compile(p, re.I) for p in (
    r"mail|contact|write|schreib|correo|courriel", r"phone|tel|call|fax|mobile|handy|whatsapp|number",
    r"card|visa|master|credit|kart|pay|tarjeta|carte", r"\bip\b|addr|host|server|login|from",
    r"vers|licen|isbn|issn|page|seite|art\b|no\.|\bv$|sec|fig|\$|€|eur|usd|id\b")]
_LEFT = re.compile(r"[0-9]+\)?[ ./-]{1,2}$")
_RIGHT = re.compile(r"[ ./-]{1,2}\(?([0-9]+)")
N_FEATURES = 31


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span."""
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    digits = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    signs = {c for c in s if not c.isalnum()}
    prev, nxt = before[-1:] or " ", after[:1] or " "
    left, right = _LEFT.search(before), _RIGHT.match(after)
    return [float(v) for v in (
        *(kind == k for k in range(4)), len(s), len(digits), len(groups), max(groups), min(groups), groups[-1],
        len(signs), s[0] == "(", "." in s, "-" in s, " " in s, luhn(digits) if digits else 0,
        len(set(digits)), sum(c.isalpha() for c in s), prev.isspace(), prev == "+", nxt.isspace() or nxt in ".,;:)!?",
        *(bool(h.search(before)) for h in _HINT),
        len(_digits(left[0])) if left else 0, len(right[1]) if right else 0, groups[0], max(groups[1:-1], default=0),
        groups[-2] if len(groups) > 1 else 0)]


def _loosened(text: str, span: Span, pick: int) -> list[tuple[str, Span, float]]:
    """A base span rewritten in its place: looser forms (1.0) and other uses of numbers (0.0)."""
    start, kind, end = span
    s, d = text[start:end], _digits(text[start:end])
    year, k = 1900 + pick % 150, pick % 9 + 1
    if kind == 0:
        forms = [(s.replace("@", f"{a}at{b}").replace(".", dot), 1.0) for a, b, dot in
                 ((" [", "] ", "."), ("(", ")", "."), (" [", "] ", " [dot] "), (" (", ") ", "(dot)"))]
        forms += [(f"f({k})@x{k}", 0.0), (f"{s.split('@')[0]}[at]{k}", 0.0)]
    elif kind == 1:
        forms = [(s.replace(".", a), 1.0) for a in ("[.]", "(.)", " . ")]
        forms += [(f"{k} . {k + 1} . {k + 2} . {k}", 0.0), (f"{k}[.]{k}[.]999[.]{year % 900 + 99}", 0.0)]
    elif kind == 2:
        cut = [d[i:i + 4] for i in range(0, len(d), 4)]
        bad = d[:-1] + str((int(d[-1]) + k % 9 + 1) % 10)
        forms = [(a.join(cut), 1.0) for a in (".", " ", "/", "  ")]
        forms += [(bad, 0.0), (".".join(bad[i:i + 4] for i in range(0, len(bad), 4)), 0.0)]
    else:
        n = d[-10:]
        forms = [(f"({n[:3]}) {n[3:6]}-{n[6:]}", 1.0), (f"{n[:3]}-{n[3:6]}-{n[6:]}", 1.0),
                 (f"{n[:3]}.{n[3:6]}.{n[6:]}", 1.0), (f"00{d[:2]} {n[:3]} {n[3:6]} {n[6:]}", 1.0),
                 (f"{n[:3]} {n[3:6]} {n[6:]}", 1.0)]
        forms += [(f"{year}-{k:02}-{k + 10}", 0.0), (f"{k + 9}/{k:02}/{year}", 0.0), (f"{year}-{year + k}", 0.0),
                  (f"{d[:7]}", 0.0), (f"{k}.{k}.{year} {k + 9}.{k + 20}", 0.0), (n, 0.0), (f"{k} 000 000", 0.0)]
    # Numbers beside the span: windows that take some of them, or leave some of the span, are negative.
    out = []
    for at, (form, label) in enumerate(forms):
        turn = [(pick + start + 3 * at + j) % len(_BESIDE) for j in (0, 4, 8)] if kind >= 2 and label else []
        for before, after in (("", ""), *(_BESIDE[j] for j in turn)):
            changed = text[:start] + before + form + after + text[end:]
            a = start + len(before)
            b = a + len(form)
            for c in candidates(changed[:b + 40]):
                if kind < 2:
                    if c[1] == kind and c[0] <= a + 1 and c[2] >= b - 1 and c[0] >= a - 64:
                        out.append((changed, c, label))
                elif c[1] >= 2 and c[0] < b and a < c[2]:
                    if kind == 3 and c[1] == 3 and _digits(changed[c[0]:c[2]]) == d[-10:] != _digits(form):
                        continue  # the national number in an international one: neither right nor wrong
                    exact = c[1] == kind and abs(c[0] - a) <= 1 and abs(c[2] - b) <= 1
                    out.append((changed, c, label if exact else 0.0))
    return out


_BESIDE = [("12.05.2024 ", ""), ("", " 2023-11-30"), ("10 12 2024 09 30 ", ""), ("1 2 3 4 5 6 ", ""), ("17 ", " 4"),
           ("", " 1 2 3"), ("2021 ", ""), ("3.5 ", " 250"), ("11/02/2022 14.30 ", ""), ("", " 8080"), ("600 20 ", "")]


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """(features, label, held, kind) from a bounded sample of documents that hold a digit or an at sign."""
    rows = bounded_sample(docs.where(F.col(text_col).rlike("[0-9@]")).select(id_col, text_col), id_col, max_docs)

    def made(key, text: str, pick: int) -> Iterator[tuple[str, Span, float]]:
        taken = base_spans(text)
        if taken:
            yield from ((text, c, 0.0) for c in candidates(text, taken))
        for span in taken[:MAX_SPANS]:
            lo = max(0, span[0] - 80)
            yield from _loosened(text[lo:span[2] + 80], (span[0] - lo, span[1], span[2] - lo), pick)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                key, text = piece.column(id_col)[0].as_py(), strings(piece, text_col)[0]
                pick = int.from_bytes(hashlib.sha256(str(key).encode()).digest()[:4], "little")
                found = made(key, text, pick)
                while part := list(islice(found, 1024)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([features(t, c) for t, c, _ in part], pa.list_(pa.float64())),
                         pa.array([label for *_, label in part], pa.float64()), pa.array([pick % 4 == 0] * len(part), pa.bool_()),
                         pa.array([c[1] for _, c, _ in part], pa.int32())], names=["features", "label", "held", "kind"])
    # the sample comes out of its limit as one partition
    return rows.repartition(SPREAD, id_col).mapInArrow(run, "features array<double>, label double, held boolean, kind int")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS,
        precision: float = PRECISION) -> boosting.Boosted:
    return boosting.fit(examples(docs, id_col, text_col, max_docs), group="kind", precision=precision)


def all_spans(text: str, model: boosting.Boosted, threshold: float | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, each by start and kind."""
    taken = base_spans(text)
    likely, proposed = [], candidates(text, taken)
    while part := list(islice(proposed, 1024)):
        p = model.probability(np.array([features(text, c) for c in part]))
        likely += [(-q, c[0] - c[2], c) for q, c in zip(p.tolist(), part)
                   if q >= (model.thresholds.get(c[1], THRESHOLD) if threshold is None else threshold)]
    added: list[Span] = []
    for _, _, c in sorted(likely):  # the likelier, then the longer first; those added are by start and apart
        at = bisect(added, c)
        if (at == 0 or added[at - 1][2] <= c[0]) and (at == len(added) or c[2] <= added[at][0]):
            added.insert(at, c)
    return taken, sorted([*taken, *added])


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: boosting.Boosted, id_col: str = "doc_id", text_col: str = "text",
         threshold: float | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans) of every row; the counts are of base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.Table:
        counts, base, whole = [], [], []
        for text in strings(batch, text_col):
            taken, spans = all_spans(text, shared.value, threshold)
            counts.append([sum(s[1] == k for s in taken) for k in range(4)])
            base.append(told(taken))
            whole.append(told(spans))
        per_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        return pa.table([batch.column(id_col), *per_kind, pa.array(base, pa.string()), pa.array(whole, pa.string())],
                        names=[id_col, *(f"n_{k}" for k in KINDS), "base_spans", "spans"])
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return map_rows(docs.select(id_col, text_col), run, schema, text_col=text_col)


def redact(docs: DataFrame, model: boosting.Boosted, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """All columns of every row; each run of overlapping spans of the text is replaced by `<kind>`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for text in batch.column(at).to_pylist():
            if text:
                parts, end = [], 0
                for a, k, b in all_spans(text, shared.value, threshold)[1]:
                    if a >= end:
                        parts += [text[end:a], f"<{KINDS[k]}>"]
                    end = max(end, b)
                text = "".join([*parts, text[end:]])
            out.append(text)
        cols = list(batch.columns)
        cols[at] = pa.array(out, pa.string())
        return pa.table(cols, names=batch.schema.names)
    return map_rows(docs, run, schema, text_col=text_col)
