"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The texts of an Arrow batch are laid end to end as an array of code points and each is replaced by its
class: letter, number, other, space, white space, apostrophe. Look-ahead is in the class (an
apostrophe before a contraction's letters, white space before something else), so that a small
automaton, read from left to right, tells where a word starts. Every class is a map from states to
states; maps compose associatively, so the state before each character comes from a scan over
compositions: all blocks side by side, then over the blocks' totals. No regular expression is run.

Slices between word starts are looked up in a cache of two halves of bounded size; a new slice is merged by
the ranks, lowest first, then leftmost. `encode` keeps the byte offset of every id, by which `decode`
puts the ids' bytes in place.

The pattern is the one of the rank files: contractions, then runs of letters, numbers and other signs
with one space before them, then white space, whose last character stands apart before a word. What
is a letter, a number or white space is asked of the tiktoken library, so that both have one Unicode version.

Defined results: null is read as empty; an empty text has no ids and decodes to no bytes; repeated rows
give repeated results; an empty table gives no rows; extra columns are ignored, whatever their names;
a word of any length is merged in time n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from panelspark.llm.common import map_rows, strings

CACHE_UNITS = 150_000
LONG_UNIT = 64
LONG_MERGE = 96

# Classes of characters.
CUT, LETTER, NUMBER, OTHER, TAKES_ONE, TAKES_TWO, LEAD, ALONE, SPACE = range(9)
# States: a word starts at the next character anyway; inside a run of a class; after a leading space;
# inside white space; one or two letters of a contraction to come.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_LEAD, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)

# For each class: the state after it, and the states in which it starts no word (what follows those is below).
_AFTER = {CUT: START, LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, TAKES_ONE: ONE_LEFT,
          TAKES_TWO: TWO_LEFT, LEAD: AFTER_LEAD, ALONE: START, SPACE: IN_SPACE}
_JOINS = {
    LETTER: {IN_LETTERS: IN_LETTERS, AFTER_LEAD: IN_LETTERS, TWO_LEFT: ONE_LEFT, ONE_LEFT: START},
    NUMBER: {IN_NUMBERS: IN_NUMBERS, AFTER_LEAD: IN_NUMBERS},
    OTHER: {IN_OTHERS: IN_OTHERS, AFTER_LEAD: IN_OTHERS},
    TAKES_ONE: {IN_OTHERS: IN_OTHERS, AFTER_LEAD: IN_OTHERS},
    TAKES_TWO: {IN_OTHERS: IN_OTHERS, AFTER_LEAD: IN_OTHERS},
    SPACE: {IN_SPACE: IN_SPACE},
}


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class -> map, map x map -> map, map x state -> state, state x class -> whether a word starts)."""
    first = [tuple(_JOINS.get(c, {}).get(s, _AFTER[c]) for s in range(8)) for c in range(9)]
    maps = list(dict.fromkeys([tuple(range(8)), *first]))
    index = {m: k for k, m in enumerate(maps)}
    products: dict[tuple[int, int], int] = {}
    at = 0
    while at < len(maps):  # every product of classes, one more class at a time
        for g in first:
            m = tuple(g[s] for s in maps[at])
            if m not in index:
                index[m] = len(maps)
                maps.append(m)
        at += 1
    for i, a in enumerate(maps):
        for j, b in enumerate(maps):
            products[i, j] = index[tuple(b[s] for s in a)]
    n = len(maps)
    both = np.array([products[i, j] for i in range(n) for j in range(n)], dtype=np.int16)
    starts = np.array([[s not in _JOINS.get(c, {}) for c in range(9)] for s in range(8)])
    return np.array([index[m] for m in first], dtype=np.int16), both, np.array(maps, dtype=np.int8), starts


def _scan(maps: np.ndarray, both: np.ndarray, n: int) -> np.ndarray:
    """For each place the product of all maps before it; map 0 is the identity."""
    if len(maps) <= 64:
        out, total = np.zeros(len(maps), dtype=np.int16), 0
        for k, m in enumerate(maps.tolist()):
            out[k] = total
            total = int(both[total * n + m])
        return out
    width = int(len(maps) ** 0.5)
    rows = -(-len(maps) // width)
    padded = np.zeros(rows * width, dtype=np.int16)
    padded[:len(maps)] = maps
    steps = np.ascontiguousarray(padded.reshape(rows, width).T)
    inside = np.empty_like(steps)
    total = np.zeros(rows, dtype=np.int16)
    for k in range(width):
        inside[k] = total
        total = both[total.astype(np.int32) * n + steps[k]]
    before = _scan(total, both, n).astype(np.int32)
    return both[before * n + inside].T.reshape(-1)[:len(maps)]


@cache
def _classes() -> np.ndarray:
    """The class of each code point by itself, as the library's regular expressions see it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(points)
    single = {bytes([k]): k for k in range(256)}
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(library.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def _word_starts(chars: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Places where a word starts, and the cuts; `cuts` are places that separate texts, the last one included."""
    kind = _classes()[chars]
    kind[cuts] = CUT
    after = kind[1:]
    space = np.flatnonzero(kind[:-1] == SPACE)
    apart = space[(after[space] != SPACE) & (after[space] != CUT)]
    kind[apart] = np.where(chars[apart] == ord(" "), LEAD, ALONE)
    sign = np.flatnonzero(chars[:-1] == ord("'"))
    sign = sign[kind[sign] == OTHER]
    one, two = chars[sign + 1], chars[np.minimum(sign + 2, len(chars) - 1)]
    inner = kind[sign + 1] == LETTER
    short = inner & np.isin(one, [ord(c) for c in "stmd"])
    pairs = [("r", "e"), ("v", "e"), ("l", "l")]
    long = inner & (kind[np.minimum(sign + 2, len(chars) - 1)] == LETTER) & np.logical_or.reduce(
        [(one == ord(a)) & (two == ord(b)) for a, b in pairs])
    kind[sign[short]] = TAKES_ONE
    kind[sign[long]] = TAKES_TWO
    maps, both, states, starts = _automaton()
    before = states[_scan(maps[kind], both, len(states)), START]
    return np.flatnonzero(starts[before, kind])


def words(texts: list[str]) -> list[list[str]]:
    """The words of each text, in order; together they are the text."""
    joined = "\0".join(texts) + "\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cuts = np.cumsum([len(t) + 1 for t in texts]) - 1
    edges = _word_starts(chars, cuts)
    last = np.searchsorted(edges, cuts)
    at = edges.tolist()
    out, first = [], 0
    for end in last.tolist():  # at[end] is the cut after the text
        out.append([joined[a:b] for a, b in zip(at[first:end], at[first + 1:end + 1])])
        first = end + 1
    return out


def ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec(dict):
    """Encoder and decoder of one rank file; a dictionary from words to (ids as text, bytes of the ids)."""

    def __init__(self, rank_file: str):
        super().__init__()
        self.ranks, self.older = ranks(rank_file), {}
        size = max(self.ranks.values()) + 1
        token = [b""] * size
        for data, i in self.ranks.items():
            token[i] = data
        self.token = token
        self.bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.size = np.array([len(t) for t in token], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the adjacent pair of lowest rank is merged, the leftmost of equals, until none has one."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        if len(word) > LONG_MERGE:
            return self._merge_long(word)
        none = len(self.token)
        parts = [word[k:k + 1] for k in range(len(word))]
        pair = [ranks.get(word[k:k + 2], none) for k in range(len(word) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            k = pair.index(low)
            parts[k] += parts.pop(k + 1)
            del pair[k]
            if k < len(pair):
                pair[k] = ranks.get(parts[k] + parts[k + 1], none)
            if k:
                pair[k - 1] = ranks.get(parts[k - 1] + parts[k], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same by an agenda of pairs and links between neighbours."""
        ranks, n = self.ranks, len(word)
        parts: list[bytes | None] = [word[k:k + 1] for k in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(ranks[word[k:k + 2]], k, word[k:k + 2]) for k in range(n - 1) if word[k:k + 2] in ranks]
        heapq.heapify(agenda)
        while agenda:
            _, k, both = heapq.heappop(agenda)
            right = after[k]
            if parts[k] is None or right == n or parts[k] + parts[right] != both:
                continue
            parts[k], parts[right] = both, None
            to = after[k] = after[right]
            if to < n:
                before[to] = k
                if both + parts[to] in ranks:
                    heapq.heappush(agenda, (ranks[both + parts[to]], k, both + parts[to]))
            back = before[k]
            if back >= 0 and parts[back] + both in ranks:
                heapq.heappush(agenda, (ranks[parts[back] + both], back, parts[back] + both))
        return [ranks[p] for p in parts if p is not None]

    def __missing__(self, word: str) -> tuple[str, bytes]:
        got = self.older.get(word)
        if got is None:
            ids = self.merge(word.encode("utf-8", "surrogatepass"))
            got = ",".join(map(str, ids)), b"".join([self.token[i] for i in ids])
        if len(word) <= LONG_UNIT:
            if len(self) >= CACHE_UNITS:  # words that are still in use come back from the older half
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def ids(self, words: list[str]) -> np.ndarray:
        return np.array(",".join([self[w][0] for w in words]).split(",") if words else [], dtype=np.int32)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id starts."""
        size = self.size[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The ids' bytes, each put at its offset; offsets that leave a hole or overlap raise."""
        size = self.size[ids]
        if not np.array_equal(np.cumsum(size) - size, offsets):
            raise ValueError("offsets do not follow the ids")
        total = int(size.sum())
        return self.bytes[np.arange(total) + np.repeat(self.at[ids] - offsets, size)].tobytes()


@cache
def codec(rank_file: str) -> Codec:
    return Codec(rank_file)


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, offsets) of every row; offsets are of the text's UTF-8 bytes."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        c = codec(rank_file)
        ids = [c.ids(w) for w in words(strings(batch, text_col))]
        return pa.table([batch.column(id_col), pa.array(ids, pa.list_(pa.int32())),
                         pa.array([c.offsets(i) for i in ids], pa.list_(pa.int64()))], names=[id_col, "ids", "offsets"])
    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, offsets array<long>",
                    text_col=text_col)


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids",
           offsets_col: str = "offsets") -> DataFrame:
    """(id, data) of every row; null ids give no bytes."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        c = codec(rank_file)
        rows = zip(batch.column(ids_col).to_pylist(), batch.column(offsets_col).to_pylist())
        data = [c.decode(np.array(i or [], dtype=np.int64), np.array(o or [], dtype=np.int64)) for i, o in rows]
        return pa.table([batch.column(id_col), pa.array(data, pa.binary())], names=[id_col, "data"])
    kind = dict(encoded.dtypes)[id_col]
    return map_rows(encoded.select(id_col, ids_col, offsets_col), run, f"`{id_col}` {kind}, data binary")


def digests(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping digests."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        c, n, a, b = codec(rank_file), [], [], []
        for cut in words(strings(batch, text_col)):
            got = [c[w] for w in cut]
            ids = ",".join([g[0] for g in got])
            n.append(ids.count(",") + 1 if ids else 0)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(b"".join([g[1] for g in got])).hexdigest())
        return pa.table([batch.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                         pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_col, text_col), run, schema, text_col=text_col)
