"""SentencePiece encoding and decoding for merge-type vocabularies.

An agenda holds the adjacent symbol pairs whose concatenation is a piece, ordered by score, then
from left to right; the best pair is merged, its new neighbours enter the agenda, stale entries are
skipped. Symbols that are no piece become byte pieces. A merge never crosses the start of a run of
space marks (no piece has a mark after another character) nor a character that is in no longer
piece, such as a line break; so texts are cut there and each unit is encoded once per worker, in a
cache of two halves of bounded size. The new units of an Arrow batch are merged side by side: arrays hold
their symbols and the agenda, and each round merges every unit's best pair. Long units and those with a
character that is no piece have a heap of their own. Units that enter the cache are checked against the
sentencepiece library, in one call per Arrow batch; a difference raises.

Defined results: null is read as empty; an empty text is the end id alone and decodes to an empty
text; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from panelspark.llm.common import map_rows, strings

MARK = "▁"
CACHE_UNITS = 150_000
LONG_UNIT = 64
STEP = 4  # units of about the same length are merged together
JOINED = 64  # units a text that the library checks
NONE = np.iinfo(np.int32).max
PARTS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class _Pairs:
    """Map from pairs of piece ids to (rank of the joined piece, its id), as hash tables without chains:
    pairs whose slot is taken go to the next table. Equal scores have equal ranks; no pair: rank NONE."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        order = {x: k for k, x in enumerate(sorted(set(scores.values())))}
        found = [(ids[a] << 32 | ids[b], order[scores[p]], i) for p, i in ids.items() for k in range(1, len(p))
                 if (a := p[:k]) in ids and (b := p[k:]) in ids]
        keys, ranks, joined = (np.array(c, dtype=np.int64) for c in zip(*found))
        self.tables = []
        while len(keys):
            bits = int(4 * len(keys)).bit_length()
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * len(self.tables))
            shift = np.uint64(64 - bits)
            slot, first = np.unique(keys.view(np.uint64) * factor >> shift, return_index=True)
            table = [np.full(1 << bits, fill, dtype=kind) for fill, kind in ((-1, np.int64), (NONE, np.int32), (0, np.int32))]
            for column, values in zip(table, (keys, ranks, joined)):
                column[slot] = values[first]
            self.tables.append((factor, shift, *table))
            keys, ranks, joined = (np.delete(c, first) for c in (keys, ranks, joined))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, joined ids) of pairs; -1 on the right is no piece."""
        key = left.astype(np.int64) << 32 | right
        rank, joined = np.full(len(key), NONE, dtype=np.int32), np.zeros(len(key), dtype=np.int32)
        left_over = np.arange(len(key))
        for factor, shift, keys, ranks, ids in self.tables:
            slot = (key.view(np.uint64) * factor >> shift).view(np.int64)
            held = keys[slot]
            hit = np.flatnonzero(held == key)
            at = left_over[hit]
            rank[at], joined[at] = ranks[slot[hit]], ids[slot[hit]]
            again = np.flatnonzero((held != key) & (held >= 0))
            key, left_over = key[again], left_over[again]
        return rank, joined


class Codec:
    """Encoder and decoder of one model file; keeps what it has encoded, up to CACHE_UNITS units."""

    def __init__(self, model_file: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.end = sp.eos_id()
        self.ids, self.scores, self.bytes, self.out = {}, {}, {}, []
        for i in range(size):
            piece = sp.id_to_piece(i)
            hidden = sp.is_control(i) or sp.is_unknown(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not hidden:
                self.ids[piece] = i
                self.scores[piece] = -sp.get_score(i)
            self.out.append(b"" if hidden else bytes([int(piece[3:5], 16)]) if sp.is_byte(i)
                            else piece.replace(MARK, " ").encode())
        inner = {ch for p in self.ids if len(p) > 1 for ch in p}
        if any(MARK in p.lstrip(MARK) for p in self.ids) or "\n" in inner:
            raise ValueError("a piece crosses the start of a word or a line break")
        self.names = list(map(str, range(size)))
        self.line = " ".join(map(str, self.merge("\n")))
        self.pairs = _Pairs(self.ids, self.scores)
        self.symbol = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.lead, self.bare = _Units(self, MARK), _Units(self, "")
        self.fresh: list[tuple[str, str, str]] = []

    def merge(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit, by merging the best adjacent pair until none is a piece."""
        symbols: list[str | None] = list(unit)
        n, scores = len(symbols), self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for k in range(n - 1):
            both = symbols[k] + symbols[k + 1]
            if both in scores:
                agenda.append((scores[both], k, k + 1, both))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right \
                    or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            to = after[left] = after[right]
            if to < n:
                before[to] = left
                pair = both + symbols[to]
                if pair in scores:
                    heapq.heappush(agenda, (scores[pair], left, to, pair))
            back = before[left]
            if back >= 0:
                pair = symbols[back] + both
                if pair in scores:
                    heapq.heappush(agenda, (scores[pair], back, left, pair))
        ids: list[int] = []
        for s in symbols:
            if s is not None:
                one = self.ids.get(s)
                if one is None:
                    ids.extend(self.bytes[b] for b in s.encode())
                else:
                    ids.append(one)
        return tuple(ids)

    def merge_all(self, units: list[str]) -> list[tuple[str, bytes]]:
        """(ids as text, decoded bytes) of distinct units, merged side by side."""
        out: list[tuple[str, bytes]] = [("", b"")] * len(units)
        size = np.array([len(u) for u in units], dtype=np.int64)
        ends = np.cumsum(size)
        symbols = self.symbol[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        odd = size > LONG_UNIT
        odd[np.searchsorted(ends, np.flatnonzero(symbols < 0), "right")] = True
        for k in np.flatnonzero(odd | (size == 0)).tolist():
            out[k] = self.told(self.merge(units[k]))
        group = np.where(odd, 0, -(-size // STEP))
        for g in np.unique(group[group > 0]).tolist():
            rows = np.flatnonzero(group == g)
            kept = self._merge_rows(symbols, ends[rows] - size[rows], size[rows], g * STEP)
            count = np.count_nonzero(kept >= 0, axis=1)
            ids = kept[kept >= 0].tolist()
            names, parts = [self.names[i] for i in ids], [self.out[i] for i in ids]
            at = 0
            for k, end in zip(rows.tolist(), np.cumsum(count).tolist()):
                out[k] = " ".join(names[at:end]), b"".join(parts[at:end])
                at = end
        return out

    def _merge_rows(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Ids of the units of at most `width` symbols that begin at `start`, -1 where a symbol went into another.

        Arrays have a row a place and a column a unit. The agenda holds for each place the rank of the pair
        that begins there, times LONG_UNIT, plus the place: its smallest value is the best pair, the leftmost of equals.
        """
        n, places = len(start), np.arange(width)
        inside = places[:, None] < size
        held = np.where(inside, symbols[np.minimum(start + places[:, None], len(symbols) - 1)], -1)
        after = np.repeat(places[:, None] + 1, n, axis=1)
        before = after - 2
        agenda, joined = np.full((width, n), NONE, dtype=np.int32), np.zeros((width, n), dtype=np.int32)
        row, col = np.nonzero(inside[1:])

        def enter(row: np.ndarray, col: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            rank, joined[row, col] = self.pairs.find(left, right)
            agenda[row, col] = np.where(rank == NONE, NONE, rank * LONG_UNIT + row)

        enter(row, col, held[row, col], held[row + 1, col])
        while True:
            best = agenda.min(axis=0)
            col = np.flatnonzero(best != NONE)
            if not len(col):
                return np.ascontiguousarray(held.T)
            row = best[col] % LONG_UNIT
            gone = after[row, col]
            held[row, col] = now = joined[row, col]
            held[gone, col] = -1
            agenda[gone, col] = agenda[row, col] = NONE
            after[row, col] = to = after[gone, col]
            k = np.flatnonzero(to < size[col])
            before[to[k], col[k]] = row[k]
            enter(row[k], col[k], now[k], held[to[k], col[k]])
            back = before[row, col]
            k = np.flatnonzero(back >= 0)
            enter(back[k], col[k], held[back[k], col[k]], now[k])

    def told(self, ids: tuple[int, ...]) -> tuple[str, bytes]:
        return " ".join(map(str, ids)), b"".join([self.out[i] for i in ids])

    def learn(self, lead: set[str], bare: set[str]) -> None:
        """Put what the cache lacks of a batch's units into it, merged side by side."""
        lead = {u for u in lead if not self.lead.holds(u)}
        for u in [u for u in lead if "\n" in u]:
            lead.remove(u)
            first, *rest = u.split("\n")
            bare.update(rest)
            if not self.lead.holds(first):
                lead.add(first)
        new = [(self.lead, u) for u in lead if len(u) <= LONG_UNIT]
        new += [(self.bare, u) for u in bare if 0 < len(u) <= LONG_UNIT and not self.bare.holds(u)]
        if new:
            for (cached, u), got in zip(new, self.merge_all([cached.mark + u for cached, u in new])):
                self.fresh.append((cached.mark, u, got[0]))
                cached.put(u, got)

    def batch(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """both() of each text, the new units of all texts merged together."""
        lead, bare, cut = set(), set(), []
        for t in texts:
            if self.spaced(t):
                parts = self.parts(t)
                for cached, u in parts:
                    (lead if cached is self.lead else bare).add(u)
                cut.append((True, parts))
            else:
                words = t.replace(MARK, " ").split(" ") if t else []
                lead.update(words)
                cut.append((False, words))
        self.learn(lead, bare)
        for spaced, u in cut:
            yield self.joined([cached[x] for cached, x in u] if spaced else list(map(self.lead.__getitem__, u)))

    def units(self, text: str) -> list[tuple[str, bytes]]:
        """The units of a text in which no marks follow each other."""
        return list(map(self.lead.__getitem__, text.replace(MARK, " ").split(" "))) if text else []

    def spaced(self, text: str) -> bool:
        """Whether marks follow each other, so that they may merge."""
        t = text.replace(MARK, " ")
        return t[:1] == " " or t[-1:] == " " or "  " in t or " \n" in t

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with the end id."""
        return list(map(int, self.both(text)[0].split(" ")))

    def parts(self, text: str) -> list[tuple[_Units, str]]:
        """The units of any text and the half of the cache they belong to: each run of marks and the word after it,
        and each line break."""
        return [(self.lead, p[1:]) if p[0] == MARK and len(p) > 1 and p[1] != MARK else (self.bare, p)
                for p in PARTS.findall(MARK + text.replace(" ", MARK))]

    def runs(self, text: str) -> list[tuple[str, bytes]]:
        return [cached[u] for cached, u in self.parts(text)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks are spaces, the first one is dropped, bytes are read as UTF-8."""
        got = b"".join([self.out[i] for i in ids])
        return got.removeprefix(b" ").decode("utf-8", "replace")

    def both(self, text: str) -> tuple[str, int, bytes]:
        """(ids with the end id as text, their number, decoded text as UTF-8), through units."""
        return self.joined(self.runs(text) if self.spaced(text) else self.units(text))

    def joined(self, got: list[tuple[str, bytes]]) -> tuple[str, int, bytes]:
        ids = " ".join([*[u[0] for u in got], str(self.end)])
        return ids, ids.count(" ") + 1, b"".join([u[1] for u in got]).removeprefix(b" ")

    def verify(self) -> None:
        """Compare what was merged since the last call with the library, some units joined to a text: by spaces,
        or by line breaks if no mark precedes them."""
        fresh, self.fresh = self.fresh, []
        first = " ".join(map(str, self.merge(MARK)))
        for mark in (MARK, ""):
            of = [(text, ids) for m, text, ids in fresh if m == mark and text]
            some = [of[k:k + JOINED] for k in range(0, len(of), JOINED)]
            given = [" ".join([t for t, _ in x]) if mark else "".join(["\n" + t for t, _ in x]) for x in some]
            for x, got in zip(some, self.library.encode(given, num_threads=1)):
                ids = " ".join([i for _, i in x] if mark else [first, *[f"{self.line} {i}" for _, i in x]])
                if " ".join([self.names[i] for i in got]) != ids:
                    raise ValueError(f"merged ids differ from the library's for one of {x!r}: {got}")


class _Units(dict):
    """(ids as text, decoded bytes) of units that `mark` precedes."""

    def __init__(self, owner: Codec, mark: str):
        super().__init__()
        self.owner, self.mark, self.older = owner, mark, {}

    def __missing__(self, text: str) -> tuple[str, bytes]:
        owner = self.owner
        if self.mark and "\n" in text:
            first, *rest = text.split("\n")
            got = [self[first]]
            for part in rest:
                got.append((owner.line, b"\n"))
                if part:
                    got.append(owner.bare[part])
            return " ".join([g[0] for g in got]), b"".join([g[1] for g in got])
        got = self.older.get(text)
        if got is None:
            got = owner.told(owner.merge(self.mark + text))
            owner.fresh.append((self.mark, text, got[0]))
        if len(text) <= LONG_UNIT:
            self.put(text, got)
        return got

    def holds(self, text: str) -> bool:
        return text in self or text in self.older

    def put(self, text: str, got: tuple[str, bytes]) -> None:
        if len(self) >= CACHE_UNITS:  # units that are still in use come back from the older half
            self.older = dict(self)
            self.clear()
        self[text] = got


@cache
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row, with the end id."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        c = codec(model_file)
        ids = [np.fromstring(i, dtype=np.int32, sep=" ") for i, _, _ in c.batch(strings(batch, text_col))]
        c.verify()
        return pa.table([batch.column(id_col), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])
    kind = dict(docs.dtypes)[id_col]
    return map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>", text_col=text_col)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; null ids give an empty text."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        c = codec(model_file)
        texts = [c.decode(i or []) for i in batch.column(ids_col).to_pylist()]
        return pa.table([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])
    kind = dict(encoded.dtypes)[id_col]
    return map_rows(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
            keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping digests
    and, if asked, the ids."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        c, n, a, b, kept = codec(model_file), [], [], [], []
        for ids, size, back in c.batch(strings(batch, text_col)):
            n.append(size)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(back).hexdigest())
            if keep_ids:
                kept.append(np.fromstring(ids, dtype=np.int32, sep=" "))
        c.verify()
        cols = [batch.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
        if keep_ids:
            cols.append(pa.array(kept, pa.list_(pa.int32())))
        return pa.table(cols, names=names)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_col, text_col), run, schema + ", ids array<int>" * keep_ids, text_col=text_col)
