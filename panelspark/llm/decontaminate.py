"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five words that a document and a benchmark item share. Documents are scanned once
against a Bloom filter of the benchmark's seeds, whose size is bounded; what passes it is joined
with the seeds themselves. For every pair that shares a seed, the words around the seeds are tiled:
running Karp-Rabin hashes find the matches of unmarked words, the longest is marked (of equals the first
in the text, then in the item), what it leaves of other matches waits for its turn, and the search goes
on with shorter ones down to the seed length. The share of the item's words that tiles
cover, in whatever order, is its coverage. Pairs whose shared seeds cannot reach the coverage
are dropped before any words are joined to them.

Defined results: null and empty texts share nothing; an item of fewer words than a seed must occur
whole; an item without words matches nothing; repeated rows and repeated items are reported once
per pair of ids, with the highest coverage; a row without an id is reported under a null id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import join_small, map_rows, pieces, strings
from panelspark.llm.words import WORD_BASE, powers, windows, word_hashes
from panelspark.session import stage

SEED_WORDS = 5
COVERAGE = 0.5
MAX_FILTER_BITS = 1 << 27


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in text, place in item) of two arrays of word hashes."""
    least = max(1, min(least, len(item)))
    sums, free, down = [], [], []
    for words in (text, item):
        up, back = powers(WORD_BASE, len(words) + 1)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])]))
        free.append(np.ones(len(words), dtype=bool))
        down.append(back)

    def runs(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of `size` unmarked words."""
        n = len(free[side]) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        used = np.concatenate([[0], np.cumsum(~free[side])])
        at = np.flatnonzero(used[size:] == used[:n])
        return at, (sums[side][at + size] - sums[side][at]) * down[side][at]

    found, size = [], max(least, len(item))
    while True:
        places: dict[int, list[int]] = {}
        for p, h in zip(*(x.tolist() for x in runs(1, size))):
            places.setdefault(h, []).append(p)
        at, h = runs(0, size)
        hit = np.isin(h, np.fromiter(places, dtype=np.uint64, count=len(places)))
        matches = []  # from their first word on
        for t, key in zip(at[hit].tolist(), h[hit].tolist()):
            for p in places[key]:
                if t and p and text[t - 1] == item[p - 1] and free[0][t - 1] and free[1][p - 1]:
                    continue
                n = 0
                while (t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n]
                       and free[0][t + n] and free[1][p + n]):
                    n += 1
                if n >= size:
                    matches.append((-n, t, p))
        heapq.heapify(matches)
        while matches:
            n, t, p = heapq.heappop(matches)
            n = -n
            open_ = free[0][t:t + n] & free[1][p:p + n]
            if open_.all():
                free[0][t:t + n] = free[1][p:p + n] = False
                found.append((n, t, p))
                continue
            # what a longer tile has left of the match waits for its turn
            edge = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
            for first, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if end - first >= size:
                    heapq.heappush(matches, (first - end, t + first, p + first))
        if size == least:
            return found
        size = max(least, size // 2)


def reachable(text: np.ndarray, item: np.ndarray, least: int) -> int:
    """Words of the item in some run of `least` words that the text holds too: no tiling covers more."""
    least = max(1, min(least, len(item)))
    if len(text) < least or not len(item):
        return 0
    shared = np.isin(windows(item, least), windows(text, least))
    reach = np.zeros(len(item) + 1, dtype=np.int64)
    np.add.at(reach, np.flatnonzero(shared), 1)
    np.add.at(reach, np.flatnonzero(shared) + least, -1)
    return int((np.cumsum(reach)[:-1] > 0).sum())


def _item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    kind = dict(items.dtypes)[item_col]

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = strings(batch, text_col)
        h, row = word_hashes(texts)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        words = pa.LargeListArray.from_arrays(cut, pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
        return pa.table([batch.column(item_col), words], names=["item_id", "item_words"])
    return map_rows(items.select(item_col, text_col), run, f"item_id {kind}, item_words array<long>",
                    text_col=text_col).where("size(item_words) > 0")


def _item_seeds(words: DataFrame, k: int) -> DataFrame:
    kind = dict(words.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in pieces(batch, 1):
                h = one.column("item_words").flatten().to_numpy().view(np.uint64)
                seed, times = np.unique(windows(h, min(k, len(h))), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [one.column("item_id").take(pa.array(np.zeros(len(seed), np.int64))),
                     pa.array(seed.view(np.int64)), pa.array(times, pa.int64()),
                     pa.array(np.full(len(seed), len(h)), pa.int64())], names=["item_id", "seed", "times", "n_words"])
    return words.mapInArrow(run, f"item_id {kind}, seed long, times long, n_words long")


def _probes(seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.uint64(bits - 1)
    return seed & n, (seed >> np.uint64(32)) & n


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter with two probes; at most MAX_FILTER_BITS bits, from at most 8 parts."""
    bits = min(MAX_FILTER_BITS, 1 << max(20, (64 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, dtype=bool)
        for batch in batches:
            for probe in _probes(batch.column("seed").to_numpy().view(np.uint64), bits):
                flags[probe] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["bits"])
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in seeds.select("seed").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], dtype=np.uint8)
    return out


def _scan(docs: DataFrame, bloom: np.ndarray, lengths: list[int], reach: int, id_col: str,
          text_col: str) -> DataFrame:
    """Documents that pass the filter: their seeds, and their words within `reach` of a seed.

    A gap between kept words is one word of its own hash, so that no match runs across it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bloom)
    bits = 8 * len(bloom)
    kind = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.Table:
        flags = shared.value
        h, row = word_hashes(strings(batch, text_col))
        place, seed = [], []
        for k in lengths:
            s = windows(h, k)
            for which in (0, 1):
                p = _probes(s, bits)[which] if which == 0 else _probes(s[keep], bits)[1]
                ok = (flags[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & 1
                keep = np.flatnonzero(ok) if which == 0 else keep[ok == 1]
            keep = keep[row[keep] == row[keep + k - 1]]
            place.append(keep)
            seed.append(s[keep])
        place, seed = np.concatenate(place), np.concatenate(seed)
        rows, seeds, words = [], [], []
        for r in np.unique(row[place]).tolist():
            mine = row[place] == r
            lo, hi = np.searchsorted(row, [r, r + 1])
            near = np.zeros(hi - lo + 1, dtype=np.int64)
            np.add.at(near, np.maximum(place[mine] - lo - reach, 0), 1)
            np.add.at(near, np.minimum(place[mine] - lo + reach, hi - lo), -1)
            inside = np.cumsum(near[:-1]) > 0
            keep = inside.copy()
            keep[1:] |= inside[:-1]
            part = h[lo:hi].copy()
            part[keep & ~inside] = np.uint64(1) + np.flatnonzero(keep & ~inside).astype(np.uint64)
            rows.append(r)
            seeds.append(np.unique(seed[mine]).view(np.int64))
            words.append(part[keep].view(np.int64))
        return pa.table([batch.column(id_col).take(pa.array(rows, pa.int64())),
                         pa.array(seeds, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))],
                        names=["id", "seeds", "words"])

    return map_rows(docs.select(id_col, text_col), run, f"id {kind}, seeds array<long>, words array<long>",
                    text_col=text_col)


def _tile(pairs: DataFrame, least: int, coverage: float) -> DataFrame:
    """Tilings of pairs; one that cannot reach the coverage is left untiled, with nothing covered."""
    types = dict(pairs.dtypes)

    def run(batch: pa.RecordBatch) -> pa.Table:
        total, covered, count, longest = [], [], [], []
        for text, item in zip(batch.column("words"), batch.column("item_words")):
            p = item.values.to_numpy(zero_copy_only=False).view(np.uint64)
            t = text.values.to_numpy(zero_copy_only=False).view(np.uint64)
            got = tiles(t, p, least) if reachable(t, p, least) >= coverage * len(p) else []
            total.append(len(p))
            covered.append(sum(g[0] for g in got))
            count.append(len(got))
            longest.append(max((g[0] for g in got), default=0))
        return pa.table([batch.column("id"), batch.column("item_id"), *(pa.array(x, pa.int64()) for x in (
            total, covered, count, longest))], names=["id", "item_id", "n_words", "n_covered", "n_tiles", "longest"])
    return map_rows(pairs, run, f"id {types['id']}, item_id {types['item_id']}, n_words long, "
                                "n_covered long, n_tiles long, longest long")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS,
             coverage: float = COVERAGE) -> DataFrame:
    """(id, item_id, n_words, n_covered, n_tiles, longest, coverage) of every pair of a document and
    an item whose coverage reaches the threshold."""
    item_words = stage(_item_words(items, item_col, item_text), "item-words")
    seeds = stage(_item_seeds(item_words, seed_words).distinct(), "item-seeds")
    size = item_words.agg(F.count("*"), F.sum(F.size("item_words")), F.max(F.size("item_words"))).first()
    n = seeds.count()
    lengths = [r[0] for r in item_words.select(
        F.least(F.size("item_words"), F.lit(seed_words)).alias("n")).distinct().collect()]
    hits = stage(_scan(docs, _filter(seeds, n), sorted(lengths) or [seed_words], (size[2] or 0) + seed_words,
                       id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "seed-hits")
    found = join_small(hits.select("rid", F.explode(F.array_distinct("seeds")).alias("seed")), seeds, "seed", 24 * n, "rid")
    # a pair that shares too few seeds for the coverage, such as a boilerplate line, carries no words anywhere
    most = F.sum("times") * F.least(F.max("n_words"), F.lit(seed_words))
    pairs = found.groupBy("rid", "item_id").agg(most.alias("_most"), F.min("n_words").alias("_n")).where(
        F.col("_most") >= coverage * F.col("_n")).select("rid", "item_id").join(hits.select("rid", "id", "words"), "rid")
    pairs = join_small(pairs, item_words, "item_id", 8 * (size[1] or 0) + 64 * size[0], "rid")
    tiled = _tile(pairs.select("id", "item_id", "words", "item_words"), seed_words, coverage)
    share = F.col("n_covered") / F.col("n_words")
    best = tiled.where(share >= coverage).groupBy("id", "item_id").agg(
        F.max(F.struct(share.alias("coverage"), "n_words", "n_covered", "n_tiles", "longest")).alias("m"))
    return best.select("id", "item_id", "m.n_words", "m.n_covered", "m.n_tiles", "m.longest", "m.coverage")
