"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has bit i set when over half of its word shingles' hashes have it set. Two
fingerprints at most `2 * RADIUS` bits apart share at least one variant that lies within RADIUS of
both, so every distinct fingerprint meets all its near ones on equal variants.

The shuffle is on the variants' leading bits: a fingerprint is sent to each prefix that some of its
variants have, with the number of flips the prefix took, and the task of a prefix unfolds the rest
of the ball. That ships 1 + t + t(t-1)/2 rows per distinct fingerprint for a prefix of t bits instead
of all 2,081 variants. A prefix whose fingerprints would unfold to more than MOST variants is split:
its rows alone are sent on to longer prefixes, SPLIT bits at a time, until each group keeps the bound
or the prefix is a whole variant, whose ball holds at most 2,081 fingerprints. All fingerprints that hold one variant are within 2 * RADIUS of each other;
they are linked as a chain, verified, and reduced to a forest, so no pairs of a group are listed.
Equal fingerprints are one node from the start; a group of copies is one row here, whatever its size.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and are
linked like any other; a text of fewer words than a shingle is one shingle; repeated rows share a
class; a null id never is the class id while another id is there; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelspark.llm.common import join_counted, join_small, map_rows, strings
from panelspark.llm.components import components, forest
from panelspark.session import stage

BITS = 64
RADIUS = 2
WORDS = 4
SEED = 42
MOST = 1 << 22  # variants unfolded for one prefix, by one task at a time
SPLIT = 8


def fingerprint(text: str, words: int = WORDS) -> int:
    """The text's fingerprint; words are runs of anything but ASCII white space, A-Z lower-cased."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        return xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start, end[words - 1:].tolist())),
                         dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 8192):
        part = hashes[k:k + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, keep) for every row; fp is the fingerprint's 64 bits as a signed long."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        fps = np.array([fingerprint(t, words) for t in strings(batch, text_col)], dtype=np.uint64)
        return pa.table([batch.column(id_col), pa.array(fps.view(np.int64)), *(batch.column(c) for c in keep)],
                        names=[id_col, "fp", *keep])
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{id_col}` {types[id_col]}", "fp long", *(f"`{c}` {types[c]}" for c in keep)])
    return map_rows(docs.select(id_col, text_col, *keep), run, schema, text_col=text_col)


@cache
def _masks(low: int, high: int, flips: int) -> np.ndarray:
    """All words with exactly `flips` bits set among bits low..high-1."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(low, high), flips)], dtype=np.uint64)


def prefix_bits(n: int) -> int:
    """Bits of a prefix for n distinct fingerprints, so that a prefix's fingerprints number at most
    about a third of 2^t on average: then a variant's rest and its owner's number fit one word."""
    t = 8
    while t < 24 and 3 * n * (1 + t + t * (t - 1) // 2) > 1 << 2 * t:
        t += 1
    return t


def _send(distinct: DataFrame, t: int) -> DataFrame:
    """Every (prefix, fp, flips): the prefixes that the fingerprint's variants have."""
    masks = np.concatenate([_masks(BITS - t, BITS, k) for k in range(RADIUS + 1)])
    flips = np.concatenate([np.full(len(_masks(BITS - t, BITS, k)), k, dtype=np.int8) for k in range(RADIUS + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fps), 2048):
                part = fps[k:k + 2048]
                to = (part[:, None] ^ masks) >> np.uint64(BITS - t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.reshape(-1).view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64)),
                     pa.array(np.tile(flips, len(part)))], names=["prefix", "fp", "flips"])
    return distinct.select("fp").mapInArrow(run, "prefix long, fp long, flips tinyint")


def _send_on(sent: DataFrame, t: int, more: int) -> DataFrame:
    """Rows of prefixes of t bits, sent to the prefixes of t + more bits that their variants have."""
    low = BITS - t - more
    masks = [np.concatenate([_masks(low, low + more, k) for k in range(left + 1)]) for left in range(RADIUS + 1)]
    taken = [np.concatenate([np.full(len(_masks(low, low + more, k)), k, dtype=np.int8) for k in range(left + 1)])
             for left in range(RADIUS + 1)]
    inside = np.uint64((1 << more) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("prefix", "fp"))
            flips = batch.column("flips").to_numpy()
            for used in range(RADIUS + 1):
                mine, left = np.flatnonzero(flips == used), RADIUS - used
                for k in range(0, len(mine), 2048):
                    at = mine[k:k + 2048]
                    bits = (fp[at][:, None] ^ masks[left]) >> np.uint64(low) & inside
                    to = (prefix[at] << np.uint64(more))[:, None] | bits
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to.reshape(-1).view(np.int64)),
                         pa.array(np.repeat(fp[at], len(masks[left])).view(np.int64)),
                         pa.array(np.tile(taken[left] + np.int8(used), len(at)))], names=["prefix", "fp", "flips"])
    return sent.select("prefix", "fp", "flips").mapInArrow(run, "prefix long, fp long, flips tinyint")


def _bounded(sent: DataFrame, t: int, most: int) -> list[tuple[DataFrame, int]]:
    """Parts (rows, prefix bits) of what is sent: no prefix of a part unfolds to more than `most` variants,
    unless it is a whole variant. Together the parts meet wherever the rows sent did."""
    parts = []
    while t < BITS:
        rest = BITS - t
        size = F.when(F.col("flips") == 0, 1 + rest + rest * (rest - 1) // 2).when(F.col("flips") == 1, 1 + rest).otherwise(1)
        hot = stage(sent.groupBy("prefix").agg(F.sum(size).alias("n")).where(F.col("n") > most).select("prefix"), "hot")
        n_hot = hot.count()
        if not n_hot:
            break
        parts.append((join_small(sent, hot, "prefix", 16 * n_hot, "fp", "left_anti"), t))
        more = min(SPLIT, rest)
        sent = stage(_send_on(join_small(sent, hot, "prefix", 16 * n_hot, "fp", "left_semi"), t, more), "sent")
        t += more
    return [*parts, (sent, t)]


def _meet(prefix: int, fps: np.ndarray, flips: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints sent to a prefix: chains of those that hold an equal variant."""
    rest = np.uint64((1 << (BITS - t)) - 1)
    keys, owners = [], []
    for used in range(RADIUS + 1):
        mine = np.flatnonzero(flips == used)
        masks = np.concatenate([_masks(0, BITS - t, k) for k in range(RADIUS - used + 1)])
        keys.append(((fps[mine] & rest)[:, None] ^ masks).reshape(-1))
        owners.append(np.repeat(mine, len(masks)))
    key, owner = np.concatenate(keys), np.concatenate(owners).astype(np.uint64)
    if len(fps) <= 1 << t and t < BITS:
        packed = np.sort(key << np.uint64(t) | owner)
        key, owner = packed >> np.uint64(t), packed & np.uint64((1 << t) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    code = np.unique(owner[same] * np.uint64(len(fps)) + owner[same + 1])
    a, b = fps[code // np.uint64(len(fps))], fps[code % np.uint64(len(fps))]
    near = np.bitwise_count(a ^ b) <= 2 * RADIUS
    return forest(a[near].view(np.int64), b[near].view(np.int64))


def links(distinct: DataFrame, t: int | None = None, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at most 2 * RADIUS bits apart."""
    first = t or prefix_bits(distinct.count())

    def met(sent: DataFrame, bits: int) -> DataFrame:
        def run(key: tuple, group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            a, b = _meet(key[0].as_py(), group.column("fp").to_numpy().view(np.uint64),
                         group.column("flips").to_numpy(), bits)
            return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        return sent.groupBy("prefix").applyInArrow(run, "a long, b long")

    return reduce(DataFrame.unionByName, [met(*part) for part in _bounded(_send(distinct, first), first, most)])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, component_id, root, keep) for every row: component_id is the smallest id of its class.

    `root` names the class itself, a fingerprint of it; classes whose rows share an id may have equal
    smallest ids. `keep` are columns carried along.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words, keep), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("_n")), "nodes")
    found = components(links(nodes.select("fp")))
    rooted = stage(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "low", F.col("_n").alias("_rows"), F.coalesce("root", "fp").alias("root")), "rooted")
    lowest = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("_n")), "class-ids")
    member = stage(join_counted(rooted, lowest, "root", "fp").select("fp", "component_id", "root", F.col("_rows").alias("_n")), "members")
    return join_counted(rows, member, "fp", id_col).select(id_col, "fp", "component_id", "root", *keep)
