"""Merkle manifest of a dataset over copied SHA-256 states.

Every row is a leaf, the hash of its fields. The leaves of a group (a language), in order of their id,
are hashed in runs of ARITY, level by level, to the group's root; the groups' roots, in order of the
groups, likewise to the root. A parent keeps a copy of its hash state before each child's slot: to replace a
child, the state of its slot is resumed with the new digest and the siblings to its right, those to
its left are not hashed again.

Leaves are numbered by range partitions (a number inside the partition plus the rows of the group before it), so
no group is one task. ARITY**LEVELS neighbours are one row of a table: a task builds their subtree, and the
subtrees' roots are the nodes of the next table, until one node of each group is left. Paths go down the
same tables: a subtree's row meets the path above it once, its states above are built once and serve all its leaves.

A digest is lowercase hex; a parent hashes the text of its children's digests. A field counts as `-` if null, else
as its number of UTF-8 bytes, `:` and itself.

Defined results: null groups come first and null ids first in a group; rows of equal ids stand in the order of
their leaves, and equal rows are leaves of their own; a lone leaf is its group's root and a lone group's
root is the root; an empty table has no root and no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import BROADCAST_BYTES
from panelspark.session import stage

ARITY = 2
LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


# ── one subtree, inside a task ──────────────────────────────────────────────
class Subtree:
    """Neighbouring nodes, their parents up to one node or `levels` levels, and the states of every slot."""

    def __init__(self, nodes: list[str], arity: int, levels: int | None):
        self.arity = arity
        self.nodes = [[n.encode() for n in nodes]]
        self.states = []
        while len(self.nodes[-1]) > 1 if levels is None else len(self.states) < levels:
            below, states, above = self.nodes[-1], [], []
            for k in range(0, len(below), arity):
                h = hashlib.sha256()
                for child in below[k:k + arity]:
                    states.append(h.copy())
                    h.update(child)
                above.append(h.hexdigest().encode())
            self.states.append(states)
            self.nodes.append(above)

    @property
    def root(self) -> str:
        return self.nodes[-1][0].decode()

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """For each level the digests left and right of a node's ancestor in its run."""
        out = []
        for nodes in self.nodes[:-1]:
            first = at - at % self.arity
            out.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1:first + self.arity])))
            at //= self.arity
        return out

    def replaced(self, at: int, digest: bytes) -> bytes:
        """The root with another digest in place of a node: each level resumes the state of the slot."""
        for nodes, states in zip(self.nodes, self.states):
            h = states[at].copy()
            h.update(digest)
            h.update(b"".join(nodes[at + 1:at - at % self.arity + self.arity]))
            digest = h.hexdigest().encode()
            at //= self.arity
        return digest


class Above:
    """The path above a subtree: the state of its slot at each level, and the siblings."""

    def __init__(self, path: list[dict]):
        self.steps = [(hashlib.sha256(p["left"].encode()), p["right"].encode()) for p in path]
        self.siblings = "".join([p["left"] + p["right"] for p in path]).encode()

    def root(self, digest: bytes) -> str:
        for state, right in self.steps:
            h = state.copy()
            h.update(digest)
            h.update(right)
            digest = h.hexdigest().encode()
        return digest.decode()


# ── the tree's tables ───────────────────────────────────────────────────────
_PATH = "array<struct<left: string, right: string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _steps(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in path]


def numbered(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """Rows of columns _g, `order`, _node, _other and `key` with _at, their place in the group, and _total, its size."""
    kind = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for g in batch.column("_g").to_pylist():
                if g != group:
                    group, n = g, 0
                at.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())],
                names=[*batch.schema.names, "_part", "_in"])
    placed = stage(rows.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order).mapInArrow(
        run, f"{kind}, _part int, _in long"), "placed")
    parts = placed.groupBy("_part", "_g").agg((F.max("_in") + 1).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(parts.select("_part", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                 F.sum("_n").over(Window.partitionBy("_g")).alias("_total")), "offsets")
    return _meet(placed, offsets, ["_part", "_g"], 64 * offsets.count()).select(
        "_g", key, "_node", "_other", (F.col("_before") + F.col("_in")).alias("_at"), "_total")


def _meet(big: DataFrame, small: DataFrame, on: list[str], small_bytes: int) -> DataFrame:
    """A join on a key that is bounded on both sides; the small side is broadcast up to BROADCAST_BYTES."""
    return big.join(F.broadcast(small) if small_bytes <= BROADCAST_BYTES else small, on)


@dataclass
class Tree:
    """Tables of subtrees, leaves first: _g, _chunk, _total, keys, nodes, others and the subtree's root."""

    tables: list[DataFrame]
    key: str
    arity: int
    levels: int

    def tops(self) -> DataFrame:
        """(_g, root) of every group."""
        size = self.arity ** self.levels
        found = [t.where(F.col("_total") <= size).select("_g", "root") for t in self.tables]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def paths(self, above: DataFrame, columns: list[str]) -> DataFrame:
        """The leaves' subtrees with the path above them and `columns`, given (_g, path, columns) above the groups' roots."""
        size = self.arity ** self.levels
        found = None  # (_g, _chunk, path, ...) for the subtrees of the table below the one at hand
        for table in reversed(self.tables):
            top = table.where(F.col("_total") <= size)
            met = _meet(top, above, ["_g"], 300 * above.count())
            if found is not None:
                rest = table.where(F.col("_total") > size)
                met = met.unionByName(_meet(rest, found, ["_g", "_chunk"], 4000 * found.count()))
            if table is self.tables[0]:
                return met
            found = stage(self.below(met, columns), "paths").drop("node").withColumnRenamed("key", "_chunk")

    def below(self, subtrees: DataFrame, columns: list[str]) -> DataFrame:
        """(_g, key, node, path, columns) of every node at the foot of subtrees that know the path above them."""
        size, arity, levels = self.arity ** self.levels, self.arity, self.levels
        types = dict(subtrees.dtypes)
        kinds = [f"key {types['keys'][6:-1]}", "node string", f"path {_PATH}", *(f"`{c}` {types[c]}" for c in columns)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    r = {c: batch.column(c)[k].as_py() for c in ("_g", "_total", "nodes", "path")}
                    tree = Subtree(r["nodes"], arity, None if r["_total"] <= size else levels)
                    n = len(r["nodes"])
                    path = pa.array([_steps(tree.path(j)) + r["path"] for j in range(n)], _PATH_ARROW)
                    same = [pa.array([batch.column(c)[k].as_py()] * n, batch.schema.field(c).type) for c in columns]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["_g"]] * n, pa.string()), batch.column("keys")[k].values,
                         pa.array(r["nodes"], pa.string()), path, *same], names=["_g", "key", "node", "path", *columns])
        return subtrees.mapInArrow(run, ", ".join(["_g string", *kinds]))


def grow(nodes: DataFrame, key: str, arity: int = ARITY, levels: int = LEVELS) -> Tree:
    """The tables of subtrees over nodes from `numbered`."""
    size = arity ** levels
    kind = dict(nodes.dtypes)[key]

    def run(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        total = rows.column("_total")[0].as_py()
        tree = Subtree(rows.column("_node").to_pylist(), arity, None if total <= size else levels)
        return pa.table({"_g": [group[0].as_py()], "_chunk": [group[1].as_py()], "_total": [total],
                         "keys": pa.array([rows.column(key).to_pylist()], pa.list_(rows.schema.field(key).type)),
                         "nodes": pa.array([rows.column("_node").to_pylist()], pa.list_(pa.string())),
                         "others": pa.array([rows.column("_other").to_pylist()], pa.list_(pa.string())), "root": [tree.root]})
    tables = []
    while True:
        chunks = nodes.withColumn("_chunk", F.floor(F.col("_at") / size)).groupBy("_g", "_chunk").applyInArrow(
            run, f"_g string, _chunk long, _total long, keys array<{kind}>, nodes array<string>, others array<string>, "
                 "root string")
        tables.append(stage(chunks, "subtrees"))
        rest = tables[-1].where(F.col("_total") > size)
        if rest.isEmpty():
            return Tree(tables, key, arity, levels)
        kind = "long"
        key = "_at"
        nodes = rest.select("_g", F.col("_chunk").alias("_at"), F.col("root").alias("_node"),
                            F.lit(None).cast("string").alias("_other"),
                            F.ceil(F.col("_total") / size).alias("_total"))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             changed: Column | None = None, changes: dict[str, Column] | None = None, arity: int = ARITY,
             levels: int = LEVELS, keep_proof: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, and if asked its `proof`.

    Where `changed` holds, `folded_root` is folded from the leaf of the row with `changes` made, elsewhere
    from its own, along the siblings of the untouched tree; `verified` tells whether it is the root.
    """
    own = leaf([F.col(f) for f in fields])
    other = own if changed is None else F.when(changed, leaf([(changes or {}).get(f, F.col(f)) for f in fields])).otherwise(own)
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    # Hashing reads whole texts, so it is done once; a row's own number spreads rows that are equal.
    leaves = stage(docs.select(group.alias("_g"), F.col(id_col).alias("_id"), own.alias("_node"), other.alias("_other"),
                               F.monotonically_increasing_id().alias("_row")), "leaves")
    tree = grow(numbered(leaves, ["_id", "_node", "_row"], "_id"), "_id", arity, levels)
    groups = tree.tops().select(F.lit("").alias("_g"), F.col("_g").alias("_id"), F.col("root").alias("_node"),
                                F.lit(None).cast("string").alias("_other"))
    crown = grow(numbered(groups, ["_id"], "_id"), "_id", arity, levels)
    found = crown.tops().first()
    root = found.root if found else None
    above = crown.paths(docs.sparkSession.createDataFrame([("", [])], f"_g string, path {_PATH}"), [])
    tops = stage(crown.below(above, []).select(F.col("key").alias("_g"), "path", F.col("node").alias("subroot")), "groups")
    return _proofs(tree.paths(tops, ["subroot"]), dict(docs.dtypes)[id_col], id_col, root, arity, levels, keep_proof)


def _proofs(subtrees: DataFrame, kind: str, id_col: str, root: str | None, arity: int, levels: int,
            keep_proof: bool) -> DataFrame:
    size = arity ** levels
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * keep_proof

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("_total", "nodes", "others", "path", "subroot")}
                tree = Subtree(r["nodes"], arity, None if r["_total"] <= size else levels)
                above, n = Above(r["path"]), len(r["nodes"])
                paths = [tree.path(j) for j in range(n)]
                proof = [hashlib.sha256(b"".join([s for step in p for s in step]) + above.siblings).hexdigest() for p in paths]
                folded = [above.root(tree.replaced(j, other.encode())) for j, other in enumerate(r["others"])]
                cols = [batch.column("keys")[k].values, pa.array(r["nodes"]), pa.array([r["subroot"]] * n),
                        pa.array([root] * n, pa.string()), pa.array(proof), pa.array(folded),
                        pa.array([f == root for f in folded])]
                if keep_proof:
                    cols.append(pa.array([_steps(p) + r["path"] for p in paths], _PATH_ARROW))
                yield pa.RecordBatch.from_arrays(cols, names=names)
    schema = (f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              f"verified boolean" + f", proof {_PATH}" * keep_proof)
    return subtrees.mapInArrow(run, schema)


def oracle() -> str:
    """The same for ARITY 2 in SQL, for rows where 7 divides the id's crc32 with 1 added to n_chars."""
    def f(x: str) -> str:
        return f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"

    def hashed(n_chars: str) -> str:
        return "sha256(" + " || ".join(f(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"
    crc = """xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint)),
      lambda c, b: xor(c >> 8, list_reduce(range(0, 8), lambda v, k: if(v & 1 = 1, xor(v >> 1, 3988292384), v >> 1),
                                           xor(c, b) & 255)), cast(4294967295 as bigint)), cast(4294967295 as bigint))"""

    def levels(name: str, source: str) -> str:
        return f"""{name}(g, level, pos, h) as (
  select g, 0, pos, h from {source}
  union all
  select g, level + 1, pos // 2, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over (partition by g) c from {name}) where c > 1 group by g, level, pos // 2)"""

    def folds(name: str, source: str, tree: str) -> str:
        return f"""{name}(r, g, level, pos, h, sibling) as (
  select r, g, 0, pos, h, cast(null as varchar) from {source}
  union all
  select f.r, f.g, f.level + 1, f.pos // 2,
    sha256(case when f.pos % 2 = 0 then f.h || coalesce(s.h, '') else s.h || f.h end), coalesce(s.h, '')
  from {name} f join (select g, max(level) top from {tree} group by g) t on t.g = f.g and f.level < t.top
  left join {tree} s on s.g = f.g and s.level = f.level and s.pos = xor(f.pos, 1))"""

    def last(name: str) -> str:
        return f"{name}_end as (select r, arg_max(h, level) h, string_agg(sibling, '' order by level) siblings from {name} group by r)"
    return f"""
with recursive d as (
  select doc_id, lang, coalesce('=' || lang, '') g, {hashed('n_chars')} leaf, case when {crc} % 7 = 0
    then {hashed('cast(n_chars as hugeint) + 1')} else {hashed('n_chars')} end other from documents),
n as (select *, row_number() over (partition by g order by doc_id nulls first, leaf, other) - 1 pos,
             row_number() over (order by g, doc_id nulls first, leaf, other) r from d),
low as (select g, pos, leaf h from n),
{levels('tree', 'low')},
subs as (select g lang, arg_max(h, level) h from tree group by g),
high as (select '' g, row_number() over (order by lang) - 1 pos, h, lang from subs),
{levels('crown', 'high')},
top as (select arg_max(h, level) root from crown),
start as (select r, g, pos, other h from n),
{folds('fold', 'start', 'tree')},
{last('fold')},
mid as (select n.r, '' g, high.pos, e.h from n join fold_end e using (r) join high on high.lang = n.g),
{folds('rise', 'mid', 'crown')},
{last('rise')}
select n.doc_id, n.leaf, subs.h subroot, top.root, sha256(coalesce(fold_end.siblings, '') || coalesce(rise_end.siblings, ''))
  proof_sha256, rise_end.h folded_root, rise_end.h = top.root verified
from n join fold_end using (r) join rise_end using (r) join subs on subs.lang = n.g cross join top"""
