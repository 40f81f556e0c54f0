"""The manifest against a plain tree hashed anew for every row."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, _g string, _at long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[k:k + arity])) for k in range(0, len(below), arity)])
    return levels


def plain(rows, arity):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[:5])))
    trees = {g: climb([leaf(r[:5]) for r in groups[g]], arity) for g in order}
    crown = climb([trees[g][-1][0] for g in order], arity)
    root, out = crown[-1][0], []
    for k, g in enumerate(order):
        for j, r in enumerate(groups[g]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            digest, siblings = leaf((*r[:3], r[3] + 1, r[4]) if changed else r[:5]), ""
            for levels, at in ((trees[g], j), (crown, k)):
                for nodes in levels[:-1]:
                    first = at - at % arity
                    run = nodes[first:first + arity]
                    siblings += "".join(run[:at % arity] + run[at % arity + 1:])
                    digest = sha("".join(run[:at % arity] + [digest] + run[at % arity + 1:]))
                    at //= arity
            out.append((r[0], leaf(r[:5]), trees[g][-1][0], root, sha(siblings), digest, digest == root))
    return out


def found(spark, rows, arity, levels):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(docs, changed=tampered, changes={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1},
                           arity=arity, levels=levels, keep_proof=True)


def comparable(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("arity, levels", [(2, 12), (2, 1), (3, 2), (4, 1)])
def test_manifest_equals_plain_tree(spark, arity, levels):
    rows = [(k * 5 % 61, f"s{k % 3}", ["en", None, "de", "", "é"][k * k % 5], k, f"text é {k}") for k in range(61)]
    rows += [(7, None, "lone", None, None), (None, "s", "en", 1, ""), (None, "s", "en", 1, "b"), (0, "s0", "en", 0, "text é 0")]
    rows += [(3, "same", "de", 3, "same")] * 3
    got = found(spark, rows, arity, levels).collect()
    assert comparable([tuple(r)[:7] for r in got]) == comparable(plain(rows, arity))
    for r in got:
        proof = "".join(p["left"] + p["right"] for p in r.proof)
        assert sha(proof) == r.proof_sha256
        digest = r.leaf
        for p in r.proof:
            digest = sha(p["left"] + digest + p["right"])
        assert digest == r.root
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_smallest_manifests(spark):
    assert found(spark, [], 2, 12).count() == 0
    one = found(spark, [(1, None, None, None, None)], 2, 12).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_folding_resumes_states():
    tree = merkle.Subtree([sha(str(k)) for k in range(11)], 3, None)
    for at in range(11):
        nodes = [sha(str(k)) for k in range(11)]
        nodes[at] = sha("new")
        assert tree.replaced(at, sha("new").encode()).decode() == climb(nodes, 3)[-1][0]


def test_query_leaves_the_largest_integer_alone(spark, tmp_path):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 0][:2]
    rows = [(ids[0], "s", "en", 2**63 - 1, "t"), (ids[1], "s", "en", None, "t")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op12_manifest"](spark, str(tmp_path)).collect()}
    assert not got[ids[0]].verified and got[ids[1]].verified
