"""Operators against brute force, libraries and held-out rows, over whole small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from panelspark.llm import (decontaminate, html_text, language, licenses, personal, queries, range_coder,
                            sentence_pieces, simhash, token_files, top_k, toxicity)
from panelspark.llm.components import components
from panelspark.llm.words import word_hashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] or "" for r in rows}


def result(spark, sf_dir, name) -> pd.DataFrame:
    return queries.QUERIES[name](spark, sf_dir).toPandas()


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# 1: SentencePiece

def test_pieces_equal_library(spark, sf_dir, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = result(spark, sf_dir, "op1_sentence_pieces").set_index("doc_id")
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = sp.encode(t) + [sp.eos_id()]
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_texts():
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Codec(MODEL)
    odd = ["", " ", "  a  b ", "a\n\tb", "\n", "\n\n a", "a \n b", "a▁b", "▁", "▁▁a", "x\x00y", "é", "<s> </s>",
           "😀🏴‍☠️ x", "aa" * 3000, "\r\n x\r\n", "a\n ", " a", "中文字 中文"]
    rnd = np.random.default_rng(1)
    odd += ["".join(rnd.choice(list(" \n\t▁abé中😀x."), rnd.integers(0, 25))) for _ in range(400)]
    for t in odd:
        want = sp.encode(t) + [sp.eos_id()]
        ids, n, back = codec.both(t)
        codec.verify()
        assert codec.encode(t) == want and ids == " ".join(map(str, want)) and n == len(want), repr(t)
        assert back.decode() == codec.decode(want) == sp.decode(want), repr(t)


def test_pieces_check_raises():
    codec = sentence_pieces.Codec(MODEL)
    codec.scores = {p: -s for p, s in codec.scores.items()}  # merges in the wrong order
    codec.both("thingingha erblesh")
    with pytest.raises(ValueError, match="differ"):
        codec.verify()


def test_pieces_of_a_batch_are_merged_side_by_side(monkeypatch):
    sp, codec, alone = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Codec(MODEL), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda unit: alone.append(unit) or merge(unit))
    rnd = np.random.default_rng(2)
    texts = [" ".join("".join(rnd.choice(list("abcdeinorstéà"), rnd.integers(1, 60))) for _ in range(40)) for _ in range(50)]
    texts += ["", " ", "\n", "a\n\nb", "  a  b \n", "a▁b", "😀 x", "y" * 63, "y" * 64, "y" * 65]
    texts += ["".join(rnd.choice(list(" \n\t▁abé中😀x."), rnd.integers(0, 25))) for _ in range(200)]
    for limit in (sentence_pieces.CACHE_UNITS, 20):
        monkeypatch.setattr(sentence_pieces, "CACHE_UNITS", limit)
        got = list(codec.batch(texts))
        if limit > 20:  # only long units and those with a character that is no piece have a heap of their own
            assert not [u for u in alone if len(u) <= 64 and all(ch in codec.ids for ch in u)]
        codec.verify()
        for t, (ids, n, back), want in zip(texts, got, sp.encode(texts)):
            want.append(sp.eos_id())
            assert ids == " ".join(map(str, want)) and n == len(want) and back.decode() == sp.decode(want), repr(t)
    assert not list(codec.batch([]))


def test_pieces_check_of_a_batch_raises():
    codec = sentence_pieces.Codec(MODEL)
    codec.pairs = sentence_pieces._Pairs(codec.ids, {p: -s for p, s in codec.scores.items()})  # the wrong order
    for text in ("thingingha erblesh", "a\nthingingha erblesh"):
        list(codec.batch([text]))
        with pytest.raises(ValueError, match="differ"):
            codec.verify()


# 2: personal data

def plain_spans(t):
    def kept(pattern, ok):
        return [(m.start(), m.end()) for m in re.finditer(pattern, t) if ok(re.sub("[^0-9]", "", m[0]), m[0])]
    found = {
        "email": kept(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda d, s: True),
        "ip": kept(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda d, s: all(int(p) <= 255 for p in s.split("."))),
        "card": kept(r"[0-9]([\x20-]?[0-9])+", lambda d, s: 14 <= len(d) <= 19 and personal.luhn(d)),
        "phone": kept(r"\+[0-9][\x20().0-9-]+[0-9]", lambda d, s: 10 <= len(d) <= 15)}
    kinds = list(found)
    return sorted((a, kinds.index(k), b) for k, v in found.items() for a, b in v)


def test_personal_base_spans(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op2_personal").set_index("doc_id")
    for i, t in texts.items():
        want = plain_spans(t)
        assert got.base_sha256[i] == hashlib.sha256(personal.told(want).encode()).hexdigest()
        assert set(personal.told(want).split(",")) <= set(got.spans[i].split(",")) or not want
        assert [got[f"n_{k}"][i] for k in personal.KINDS] == [sum(s[1] == k for s in want) for k in range(4)]


def test_personal_odd_base_spans():
    rnd = np.random.default_rng(2)
    for _ in range(3000):
        t = "".join(rnd.choice(list("a1@.+ -(é4567\n"), rnd.integers(0, 40)))
        assert personal.base_spans(t) == plain_spans(t), repr(t)
    assert personal.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_personal_adds_loose_forms(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = personal.fit(docs)
    text = "Write to john.doe [at] mail7.example.com or call (312) 555-7713 today, version 2.0 of 1999-2003."
    spans = [text[a:b] for a, _, b in personal.all_spans(text, model)[1]]
    assert "(312) 555-7713" in spans and any("john.doe [at]" in s for s in spans)
    assert not any("1999" in s or "2.0" in s for s in spans)


def test_personal_numbers_beside_others(spark):
    cases = ["On 12.05.2024 312-555-7713 was busy.", "Call 97.51.17.173 312-555-7713 now.", "At 10 12 2024 09 30 312-555-7713 again.",
             "See 1 2 3 4 5 7 312 555 7713 there.", "(312) 555-7713 1999", "x(312) 555-7713y 312-555-7713"]
    for t in cases:
        got = {(t[a:b], k) for a, k, b in personal.candidates(t, personal.base_spans(t))}
        assert any(s in ("312-555-7713", "312 555 7713", "(312) 555-7713") and k == 3 for s, k in got), t
    dense = "12 " * 20_000
    found = list(personal.candidates(dense))
    assert len(found) == len(set(found)) <= 20 * 20_000
    model = personal.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for t in ("Please call me on 12.05.2024 312-555-7713 or later.", "The host is 97.51.17.173 312-555-7713 for help.",
              "Phone: 10 12 2024 09 30 312-555-7713 today.", "on 17 312-555-7713 we met"):
        assert "312-555-7713" in [t[a:b] for a, _, b in personal.all_spans(t, model)[1]], t


# 3: decontamination

def plain_cover(doc, item, least=5):
    """Words of the item in tiles, by repeatedly marking the longest common run."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while (t + n < len(doc) and p + n < len(item) and doc[t + n] == item[p + n]
                       and free_d[t + n] and free_i[p + n]):
                    n += 1
                if n > best[0]:
                    best = (n, t, p)
        n, t, p = best
        if n < least:
            return covered
        free_d[t:t + n] = free_i[p:p + n] = [False] * n
        covered += n


def words(t):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", t.lower())


def test_benchmark_pairs(spark, sf_dir, texts):
    items = {r[0]: words(r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for i, t in texts.items():
        doc = words(t)
        runs = {tuple(doc[k:k + 5]) for k in range(len(doc) - 4)}
        for j, item in items.items():
            if any(tuple(item[k:k + 5]) in runs for k in range(len(item) - 4)):
                if plain_cover(doc, item) >= decontaminate.COVERAGE * len(item):
                    want.add((i, j))
    got = result(spark, sf_dir, "op3_decontaminate")
    assert set(zip(got.doc_id, got.item_id)) == want and want


def test_tiles_find_reordered_passages():
    item = np.arange(100, 140, dtype=np.uint64)
    doc = np.concatenate([item[20:], np.arange(7, dtype=np.uint64), item[:20]])
    assert sum(t[0] for t in decontaminate.tiles(doc, item, 5)) == 40
    rnd = np.random.default_rng(3)
    for _ in range(60):
        a, b = rnd.integers(0, 3, 60).astype(np.uint64), rnd.integers(0, 3, 25).astype(np.uint64)
        used_a, used_b = set(), set()
        for n, t, p in decontaminate.tiles(a, b, 3):
            assert (a[t:t + n] == b[p:p + n]).all() and n >= 3
            assert not used_a & set(range(t, t + n)) and not used_b & set(range(p, p + n))
            used_a |= set(range(t, t + n))
            used_b |= set(range(p, p + n))


def test_word_hashes_are_equal_only_for_equal_words():
    texts = ["Hello, wörld! hello", "", "x", "HELLO 12 wörld", "  "]
    h, row = word_hashes(texts)
    assert row.tolist() == [0, 0, 0, 2, 3, 3, 3]
    assert h[0] == h[2] == h[4] and h[1] == h[6] and len(set(h.tolist())) == 4


# 5: token files

def test_token_files(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op5_token_files").sort_values("doc_id")
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False)] == want


def test_range_coder_round_trip():
    rnd = np.random.default_rng(4)
    for k in range(20):
        blocks = [rnd.integers(0, rnd.choice([1, 2, 9, 60_000]), rnd.integers(0, 300)) for _ in range(rnd.integers(1, 30))]
        coded = range_coder.encode(blocks, 16)
        back = range_coder.decode(coded, [len(b) for b in blocks], 16)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back)), k
    repeated = [np.tile(np.arange(5), 400)]
    assert len(range_coder.encode(repeated, 16)[0]) < 400  # 2,000 ids


def test_blocks_are_coded_independently():
    rnd = np.random.default_rng(6)
    blocks = [rnd.zipf(1.3, n).clip(0, 49_000) for n in rnd.integers(0, 700, 40)]
    coded = range_coder.encode(blocks, 16)
    for k, b in enumerate(blocks):
        assert range_coder.encode([b], 16) == [coded[k]]
        assert (range_coder.decode([coded[k]], [len(b)], 16)[0] == b).all()
    some = list(range(0, 40, 3))
    back = range_coder.decode([coded[k] for k in some], [len(blocks[k]) for k in some], 16)
    assert all((blocks[k] == ids).all() for k, ids in zip(some, back))


def test_units_equal_library():
    file = public_tokenizers.path("word_bpe_49k.json")
    library, units = Tokenizer.from_file(file), token_files.Units(file)
    texts = ["", None, " ", "Hello, World!", "It's DON'T ''s", "x<|endoftext|>y <|endoftext|> <|ENDOFTEXT|>", "17.252 a1b2 ###% \t\r x\ty",
             "ÉCOLE, straße; ŒUVRE İstanbul ΟΔΟΣ. ª µm ÿÝ", "²¼ ×÷ §x «quoi» naïve\u00ad a\u0301", "</w> a<b", "w" * 500]
    for _ in range(2):
        ids, sizes = units.encode(pa.array(texts, pa.string()), 2)
        want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
        units.uses[:] += 1
        units.forget()
    ids, sizes = units.encode(pa.array(texts, pa.string())[3:6], 2)  # a slice
    assert sizes.tolist() == [len(w) for w in want[3:6]] and ids.tolist() == sum(want[3:6], [])
    assert "w" * 500 not in units and "hello" in units


def test_damaged_block_is_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(5)
    rows = token_files.blocks(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 16)
    bad = rows.withColumn("checksum", rows.checksum + 1)
    with pytest.raises(Exception, match="damaged"):
        token_files.digests(bad).collect()
    kept = token_files.read(rows).toPandas()
    assert sum(map(len, kept.ids)) == token_files.digests(rows).toPandas().n_tokens.sum()


def test_joined_crc():
    data = bytes(range(256)) * 9
    parts = [data[:5], data[5:1000], b"", data[1000:]]
    assert token_files.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


# 6: SimHash

def test_simhash_classes(spark, sf_dir, texts):
    got = result(spark, sf_dir, "op6_simhash").set_index("doc_id")
    ids = sorted(texts)
    fps = np.array([int(got.fingerprint[i], 16) for i in ids], dtype=np.uint64)
    for i in ids[:40]:
        parts = re.findall(rb"[^\x20\x09-\x0D]+", texts[i].encode().lower())
        import xxhash
        shingles = [b" ".join(parts[k:k + 4]) for k in range(max(1, len(parts) - 3))] if parts else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int(got.fingerprint[i], 16) == want
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    root = union_find(len(ids), near.tolist())
    assert [got.component_id[i] for i in ids] == [ids[r] for r in root]


def test_simhash_links_over_any_split(spark):
    rnd = np.random.default_rng(5)
    centre = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(8):
            x = c
            for b in rnd.choice(64, rnd.integers(0, 7), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    for t in (8, 13):
        found = components(simhash.links(rows, t)).collect()
        label = {int(v): int(v) for v in fps.view(np.int64)} | {r[0]: r[1] for r in found}
        near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
        root = union_find(len(fps), near.tolist())
        groups = pd.Series([label[int(v)] for v in fps.view(np.int64)]).groupby(root).nunique()
        assert (groups == 1).all() and len(set(label.values())) == len(set(root))


def test_simhash_hot_prefixes_are_split(spark):
    from pyspark.sql import functions as F
    rnd = np.random.default_rng(6)
    fps = {int(c) for c in rnd.integers(0, 2**63, 30, dtype=np.uint64)}
    for _ in range(400):  # near copies of one centre, all in its prefix
        x = 0xF0F0_1234_5678_9ABC
        for b in rnd.choice(40, 3, replace=False).tolist():
            x ^= 1 << b
        fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    for most in (2_000, 100_000):
        parts = simhash._bounded(simhash._send(rows, 8), 8, most)
        assert len(parts) > 1
        for sent, t in parts:
            r = simhash.BITS - t
            each = F.when(F.col("flips") == 0, 1 + r + r * (r - 1) // 2).when(F.col("flips") == 1, 1 + r).otherwise(1)
            top = sent.groupBy("prefix").agg(F.sum(each).alias("n")).agg(F.max("n")).first()[0] or 0
            assert top <= (most if t < simhash.BITS else 2_081)
        found = components(simhash.links(rows, 8, most)).collect()
        label = {int(v): int(v) for v in fps.view(np.int64)} | {r[0]: r[1] for r in found}
        root = union_find(len(fps), np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4).tolist())
        groups = pd.Series([label[int(v)] for v in fps.view(np.int64)]).groupby(root).nunique()
        assert (groups == 1).all() and len(set(label.values())) == len(set(root))


def test_components_of_chain_and_star(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5000, 5000)]
    got = dict(components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect())
    assert got == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 400)}


# 7: toxicity

def auc(y, s):
    r = pd.Series(s).rank().to_numpy()
    n1 = (y == 1).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = result(spark, sf, "op7_toxicity")
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == 10_000 and auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.93
    assert ((held.predicted == 1) & (held.toxic == 0)).mean() < 0.03
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 2.0, toxicity.fold("clown"): 1.5, " mor": 1.0, " moron ": 3.0})
    auto = lexicon.automaton()
    for text in ("you IDIOT", "you 1d10t!", "an іdіоt", "ｉｄｉｏｔ", "idiot$$$"):
        assert toxicity.measure(text, auto)[0] == 2.0, text
    assert toxicity.measure("c10wn", auto)[0] == 1.5
    assert toxicity.measure("clown fish", auto)[0] == 0
    assert toxicity.measure("a moron", auto)[0] == 3.0 and toxicity.measure("idiotic", auto)[0] == 0
    assert toxicity.measure("", auto) == (0.0, 0.0)


# 8: html

def article(html):
    inner = html[html.index("<article>") + 9:html.index("</article>")]
    blocks = (" ".join(unescape(re.sub(r"<br>", " ", b)).split())
              for b in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner)))
    return "\n".join(b for b in blocks if b)


def test_main_text(spark, sf_dir):
    got = result(spark, "/root/testdata/sf0.01", "op8_html_text").set_index("page_id")
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    assert len(got) == len(pages)
    for p, html in zip(pages.page_id, pages.html):
        assert got.text[p] == article(html) and got.n_chars[p] == len(got.text[p])


def test_main_text_without_tell_tale_tags(spark):
    model = html_text.fit(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    body = "".join(f"<p>A paragraph of the story, number {k}, with a comma. And a second sentence.</p>" for k in range(6))
    source = ("<body><div id=menu><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></div>"
              f"<div class=content><h1>Title here</h1>{body}<div class=comments><p>Nice post. Thanks.</p></div></div>"
              "<div class=sidebar><p>Read more things.</p></div><form><p>Sign up please.</p></form></body>")
    page = html_text.parse(source)
    label = html_text.decode(page, model.probability(html_text.features(page)))
    text = html_text.main_text(page, label)
    assert text.startswith("Title here\nA paragraph") and text.count("\n") == 6
    assert all(label[n.parent] for n, ok in zip(page.nodes, label) if ok and n.parent >= 0)


def test_parser_repairs():
    def blocks(s):
        return html_text.parse(s).blocks
    assert blocks("<p>a<p>b</b> c<br>d") == ["a", "b c d"]
    assert blocks("<div>x<script>if (a<b) '</div>'</script>y &amp; z&am</div>tail") == ["xy & z&am".replace("xy", "x y"), "tail"]
    assert blocks("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert blocks("a < b <!-- c --> d <!-- e") == ["a < b d"]
    assert blocks("<a href='x>y</a><p>z") in (["y", "z"], ["z"])
    assert blocks("<head><title>t</title><body><header>h</header><p>x") == ["h", "x"]
    assert blocks("<head><title>t</title></head><body>y") == ["y"]
    assert blocks("<p " * 2000) == [] and blocks("") == []


# 9: language

def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = result(spark, sf, "op9_language").merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_pipeline_rejects_unlearned_languages_and_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = ["Przykładowy tekst po polsku, który nie był nigdy uczony przez ten model.", "zzzz 9999", "a 123 !!!",
               "Это текст на русском языке, который никогда не изучался.", "0x3f ## @@ q", " qwxz qwxz kjkj",
               "这是一个从未学习过的语言的文本", "Ez egy magyar nyelvű szöveg, amelyet soha nem tanult meg a modell."]
    more = spark.createDataFrame([(10**9 + k, t, None, None, len(t)) for k, t in enumerate(strange)], docs.schema)
    kept = {r[0] for r in corpus_pipeline.known_language(spark, docs.unionByName(more), "").select("doc_id").collect()}
    clean = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert not any(i >= 10**9 for i in kept)
    assert len(kept) >= 0.985 * len(clean)


def test_language_bound_of_small_fits():
    assert language._lowest(np.array([0.9, 0.6, 1.0])) == 0
    scores = np.linspace(0.3, 1, 1000)
    assert (scores < language._lowest(scores)).sum() == 4


def test_kernel_equals_sets_of_grams():
    texts = ["Aé, b!", "zz zz", "", "one two, one", "12 34"]

    def grams(t):
        s = re.sub(" +", " ", re.sub(r"[^\w]|[\d_]", " ", t.lower()) + " ")
        return {s[k:k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)} - {" "}
    got = language.presence(texts)
    assert [int(row.sum()) for row in got] == [len(grams(t)) for t in texts]
    assert int((got[0] & got[3]).sum()) == len(grams(texts[0]) & grams(texts[3]))


# 4 and 10 have SQL, which tests/test_oracle.py runs; here are odd rows.

def test_license_places(spark):
    rows = [(1, "CC BY cc-by ... cc by"), (2, None), (3, ""), (4, "all rights reserved All Rights. Reserved"),
            (5, "Released under the MIT License"), (6, "by cc rights all"), (7, "cc " * 5000 + "by")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, licenses.idf(docs)).toPandas().set_index("doc_id")
    assert got.n_base.tolist() == [3, 0, 0, 2, 0, 0, 1]
    assert got.n_words.tolist() == [6, 0, 0, 6, 5, 4, 5001]
    assert got.base_labels.tolist() == ["cc-by", "", "", "reserved", "", "", "cc-by"]
    assert got.labels[5] == "mit" and got.score.between(0, 1).all()
    assert (got.first_word[7], got.last_word[4]) == (4999, 3) and pd.isna(got.first_word[2])


def test_license_plan_has_no_python(spark, sf_dir):
    plan = queries.QUERIES["op4_licenses"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_top_k_evaluates_until_exact(spark):
    from pyspark.sql import functions as F
    rnd = np.random.default_rng(6)
    x = np.round(rnd.normal(size=(400, 8)), 2)
    x[100:160] = x[0]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = top_k.search(rows, F.col("vec_id") % 50 == 0).toPandas()
    q = np.floor(256 * x).astype(np.int64)
    for i in range(0, 400, 50):
        s = q @ q[i]
        want = sorted(((-s[j], j) for j in range(400) if j != i))[:5]
        mine = got[got.query_id == i].sort_values("rank")
        assert [(-a, b) for a, b in zip(mine.score, mine.vec_id)] == want


# Helpers

def test_join_beyond_the_broadcast_bound_gives_the_same_rows(spark):
    from panelspark.llm.common import BROADCAST_BYTES, join_small
    big = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(200)] + [(None, None)], "r long, k long")
    small = spark.createDataFrame([(k, k * k) for k in range(0, 100, 5)] + [(1, 7), (1, 8)], "k long, v long")
    for how in ("inner", "left_anti", "left_semi"):
        a, b = (sorted(map(str, join_small(big, small, "k", size, "r", how).collect())) for size in (1, BROADCAST_BYTES + 1))
        assert a == b and a


def test_bounded_sample_does_not_depend_on_partitions(spark):
    from panelspark.llm.common import bounded_sample
    rows = spark.range(5000).withColumnRenamed("id", "k")
    a, b = ({r[0] for r in bounded_sample(d, "k", 100).collect()} for d in (rows, rows.repartition(9)))
    assert a == b and len(a) == 100
    assert bounded_sample(rows.limit(0), "k", 100).count() == 0


# Odd tables

def test_odd_and_empty_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    from pyspark.sql import functions as F
    rows = [(1, "Hello world this is a test of the thing and more words here", "en", "s", 1), (None, "null id", "en", None, None),
            (2, None, None, None, None), (3, "", "en", "x", 0), (4, " \n ", "en", "x", 0), (5, "x" * 50_000, "fr", "y", 1),
            (1, "Hello world this is a test of the thing and more words here", "en", "s", 1), (8, "a b c", "de", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for c in ("score", "fp", "seeds", "id", "words", "component_id", "lang_pred", "ids", "item_id", "root", "y", "part"):
        docs = docs.withColumn(c, docs.n_chars)
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0), (8, 1), (None, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "hello world this is a test of the thing"), (2, "a b c"), (3, None), (4, ""), (2, "a b c")],
                                  "item_id long, text string").withColumn("words", F.lit(2))
    for d in (docs, docs.limit(0)):
        n = d.count()
        assert language.predict(d, language.fit(d)).count() == n
        assert simhash.classes(d).count() == n
        assert personal.find(d, personal.fit(d)).count() == n
        assert sentence_pieces.digests(d, MODEL).count() == n
        assert sentence_pieces.decode(sentence_pieces.encode(d, MODEL), MODEL).count() == n
        assert licenses.scan(d, licenses.idf(d)).count() == n
        for some in (labels, labels.limit(0)):
            assert toxicity.score(d, toxicity.fit(d, some)).count() == n
        assert token_files.digests(token_files.blocks(d, public_tokenizers.path("word_bpe_49k.json"), 2, 16)).count() == n
        assert decontaminate.overlaps(d, items.limit(0)).count() == 0
        pairs = {(r.id, r.item_id) for r in decontaminate.overlaps(d, items).collect()}
        assert pairs == ({(1, 1), (8, 2)} if n else set())
    got = {r.doc_id: r for r in simhash.classes(docs).collect()}
    assert got[2].component_id == got[3].component_id == got[4].component_id == 2 and got[1].component_id == 1
    kept = spark.createDataFrame(rows, schema)
    for name, fn in corpus_pipeline.STAGES:
        kept = fn(spark, kept, "/root/testdata/sf0.001")
        assert name == "sentence_pieces" or kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "8", "None"]


def test_odd_pages_and_vectors(spark):
    from pyspark.sql import functions as F
    pages = spark.createDataFrame([(1, "u", "<body><article><p>Hi there all of you.</p></article>"), (2, "u", None), (3, None, ""),
                                   (None, "x", "<p>open <b>x <script>"), (4, "u", "<div "), (5, "u", "<!-- never")],
                                  "page_id long, url string, html string").withColumn("text", F.lit(1))
    for p in (pages, pages.limit(0)):
        assert html_text.extract(p, html_text.fit(p)).count() == p.count()
    vectors = spark.createDataFrame(
        [(0, [1.0, 2.0]), (50, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [0.5]), (4, []), (100, [1.0, 2.0]),
         (100, [1.0, 2.0]), (None, [1.0]), (7, [float("inf")])], "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.search(vectors, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 100, 327_680), (0, 2, 100, 327_680), (0, 3, 3, 32_768), (0, 4, 4, 0),
                   (100, 1, 0, 327_680), (100, 2, 3, 32_768), (100, 3, 4, 0)]
    assert top_k.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# Pipeline

def test_pipeline_against_brute_force(spark, sf_dir, texts):
    got = corpus_pipeline.run(spark, sf_dir).toPandas().set_index("doc_id")
    ids = sorted(i for i, t in texts.items() if any(c.isalpha() for c in t))
    fps = np.array([simhash.fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    root = union_find(len(ids), near.tolist())
    kept = [i for k, i in enumerate(ids) if root[k] == k]
    items = [words(r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seeds = {tuple(item[k:k + 5]): j for j, item in enumerate(items) for k in range(len(item) - 4)}
    clean = []
    for i in kept:
        doc = words(texts[i])
        hits = {seeds[g] for k in range(len(doc) - 4) if (g := tuple(doc[k:k + 5])) in seeds}
        if not any(plain_cover(doc, items[j]) >= 0.5 * len(items[j]) for j in hits):
            clean.append(i)
    assert sorted(got.index) == clean
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i in clean:
        t, out, end = texts[i], [], 0
        for a, k, b in plain_spans(t):
            if a >= end:
                out += [t[end:a], f"<{personal.KINDS[k]}>"]
            end = max(end, b)
        want = sp.encode("".join([*out, t[end:]])) + [2]
        assert list(got.ids[i]) == want and got.n_tokens[i] == len(want)
