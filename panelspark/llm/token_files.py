"""Token-id files: documents as ids in ascending order of their id, in range-coded blocks.

Format: a folder of Parquet files whose rows are blocks. `part` numbers the ranges of document ids in
ascending order, `block` the blocks of a part. `payload` holds BLOCK_IDS ids (the last block of a
part fewer), coded on their own by `range_coder`; `checksum` is the crc32 of the ids as little-endian
unsigned 32-bit integers and is verified on reading. `doc_ids`, `ordinals` and `sizes` list the pieces
of documents in the block: the document's id, its number in the part, how many of its ids are here.
A block is read without any other, so reading is as parallel as there are blocks.

Texts are cut at spaces and line breaks, where the tokenizer never joins, and units of plain letters, digits
and signs on into its words. The library encodes each distinct word once per worker, in a cache of bounded size.

Defined results: null is read as empty, which is the end id alone; documents with equal ids stand
side by side in the order of their texts, a null id stands first; repeated rows are documents of
their own; an empty table gives an empty folder of the same schema; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import range_coder
from panelspark.llm.common import join_small, pieces

BLOCK_IDS = 1_024
GROUP_BLOCKS = 4_096
CACHE_UNITS = 400_000
CACHE_CHARS = 1 << 24
LONG_UNIT = 64

_POLY = 0xEDB88320


_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_GAP, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte of UTF-8, and what it becomes in a lower-cased plain unit."""
    kind, lower = np.full(256, _ODD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = _SIGN
    kind[[ord("'"), ord("<")]] = _ODD  # contractions, special tokens
    kind[ord("0"):ord("9") + 1] = _DIGIT
    kind[ord("a"):ord("z") + 1] = kind[ord("A"):ord("Z") + 1] = _LETTER
    kind[0xC3] = kind[0x80:0xC0] = _LETTER  # from À to ÿ
    kind[[ord(" "), ord("\n")]] = _GAP
    lower[ord("A"):ord("Z") + 1] += 32
    lower[0x80:0x9F] += 32
    return kind, lower


_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
_KIND, _LOWER = (a.tobytes() for a in _byte_kinds())
_UNITS = bytes(_GAP if b in b" \n" else _ODD for b in range(256))


def cut(texts: pa.Array, plain: bool) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in a row, and the place after the last word of each text.

    Units are cut at spaces and line breaks. A plain unit, of letters from A to ÿ, digits and most signs of ASCII,
    is lower-cased and cut on into runs of letters, single digits and runs of signs. Others stay as they are.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()  # of a slice: the whole array's
    edges = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    edges = edges - edges[0] if len(edges) else np.zeros(1, np.int64)
    n = len(raw)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    whole = raw.tobytes()
    kind = np.frombuffer(bytearray(whole.translate(_KIND if plain else _UNITS)), np.uint8)
    sign = np.flatnonzero((raw == 0x97) | (raw == 0xB7))  # × and ÷ after the byte of the letters
    kind[sign[raw[sign - 1] == 0xC3]] = _ODD
    first = np.zeros(n + 1, dtype=bool)
    first[edges] = True
    full = kind != _GAP
    change = np.empty(n, dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == _DIGIT
    change |= first[:n]
    change &= full
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        begins = full.copy()  # of units
        begins[1:] &= ~full[:-1] | first[1:n]
        at = np.flatnonzero(begins)
        which = np.unique(np.searchsorted(at, odd, "right") - 1)
        mark = np.zeros(n + 1, dtype=np.int8)
        mark[at[which]] += 1
        mark[np.append(at, n)[which + 1]] -= 1  # the next unit: gaps before it don't count
        inside = np.cumsum(mark[:n], dtype=np.int8).view(bool)
        change = np.where(inside, begins, change)
        lower = np.frombuffer(whole.translate(_LOWER), np.uint8)
        words = np.where(inside, raw, lower).tobytes().translate(None, b" \n")
    else:
        words = whole.translate(_LOWER, b" \n")
    ends = np.append(np.flatnonzero(change[full]), len(words)).astype(np.int32)
    return (pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(words)]),
            np.searchsorted(np.flatnonzero(change), edges[1:]))


class Units(dict):
    """The number of each known word of `cut`; number k has `length[k]` ids from `start[k]` in `flat`.

    The library encodes new words of letters side by side in one text, where just the last id of a word ends
    it, and other words one by one. For a file that does not cut and lower-case as `cut` does, words are whole units.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers  # reads the setting when it is first used
        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            made = json.load(f)
        suffix = made["model"].get("end_of_word_suffix")
        steps = [n.get("type") for n in (made["normalizer"] or {}).get("normalizers", [])]
        cuts = [(c.get("pattern"), c.get("use_regex")) for c in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.splits = (steps == ["NFC", "Replace", "Lowercase"] and cuts == [({"Regex": _CUT}, None), (None, False)]
                       and made["post_processor"] is None and made["model"]["type"] == "BPE" and bool(suffix)
                       and not made["model"].get("dropout") and all("<" in t["content"] for t in made["added_tokens"]))
        if self.splits:
            self.words = Tokenizer.from_file(tokenizer_file)
            self.words.normalizer = None  # words are normal already
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            shown = {b: level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)}
            self.shown = [(chr(b), c) for b, c in shown.items() if chr(b) != c and b >= 0x9F]
            self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
            self.ends[[k for t, k in made["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.new: list[str] = []
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.flat, self.filled = np.empty(1 << 16, dtype=np.uint32), 0
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self.chars = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = k = len(self)
        self.new.append(unit)
        return k

    def add(self, ids: list[list[int]], keys: list) -> None:
        self.update(zip(keys, range(len(self), len(self) + len(keys))))
        self._room()
        self._store([self[k] for k in keys], np.array([len(x) for x in ids]), np.array([i for x in ids for i in x]))

    def _room(self) -> None:
        if len(self) > len(self.start):
            more = np.zeros(len(self) + (1 << 16), np.int64)
            self.start, self.length, self.uses = (np.append(a, more) for a in (self.start, self.length, self.uses))

    def _store(self, numbers: list[int] | np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        upto = np.cumsum(lengths)
        self.start[numbers], self.length[numbers] = self.filled + upto - lengths, lengths
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.empty(len(self.flat) + len(ids), np.uint32))
        self.flat[self.filled:self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in a row, and the place after each."""
        lengths = self.length.take(numbers)
        upto = np.cumsum(lengths)
        at = np.repeat(self.start.take(numbers) - (upto - lengths), lengths)
        at += np.arange(len(at))
        return self.flat.take(at), upto

    def _ask(self, asked: list[str]) -> None:
        """Units as they are, each by itself."""
        for k in range(0, len(asked), 4096):
            some = asked[k:k + 4096]
            ids = [e.ids for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
            self._store([self[u] for u in some], np.array([len(x) for x in ids]), np.array([i for x in ids for i in x]))

    def _shown(self, row: str) -> str:
        """Lower-case letters from a to ÿ as the letters that the tokenizer has for their bytes."""
        if not row.isascii():
            row = row.encode().decode("latin-1")
            for byte, letter in self.shown:
                row = row.replace(byte, letter)
        return row

    def _ask_words(self, asked: list[str]) -> None:
        rows = [self._shown(" ".join(asked[k:k + 64])) for k in range(0, len(asked), 64)]
        ids = np.array([i for e in self.words.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids], dtype=np.int64)
        ends = np.flatnonzero(self.ends.take(ids)) + 1
        if len(ends) != len(asked):
            raise ValueError(f"{len(asked)} words, {len(ends)} ends of words")
        self._store([self[u] for u in asked], np.diff(ends, prepend=0), ids)

    def learn(self) -> None:
        """Find the ids of the new words."""
        words, self.new = self.new, []
        self.chars += sum(map(len, words))
        self._room()
        letters, others = [], words
        if self.splits:
            letters, others = [], []
            for w in words:
                (letters if _WORD(w) else others).append(w)
        if letters:
            self._ask_words(letters)
        if others:
            self._ask(others)

    def forget(self) -> None:
        """Keep the words of more than one batch, at most half as many as the cache holds."""
        uses, keys = self.uses[:len(self)], list(self)
        kept = np.flatnonzero(uses > 1)
        kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[:CACHE_UNITS // 2]])
        kept = kept[np.array([len(keys[k]) <= LONG_UNIT for k in kept.tolist()], dtype=bool)]
        lengths, (ids, _) = self.length[kept], self._ids(kept)
        names = [keys[k] for k in kept.tolist()]
        self.clear()
        self.update(zip(names, range(len(self), len(self) + len(names))))
        self._room()
        self._store(np.arange(len(self) - len(names), len(self)), lengths, ids)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, an end id after each, in a row, and the number of ids of each text."""
        if len(self) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.forget()
        if end_id not in self:  # a key that no text has
            self.add([[end_id]], [end_id])
        words, ends = cut(texts, self.splits)
        coded = words.dictionary_encode()
        numbers = np.fromiter(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        if self.new:
            self.learn()
        self.uses[numbers] += 1
        numbers = np.insert(numbers.take(coded.indices.to_numpy()), ends, self[end_id])
        ids, upto = self._ids(numbers)
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


@cache
def units(tokenizer_file: str) -> Units:
    return Units(tokenizer_file)


_BLOCKS = ("part int, block long, n_ids int, id_bits int, payload binary, checksum long, "
           "doc_ids array<long>, ordinals array<long>, sizes array<int>")
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int32()), ("id_bits", pa.int32()),
                    ("payload", pa.binary()), ("checksum", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("ordinals", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def blocks(docs: DataFrame, tokenizer_file: str, end_id: int, id_bits: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The rows of the files: documents sorted by id, encoded, cut into blocks and coded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = TaskContext.get().partitionId(), units(tokenizer_file)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # ids of documents, numbers of their ids, their ids
        size = ordinal = block = 0

        def cut_blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, ordinal, block
            if not size:
                return
            docs, sizes = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            take = size if last else size // BLOCK_IDS * BLOCK_IDS
            edges = np.arange(0, take, BLOCK_IDS)
            parts = [ids[k:min(k + BLOCK_IDS, take)] for k in edges.tolist()]
            upto = np.cumsum(sizes)
            begin = np.unique(np.concatenate([edges, (upto - sizes)[upto - sizes < take]]))
            doc = np.searchsorted(upto, begin, "right")
            rows = pa.array(np.append(np.searchsorted(begin, edges), len(begin)), pa.int32())
            n = len(edges)
            columns = [np.full(n, part), block + np.arange(n), [len(p) for p in parts], np.full(n, id_bits),
                       range_coder.encode(parts, id_bits), [zlib.crc32(p.astype("<u4", copy=False)) for p in parts]]
            lists = [docs.take(pa.array(doc)), pa.array(ordinal + doc, pa.int64()),
                     pa.array(np.diff(np.append(begin, take)), pa.int32())]
            block += n
            done = int(np.searchsorted(upto, take, "right"))
            ordinal += done
            left = sizes[done:].copy()
            if len(left):
                left[0] = upto[done] - take
            held, size = [(docs[done:], left, ids[take:].copy())], size - take
            yield from pa.Table.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _ARROW)),
                                             *(pa.ListArray.from_arrays(rows, v) for v in lists)], schema=_ARROW).to_batches(1024)

        for batch in batches:
            for piece in pieces(batch, 1024, text_col, 4 << 20):
                ids, sizes = known.encode(piece.column(text_col), end_id)
                held.append((piece.column(id_col), sizes, ids))
                size += len(ids)
                if size >= BLOCK_IDS * GROUP_BLOCKS:
                    yield from cut_blocks(False)
        yield from cut_blocks(True)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return rows.repartitionByRange(id_col).sortWithinPartitions(id_col, text_col).mapInArrow(run, _BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_bits: int = 16, id_col: str = "doc_id",
          text_col: str = "text") -> None:
    blocks(docs, tokenizer_file, end_id, id_bits, id_col, text_col).write.parquet(path)


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the blocks in a row, the edges of the pieces of documents in them, and the block of each piece."""
    columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "n_ids", "id_bits", "checksum")}
    payloads, sizes = batch.column("payload").to_pylist(), columns["n_ids"].tolist()
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(payloads)
    for bits in np.unique(columns["id_bits"]).tolist():
        mine = np.flatnonzero(columns["id_bits"] == bits).tolist()
        for k, ids in zip(mine, range_coder.decode([payloads[k] for k in mine], [sizes[k] for k in mine], bits)):
            found[k] = ids
    ids = np.concatenate([np.empty(0, np.int32), *found]).astype("<u4", copy=False)
    at = 0
    for k, (n, checksum) in enumerate(zip(sizes, columns["checksum"].tolist())):
        if zlib.crc32(ids[at:at + n]) != checksum:
            raise ValueError(f"block {columns['block'][k]} of part {columns['part'][k]} is damaged")
        at += n
    pieces_of = np.diff(batch.column("sizes").offsets.to_numpy())
    return ids, np.append(0, np.cumsum(batch.column("sizes").flatten().to_numpy())), np.repeat(np.arange(len(sizes)), pieces_of)


@cache
def _longer(power: int) -> np.ndarray:
    """What 2^power zero bytes more make of a crc32 register, by each of its four bytes."""
    if power:
        half = _longer(power - 1)
        return np.stack([_moved(row, half) for row in half])
    table = np.arange(256, dtype=np.uint32)
    out = [table << np.uint32(8 * k) for k in range(4)]
    for _ in range(8):
        out = [(r >> np.uint32(1)) ^ (r & np.uint32(1)) * np.uint32(_POLY) for r in out]
    return np.stack(out)


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0].take(crc & np.uint32(255))
    for k in (1, 2, 3):
        out = out ^ table[k].take((crc >> np.uint32(8 * k)) & np.uint32(255))
    return out


def _joined(crc: np.ndarray, length: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """crc32 of concatenations of parts in a row, each from its first part, by the parts' crc32 and length in bytes."""
    upto = np.cumsum(length)
    after = np.repeat(np.append(upto[begin[1:] - 1], upto[-1]), np.diff(np.append(begin, len(crc)))) - upto
    crc = crc.astype(np.uint32)
    for power in range(int(after.max()).bit_length()):
        at = np.flatnonzero(after >> power & 1)
        crc[at] = _moved(crc[at], _longer(power))
    return np.bitwise_xor.reduceat(crc, begin)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from each part's crc32 and length in bytes, in order."""
    if not parts:
        return 0
    crc, length = (np.array(x, dtype=np.int64) for x in zip(*parts))
    return int(_joined(crc, length, np.zeros(1, np.int64))[0])


def read(files: DataFrame) -> DataFrame:
    """(part, block, at, doc_id, ordinal, ids): the pieces of documents in the blocks, ids decoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, GROUP_BLOCKS):
                ids, edges, of = _decoded(piece)
                block = pa.array(of)
                offset = np.append(0, np.cumsum(piece.column("n_ids").to_numpy()))[of]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("part").take(block), piece.column("block").take(block),
                     pa.array(edges[:-1] - offset, pa.int32()), piece.column("doc_ids").flatten(),
                     piece.column("ordinals").flatten(),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int64()))],
                    names=["part", "block", "at", "doc_id", "ordinal", "ids"])
    return files.mapInArrow(run, "part int, block long, at int, doc_id long, ordinal long, ids array<long>")


def _sums(files: DataFrame) -> DataFrame:
    """(part, ordinal, doc_id, first, crc, n) of the pieces; `first` is the place in the part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, GROUP_BLOCKS):
                ids, edges, of = _decoded(piece)
                upto = np.cumsum(piece.column("n_ids").to_numpy(), dtype=np.int64)
                before = upto - piece.column("n_ids").to_numpy()
                first = piece.column("block").to_numpy()[of] * BLOCK_IDS + edges[:-1] - before[of]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("part").take(pa.array(of)), piece.column("ordinals").flatten(),
                     piece.column("doc_ids").flatten(), pa.array(first), pa.array(crc, pa.int64()),
                     pa.array(np.diff(edges), pa.int64())],
                    names=["part", "ordinal", "doc_id", "first", "crc", "n"])
    return files.mapInArrow(run, "part int, ordinal long, doc_id long, first long, crc long, n long")


def digests(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    Checksums of a document's pieces are joined; a document's pieces are few numbers per BLOCK_IDS ids.
    """
    found = _sums(files).groupBy("part", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("first", "crc", "n"))).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("pieces")
            crc, n = (found.flatten().field(c).to_numpy() for c in ("crc", "n"))
            begin = found.offsets.to_numpy()[:-1]
            crc = _joined(crc, 4 * n, begin - begin[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "first", "n_tokens")),
                                              pa.array(crc, pa.int64())],
                                             names=["part", "doc_id", "first", "n_tokens", "ids_crc32"])
    whole = found.mapInArrow(run, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    parts = totals.count()
    return join_small(whole, offset, "part", 16 * parts, "first").select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
