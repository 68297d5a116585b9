"""BPE encoding and decoding through a distinct-word table.

The tokenizer's file is JSON of the `tokenizers` library: NFC, lower case, a
regular expression that cuts words, byte-level BPE with word ends.  A word's ids
do not depend on its neighbours, so:

1. texts are split to words once, to chunks of a task: the chunk's distinct words and
   the texts as numbers of these, packed (one row for each chunk, with the other
   columns of its documents);
2. the distinct-word table is hash-partitioned by word.  A chunk sends each partition
   its distinct words; there each distinct word of the corpus is encoded once, and its
   ids go back to the chunks in the order in which they asked.  So a word of every text
   is one short row for each chunk, and partitions are as many as the words ask for;
3. ids are joined back by chunk, and within it to each position by the word's number;
4. decoding joins ids to the pieces of the vocabulary (a fixed size, broadcast) and puts
   a blank between pieces, as the library does for a file without a decoder.

Rows: null text is the empty text, with no ids.  The strings of special tokens
inside a text become those tokens.  Repeated rows and null ids are encoded like
any other; a text of any length is processed whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .packing import groups, pack, pack_codes, rows_of, unpack, unpack_codes


@dataclass(frozen=True)
class Params:
    tokenizer: str = ""  #: path of the tokenizer's JSON file, read on the driver
    chunk_words: int = 1 << 19  #: words of a chunk, about; larger ones need less disk and more memory
    part_words: int = 1 << 17  #: words that a partition of the table is asked for, about


#: Below this code point Python's NFC, lower-casing and letter classes are those of the library.
_PLAIN = 0x250
#: White space among them.
_BLANK = r"\t-\r \x85\xa0"


def _class(test) -> str:
    """The code points below `_PLAIN` that pass, as the inside of a character class."""
    return "".join(re.escape(chr(i)) for i in range(_PLAIN) if test(unicodedata.category(chr(i))))


class Words:
    """Cuts texts into the tokenizer's words and encodes words, caching each."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        letters, digits = _class(lambda c: c[0] == "L"), _class(lambda c: c[0] == "N")
        self.plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_BLANK}{letters}{digits}]+")
        self.beyond = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special tokens by turns."""
        return self.cut.split(text) if any(x in text for x in self.special) else [text]

    def split(self, segment: str) -> list[str]:
        """The normalised words of ordinary text."""
        if self.beyond.search(segment):
            text = self.tok.normalizer.normalize_str(segment)
            found, pos = [], 0
            for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
                found.append(word)
                pos += 1
            return [_unbyte(w) for w in found]
        return self.plain.findall(unicodedata.normalize("NFC", segment).lower())

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token is itself with a NUL before it."""
        parts = self.segments(text)
        if len(parts) == 1:
            return self.split(parts[0])
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)
            else:
                out += self.split(part)
        return out

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        is_plain = [w[0] != "\0" or w[1:] not in self.special for w in words]
        plain, step = [w for w, ok in zip(words, is_plain, strict=True) if ok], 4096  # the library's results are large
        coded = (e.ids for k in range(0, len(plain), step) for e in self.tok.encode_batch(plain[k : k + step], add_special_tokens=False))
        ids, size = array("q"), np.zeros(len(words), np.int64)
        for k, w in enumerate(words):
            got = next(coded) if is_plain[k] else [self.special[w[1:]]]
            ids.extend(got)
            size[k] = len(got)
        return np.frombuffer(ids, np.int64) if len(ids) else np.zeros(0, np.int64), size

    def pieces(self) -> dict[int, str]:
        """The id-to-piece table."""
        return {i: piece for piece, i in self.tok.get_vocab(with_added_tokens=True).items()}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 stands for itself, the rest follow from 256 upwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_OF = {c: b for b, c in _byte_letters().items()}


def _unbyte(piece: str) -> str:
    return bytes(_BYTE_OF[c] for c in piece).decode("utf-8")


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


_CHUNK = [("chunk", pa.int64()), ("sizes", pa.binary()), ("codes", pa.binary()), ("slice", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64())]
_CHUNK_DDL = "chunk long, sizes binary, codes binary, slice binary, words binary, n_words long"
_ASK = [("part", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary())]
_ASK_DDL = "part long, chunk long, words binary"
_TOLD = [("chunk", pa.int64()), ("part", pa.int64()), ("numbers", pa.binary()), ("ids", pa.binary())]
_TOLD_DDL = "chunk long, part long, numbers binary, ids binary"


def _packed(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    sizes = pack(np.array([len(w) for w in raw], np.uint64))
    return len(sizes).to_bytes(8, "big") + sizes + zstandard.ZstdCompressor(level=6).compress(b"".join(raw))


def _unpacked(blob: bytes) -> list[str]:
    cut = 8 + int.from_bytes(blob[:8], "big")
    ends = np.cumsum(unpack(blob[8:cut])).tolist()
    raw = zstandard.ZstdDecompressor().decompress(blob[cut:])
    return [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _split(batches: Iterator[pa.RecordBatch], spec, rest: list[str], p: Params) -> Iterator[pa.RecordBatch]:
    """Chunks; `rest` are the other columns of their documents."""
    from pyspark import TaskContext

    words, at = Words(spec.value), TaskContext.get().partitionId() << 32
    numbers, texts, held, total = _Numbers(), [], [], 0

    def out() -> pa.RecordBatch:
        found = list(numbers)
        codes = np.concatenate(texts)
        # small numbers for frequent words
        order = np.argsort(-np.bincount(codes, minlength=len(found)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        found = [found[k] for k in order.tolist()]
        part = np.fromiter((xxhash.xxh3_64_intdigest(w) >> 48 for w in found), np.uint64, len(found))
        own = pa.Table.from_batches(held).combine_chunks().to_batches()
        own = pa.StructArray.from_arrays(own[0].columns, names=rest) if rest else pa.nulls(len(texts))
        own = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), own)
        row = rows_of([(at, pack(np.array([len(t) for t in texts])), pack_codes(place[codes]), pack(part), _packed(found), len(found))], _CHUNK)
        return pa.RecordBatch.from_arrays([*row.columns, own], names=[*row.schema.names, "rest"])

    for batch in common.slices(batches, "text"):
        for text in batch.column("text"):
            found = words.words(text.as_py() or "")
            texts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
            total += len(found)
        held.append(batch.select(rest))
        if total >= p.chunk_words:
            yield out()
            at, total = at + 1, 0
            numbers, texts, held = _Numbers(), [], []
    if texts:
        yield out()


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = _unpacked(row["words"])
            for k, at in groups(unpack(row["slice"]).astype(np.int64) % parts):
                yield rows_of([(k, row["chunk"], _packed([found[i] for i in at.tolist()]))], _ASK)


def _encode(table: pa.Table, spec) -> pa.Table:
    """The ids of the words asked for; each distinct word is encoded once."""
    asked, numbers = table.to_pylist(), _Numbers()
    codes = []
    for row in asked:
        found = _unpacked(row["words"])
        codes.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
    ids, size = Words(spec.value).encode(list(numbers))
    start = np.cumsum(size) - size
    out = []
    for row, code in zip(asked, codes, strict=True):
        n = size[code]
        at = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((row["chunk"], row["part"], pack(n), pack(ids[at])))
    return pa.Table.from_batches([rows_of(out, _TOLD)])


def _join(batches: Iterator[pa.RecordBatch], sent, parts: int, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents with their ids, from the chunks and what they were told."""
    piece = sent.value
    common.give_back()
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.select(["sizes", "codes", "slice", "told"]).slice(at, 1).to_pylist()[0]
            told, part = {x["part"]: x for x in row["told"] or []}, unpack(row["slice"]).astype(np.int64) % parts
            ids, decoded, number = ([None] * len(part) for _ in range(3))
            for k, place in groups(part):
                n, found = unpack(told[k]["numbers"]).tolist(), unpack(told[k]["ids"]).tolist()
                end = 0
                for i, size in zip(place.tolist(), n, strict=True):
                    own = found[end : end + size]
                    end += size
                    number[i], ids[i], decoded[i] = size, " ".join(map(str, own)), " ".join([piece[x] for x in own])
            codes, sizes = unpack_codes(row["codes"]), unpack(row["sizes"]).astype(np.int64)
            number = np.array(number, np.int64)
            silent = len(number) and number.min() == 0  # words without ids, such as an empty piece
            ends, totals, shas, texts = np.cumsum(sizes).tolist(), [], [], []
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                code = codes[a:b]
                code = code[number[code] > 0] if silent else code
                totals.append(int(number[code].sum()))
                code = code.tolist()
                both = [" ".join([x[c] for c in code]) for x in (ids, decoded)]
                shas.append([hashlib.sha256(x.encode()).hexdigest() for x in both])
                if with_ids:
                    texts.append(both)
            rest = batch.column("rest").slice(at, 1).flatten()
            columns = rest.flatten() if pa.types.is_struct(rest.type) else []
            columns += [pa.array(totals, pa.int64()), *(pa.array([x[k] for x in shas], pa.string()) for k in (0, 1))]
            if with_ids:
                columns += [pa.array([x[k] for x in texts], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, p: Params, with_ids: bool = False) -> DataFrame:
    """All columns of `docs` but text, with n_tokens, ids_sha256, decoded_sha256, and
    with `with_ids` also ids (decimal, joined by blanks) and decoded."""
    with open(p.tokenizer, encoding="utf-8") as f:
        spec = f.read()
    context = docs.sparkSession.sparkContext
    sent, pieces = context.broadcast(spec), context.broadcast(Words(spec).pieces())
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, *(T.StructField(c, T.LongType() if c == "n_tokens" else T.StringType()) for c in new)])
    chunk = T.StructType.fromDDL(_CHUNK_DDL).add("rest", T.ArrayType(T.StructType(rest) if rest else T.StringType()))
    own = [f.name for f in rest]

    docs = docs.withColumn("text", F.col("text").cast("string"))
    chunks = common.stored(docs.mapInArrow(lambda b: _split(b, sent, own, p), chunk), "chunks")
    parts = min(1 << 16, (chunks.agg(F.sum("n_words")).first()[0] or 0) // p.part_words + 1)
    asked = chunks.select("chunk", "slice", "words").mapInArrow(lambda b: _ask(b, parts), _ASK_DDL)
    told = common.stored(asked.groupBy("part").applyInArrow(lambda t: _encode(t, sent), _TOLD_DDL), "ids")
    common.release(docs.sparkSession)
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("part", "numbers", "ids")).alias("told"))
    full = chunks.drop("words", "n_words").join(told, "chunk", "left")
    return full.mapInArrow(lambda b: _join(b, pieces, parts, schema.names, with_ids), schema)


def production(**changes) -> Params:
    import public_tokenizers

    return Params(tokenizer=str(public_tokenizers.path("word_bpe_49k.json")), **changes)


def op7_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every text of `documents`, as digests."""
    return encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), production(chunk_words=1 << 22))
