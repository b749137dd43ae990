"""Packing: concatenate all documents and cut the stream into sequences of fixed length.

Pass 1 tokenises every document once and notes its offset inside its task, which is written to the
checkpoint folder with the ids.  The token totals of the tasks (one number per task) are summed up to
the offset of each task in the whole stream.  Pass 2 adds both offsets and cuts each document at
multiples of the sequence length; a document that crosses a boundary gives one piece per sequence.
Only the last sequence of the stream is not full.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.session import cut_lineage

SEQUENCE = 1024
END_OF_DOCUMENT = 0
# Characters of texts that are cut into pre-tokens at a time, about; a longer text is a group of its own.
GROUP_CHARS = 1 << 23
# Bytes of a worker process's memory of pre-tokens and their ids; beyond, it keeps those of the last group.
MEMORY_BYTES = 1 << 25
# Pre-tokens that go to the tokenizer as one text.
TOGETHER = 10_000

# Texts with characters outside these go to the tokenizer whole.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡§«»¿-ſ‐-‧]")

# Classes of the pre-tokenizer's pattern: letters, digits, white space, the rest, and the end of a text.
_LETTER, _DIGIT, _SPACE, _OTHER, _END = range(5)
# No byte of UTF-8.
_END_BYTE = b"\xff"


def _classes_of_bytes() -> np.ndarray:
    """Class of each byte; of U+0080 and above that of letters, but for the first bytes of U+0080 to U+00BF and of U+2000."""
    table = np.full(256, _OTHER, dtype=np.uint8)
    for low, high, of in (("0", "9", _DIGIT), ("A", "Z", _LETTER), ("a", "z", _LETTER), ("\x80", "\xff", _LETTER)):
        table[ord(low):ord(high) + 1] = of
    table[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
    table[[0xC2, 0xE2]] = _OTHER
    table[_END_BYTE[0]] = _END
    return table


_CLASS = _classes_of_bytes()


def pre_token_starts(data: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the bytes of texts of usual characters that end in ``_END_BYTE`` each.

    As the pattern of byte-level tokenizers has it: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    kind = _CLASS[data]
    for first, more in ((0xC2, 1), (0xE2, 2)):
        at = np.flatnonzero(data == first)
        for k in range(1, more + 1):
            kind[at + k] = _OTHER
    at = np.flatnonzero(data == 0xC3)
    at = at[(data[at + 1] | 0x20) == 0xB7]  # the signs of multiplication and division
    kind[at] = kind[at + 1] = _OTHER

    begins = np.ones(len(data), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    # The last space before a word belongs to it; other white space there stands alone.
    after = np.flatnonzero(begins[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _END)) + 1
    begins[after - 1] = True
    begins[after] = data[after - 1] != 0x20
    # A text's end is a pre-token of its own, next to another one (of an empty text) too.
    begins |= kind == _END
    # Contractions: an apostrophe that begins a pre-token takes one or two letters along.
    at = np.flatnonzero((data == 0x27) & begins)
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    begins[at[short | long] + 1] = False
    begins[at[short] + 2] = True
    begins[at[long] + 3] = True
    return np.flatnonzero(begins)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer file, from the package that ships them."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, as unsigned 16- or 32-bit little-endian bytes.

    Byte-level BPE never merges across pre-tokens, so many texts are cut into pre-tokens at once, Arrow numbers the
    distinct ones, and those that are new go to the tokenizer and are remembered.  Texts with unusual characters go
    to the tokenizer whole.  The strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = (np.dtype("<u2"), "H") if small else (np.dtype("<u4"), "I")
        line = self._encode(["\n"])[0]
        self.line = line if len(line) == self.kind.itemsize else None
        self._forget()

    def _forget(self) -> None:
        """The end of a text is number 0 among the known pre-tokens and has no ids."""
        self.known = pa.array([_END_BYTE], pa.large_binary())
        self.ids = pa.array([b""], pa.large_binary())

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _encode_new(self, pieces: list[bytes]) -> pa.Array:
        """Ids of pre-tokens, from many of them in one text: only those of white space alone hold a line end."""
        found: list[bytes | None] = [None] * len(pieces)
        together = [k for k, p in enumerate(pieces) if not p.isspace()] if self.line else []
        for at in range(0, len(together), TOGETHER):
            some = together[at:at + TOGETHER]
            ids = np.frombuffer(self._encode([b"".join([pieces[k] + b"\n" for k in some]).decode()])[0], self.kind)
            ends = np.flatnonzero(ids == np.frombuffer(self.line, self.kind))
            if len(ends) == len(some):
                raw, size, begin = ids.tobytes(), self.kind.itemsize, 0
                for k, end in zip(some, ends.tolist()):
                    found[k] = raw[begin * size:end * size]
                    begin = end + 1
        alone = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(alone, self._encode([pieces[k].decode() for k in alone])):
            found[k] = x
        return pa.array(found, pa.large_binary())

    def _encode_usual(self, texts: list[str]) -> list[bytes]:
        data = np.frombuffer(_END_BYTE.join([t.encode() for t in texts]) + _END_BYTE, dtype=np.uint8)
        starts = pre_token_starts(data)
        bounds = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        numbered = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        numbers = numbered.indices.to_numpy()[len(self.known):]
        new = numbered.dictionary[len(self.known):]
        if len(new):
            self.known, self.ids = numbered.dictionary, pa.concat_arrays([self.ids, self._encode_new(new.to_pylist())])
        found = self.ids.take(pa.array(numbers))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset:][1:len(found) + 1][numbers == 0].tolist()
        raw = found.buffers()[2]
        if self.known.nbytes + self.ids.nbytes > MEMORY_BYTES:
            used = pa.array(np.bincount(numbers, minlength=len(self.known)) > 0)
            self.known, self.ids = self.known.filter(used), self.ids.filter(used)
            if self.known.nbytes + self.ids.nbytes > MEMORY_BYTES:
                self._forget()
        return [raw[b:e].to_pybytes() for b, e in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        found: list[bytes] = [b""] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if _UNUSUAL.search(text):
                found[k] = self._encode([text])[0]
            elif text:
                group.append(k)
                size += len(text)
            if group and (size >= GROUP_CHARS or k == len(texts) - 1):
                for i, ids in zip(group, self._encode_usual([texts[i] for i in group])):
                    found[i] = ids
                group, size = [], 0
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: later tasks find its memory filled."""
    return Encoder(path)


_TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType()),
    T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

_PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType())])


def tokenized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (with the end id), their number, and the place in the stream: task and offset in it.

    Ids are bytes of two each if the vocabulary fits, else four.  Null text is an empty document.
    """
    path = path or vocabulary_file()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at, part = encoder_of(path), 0, TaskContext.get().partitionId()
        end = np.array([END_OF_DOCUMENT], dtype=encoder.kind).tobytes()
        for batch in batches:
            ids = [x + end for x in encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) // encoder.kind.itemsize for x in ids], dtype=np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(n),
                 pa.array(np.full(len(n), part, np.int32)), pa.array(start)], _TOKENS.names)

    return documents.select("doc_id", "text").mapInArrow(encode, _TOKENS)


def pack(documents: DataFrame, length: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """One row per piece of a document in a sequence of ``length`` tokens.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens (ids of the document with the end id), sequence_id, offset (in
    the sequence) and ids (bytes, see :func:`tokenized`).  Each id lies in exactly one piece, the pieces of a
    sequence fill it from 0 without gaps, and all sequences but the last are full.

    ``documents`` has doc_id and text; other columns are not read.  Null and empty texts are one end id;
    repeated rows are packed as often as they come; an empty table gives no piece.

    Runs a job: tokens are written once to the checkpoint folder, so a lost executor cannot change the
    order.  The driver holds one total per task of that job.
    """
    tokens = cut_lineage(tokenized(documents, path))
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n")).collect()
    offsets, total = {}, 0
    for row in sorted(totals):
        offsets[row["part"]] = total
        total += row["n"]
    shared = documents.sparkSession.sparkContext.broadcast(offsets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            base = np.array([shared.value[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
            first = base + batch.column("at").to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[doc] // length + number
            begin = np.maximum(sequence * length, first[doc])
            end = np.minimum((sequence + 1) * length, first[doc] + n[doc])
            start, size = begin - first[doc], end - begin
            column = batch.column("ids")
            ids, crc, last, values = [], [], -1, None
            for d, s, c in zip(doc.tolist(), start.tolist(), size.tolist()):
                if d != last:
                    raw = column[d].as_py()
                    values, last = np.frombuffer(raw, dtype=f"<u{len(raw) // int(n[d])}"), d
                part = values[s:s + c]
                ids.append(part.tobytes())
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                 pa.array(n[doc]), pa.array(sequence), pa.array(begin - sequence * length), pa.array(ids, pa.binary())],
                _PIECE.names)

    return tokens.mapInArrow(cut, _PIECE)
