"""Alignment of two tokenizers over the same texts, and the token pairs that belong together corpus-wide.

A text's tokens by tokenizer A and by tokenizer B both cut its bytes.  Pass 1 encodes texts, flattens the
token lists of many of them into Arrow columns, turns byte lengths into end offsets by a segmented cumulative
sum, and joins both sides on (text, end) in Acero: an end of both sides closes a group, every end is one
linked pair of occurrences.  It writes the ids and one step byte per link.  Pass 2 counts id pairs per task
(``Table.group_by``); Spark merges these partial counts and finds the best count of each B id.  Pass 3 gives
every link its pair's count: from a broadcast table if the pairs are few enough, else each block of documents
is joined with the counts of just the pairs it holds.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sightline.llm.packing import vocabulary_file
from sightline.session import cut_lineage, release

# Text bytes that are aligned at a time; a longer text is aligned in parts of about this size.
BLOCK_BYTES = 1 << 19
# Entries of a worker process's memory of encoded words, and of a task's pairs before it hands them on.
MEMORY = 200_000
TASK_PAIRS = 1 << 20
# Pairs that are broadcast at most (20 bytes each); beyond, blocks are joined with their pairs' counts.
BROADCAST_PAIRS = 2_000_000

END_A, END_B, END_BOTH = 1, 2, 3

Finish = Callable[[pa.RecordBatch], pa.RecordBatch]

# A place where both tokenizers end a token: before one space that is followed by a letter.
_CUT = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")
_WORD = re.compile(" +[^ ]*")
# Characters outside these, white space but these, and control characters go to the tokenizer's own library.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡§«»¿-ſ‐-‧]")


def _bytes_of_byte_level() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte: itself, or the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, extra = {}, 0x100
    for byte in range(256):
        table[chr(byte if byte in plain else extra)] = byte
        extra += byte not in plain
    return table


class ByteLevel:
    """Tokenizer A: ids of a text, and the bytes that each id stands for.

    If ids rank the merges, texts of usual characters go to a second implementation of the same tokenizer that
    is several times as fast; texts on whose character classes the two might differ do not.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.kind, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        letters = _bytes_of_byte_level()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        # A special token never comes out of a text; its bytes are not asked for.
        self.pieces = [
            b"" if i in special else bytes(letters[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.fast = self._ranked(path, special)

    def _ranked(self, path: str, special: set[int]):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if any(self.tokenizer.token_to_id("".join(pair)) != 256 + i for i, pair in enumerate(pairs)):
            return None
        ranks = {p: i for i, p in enumerate(self.pieces) if i not in special}
        return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not UNUSUAL.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.frombuffer(array(self.code, ids), dtype=self.kind)

    def spells(self, ids: np.ndarray, text: bytes) -> bool:
        """Byte-level ids spell their text unless the vocabulary normalises; lengths rule that out cheaply."""
        return int(self.lengths[ids].sum()) == len(text)


class Pieces:
    """Tokenizer B: words with their leading spaces are encoded once and remembered.

    No piece of the vocabulary has a space after another character, so no merge crosses the start of a word.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.kind, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.by_words = not any(re.search("[^▁]▁", n) for n in names)
        self.pieces = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i)
            else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.spelling = pa.array(self.pieces, pa.large_binary())
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")
        self.known: dict[str, bytes | None] = {}

    def _encode(self, words: list[str]) -> list[bytes | None]:
        """Ids of words that start with a space, None for those that their pieces do not spell."""
        # The model puts a space before a text, but not before an empty one: a last space is a word of its own.
        ids = [found or [self.space] for found in self.model.encode([w[1:] for w in words], num_threads=1)]
        coded = [array(self.code, x).tobytes() for x in ids]
        flat = np.frombuffer(b"".join(coded), dtype=self.kind)
        spelt = pc.take(self.spelling, pa.array(flat)).buffers()[2].to_pybytes()
        texts = [w.encode() for w in words]
        sizes = np.add.reduceat(self.lengths[flat], np.cumsum([0, *map(len, ids[:-1])]))
        if spelt == b"".join(texts) and np.array_equal(sizes, [len(t) for t in texts]):
            return coded
        return [c if b"".join([self.pieces[i] for i in x]) == t else None for c, x, t in zip(coded, ids, texts)]

    def encode(self, spaced: list[str]) -> list[np.ndarray | None]:
        """Ids of texts that start with a space (the one that the model adds), None for those that they do not spell."""
        words = [_WORD.findall(text) if self.by_words else [text] for text in spaced]
        distinct = set().union(*words)
        new = list(distinct.difference(self.known))
        if len(self.known) + len(new) > MEMORY:
            self.known = {w: self.known[w] for w in distinct.intersection(self.known)}
        if new:
            self.known.update(zip(new, self._encode(new)))
        found = [list(map(self.known.__getitem__, w)) for w in words]
        # A text without spaces is one long word, not worth remembering.
        for w in new:
            if len(w) > 64:
                del self.known[w]
        return [None if None in x else np.frombuffer(b"".join(x), dtype=self.kind) for x in found]


@lru_cache(maxsize=1)
def tokenizers_of(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    """One pair per worker process: later tasks find their memories filled."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    pa.set_cpu_count(1)
    return ByteLevel(path_a), Pieces(path_b)


def text_parts(text: str, size: int = BLOCK_BYTES) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut only where both tokenizers end a token."""
    parts, begin = [], 0
    while len(text) - begin > size:
        cut = _CUT.search(text, begin + size)
        if cut is None:
            break
        parts.append(text[begin:cut.start()])
        begin = cut.start()
    return [*parts, text[begin:]]


def align_parts(a: list[np.ndarray], b: list[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray) -> list[bytes]:
    """Step bytes of each part from the ids of both sides, which spell the same bytes.

    One byte per distinct end offset, in order: :data:`END_A`, :data:`END_B` or :data:`END_BOTH`.
    """
    sides = []
    for ids, lengths in ((a, lengths_a), (b, lengths_b)):
        rows = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(np.concatenate(ids).astype(np.int64)))
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        size = pc.take(pa.array(lengths), flat)
        # Cumulative over all parts, less what came before each part: ends within the part.
        total = pc.cumulative_sum(size)
        before = np.concatenate([[0], total.to_numpy()])[rows[:-1]]
        end = pc.subtract(total, pc.take(pa.array(before), parent))
        sides.append((parent, end))
    (part_a, end_a), (part_b, end_b) = sides
    left = pa.table({"part": part_a, "end": end_a, "a": pa.array(np.ones(len(end_a), np.int8))})
    right = pa.table({"part": part_b, "end": end_b, "b": pa.array(np.full(len(end_b), END_B, np.int8))})
    met = left.join(right, ["part", "end"], join_type="full outer", use_threads=False)
    steps = pc.add(pc.fill_null(met["a"], 0), pc.fill_null(met["b"], 0)).to_numpy()
    part, end = met["part"].to_numpy(), met["end"].to_numpy()
    order = np.argsort(part * (int(end.max()) + 1) + end, kind="stable") if len(end) else np.zeros(0, np.int64)
    steps, part = steps[order].astype(np.uint8), part[order]
    bounds = np.searchsorted(part, np.arange(len(a) + 1))
    return [steps[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]


_ALIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
    T.StructField("a_ids", T.BinaryType()), T.StructField("b_ids", T.BinaryType()), T.StructField("steps", T.BinaryType()),
    T.StructField("block", T.LongType())])


def aligned_documents(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Ids of both sides and steps per document; see :func:`align_tokenizers` for the columns."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers_of(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy()]))
            start = 0
            while start < len(texts):
                stop = int(np.searchsorted(size, size[start] + BLOCK_BYTES, "right")) - 1
                stop = min(max(stop, start + 1), len(texts))
                yield block_of(batch.slice(start, stop - start), first, second, block)
                block, start = block + 1, stop

    def block_of(batch: pa.RecordBatch, first: ByteLevel, second: Pieces, block: int) -> pa.RecordBatch:
        parts = [text_parts(" " + text) if text else [] for text in batch.column(1).to_pylist()]
        found = iter(second.encode([p for row in parts for p in row]))
        owner: list[int] = []
        ids_a: list[np.ndarray] = []
        ids_b: list[np.ndarray] = []
        for row, held in enumerate(parts):
            b = [next(found) for _ in held]
            a = [first.encode(part) for part in held] if not any(x is None for x in b) else []
            if a and all(first.spells(x, part.encode()) for x, part in zip(a, held)):
                owner += [row] * len(held)
                ids_a += a
                ids_b += b
        steps = align_parts(ids_a, ids_b, first.lengths, second.lengths) if owner else []
        n, rows = len(batch), {}
        for at, row in enumerate(owner):
            rows.setdefault(row, []).append(at)
        out_a, out_b, out_s = [b""] * n, [b""] * n, [b""] * n
        for row, parts in rows.items():
            out_a[row] = b"".join(ids_a[p].tobytes() for p in parts)
            out_b[row] = b"".join(ids_b[p].tobytes() for p in parts)
            out_s[row] = b"".join(steps[p] for p in parts)
        numbers = [
            [len(x) // first.kind.itemsize for x in out_a], [len(x) // second.kind.itemsize for x in out_b],
            [x.count(END_BOTH) for x in out_s], [len(x) for x in out_s]]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *[pa.array(x, pa.int64()) for x in numbers],
             *[pa.array(x, pa.binary()) for x in (out_a, out_b, out_s)], pa.array(np.full(n, block, np.int64))],
            _ALIGNED.names)

    return documents.select("doc_id", "text").mapInArrow(align, _ALIGNED)


def _joined_binary(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _width(column: pa.Array, n: np.ndarray) -> np.dtype:
    return np.dtype("<u2" if 2 * int(n.sum()) == int(pc.sum(pc.binary_length(column)).as_py() or 0) else "<u4")


def link_pairs(batch: pa.RecordBatch, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Id pair (a * size_b + b) of every link of a batch of aligned documents, and each document's links."""
    n_links = batch.column("n_links").to_numpy()
    a, b = (
        _joined_binary(batch.column(f"{side}_ids"), _width(batch.column(f"{side}_ids"), batch.column(f"n_{side}").to_numpy()))
        for side in "ab")
    steps = _joined_binary(batch.column("steps"), np.dtype(np.uint8))
    # A link lies in the tokens that have not ended before it.
    ended_a, ended_b = steps & END_A, steps >> 1
    at_a, at_b = np.cumsum(ended_a, dtype=np.int64) - ended_a, np.cumsum(ended_b, dtype=np.int64) - ended_b
    return a[at_a].astype(np.int64) * size_b + b[at_b], n_links


def _small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with about :data:`BLOCK_BYTES` links each (a longer document alone)."""
    for batch in batches:
        size = np.cumsum(np.concatenate([[0], batch.column("n_links").to_numpy()]))
        start = 0
        while start < len(batch):
            stop = int(np.searchsorted(size, size[start] + BLOCK_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), len(batch))
            yield batch.slice(start, stop - start)
            start = stop


def _counted(pairs: np.ndarray) -> pa.Table:
    found = pc.value_counts(pa.array(pairs))
    return pa.table({"pair": found.field(0), "n": found.field(1)})


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, its links in the whole table (n), and whether no pair of its B id has more (best).

    Tasks count their own pairs, Spark merges.  A B id has at most one pair per A id, so the window is bounded
    by the vocabulary.
    """
    schema = "pair long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in _small_batches(batches):
            held.append(_counted(link_pairs(batch, size_b)[0]))
            rows += len(held[-1])
            if rows > TASK_PAIRS:
                merged = _merged(held)
                if 2 * len(merged) > TASK_PAIRS:
                    yield from merged.to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [merged], len(merged)
        if held:
            yield from _merged(held).to_batches()

    counts = aligned.select("n_links", "n_a", "n_b", "a_ids", "b_ids", "steps").mapInArrow(count, schema).groupBy(
        "pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.pmod("pair", F.lit(size_b))))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def _merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(
        ["pair", "n_sum"]).rename_columns(["pair", "n"])


_RESULT = T.StructType([*_ALIGNED.fields[:-1], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])


def _with_sums(batch: pa.RecordBatch, size_b: int, pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """Add n_best and count_sum; ``pairs`` is sorted and holds every pair of the batch."""
    links, n_links = link_pairs(batch, size_b)
    coded = pa.array(links).dictionary_encode()
    where = np.searchsorted(pairs, coded.dictionary.to_numpy())
    code = coded.indices.to_numpy()
    bounds = np.cumsum(np.concatenate([[0], n_links]))
    sums = []
    for values in (best.astype(np.int64), n):
        total = np.concatenate([[0], np.cumsum(values[where][code], dtype=np.int64)]) if len(links) else np.zeros(1, np.int64)
        sums.append(total[bounds[1:]] - total[bounds[:-1]])
    return pa.RecordBatch.from_arrays(
        [*[batch.column(f.name) for f in _ALIGNED.fields[:-1]], *[pa.array(s) for s in sums]], _RESULT.names)


def _sums_by_broadcast(aligned: DataFrame, counts: DataFrame, size_b: int, finish: Finish, schema: T.StructType) -> DataFrame:
    table = counts.sort("pair").toArrow()
    shared = aligned.sparkSession.sparkContext.broadcast(
        tuple(table[c].to_numpy().astype(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", bool))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(batches):
            yield finish(_with_sums(batch, size_b, *shared.value))

    return aligned.mapInArrow(add, schema)


def _sums_by_blocks(aligned: DataFrame, counts: DataFrame, size_b: int, finish: Finish, schema: T.StructType) -> DataFrame:
    """As :func:`_sums_by_broadcast` for any number of pairs; a block's pairs are at most its links."""
    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in _by_block(batch):
                pairs = pc.unique(pa.array(link_pairs(one, size_b)[0]))
                block = pa.array(np.full(len(pairs), one.column("block")[0].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([block, pairs], ["block", "pair"])

    lookups = aligned.mapInArrow(needed, "block long, pair long").join(counts, "pair")

    def add(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by("pair")
        lists = [pairs[c].to_numpy() for c in ("pair", "n", "best")]
        rows = documents.combine_chunks().to_batches()
        return pa.Table.from_batches([finish(_with_sums(b, size_b, *lists)) for b in rows])

    return aligned.groupBy("block").cogroup(lookups.groupBy("block")).applyInArrow(add, schema)


def _by_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    block = batch.column("block").to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
    for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if stop > start:
            yield batch.slice(start, stop - start)


def align_tokenizers(
    documents: DataFrame, path_a: str | None = None, path_b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS,
    finish: Finish | None = None, schema: T.StructType = _RESULT,
) -> DataFrame:
    """One row per document: the ids of both tokenizers, how they align, and how usual their pairs are.

    doc_id, n_a, n_b, n_groups, n_links; a_ids and b_ids (little-endian, 2 bytes each where the vocabulary
    fits, else 4); steps (a byte per link: 1 an A token ends, 2 a B token ends, 3 both end and close a group);
    n_best (links whose pair is the commonest of its B id, ties included); count_sum (corpus-wide counts of the
    pairs of all links).  A encodes a space and the text, B the text, before which it puts a space itself; the
    strings of special tokens are ordinary text.

    Null and empty texts, and texts that the tokens of either side do not spell (B shows U+2581 as a space),
    have no tokens: zeros and empty bytes.  Repeated rows count and are returned as often as they come; null
    ids stay null; an empty table gives no rows.  Only doc_id and text are read.

    ``finish`` turns batches of these rows into batches of ``schema`` in the same pass, so that ids which are
    only needed for a digest or a file never leave the worker.

    Runs jobs: aligned documents and pair counts are written to the checkpoint folder.  Up to
    ``broadcast_pairs`` pairs pass through the driver and are broadcast; beyond, nothing does.
    """
    path_a, path_b = path_a or vocabulary_file(), path_b or vocabulary_file("piece_bpe_32k.model")
    size_b = len(tokenizers_of(path_a, path_b)[1].pieces)
    aligned = cut_lineage(aligned_documents(documents, path_a, path_b))
    counts = cut_lineage(pair_counts(aligned, size_b))
    finish = finish or (lambda batch: batch)
    if counts.count() > broadcast_pairs:
        return _sums_by_blocks(aligned, counts, size_b, finish, schema)
    result = _sums_by_broadcast(aligned, counts, size_b, finish, schema)
    release(counts)
    return result


def group_texts(batch: pa.RecordBatch) -> list[str]:
    """Groups of each aligned document as ``a1,a2|b1;a3|b2,b3``: decimal ids in order."""
    texts = []
    n = {side: batch.column(f"n_{side}").to_numpy() for side in "ab"}
    steps = _joined_binary(batch.column("steps"), np.dtype(np.uint8))
    n_steps = batch.column("n_links").to_numpy()
    closed = np.cumsum(steps == END_BOTH)
    tokens, group = {}, {}
    for side, bit in (("a", END_A), ("b", END_B)):
        column = batch.column(f"{side}_ids")
        tokens[side] = _joined_binary(column, _width(column, n[side])).astype(np.int64)
        at = np.flatnonzero(steps & bit)
        group[side] = closed[at] - (steps[at] == END_BOTH)
    if not len(steps):
        return [""] * len(batch)
    number = int(closed[-1])
    per_a, per_b = (np.bincount(group[side], minlength=number) for side in "ab")
    # A group's A tokens come before its B tokens; a token is followed by a comma, or at its side's end by | or ;.
    at_a = np.arange(len(tokens["a"])) + (np.cumsum(per_b) - per_b)[group["a"]]
    at_b = np.arange(len(tokens["b"])) + np.cumsum(per_a)[group["b"]]
    last_a, last_b = np.zeros(len(at_a), np.int64), np.zeros(len(at_b), np.int64)
    last_a[np.cumsum(per_a) - 1], last_b[np.cumsum(per_b) - 1] = 1, 2
    entry = np.empty(len(at_a) + len(at_b), np.int64)
    entry[at_a], entry[at_b] = tokens["a"] * 3 + last_a, tokens["b"] * 3 + last_b
    strings = pc.take(_decimals(1 << (int(entry.max()) // 3).bit_length()), pa.array(entry))
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2].to_pybytes()
    ends = np.cumsum(n["a"] + n["b"])
    for row, (end, held) in enumerate(zip(ends.tolist(), n_steps.tolist())):
        begin = int(offsets[end - n["a"][row] - n["b"][row]])
        texts.append(data[begin:int(offsets[end]) - 1].decode() if held else "")
    return texts


@lru_cache(maxsize=4)
def _decimals(n: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for i in range(n) for mark in ",|;"], pa.large_string())
