"""Benchmark decontamination: broadcast hash set of benchmark word windows, one scan of the documents.

The windows of the benchmark items are hashed and the sorted hashes go to every task (their number is
checked first; a large benchmark goes in passes).  Each document is cut into words once a pass; windows
whose hash is in the set are compared with the item's words, and the words they cover are hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.llm.textops import ALPHANUMERIC, LOWER_ASCII, Words, word_groups
from sightline.operators.ordering import salted_join
from sightline.session import cut_lineage, release

WINDOW = 10
# Benchmark words that one pass over the documents broadcasts (about 100 bytes each in a task).
PASS_WORDS = 1_000_000
# Longer items are cut, so that a single one cannot exceed a pass.
PIECE_WORDS = 50_000

_HITS = T.StructType([
    T.StructField("_n_words", T.LongType()), T.StructField("_hit_spans", T.ArrayType(T.LongType())),
    T.StructField("_items", T.ArrayType(T.StringType()))])
_KEY = "_text_key"
_FOUND = T.StructType([T.StructField(_KEY, T.BinaryType()), *_HITS.fields[1:]])


def _normal(words: Words, first: int, size: int) -> bytes:
    """Words first .. first+size, lower-cased and joined by a space."""
    return b" ".join(
        words.fold[words.data[words.starts[i]:words.ends[i]]].tobytes() for i in range(first, first + size))


class _Windows:
    """Benchmark windows of one pass: by size, sorted hashes and the items of each text of a window."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.by_size: dict[int, tuple[np.ndarray, dict[bytes, set[str]]]] = {}
        found: dict[int, tuple[set[int], dict[bytes, set[str]]]] = {}
        names = [name for name, _ in items]
        for words in word_groups(pa.array([text for _, text in items], pa.string()), ALPHANUMERIC, LOWER_ASCII):
            counts = np.diff(words.row_bounds)
            for size in range(1, WINDOW + 1):
                at, hashes = words.windows(size)
                # Items shorter than a full window are one window of their own size.
                rows = words.rows[at]
                use = counts[rows] == size if size < WINDOW else np.ones(len(at), dtype=bool)
                for i, h in zip(at[use], hashes[use]):
                    known, texts = found.setdefault(size, (set(), {}))
                    known.add(int(h))
                    texts.setdefault(_normal(words, int(i), size), set()).add(names[words.first_row + words.rows[i]])
        for size, (known, texts) in found.items():
            self.by_size[size] = (np.array(sorted(known), dtype=np.uint64), texts)

    def scan(self, text: pa.Array) -> tuple[list, list, list]:
        """Per text: number of words, hit spans (start, end, start, end ...), items with occurring windows."""
        n_words, spans, items = [], [], []
        for words in word_groups(text, ALPHANUMERIC, LOWER_ASCII):
            edge = np.zeros(len(words.starts) + WINDOW + 1, dtype=np.int32)
            own: dict[int, set[str]] = {}
            for size, (known, texts) in self.by_size.items():
                at, hashes = words.windows(size)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                for i in at[known[place] == hashes]:
                    match = texts.get(_normal(words, int(i), size))
                    if match:
                        edge[i] += 1
                        edge[i + size] -= 1
                        own.setdefault(int(words.rows[i]), set()).update(match)
            hit = np.cumsum(edge)[:len(words.starts)] > 0
            first = words.row_bounds
            for r in range(words.n_rows):
                n_words.append(int(first[r + 1] - first[r]))
                if r in own:
                    change = np.flatnonzero(np.diff(hit[first[r]:first[r + 1]].astype(np.int8), prepend=0, append=0))
                    spans.append(change.tolist())
                    items.append(sorted(own[r]))
                else:
                    spans.append([])
                    items.append([])
        return n_words, spans, items


def _pieces(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (item, piece, n_words); items of more than PIECE_WORDS words in pieces that share WINDOW - 1 words."""
    words = F.filter(F.split(F.col(text), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("string").alias("item"), F.col(text).alias("piece"), words.alias("words"))
    # A piece starts only where a full window is left, so no piece passes for a short item.
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)), F.lit(PIECE_WORDS))
    cut = F.transform(starts, lambda s: F.slice("words", s, F.lit(PIECE_WORDS + WINDOW - 1)))
    pieces = F.when(F.size("words") > PIECE_WORDS + WINDOW - 1, F.transform(cut, lambda w: F.struct(
        F.array_join(w, " ").alias("piece"), F.size(w).cast("long").alias("n_words")))).otherwise(
        F.array(F.struct("piece", F.size("words").cast("long").alias("n_words"))))
    return rows.select("item", F.explode(pieces).alias("p")).select("item", "p.*").distinct()


def _adding(documents: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """``documents`` with the columns of _HITS from one pass."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(shared.value)
        for batch in batches:
            n_words, spans, names = windows.scan(batch.column(text))
            columns = [*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                       pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *_HITS.names])

    return documents.mapInArrow(scan, T.StructType([*documents.schema.fields, *_HITS.fields]))


def _hits_only(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """Key, hit spans and items of the distinct texts (key, text) that one pass hits."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(shared.value)
        for batch in batches:
            _, spans, names = windows.scan(batch.column(1))
            at = [i for i, found in enumerate(spans) if found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([spans[i] for i in at], pa.list_(pa.int64())),
                 pa.array([names[i] for i in at], pa.list_(pa.string()))], _FOUND.names)

    return texts.mapInArrow(scan, _FOUND).dropDuplicates([_KEY])


def _merged(hits: DataFrame) -> DataFrame:
    """One row per text: the spans of its rows (one or two) united, and all their items."""
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_union(s[0], s[1] if len(s) > 1 else []) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.int64())), batch.column(2)], _FOUND.names)

    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items"))))
    return hits.groupBy(_KEY).agg(F.collect_list("_hit_spans"), items).mapInArrow(unite, _FOUND)


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``documents`` with ``n_words``, ``hit_spans`` and ``items``.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.  Windows are ten
    consecutive words of an item, or the whole of a shorter one.  ``hit_spans`` lists start and end
    (exclusive) of the maximal hit runs, as word numbers; ``items`` the ids of items with an occurring
    window.  Null and empty texts have no words and no hits, items with null id or text are left out,
    repeated rows are judged alike, an empty benchmark hits nothing.  Columns of ``documents`` of those
    three names are replaced.

    One job counts the benchmark's words.  Up to PASS_WORDS they go to every task at once and the documents
    are scanned once, lazily.  A larger benchmark is dealt to passes of about so many words, and each pass is
    a job of its own: its items are collected and broadcast, the hits it finds are written (distinct hit
    texts only) and its broadcast is destroyed before the next one is collected.  The driver and a task hold
    one pass at any size of the benchmark; scans grow with that size.
    """
    public = [n.removeprefix("_") for n in _HITS.names]
    found = _scanned(documents.drop(*public), benchmark, text, item, item_text)
    return found.withColumnsRenamed(dict(zip(_HITS.names, public)))


def _scanned(documents: DataFrame, benchmark: DataFrame, text: str, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``documents`` with the three columns under names of our own."""
    pieces = _pieces(benchmark, item, item_text)
    passes = int(pieces.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] // PASS_WORDS) + 1
    broadcast = documents.sparkSession.sparkContext.broadcast
    if passes == 1:
        return _adding(documents, broadcast([(r[0], r[1]) for r in pieces.select("item", "piece").collect()]), text)

    dealt = cut_lineage(pieces.select("item", "piece", F.pmod(F.xxhash64("item", "piece"), F.lit(passes)).alias("pass")))
    key = F.unhex(F.sha2(F.col(text), 256)).alias(_KEY)
    texts = documents.select(key, F.col(text).alias("_text"))
    hits: DataFrame | None = None
    for k in range(passes):
        shared = broadcast([(r[0], r[1]) for r in dealt.where(F.col("pass") == k).select("item", "piece").collect()])
        new = cut_lineage(_hits_only(texts, shared))
        shared.destroy()
        if hits is not None:
            older, newer = hits, new
            new = cut_lineage(_merged(older.unionByName(newer)))
            release(older)
            release(newer)
        hits = new
    release(dealt)
    counted = _adding(documents.select("*", key), broadcast([]), text).drop("_hit_spans", "_items")
    # Copies of one text share a key; their other columns spread them.
    spread = [f.name for f in documents.schema.fields if isinstance(f.dataType, T.AtomicType)]
    found = salted_join(counted, hits, [_KEY], spread, "left").withColumns(
        {n: F.coalesce(F.col(n), F.array().cast(_HITS[n].dataType)) for n in ("_hit_spans", "_items")})
    return found.select(*documents.columns, *_HITS.names)


def _union(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of disjoint sorted spans."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination_digest(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`find_contamination`; items are sorted as strings."""
    ids = F.array_join(F.array_sort("items"), ",")
    n_hit = F.aggregate(
        F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
        F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_spans(text: str | None, spans: list[int]) -> str | None:
    """``text`` without the bytes of the words in ``spans`` and between them."""
    if text is None or not spans:
        return text
    words = next(word_groups(pa.array([text], pa.string()), ALPHANUMERIC, LOWER_ASCII))
    data, out, last = text.encode(), [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        out.append(data[last:words.starts[start]])
        last = words.ends[end - 1]
    return b"".join([*out, data[last:]]).decode()


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, mode: str = "document", text: str = "text"
) -> DataFrame:
    """Rows of ``documents`` with its own columns: contaminated ones removed, or only their hit spans.

    ``mode`` is "document" or "span".  Clean rows are returned unchanged.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode!r}")
    found = _scanned(documents, benchmark, text)
    names = documents.columns
    if mode == "document":
        return found.where(F.size("_hit_spans") == 0).select(*names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_spans(t, s) for t, s in zip(batch.column(text).to_pylist(), batch.column("_hit_spans").to_pylist())]
            at = names.index(text)
            kept = batch.select(names)
            yield kept.set_column(at, text, pa.array(texts, kept.schema.field(text).type))

    return found.mapInArrow(cut, documents.schema)
