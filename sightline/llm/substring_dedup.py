"""Substring dedup: suffix automata over reference shards give matching statistics of the documents.

A window of 35 words is repeated if its words start anywhere else.  Comparing all text with all text
is cut down without losing a window:

1. Every window picks the smallest hash of its 8-word grams as its anchor (windows with equal words
   pick equal anchors).  Neighbouring windows with one anchor form a context: the anchor, a digest of
   the words, and the place.
2. Contexts whose anchor occurs once have no repeated window.  If all contexts of an anchor are equal,
   all their windows are repeated.  Both are settled by counts (combined before the shuffle).
3. The other contexts, once per distinct text and with its count, are the reference.  Anchors are dealt
   into shards of bounded size; each shard's suffix automaton is built where the shard's texts stream
   through it, and a window is repeated if the state it ends in occurs twice or more.
4. Anchors with too many distinct contexts for one shard are settled by counts: their windows are cut
   into ever smaller runs, and a run is settled as in step 2 by the words that all its windows share.

The maximal runs of words covered by repeated windows are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.llm.textops import Words, mix, window_sums, word_groups
from sightline.operators.ordering import salted_join
from sightline.session import cut_lineage

WINDOW = 35
GRAM = 8
# Distinct contexts (about 50 words each) per shard, and the most that one anchor may bring to a shard.
SHARD_CONTEXTS = 2_000
ANCHOR_CONTEXTS = 500
# Windows per run (by distance from the anchor) in which such anchors are settled.
RUNS = (7, 2, 1)
# Anchors with at least this part of all shared contexts are spread; there are at most as many.
HOT_ANCHORS = 500
_RUN_BITS = 6  # windows of one context: at most WINDOW - GRAM + 1 = 28, in the low bits of its place
_KEYS = ("_doc", "_key")

_CONTEXT = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "digest", "_doc", "_key", "place")])
_TEXT = T.StructType([
    T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("hot", T.BooleanType()), T.StructField("words", T.BinaryType())])
_MASK = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor", "digest", "mask")])
_RUN = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("anchor", "digest", "n", "low", "high")],
    T.StructField("words", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("run", "common", "own")]])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value in each window of ``width`` values."""
    at, best, size = np.arange(len(values)), values, 1
    while size < width:
        step = min(size, width - size)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        size += step
    return at


def contexts_of(words: Words) -> tuple[np.ndarray, ...]:
    """Row, first window (as a word of the row), number of windows, anchor and digest of each context."""
    h, n = words.hashes, len(words.starts)
    if n < WINDOW:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    first = np.arange(n - GRAM + 1)
    grams = mix(window_sums(h, first, first + GRAM))
    at = sliding_argmin(grams, WINDOW - GRAM + 1)
    window = np.flatnonzero(words.rows[:n - WINDOW + 1] == words.rows[WINDOW - 1:])
    anchor, row = at[window], words.rows[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(window)))
    start = window[head]
    # Equal words at another distance from the anchor would be another text, so the distance is part of the digest.
    digest = mix(window_sums(h, start, start + run + WINDOW - 1) ^ mix((run * 64 + anchor[head] - start).astype(np.uint64)))
    rows = row[head]
    return rows, start - words.row_bounds[rows], run, grams[anchor[head]].view(np.int64), digest.view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_groups(batch.column(2)):
            rows, start, run, anchor, digest = contexts_of(words)
            take = pa.array(rows + words.first_row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(digest), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array((start << _RUN_BITS) | run)], _CONTEXT.names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the wanted contexts (column 1: place, anchor, digest, n, hot) of each text (column 0)."""
    for batch in batches:
        wanted = batch.column(1)
        for words in word_groups(batch.column(0)):
            out: list[tuple] = []
            for r in range(words.n_rows):
                first = words.row_bounds[r]
                for c in wanted[words.first_row + r].as_py():
                    start = first + (c["place"] >> _RUN_BITS)
                    end = start + (c["place"] & ((1 << _RUN_BITS) - 1)) + WINDOW - 2
                    out.append((c["anchor"], c["digest"], c["n"], c["hot"],
                                words.data[words.starts[start]:words.ends[end]].tobytes()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _TEXT.names)


class SuffixAutomaton:
    """Suffix automaton of several word lists; ``count`` of a state is how often its strings occur."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state of ``p`` followed by ``word``, cut off from the longer strings of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, times: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                state, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = state
                    p = self.link[p]
                if p >= 0:
                    self.link[state] = self._split(p, word, self.next[p][word])
                last = state
            self.count[last] += times

    def finish(self) -> None:
        """Sum the counts up to the shorter strings; after the last ``add``."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list, size: int) -> Iterator[int]:
        """Starts of the windows of ``size`` words of ``words`` that occur twice or more.

        The matching statistics (longest suffix found so far) are kept at ``size`` words at most.
        """
        v = matched = 0
        for j, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if word in self.next[v]:
                v, matched = self.next[v][word], matched + 1
            while self.length[self.link[v]] >= size:
                v = self.link[v]
            matched = min(matched, self.length[v])
            if matched >= size and self.count[v] >= 2:
                yield j - size + 1


def _match_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows (bits of ``mask``) of the contexts of one shard."""
    texts = {(a, d): (n, w.split()) for a, d, n, w in zip(shard["anchor"], shard["digest"], shard["n"], shard["words"])}
    automaton = SuffixAutomaton()
    for n, words in texts.values():
        automaton.add(words, n)
    automaton.finish()
    out = []
    for (a, d), (_, words) in texts.items():
        mask = sum(1 << i for i in automaton.repeated(words, WINDOW))
        if mask:
            out.append((a, d, mask))
    return pd.DataFrame(out, columns=_MASK.names).astype("int64")


def _runs(width: int):
    """Cut windows low .. high of each context where the distance from the anchor reaches a multiple of ``width``.

    ``common`` hashes the words that any windows of such distances share, ``own`` those of the run's windows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, lows, highs = (batch.column(c).to_numpy() for c in ("anchor", "low", "high"))
            for words in word_groups(batch.column("words").cast(pa.string())):
                h, at = words.hashes, np.arange(max(len(words.starts) - GRAM + 1, 0))
                grams = mix(window_sums(h, at, at + GRAM)).view(np.int64)
                rows, first, last, run, start = [], [], [], [], []
                for r in range(words.n_rows):
                    i = words.first_row + r
                    begin = int(words.row_bounds[r])
                    anchor = int(np.flatnonzero(grams[begin:] == anchors[i])[0])
                    distance = anchor - np.arange(lows[i], highs[i])
                    for k in np.unique(distance // width):
                        inside = np.flatnonzero(distance // width == k) + lows[i]
                        rows.append(i)
                        first.append(begin + int(inside[0]))
                        last.append(begin + int(inside[-1]))
                        run.append(int(k))
                        start.append(begin + anchor - int(k) * width)
                rows, first, last, start = (np.array(x, dtype=np.int64) for x in (rows, first, last, start))
                begin = words.row_bounds[rows - words.first_row]
                take = pa.array(rows)
                common = mix(window_sums(h, start, start - width + 1 + WINDOW)).view(np.int64)
                own = mix(window_sums(h, first, last + WINDOW) ^ mix((last - first).astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(take) for c in ("anchor", "digest", "n")], pa.array(first - begin),
                     pa.array(last - begin + 1), batch.column("words").take(take), pa.array(run, pa.int64()),
                     pa.array(common), pa.array(own)], _RUN.names)
    return cut


def _counted_windows(texts: DataFrame) -> DataFrame:
    """anchor, digest and mask of the repeated windows of contexts (anchor, digest, n, words), by counts alone."""
    columns = ["anchor", "digest", "n", "low", "high", "words"]
    size = F.size(F.split(F.col("words").cast("string"), r"[\x20\x09-\x0D]+", -1))
    left = texts.select("anchor", "digest", "n", F.lit(0).cast("long").alias("low"), (size - WINDOW + 1).cast("long").alias("high"), "words")
    out = None
    for width in RUNS:
        runs = cut_lineage(left.mapInArrow(_runs(width), _RUN))
        shared = runs.groupBy("anchor", "run", "common").agg(
            F.sum("n").alias("total"), F.min("own").alias("least"), F.max("own").alias("most")).where("total > 1")
        judged = salted_join(
            runs, shared.withColumn("pure", F.col("least") == F.col("most")), ["anchor", "run", "common"], ["digest"])
        bits = F.expr("shiftleft(1L, cast(high AS INT)) - shiftleft(1L, cast(low AS INT))").alias("mask")
        found = judged.where("pure").select("anchor", "digest", bits)
        out = found if out is None else out.unionByName(found)
        left = judged.where("NOT pure").select(*columns)
    return out.groupBy("anchor", "digest").agg(F.sum("mask").alias("mask"))


def repeated_contexts(keyed: DataFrame) -> DataFrame:
    """``_doc``, ``_key``, ``place`` and ``mask`` (bit i: window i is repeated) of contexts with repeated windows.

    ``keyed`` has ``_doc``, ``_key`` and ``_text``.  Runs jobs: two tables are written to the checkpoint folder.
    """
    contexts = keyed.select("_doc", "_key", "_text").mapInArrow(_contexts, _CONTEXT)
    anchors = cut_lineage(
        contexts.groupBy("anchor").agg(
            F.count("*").alias("total"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where("total > 1").select("anchor", "total", (F.col("low") == F.col("high")).alias("pure")))
    shared = cut_lineage(_of_anchors(contexts, anchors))
    all_windows = F.expr(f"shiftleft(1L, cast(place & {(1 << _RUN_BITS) - 1} AS INT)) - 1").alias("mask")

    # One text per distinct context, fetched from the document where it stands first.
    kinds = cut_lineage(
        shared.where(~F.col("pure")).groupBy("anchor", "digest").agg(
            F.count("*").alias("n"), F.min(F.struct("_doc", "_key", "place")).alias("first")))
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    wanted = (
        salted_join(kinds, per_anchor, ["anchor"], ["digest"])
        .select("first.*", "anchor", "digest", "n", (F.col("kinds") > ANCHOR_CONTEXTS).alias("hot"))
        .groupBy("_doc", "_key").agg(F.collect_list(F.struct("place", "anchor", "digest", "n", "hot")).alias("wanted")))
    texts = cut_lineage(
        keyed.join(wanted.withColumnsRenamed({"_doc": "_wdoc", "_key": "_wkey"}),
                   F.col("_doc").eqNullSafe(F.col("_wdoc")) & F.col("_key").eqNullSafe(F.col("_wkey")))
        .select("_text", "wanted").mapInArrow(_texts, _TEXT))
    shards = F.pmod("anchor", F.lit(kinds.count() // SHARD_CONTEXTS + 1))
    masks = texts.where(~F.col("hot")).withColumn("shard", shards).groupBy("shard").applyInPandas(_match_shard, _MASK)
    hot = texts.where("hot")
    if hot.limit(1).count():
        # A document that comes twice brings its contexts twice.
        masks = masks.unionByName(_counted_windows(hot.dropDuplicates(["anchor", "digest"])))

    mixed = salted_join(shared.where(~F.col("pure")), masks, ["anchor", "digest"], ["_doc", "place"])
    whole = shared.where("pure").select(*_KEYS, "place", all_windows)
    return whole.unionByName(mixed.select(*_KEYS, "place", "mask"))


def _of_anchors(contexts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Contexts whose anchor is in ``anchors``, with ``pure``.

    Anchors that hold a large part of the contexts (at most HOT_ANCHORS, so they may be broadcast) are
    spread over several tasks: they are repeated per part, and their contexts take a part by hash.
    """
    all_total = anchors.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    is_hot = F.col("total") * HOT_ANCHORS > F.lit(all_total)
    parts = F.when(is_hot, F.ceil(F.col("total") * HOT_ANCHORS / F.lit(max(all_total, 1))).cast("int")).otherwise(F.lit(1))
    hot = F.broadcast(anchors.where(is_hot).select("anchor", parts.alias("_parts")))
    spread = contexts.join(hot, "anchor", "left").withColumn(
        "_part", F.pmod(F.xxhash64("_doc", "_key", "place"), F.coalesce("_parts", F.lit(1))).cast("int"))
    repeated = anchors.select("anchor", "pure", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return spread.join(repeated, ["anchor", "_part"]).drop("_part", "_parts")


def _cut(remove: np.ndarray, words: Words, first: int) -> str:
    """The text with the words in ``remove`` left out; what is kept stays as it is, runs are joined by a space."""
    keep = np.flatnonzero(np.diff((~remove).astype(np.int8), prepend=0, append=0))
    return b" ".join(
        words.data[words.starts[first + a]:words.ends[first + b - 1]].tobytes()
        for a, b in zip(keep[::2], keep[1::2])).decode()


def remove_repeated(
    documents: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: str = ""
) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text``, and ``n_words`` and ``n_removed``.

    Words are runs without white space, unchanged.  Every word inside a window of 35 words of one document
    that also starts elsewhere (in any document, the same one included) is removed; windows are judged on
    the input.  Texts without such a window stay as they are.  Null texts have no words and stay null;
    repeated rows (equal id and text) repeat each other's windows; other columns are passed on, and columns
    named n_words and n_removed, after ``prefix``, are replaced.
    """
    counts = [prefix + n for n in ("n_words", "n_removed")]
    given = documents.drop(*counts)
    names = given.columns
    key = {"_doc": F.col(doc_id).cast("long"), "_key": F.xxhash64(text)}
    keyed = documents.select(*[c.alias(n) for n, c in key.items()], F.col(text).alias("_text"))
    spans = repeated_contexts(keyed).groupBy(*_KEYS).agg(F.collect_list(F.struct("place", "mask")).alias("_spans"))
    spans = spans.withColumnsRenamed({"_doc": "_sdoc", "_key": "_skey"})
    joined = given.withColumns(key).join(
        spans, F.col("_doc").eqNullSafe(F.col("_sdoc")) & F.col("_key").eqNullSafe(F.col("_skey")), "left")
    out = T.StructType([*given.schema.fields, *[T.StructField(n, T.LongType()) for n in counts]])
    at = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_groups(batch.column(text)):
                part = batch.slice(words.first_row, words.n_rows)
                texts, spans, bounds = part.column(text), part.column("_spans"), words.row_bounds
                new, n_removed = {}, []
                for r in range(words.n_rows):
                    remove = np.zeros(int(bounds[r + 1] - bounds[r]), dtype=bool)
                    for c in spans[r].as_py() or ():
                        start, mask = c["place"] >> _RUN_BITS, c["mask"]
                        # The windows of a context overlap, so its runs of bits are runs of words.
                        low = 0
                        while mask >> low:
                            low += ((mask >> low) & -(mask >> low)).bit_length() - 1
                            high = low + (~(mask >> low) & ((mask >> low) + 1)).bit_length() - 1
                            remove[start + low:start + high + WINDOW - 1] = True
                            low = high
                    n_removed.append(int(remove.sum()))
                    if n_removed[-1]:
                        new[r] = _cut(remove, words, int(bounds[r]))
                columns = [part.column(c) for c in names]
                if new:
                    columns[at] = pa.array([new.get(r, t) for r, t in enumerate(texts.to_pylist())], texts.type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.diff(bounds)), pa.array(n_removed, pa.int64())], [f.name for f in out])

    return joined.select(*names, "_spans").mapInArrow(cut, out)
