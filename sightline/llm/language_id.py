"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts byte trigrams of words per language over all labelled documents, summed up in Spark.
Scoring: a word's script leaves the languages that use it; the word's score per language is the sum of
its trigrams' log probabilities; Viterbi over the words of a document, in which a change of language
costs SWITCH, labels spans of mixed-language text.  A document's language is that of most of its letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sightline.llm.textops import LOWER_ASCII, Words, word_groups

UNKNOWN = "und"
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
SWITCH = 12.0
# A language uses a script if at least this share of its training words does.
SCRIPT_SHARE = 0.001
# Scores (words times languages) that are held at once, and bytes of one word.
SCORES_AT_ONCE = 12_000_000
BYTES_AT_ONCE = 4_000_000
_NEVER = -1e9

LETTERS = np.zeros(256, dtype=bool)
LETTERS[ord("a"):ord("z") + 1] = LETTERS[ord("A"):ord("Z") + 1] = LETTERS[0x80:] = True

# First code point of each range and its script; script 0 is common and narrows nothing.
_RANGES = (
    (0x0000, 0), (0x0041, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0E00, 9), (0x0E80, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 0),
    (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 13), (0x3100, 0), (0x3400, 14), (0xA000, 0), (0xAC00, 12),
    (0xD7B0, 0), (0xF900, 14), (0xFB00, 0), (0x20000, 14), (0x30000, 0))
_FIRST = np.array([start for start, _ in _RANGES])
_SCRIPT = np.array([script for _, script in _RANGES])
SCRIPTS = int(_SCRIPT.max()) + 1

_COUNTS = "lang string, kind int, item long, n long"


def trigram_codes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams (one per byte of a word, 0 beyond its ends), and each word's first one."""
    size = words.ends - words.starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(words.starts - first, size)
    here = words.fold[words.data[at]].astype(np.uint32)
    before, after = np.zeros_like(here), np.zeros_like(here)
    before[1:], after[:-1] = here[:-1], here[1:]
    before[first] = 0
    after[first + size - 1] = 0
    return _buckets(before, here, after), first


def _buckets(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    code = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def scripts_of(words: Words) -> np.ndarray:
    """Script of each word's first character."""
    def byte(k: int) -> np.ndarray:
        at = np.minimum(words.starts + k, len(words.data) - 1)
        return words.data[at].astype(np.int64) & 0x3F
    lead = words.data[words.starts].astype(np.int64)
    two = ((lead & 0x1F) << 6) | byte(1)
    three = ((lead & 0x0F) << 12) | (byte(1) << 6) | byte(2)
    four = ((lead & 0x07) << 18) | (byte(1) << 12) | (byte(2) << 6) | byte(3)
    point = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, two, three], four)
    return _SCRIPT[np.searchsorted(_FIRST, point, "right") - 1]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # (languages, BUCKETS) log probabilities
    uses: np.ndarray  # (SCRIPTS, languages)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    grams = np.zeros((0, BUCKETS), dtype=np.int64)
    scripts = np.zeros((0, SCRIPTS), dtype=np.int64)
    for batch in batches:
        own = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], dtype=np.int64)
        grow = len(names) - len(grams)
        grams = np.vstack([grams, np.zeros((grow, BUCKETS), dtype=np.int64)])
        scripts = np.vstack([scripts, np.zeros((grow, SCRIPTS), dtype=np.int64)])
        for words in word_groups(batch.column(0), LETTERS, LOWER_ASCII):
            if not len(words.starts):
                continue
            language = own[words.first_row + words.rows]
            codes, _ = trigram_codes(words)
            spread = np.repeat(language, words.ends - words.starts)
            grams += np.bincount(spread * BUCKETS + codes, minlength=grams.size).reshape(grams.shape)
            scripts += np.bincount(language * SCRIPTS + scripts_of(words), minlength=scripts.size).reshape(scripts.shape)
    for name, i in names.items():
        for kind, counts in ((0, grams[i]), (1, scripts[i])):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at),
                 pa.array(counts[at])], ["lang", "kind", "item", "n"])


def train(labelled: DataFrame) -> LanguageModel:
    """Model from ``text`` and ``lang`` of all rows (null in either: left out).

    Runs a job; at most BUCKETS + SCRIPTS counts of each language reach the driver, and a task holds the
    counts or scores of all languages, so memory grows with their number but not with the rows.
    """
    rows = (
        labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
        .mapInArrow(_count, _COUNTS).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(rows["lang"].unique())
    index = {x: i for i, x in enumerate(languages)}
    grams, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), SCRIPTS))
    own = rows["lang"].map(index).to_numpy(dtype=np.int64)
    for kind, counts in ((0, grams), (1, scripts)):
        use = (rows["kind"] == kind).to_numpy()
        counts[own[use], rows["item"].to_numpy(dtype=np.int64)[use]] = rows["n"].to_numpy()[use]
    scores = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    uses = (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0)
    uses[0] = True
    uses[~uses.any(axis=1)] = True
    return LanguageModel(languages, scores.astype(np.float32), uses)


def word_scores(model: LanguageModel, words: Words) -> np.ndarray:
    """(words, languages) log probabilities; languages that do not use the word's script are ruled out."""
    out = np.empty((len(words.starts), len(model.languages)), dtype=np.float32)
    long = words.ends - words.starts > BYTES_AT_ONCE
    for i in np.flatnonzero(long):
        out[i] = _long_word_scores(model, words, int(i))
    usual = words.part(np.flatnonzero(~long)) if long.any() else words
    if len(usual.starts):
        codes, first = trigram_codes(usual)
        for k in range(len(model.languages)):
            out[~long, k] = np.add.reduceat(model.scores[k][codes], first)
    out[~model.uses[scripts_of(words)]] = _NEVER
    return out


def _long_word_scores(model: LanguageModel, words: Words, i: int) -> np.ndarray:
    """Scores of one word (a text without spaces), added up over pieces of its bytes."""
    data = words.data[words.starts[i]:words.ends[i]]
    total = np.zeros(len(model.languages))
    for a in range(0, len(data), BYTES_AT_ONCE):
        # A byte on either side of the piece, 0 beyond the word's ends.
        b = min(a + BYTES_AT_ONCE, len(data))
        near = np.zeros(b - a + 2, dtype=np.uint32)
        near[int(a == 0):b - a + 1 + int(b < len(data))] = words.fold[data[max(a - 1, 0):b + 1]]
        counts = np.bincount(_buckets(near[:-2], near[1:-1], near[2:]), minlength=BUCKETS)
        total += model.scores.astype(np.float64) @ counts
    return total


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; ``scores`` lists the words of texts with the given numbers of words.

    All texts advance together, longest first, so a step is one array operation.
    """
    n_texts, languages = len(lengths), scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    rank = np.empty(n_texts, dtype=np.int64)
    rank[order] = np.arange(n_texts)
    text = np.repeat(np.arange(n_texts), lengths)
    step = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Words by step, then by text: the words of one step lie together.
    steps = int(sorted_lengths[0]) if n_texts else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(1, steps + 1), "right")
    begin = np.concatenate([[0], np.cumsum(active)])
    place = begin[step] + rank[text]
    by_step = np.empty_like(scores)
    by_step[place] = scores
    best = np.zeros((n_texts, languages))
    own = np.arange(languages, dtype=np.min_scalar_type(languages))
    back = np.zeros(scores.shape, dtype=own.dtype)
    for t in range(steps):
        n = active[t]
        value = best[:n]
        if t:
            top = value.argmax(axis=1)
            moved = (value[np.arange(n), top] - switch)[:, None]
            stay = value >= moved
            back[begin[t]:begin[t + 1]] = np.where(stay, own, top[:, None])
            value = np.where(stay, value, moved)
        best[:n] = value + by_step[begin[t]:begin[t + 1]]
    state = best.argmax(axis=1)
    path = np.empty(len(scores), dtype=own.dtype)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        path[begin[t]:begin[t + 1]] = state[:n]
        state[:n] = back[np.arange(begin[t], begin[t + 1]), state[:n]]
    return path[place]


def viterbi_in_pieces(
    scores: Callable[[int, int], np.ndarray], bounds: np.ndarray, languages: int, switch: float = SWITCH
) -> np.ndarray:
    """:func:`viterbi` of one text whose scores are too many to hold; ``scores(a, b)`` makes those of words a to b.

    Pieces lie between neighbours of ``bounds`` (from 0 to the number of words).  The first sweep keeps the
    column of values in front of each piece; the second one goes from the last piece to the first, makes
    the back pointers of a piece again from its column, and follows them.
    """
    own = np.arange(languages, dtype=np.min_scalar_type(languages))

    def advance(value: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        part = scores(a, b)
        back = np.zeros(part.shape, dtype=own.dtype)
        for t in range(b - a):
            if a + t:
                top = value.argmax()
                moved = value[top] - switch
                stay = value >= moved
                back[t] = np.where(stay, own, top)
                value = np.where(stay, value, moved)
            value = value + part[t]
        return value, back

    pieces = [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:])]
    columns = [np.zeros(languages)]
    for a, b in pieces:
        columns.append(advance(columns[-1], a, b)[0])
    path = np.empty(int(bounds[-1]), dtype=own.dtype)
    state = int(columns.pop().argmax())
    for a, b in reversed(pieces):
        _, back = advance(columns.pop(), a, b)
        for t in range(b - 1, a - 1, -1):
            path[t] = state
            state = int(back[t - a, state])
    return path


def identify(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``lang_spans`` (first word, end word, language).

    Only the text is read.  ``lang_pred`` is the language of most letters (bytes of words), ``score`` its
    share of them; null texts and texts without a letter are "und" with score 0, as is everything under an
    empty model.  Ties go to the language first in the alphabet.  Repeated rows are judged alike.

    Texts of one group with more than SCORES_AT_ONCE scores are labelled one by one in pieces of so many,
    so neither a long text nor many languages make a large matrix.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.drop("lang_pred", "score", "lang_spans")
    span = T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
    out = T.StructType([
        *given.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("lang_spans", T.ArrayType(span))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = model.languages
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

        def judge(texts: list, held: list[tuple]) -> list[tuple]:
            lengths = np.concatenate([h[0] for h in held])
            path = viterbi(np.concatenate([h[1] for h in held]), lengths)
            sizes = np.concatenate([h[2] for h in held])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            return [verdict(t, path[a:b], sizes[a:b]) for t, a, b in zip(texts, bounds[:-1], bounds[1:])]

        def verdict(t: str, own: np.ndarray, sizes: np.ndarray) -> tuple:
            if not len(own) or not (t.isascii() or any(c.isalpha() for c in t)):
                return UNKNOWN, 0.0, []
            letters = np.bincount(own, weights=sizes, minlength=len(names))
            k = int(letters.argmax())
            cut = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            spans = [{"start": s, "end": e, "lang": names[own[s]]} for s, e in zip(cut[:-1], cut[1:])]
            return names[k], float(letters[k] / letters.sum()), spans

        def judge_in_pieces(t: str, words: Words) -> tuple:
            sizes = words.ends - words.starts
            cost = np.cumsum(sizes + len(names))
            cuts = np.flatnonzero(np.diff(cost // SCORES_AT_ONCE)) + 1
            bounds = np.concatenate([[0], cuts, [len(sizes)]]) if len(sizes) else np.zeros(1, dtype=np.int64)
            path = viterbi_in_pieces(lambda a, b: word_scores(model, words.part(slice(a, b))), bounds, len(names))
            return verdict(t, path, sizes)

        for batch in batches:
            texts = batch.column(text).to_pylist()
            result: list[tuple] = []
            held: list[tuple] = []
            waiting = 0
            for words in word_groups(batch.column(text), LETTERS, LOWER_ASCII):
                if not names:
                    result += [(UNKNOWN, 0.0, [])] * words.n_rows
                    continue
                if len(words.starts) * len(names) > SCORES_AT_ONCE or len(words.data) > BYTES_AT_ONCE:
                    if held:
                        n = sum(len(h[0]) for h in held)
                        result += judge([t or "" for t in texts[len(result):len(result) + n]], held)
                        held, waiting = [], 0
                    for a, b in zip(words.row_bounds[:-1], words.row_bounds[1:]):
                        result.append(judge_in_pieces(texts[len(result)] or "", words.part(slice(a, b))))
                    continue
                if len(words.starts):
                    scores = word_scores(model, words)
                else:
                    scores = np.zeros((0, len(names)), dtype=np.float32)
                held.append((np.diff(words.row_bounds), scores, words.ends - words.starts))
                waiting += scores.size
                if waiting > SCORES_AT_ONCE:
                    n = sum(len(h[0]) for h in held)
                    result += judge([t or "" for t in texts[len(result):len(result) + n]], held)
                    held, waiting = [], 0
            if held:
                result += judge([t or "" for t in texts[len(result):]], held)
            columns = list(zip(*result)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], kind)],
                [f.name for f in out])

    return given.mapInArrow(label, out)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
