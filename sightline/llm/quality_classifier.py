"""Quality classifier by co-training of a text view and a metadata view.

Every document has a vector of text measures and hashed words (text view) and its length, language and
source (metadata view).  Both views train a logistic regression on a bounded sample of labelled rows; in
each round either view judges all unlabelled documents, and the other view trains on those that it is
surest of as well.  Their share of the Newton steps is added up in the tasks, so no unlabelled document
leaves them.  Both views are calibrated on labelled rows kept aside and their evidence is added up to one
score, with which all documents are judged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.llm.textops import ALPHANUMERIC, NOT_SPACE, Words, covered_words, word_groups
from sightline.session import cut_lineage

# Most labelled rows that reach the driver: those with the least hash of the id.
LABELLED_ROWS = 20_000
ROUNDS = 3
# Newton steps per round, from where the round before ended.
STEPS = 4
# Share of the unlabelled documents that a view may label per round and class, and how sure it must be.
PER_ROUND = 0.05
SURE = 0.95
# Documents are counted by calibrated log-odds from -30 to 30, in so many bins per unit.
BINS_PER_UNIT = 16
# Rows kept aside for calibration: one in so many.
ASIDE = 5
THRESHOLD = 0.5
RIDGE = 1e-2
LENGTH_CLASSES = 24
# A language or source has a weight of its own from so many labelled rows of the sample on; the rest share one.
CLASS_ROWS = 10
# Words and pairs of words are hashed to so many features each.
WORD_FEATURES = 64
SHINGLE = 5

TEXT_MEASURES = (
    "log_words", "word_length", "symbols", "bars", "marks", "capitals", "digits", "non_ascii", "line_ends",
    "distinct_words", "same_as_previous", "repeated_windows", "odd_word_ends", "no_space_share")
TEXT_WIDTH = len(TEXT_MEASURES) + 2 * WORD_FEATURES


def text_vectors(words: Words) -> np.ndarray:
    """(texts, measures) of a group of texts; texts without words are zero."""
    n_rows, data = words.n_rows, words.data
    size = np.diff(words.bounds).astype(np.float64)
    n = np.diff(words.row_bounds).astype(np.float64)
    some, chars = np.maximum(n, 1), np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mask), words.bounds)) / chars

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.rows, weights=mask, minlength=n_rows) / some

    def is_in(letters: bytes) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[list(letters)] = True
        return table[data]

    h = words.hashes
    order = np.lexsort((h, words.rows))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (words.rows[order][1:] != words.rows[order][:-1])
    distinct = np.bincount(words.rows[order], weights=new, minlength=n_rows) / some
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (words.rows[1:] == words.rows[:-1])
    start, windows = words.windows(SHINGLE)
    rows = words.rows[start]
    by = np.lexsort((windows, rows))
    equal = np.zeros(len(by), dtype=bool)
    equal[1:] = (windows[by][1:] == windows[by][:-1]) & (rows[by][1:] == rows[by][:-1])
    equal[:-1] |= equal[1:]
    repeated = covered_words(len(h), start[by][equal], SHINGLE)
    last = data[words.ends - 1] if len(h) else np.zeros(0, dtype=np.uint8)
    odd = ~ALPHANUMERIC[last] & ~np.isin(last, np.frombuffer(b".,", dtype=np.uint8))
    upper = (data >= ord("A")) & (data <= ord("Z"))
    digit = (data >= ord("0")) & (data <= ord("9"))
    vectors = np.column_stack([
        np.log1p(n), np.bincount(words.rows, weights=words.ends - words.starts, minlength=n_rows) / some,
        share(is_in(b"#*$%&<>")), share(is_in(b"|")), share(is_in(b"!?")), share(upper), share(digit),
        share(data >= 0x80), share(is_in(b"\n")), distinct, per_word(same), per_word(repeated), per_word(odd),
        size / chars - share(~NOT_SPACE[data])])
    vectors[n == 0] = 0
    return np.column_stack([vectors, _hashed(words, 1), _hashed(words, 2)])


def _hashed(words: Words, size: int) -> np.ndarray:
    """Square roots of the shares of hashed runs of ``size`` words in each text."""
    start, hashes = words.windows(size)
    rows = words.rows[start]
    cell = rows * WORD_FEATURES + (hashes % np.uint64(WORD_FEATURES)).astype(np.int64)
    counts = np.bincount(cell, minlength=words.n_rows * WORD_FEATURES).reshape(words.n_rows, WORD_FEATURES)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))


@dataclass
class Metadata:
    """Languages and sources with weights of their own; null is a class, and so are all other values together."""

    languages: list[str]
    sources: list[str]

    @classmethod
    def of(cls, lang: list[str | None], source: list[str | None]) -> Metadata:
        def frequent(values: list[str | None]) -> list[str]:
            return sorted(v for v, n in Counter(values).items() if v is not None and n >= CLASS_ROWS)
        return cls(frequent(lang), frequent(source))

    def vectors(self, n_chars: list[int | None], lang: list[str | None], source: list[str | None]) -> np.ndarray:
        """The length's logarithm, and one-hot length class, language and source."""
        length = np.array([max(x or 0, 0) for x in n_chars], dtype=np.int64)
        out = np.zeros((len(length), 1 + LENGTH_CLASSES + len(self.languages) + len(self.sources) + 4))
        out[:, 0] = np.log1p(length)
        row, at = np.arange(len(length)), 1
        out[row, at + np.minimum(np.log2(length + 1.0).astype(np.int64), LENGTH_CLASSES - 1)] = 1
        at += LENGTH_CLASSES
        for known, values in ((self.languages, lang), (self.sources, source)):
            place = {v: i + 2 for i, v in enumerate(known)} | {None: 0}
            out[row, at + np.array([place.get(v, 1) for v in values], dtype=np.int64)] = 1
            at += len(known) + 2
        return out


def _squash(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


@dataclass
class Logistic:
    """Ridge logistic regression on standardised columns, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def start(cls, x: np.ndarray) -> Logistic:
        scale = x.std(axis=0)
        return cls(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(x.shape[1] + 1))

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    def statistics(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Hessian and gradient of weighted rows and their total weight, as one vector that can be added up."""
        z = self.design(x)
        p = _squash(z @ self.weights)
        v = weight * np.maximum(p * (1 - p), 1e-6)
        return np.concatenate([((z * v[:, None]).T @ z).ravel(), z.T @ (weight * (y - p)), [weight.sum()]])

    def step(self, statistics: np.ndarray) -> None:
        """One Newton step; weights are rounded, so that the order of the sums does not show."""
        d = len(self.weights)
        ridge = np.full(d, RIDGE * statistics[-1])
        ridge[0] = 1e-6
        change = np.linalg.solve(
            statistics[:d * d].reshape(d, d) + np.diag(ridge), statistics[d * d:-1] - ridge * self.weights)
        self.weights = np.round(self.weights + change, 9)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:], -30, 30)


@dataclass
class QualityModel:
    text: Logistic | None
    metadata: Logistic | None
    calibration: np.ndarray | None  # intercept, text, metadata
    views: tuple[np.ndarray, np.ndarray] | None  # calibration of each view alone: slope and intercept
    prior: float
    classes: Metadata | None = None

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by the text, the metadata, and both."""
        if self.calibration is None:
            flat = np.full(len(text), self.prior)
            return flat, flat, flat
        a, b = self.text.logit(text), self.metadata.logit(metadata)
        (ta, tb), (ma, mb) = self.views
        c = self.calibration
        return _squash(ta * a + tb), _squash(ma * b + mb), _squash(c[0] + c[1] * a + c[2] * b)


def _platt(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (intercept first) of a logistic fit on logits, with smoothed targets; never negative slopes."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    z = np.column_stack([np.ones(len(y)), logits])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        w += np.linalg.solve((z * v[:, None]).T @ z + 1e-3 * np.eye(z.shape[1]), z.T @ (target - p) - 1e-3 * w)
    w[1:] = np.maximum(w[1:], 0)
    return w


@dataclass
class Teacher:
    """A view's model with its calibration, and the bins from which on it is sure of a class."""

    model: Logistic
    calibration: np.ndarray
    bad: int = -1
    good: int = 60 * BINS_PER_UNIT + 1
    weight_bad: float = 0.0
    weight_good: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        t = self.calibration[0] + self.calibration[1] * self.model.logit(x)
        return np.floor((np.clip(t, -30, 30) + 30) * BINS_PER_UNIT).astype(np.int64)

    def choose(self, counts: np.ndarray, rate: float, labelled: int) -> None:
        """Limits and weights of what this view teaches, from the number of documents in each bin.

        Bins are taken whole, the outermost one always.  Both classes weigh in the proportion of the labelled
        rows, or the metadata view would shift its prior, and together at most as much as the labelled rows.
        """
        most = PER_ROUND * counts.sum()
        odds = np.log(SURE / (1 - SURE))
        upper, lower = int(np.ceil((30 + odds) * BINS_PER_UNIT)), int(np.floor((30 - odds) * BINS_PER_UNIT)) - 1
        filled = np.flatnonzero(counts)
        if not len(filled):
            return
        above, below = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
        self.good = max(upper, min(int(np.argmax(above <= most)) if above[-1] <= most else len(counts), int(filled[-1])))
        self.bad = min(lower, max(int(np.sum(below <= most)) - 1, int(filled[0])))
        good, bad = counts[self.good:].sum(), counts[:self.bad + 1].sum()
        if not good or not bad:
            return
        use_bad = min(bad, good * (1 - rate) / rate)
        use_good = use_bad * rate / (1 - rate)
        shrink = min(1.0, labelled / (use_bad + use_good))
        self.weight_good, self.weight_bad = shrink * use_good / good, shrink * use_bad / bad

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each row; rows that this view is not sure of weigh nothing."""
        at = self.bins(x)
        good, bad = at >= self.good, at <= self.bad
        return good.astype(np.float64), good * self.weight_good + bad * self.weight_bad


# Adds up a function of (text vectors, metadata vectors) over all unlabelled documents.
OverPool = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def _bin_counts(teachers: list[Teacher], *x: np.ndarray) -> np.ndarray:
    """Rows by bin of either view."""
    size = 60 * BINS_PER_UNIT + 1
    return np.concatenate([np.bincount(t.bins(v), minlength=size) for t, v in zip(teachers, x)]).astype(np.float64)


def _taught(teachers: list[Teacher], models: list[Logistic], *x: np.ndarray) -> np.ndarray:
    """Statistics of both views' models, each on what the other view is sure of."""
    parts = []
    for k in (0, 1):
        y, weight = teachers[1 - k].labels(x[1 - k])
        use = weight > 0
        parts.append(models[k].statistics(x[k][use], y[use], weight[use]))
    return np.concatenate(parts)


def co_train(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, over_pool: OverPool) -> QualityModel:
    """Model from labelled rows (``y`` 1: good) in a fixed order and all unlabelled ones."""
    if not len(y) or y.min() == y.max() or min(y.sum(), (1 - y).sum()) < 5:
        return QualityModel(None, None, None, None, float(y.mean()) if len(y) else 1.0)
    aside = np.arange(len(y)) % ASIDE == 0
    if y[aside].min() == y[aside].max() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), dtype=bool)
    held = aside if aside.any() else ~aside
    views, own = (text, metadata), y[~aside]
    models = [Logistic.start(v[~aside]) for v in views]

    def labelled(k: int) -> np.ndarray:
        return models[k].statistics(views[k][~aside], own, np.ones(len(own)))

    for _ in range(3 * STEPS):
        for k in (0, 1):
            models[k].step(labelled(k))
    for _ in range(ROUNDS):
        teachers = [
            Teacher(replace(m), _platt(m.logit(v[held])[:, None], y[held])) for m, v in zip(models, views)]
        for t, counts in zip(teachers, np.split(over_pool(partial(_bin_counts, teachers)), 2)):
            t.choose(counts, float(own.mean()), len(own))
        for _ in range(STEPS):
            taught = over_pool(partial(_taught, teachers, models))
            cut = len(models[0].weights) * (len(models[0].weights) + 1) + 1
            for k, part in enumerate((taught[:cut], taught[cut:])):
                models[k].step(labelled(k) + part)
    a, b = models[0].logit(text[held]), models[1].logit(metadata[held])
    one = [_platt(x[:, None], y[held]) for x in (a, b)]
    both = _platt(np.column_stack([a, b]), y[held])
    return QualityModel(models[0], models[1], both, tuple(np.array([w[1], w[0]]) for w in one), float(y.mean()))


# Text vectors travel as bytes of 32-bit numbers, about 600 a row.
_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_view", T.BinaryType()), T.StructField("n_chars", T.LongType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
_SUMS = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("sums", T.BinaryType())])
# Sums of tasks meet in so many slots before they meet on the driver.
SLOTS = 256
# Rows whose vectors are dense at once.
DENSE_ROWS = 2_048


def _text_views(column: pa.Array) -> np.ndarray:
    text = [text_vectors(w).astype(np.float32) for w in word_groups(column)]
    return np.vstack(text) if text else np.zeros((0, TEXT_WIDTH), dtype=np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([row.tobytes() for row in _text_views(batch.column(1))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), text, *batch.columns[2:5]], _FEATURES.names)


def _inputs(documents: DataFrame) -> list:
    return [F.col("text"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source")]


def _matrices(rows: pa.Table | pa.RecordBatch, classes: Metadata) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(rows.column("text_view").to_pylist()), dtype=np.float32).reshape(-1, TEXT_WIDTH)
    return text.astype(np.float64), classes.vectors(*(rows.column(c).to_pylist() for c in ("n_chars", "lang", "source")))


def _over(pool: DataFrame, classes: Metadata) -> OverPool:
    """Sums over the written vectors: one vector per task, added up by slot, then on the driver."""
    def total(work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        shared = pool.sparkSession.sparkContext.broadcast((classes, work))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, run = shared.value
            sums = run(np.zeros((0, TEXT_WIDTH)), own.vectors([], [], []))
            for batch in batches:
                for at in range(0, batch.num_rows, DENSE_ROWS):
                    sums = sums + run(*_matrices(batch.slice(at, DENSE_ROWS), own))
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "sums": [sums.tobytes()]})

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for one in batch.column("sums"):
                    part = np.frombuffer(one.as_py(), dtype=np.float64)
                    sums = part if sums is None else sums + part
            if sums is not None:
                yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "sums": [sums.tobytes()]})

        rows = pool.mapInArrow(summed, _SUMS).repartition("slot").mapInArrow(merged, _SUMS).collect()
        shared.unpersist()
        nothing = work(np.zeros((0, TEXT_WIDTH)), classes.vectors([], [], []))
        return sum((np.frombuffer(r["sums"], dtype=np.float64) for r in rows), nothing)

    return total


def fit(documents: DataFrame, labels: DataFrame) -> QualityModel:
    """Co-trained model from ``labels`` (doc_id, quality 0 or 1; other values and nulls are left out).

    At most LABELLED_ROWS labelled documents reach the driver; all others take part in their tasks, in
    ROUNDS * (1 + STEPS) jobs over written vectors.  A document with contradicting labels counts as bad.
    Without both classes the model scores every document with the share of good labels (1 if there is none).
    """
    known = (
        labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality")))
    vectors = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(documents)).mapInArrow(_features, _FEATURES)
    # Small vectors are written once; the texts are not shuffled.  A hash decides who may enter the sample.
    both = cut_lineage(vectors.join(known, "doc_id", "left").withColumn("_order", F.xxhash64("doc_id")))
    # Equal hashes only come from repeated ids; the other columns settle their order.
    order = ["_order", "doc_id", "text_view", "n_chars", "lang", "source"]
    sample = both.where("quality IS NOT NULL").orderBy(*order).limit(LABELLED_ROWS).drop("_order", "doc_id").toArrow()
    classes = Metadata.of(sample.column("lang").to_pylist(), sample.column("source").to_pylist())
    pool = both.where("quality IS NULL").select("text_view", "n_chars", "lang", "source")
    y = sample.column("quality").to_numpy().astype(np.float64)
    return replace(co_train(*_matrices(sample, classes), y, _over(pool, classes)), classes=classes)


def score(documents: DataFrame, model: QualityModel, prefix: str = "") -> DataFrame:
    """``documents`` with ``p_text``, ``p_metadata``, ``score`` and ``kept`` (score of at least 0.5).

    Null texts have no words, null metadata are classes of their own, repeated rows are judged alike;
    columns of those four names, each after ``prefix``, are replaced.
    """
    names = [prefix + n for n in ("p_text", "p_metadata", "score", "kept")]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.drop(*names)
    out = T.StructType([
        *given.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names[:3]],
        T.StructField(names[3], T.BooleanType())])
    width = len(given.columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _text_views(batch.column(width)).astype(np.float64)
            metadata = [batch.column(width + i).to_pylist() for i in (1, 2, 3)]
            parts = [shared.value.scores(text[at:at + DENSE_ROWS], shared.value.classes.vectors(*(m[at:at + DENSE_ROWS] for m in metadata)))
                     for at in range(0, len(text), DENSE_ROWS)]
            found = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 3
            columns = [*batch.columns[:width], *[pa.array(x, pa.float64()) for x in found], pa.array(found[2] >= THRESHOLD)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out])

    inputs = [c.alias(f"_view{i}") for i, c in enumerate(_inputs(given))]
    return given.select("*", *inputs).mapInArrow(judge, out)
