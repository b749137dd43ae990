"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

One pass over the texts finds base spans and candidates with their votes.  Spark counts the vote patterns of
each kind over all documents; expectation-maximisation on these counts (at most 243 per kind) estimates how
reliable each labeler is and gives every pattern a probability.  With it as label a logistic model of hashed
span features is trained on the candidates of all documents, one Spark aggregate a step, and judges each
candidate by itself, also those on which no labeler votes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.llm.pii_labelers import FEATURES, FEATURES_PER_SPAN, KINDS, LABELERS, base_spans, candidates
from sightline.session import cut_lineage, release

# Expectation-maximisation: rounds, and what the prior counts for against the candidates of a kind.
EM_ROUNDS = 100
PRIOR_SHARE = 0.5
# What each labeler is expected to vote on false and on true spans: against, none, for.  A checksum seldom
# fails on a true span and passes by chance on one false span in ten; cue words are often missing.
PRIOR_VOTES = np.array([
    [[0.6, 0.3, 0.1], [0.4, 0.45, 0.15], [0.2, 0.7, 0.1], [0.15, 0.8, 0.05], [0.35, 0.3, 0.35]],
    [[0.02, 0.3, 0.68], [0.1, 0.4, 0.5], [0.05, 0.55, 0.4], [0.05, 0.75, 0.2], [0.1, 0.3, 0.6]]])
# Training: steps of the logistic model, its ridge, and the fixed-point unit of the summed gradient.
STEPS = 12
RIDGE = 1.0
UNIT = 1 << 20
ACCEPT = 0.5

_SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("score", T.DoubleType())])
_CANDIDATE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("pattern", T.LongType()), T.StructField("features", T.BinaryType())])
_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("candidates", T.ArrayType(_CANDIDATE))])
_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("base", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN))])

_ARROW_CANDIDATES = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int64()),
    ("features", pa.binary())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

Labels = Mapping[tuple[str, int], float]


def pattern_of(votes: tuple[int, ...]) -> int:
    """Votes as one number: a digit of base three per labeler."""
    number = 0
    for v in votes:
        number = number * 3 + v + 1
    return number


def votes_of(pattern: int) -> list[int]:
    digits = []
    for _ in LABELERS:
        digits.append(pattern % 3)
        pattern //= 3
    return digits[::-1]


def candidate_spans(documents: DataFrame) -> DataFrame:
    """doc_id and candidates (base spans first, by kind and start) of every document; null text has none."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                rows.append([
                    {"kind": c.span.kind, "start": c.span.start, "end": c.span.end, "base": c.base,
                     "pattern": pattern_of(c.votes), "features": c.features}
                    for c in candidates(text, base_spans(text))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(rows, _ARROW_CANDIDATES)], _FOUND.names)

    return documents.select("doc_id", "text").mapInArrow(find, _FOUND)


def estimate_reliabilities(counts: Mapping[int, int]) -> tuple[dict[int, float], np.ndarray, float]:
    """Probability of each vote pattern of one kind, the vote shares [class, labeler, vote], and the share of true spans.

    Votes are taken as independent given the truth.  The prior weighs a fixed share of the candidates, so the
    outcome depends on the mix of patterns and not on how many documents there are.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=np.float64)
    votes = np.array([votes_of(p) for p in patterns])
    weight = PRIOR_SHARE * n.sum()
    share, shares = 0.5, PRIOR_VOTES.copy()
    labeler = np.arange(len(LABELERS))
    for _ in range(EM_ROUNDS):
        log = [np.log(p) + np.log(shares[c][labeler, votes]).sum(axis=1) for c, p in ((0, 1 - share), (1, share))]
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        for c, held in ((0, n * (1 - truth)), (1, n * truth)):
            for j in labeler:
                seen = np.bincount(votes[:, j], held, minlength=3)
                shares[c, j] = (seen + weight * PRIOR_VOTES[c, j]) / (seen.sum() + weight)
        share = float(((n * truth).sum() + 0.5 * weight) / (n.sum() + weight))
    return dict(zip(patterns, truth.tolist())), shares, share


def label_patterns(found: DataFrame) -> tuple[dict[tuple[str, int], float], dict[str, np.ndarray]]:
    """Probability of each (kind, pattern) and the labelers' vote shares per kind, from all documents (runs a job)."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.pattern").count().collect()
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for kind, pattern, n in rows:
        counts[kind][pattern] = n
    labels, reliabilities = {}, {}
    for kind, held in counts.items():
        truth, reliabilities[kind], _ = estimate_reliabilities(held)
        labels |= {(kind, p): v for p, v in truth.items()}
    return labels, reliabilities


def _indices(features: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(features.to_pylist()), dtype="<u2").reshape(-1, FEATURES_PER_SPAN)


def _score(weights: np.ndarray, indices: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[indices].sum(axis=1), -30, 30)))


def train_classifier(found: DataFrame, labels: Labels, steps: int = STEPS) -> np.ndarray:
    """Weights of the hashed features, fitted to the labels of all candidates (runs a job per step).

    Equal candidates are counted first.  A step adds up gradients per feature in whole units, so the sums do
    not depend on the partitioning; its length is that of the quadratic bound on the loss, under which rows of
    ten features never overshoot.  The driver gets one number per feature.
    """
    rows = cut_lineage(found.select(F.explode("candidates").alias("c")).groupBy(
        "c.kind", "c.pattern", "c.features").agg(F.count(F.lit(1)).alias("n")))
    weights = np.zeros(FEATURES)
    known = dict(labels)

    def summed(weights: np.ndarray) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, held = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                indices, n = _indices(batch.column("features")), batch.column("n").to_numpy()
                truth = np.array([known[k] for k in zip(
                    batch.column("kind").to_pylist(), batch.column("pattern").to_pylist())])
                error = np.rint((truth - _score(weights, indices)) * UNIT).astype(np.int64) * n
                np.add.at(gradient, indices.ravel(), np.repeat(error, FEATURES_PER_SPAN))
                np.add.at(held, indices.ravel(), np.repeat(n, FEATURES_PER_SPAN))
            seen = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.astype(np.int64)), pa.array(gradient[seen]), pa.array(held[seen])], ["feature", "gradient", "n"])

        return rows.mapInArrow(add, "feature long, gradient long, n long").groupBy("feature").agg(
            F.sum("gradient").alias("gradient"), F.sum("n").alias("n"))

    for _ in range(steps):
        table = summed(weights).toArrow()
        at, gradient, n = (table[c].to_numpy() for c in ("feature", "gradient", "n"))
        weights[at] += (gradient / UNIT - RIDGE * weights[at]) / (n * FEATURES_PER_SPAN / 4 + RIDGE)
    release(rows)
    return weights


def _without_overlaps(spans: list[tuple]) -> list[tuple]:
    """The surest spans (then the first, the longest) of (kind, start, end, score) that do not overlap."""
    kept: list[tuple] = []
    for span in sorted(spans, key=lambda s: (-s[3], s[1], -s[2], KINDS.index(s[0]))):
        if all(span[1] >= k[2] or span[2] <= k[1] for k in kept):
            kept.append(span)
    return kept


def find_personal_data(documents: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end, score; code points, end exclusive), a row per document.

    ``base`` has the matches of the fixed patterns (email, ip, card, phone) and score 1; ``spans`` has them and
    the candidates that the trained classifier gives at least ``accept``, none of which touches a base span or
    another added one.  Both are in the order of :data:`KINDS`, then of the start.

    Null and empty texts have no spans; repeated rows count and are returned as often as they come; null ids
    stay null; an empty table gives no rows; only doc_id and text are read.  Of texts without any candidate
    nothing is learnt and the base alone is returned.

    Runs jobs: candidates are written to the checkpoint folder; vote patterns and one weight per feature pass
    through the driver, neither of which grows with the documents.
    """
    found = cut_lineage(candidate_spans(documents))
    labels, _ = label_patterns(found)
    weights = train_classifier(found, labels) if labels else np.zeros(FEATURES)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_rows, span_rows = [], []
            for held in batch.column("candidates").to_pylist():
                base = [(c["kind"], c["start"], c["end"], 1.0) for c in held if c["base"]]
                wide = [c for c in held if not c["base"]]
                scores = _score(weights, _indices(pa.array([c["features"] for c in wide], pa.binary()))) if wide else []
                added = _without_overlaps([
                    (c["kind"], c["start"], c["end"], float(s)) for c, s in zip(wide, scores) if s >= accept])
                names = [f.name for f in _SPAN]
                base_rows.append([dict(zip(names, s)) for s in base])
                span_rows.append([dict(zip(names, s)) for s in sorted(
                    base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base_rows, _ARROW_SPANS), pa.array(span_rows, _ARROW_SPANS)], _RESULT.names)

    return found.mapInArrow(decide, _RESULT)

