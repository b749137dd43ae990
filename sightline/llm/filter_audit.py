"""Filter interaction audit: what each filter removes, in every order of the filters.

Spark counts the documents of each part by their failure mask (which filters they fail) and labels.  A part's
counts form a decision diagram: one level per filter, each node with a child for documents that pass and one
for documents that fail, its weight the documents below it, equal nodes shared.  Swapping two adjacent levels
keeps all other levels, so a walk of such swaps through all orders rebuilds nothing; the path on which
everything passes then reads off an order's steps: its nodes are what is kept, their failing children what goes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
LETTERS = "ABCDE"

Counts = tuple[int, int, int]  # documents, good ones, toxic ones

STEPS = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()),
    T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])


class Diagram:
    """Count-weighted decision diagram over failure masks; level ``i`` tests ``order[i]``.

    Every path visits every level, so a swap touches two levels only.  Nodes are numbers; ``children`` has
    (pass, fail) of inner nodes and ``weight`` the counts of all.  Nodes of a level are shared if their
    children (for leaves: their counts) agree.
    """

    def __init__(self, order: Sequence[str], counts: Mapping[int, Counts]) -> None:
        self.order = list(order)
        self.children: list[tuple[int, int] | None] = []
        self.weight: list[Counts] = []
        leaves: dict[Counts, int] = {}
        row = []
        for mask in range(1 << len(order)):
            held = counts.get(mask, (0, 0, 0))
            if held not in leaves:
                leaves[held] = self._add(None, held)
            row.append(leaves[held])
        # Masks have the first filter as their least bit, so the last level splits a row into halves.
        self.levels: list[list[int]] = []
        for _ in order:
            half, known = len(row) // 2, {}
            row = [self._node(known, row[i], row[i + half]) for i in range(half)]
            self.levels.insert(0, list(known.values()))
        self.root = row[0]

    def _add(self, children: tuple[int, int] | None, weight: Counts) -> int:
        self.children.append(children)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, known: dict[tuple[int, int], int], passing: int, failing: int) -> int:
        if (passing, failing) not in known:
            a, b = self.weight[passing], self.weight[failing]
            known[passing, failing] = self._add((passing, failing), (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
        return known[passing, failing]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes of ``level`` keep their numbers and weights."""
        below: dict[tuple[int, int], int] = {}
        for node in self.levels[level]:
            passing, failing = self.children[node]
            (both, second_only), (first_only, neither) = self.children[passing], self.children[failing]
            self.children[node] = (self._node(below, both, first_only), self._node(below, second_only, neither))
        self.levels[level + 1] = list(below.values())
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> Iterator[tuple[str, Counts, Counts]]:
        """Per level: its filter, what is kept after it and what it removes."""
        node = self.root
        for name in self.order:
            passing, failing = self.children[node]
            yield name, self.weight[passing], self.weight[failing]
            node = passing


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions of the adjacent swaps that lead through all orders of ``n`` things, each once."""
    if n < 2:
        return
    # The last thing travels to one end and back; at each end the others make one step of their own.
    inner, leftwards = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if leftwards else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if leftwards else step
        leftwards = not leftwards


def audit_part(counts: Mapping[int, Counts], letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    diagram = Diagram(letters, counts)
    paths = {"".join(diagram.order): list(diagram.all_pass_path())}
    for level in adjacent_swaps(len(letters)):
        diagram.swap(level)
        paths["".join(diagram.order)] = list(diagram.all_pass_path())
    fails, alone, shapley = {}, {}, dict.fromkeys(letters, 0)
    for path in paths.values():
        for name, _, removed in path:
            shapley[name] += removed[0]
        # The first filter removes all that fail it, the last one those that fail nothing else.
        fails[path[0][0]], alone[path[-1][0]] = path[0][2][0], path[-1][2][0]
    for order in sorted(paths):
        for step, (name, kept, removed) in enumerate(paths[order], 1):
            yield (order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2],
                   shapley[name])


def _mask(conditions: Sequence[Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def failure_masks(documents: DataFrame, part: str = "source") -> DataFrame:
    """Per document: doc_id, part, digest of the text, mask of the failures that a text alone decides (bits A to D)."""
    words = F.array_remove(F.split("text", SPACE), "")
    base = documents.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"))
    counted = base.withColumn("_words", words).select(
        "doc_id", "part", "text", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_distinct"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    return counted.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        _mask([
            F.col("_n") < MIN_WORDS,
            100 * F.col("_distinct") < MIN_DISTINCT_PERCENT * F.col("_n"),
            100 * capitals > MAX_CAPITALS_PERCENT * F.length("text"),
            F.col("text").rlike(SYMBOLS),
        ]).alias("mask"))


def failure_cells(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Documents per (part, mask of all five failures, good, toxic).

    Failure E: a smaller doc_id has the same text, anywhere in the table.  Copies of a text share the other
    failures, so they are counted per text, part and label first, and only these counts meet per text; no
    row looks for its copies.  Rows of the least doc_id of a text pass; a null doc_id is neither smaller nor
    larger than any and passes.  A document with several label rows is good (toxic) if any says so.
    """
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    rows = failure_masks(documents, part).join(known, "doc_id", "left").select(
        "doc_id", "part", "digest", "mask", *flags)
    kind = ["digest", "mask", "part", "good", "toxic"]
    per_text = rows.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("_unnamed"))
    least = F.min("_first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("_unnamed") + F.when(F.col("_first.doc_id") == F.col("_least"), F.col("_first.n")).otherwise(F.lit(0))
    return per_text.withColumn("_least", least).withColumn("_pass", passing).groupBy(
        "part", "mask", "good", "toxic").agg(
        F.sum("_pass").alias("passing"), F.sum(F.col("n") - F.col("_pass")).alias("failing"))


def audit_filters(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step (see :data:`STEPS`).

    ``documents`` has doc_id, text and the column that names the part; ``labels`` has doc_id, quality and
    toxic; other columns are not read.  Null text is empty, a null part is the empty string, and so are
    their empty kin.  Repeated rows count each, with the same doc_id none fails E for the other.  An empty
    table has no part and gives no row; without labels good_lost and toxic_lost are 0.

    The rows of a part that reach Python are its at most 64 cells.
    """
    cells = failure_cells(documents, labels, part).groupBy("part").agg(
        F.collect_list(F.struct("mask", "good", "toxic", "passing", "failing")).alias("cells"))
    last = 1 << (len(LETTERS) - 1)

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts: dict[int, Counts] = {}
                for cell in row["cells"]:
                    for mask, n in ((cell["mask"], cell["passing"]), (cell["mask"] | last, cell["failing"])):
                        a, b, c = counts.get(mask, (0, 0, 0))
                        counts[mask] = (a + n, b + n * cell["good"], c + n * cell["toxic"])
                steps = list(audit_part(counts))
                columns = [[row["part"]] * len(steps), *map(list, zip(*steps))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7))],
                    STEPS.names)

    return cells.mapInArrow(audit, STEPS)
