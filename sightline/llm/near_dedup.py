"""MinHash near-dedup: BagMinHash signatures of five-word shingles, banding, verified multiset overlap.

1. One pass makes a signature per document; exact copies fall together by digest before anything else.
2. Every band of a signature is a bucket key.  The members of a bucket are tied to its least member, and
   the connected ties are families: all pairs that share a bucket lie in one family.
3. Families are cut by size class (similar multisets differ in size by a quarter at most) and into blocks
   of bounded size.  Inside a block the overlaps of all multisets are counted exactly by a product of
   membership matrices; one link per member leaves it, to the least member of its component there.
4. The classes are the connected components of the links.

So every pair that shares a band is verified, while rows grow with the documents and not with the pairs.

Tables of nodes are taken for much less than they are: their files are packed, and bands, salts and parts
repeat their rows.  Their joins carry a sort-merge hint, since a broadcast would pass through the driver.
Only joins on the digest are left to the sizes that adaptive execution measures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sightline.llm.bag_minhash import signatures
from sightline.llm.components import components
from sightline.llm.textops import ALPHANUMERIC, LOWER_ASCII, Words, mix, word_groups
from sightline.operators.ordering import salted_join
from sightline.session import cut_lineage

SHINGLE = 5
SIMILARITY_TENTHS = 8
# 32 bands of 4 registers: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, BAND_REGISTERS = 32, 4
REGISTERS = BANDS * BAND_REGISTERS
# Most members of a block, rows and columns of a piece of its overlap matrix, and members per task of small families.
BLOCK = 4_096
STRIP, COLUMNS = 256, 2_048
TASK_MEMBERS = 2_000
# Shingles that are signed at once (about 100 bytes each).
ELEMENTS_AT_ONCE = 600_000

_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])
_SHINGLES = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.BinaryType())])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingles_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; a text of fewer than five words is one shingle."""
    at, hashes = words.windows(SHINGLE)
    rows = [words.rows[at]]
    found = [hashes]
    counts = np.diff(words.row_bounds)
    for size in range(1, SHINGLE):
        at, hashes = words.windows(size)
        short = counts[words.rows[at]] == size
        rows.append(words.rows[at[short]])
        found.append(hashes[short])
    return np.concatenate(rows), np.concatenate(found)


def counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, hash) with the first index of each distinct pair and the number of each."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows, hashes, first, np.diff(np.append(first, len(rows)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of many documents at once: a step costs the same for few elements as for some thousands."""
    for batch in batches:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first_row = n_rows = elements = 0

        def flush() -> pa.RecordBatch:
            rows, hashes, counts = (np.concatenate(x) for x in zip(*held))
            found = signatures(rows, hashes, counts, n_rows, REGISTERS).astype(np.uint32)
            has = np.bincount(rows, minlength=n_rows) > 0
            own = [s.tobytes() if h else None for s, h in zip(found, has)]
            part = batch.slice(first_row, n_rows)
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())], _SIGNED.names)

        for words in word_groups(batch.column(2), ALPHANUMERIC, LOWER_ASCII):
            rows, hashes, first, counts = counted(*shingles_of(words))
            held.append((rows[first] + n_rows, hashes[first], counts))
            n_rows += words.n_rows
            elements += len(first)
            if elements >= ELEMENTS_AT_ONCE:
                yield flush()
                held, first_row, n_rows, elements = [], first_row + n_rows, 0, 0
        if held:
            yield flush()


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).astype(np.uint64)
        found = found.reshape(-1, BANDS, BAND_REGISTERS)
        key = np.tile(mix(band + np.uint64(1)), (len(found), 1))
        for i in range(BAND_REGISTERS):
            key = mix(key ^ found[:, :, i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "node"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the sorted hashes of its shingles; the k-th repeat of a shingle is an element of its own."""
    for batch in batches:
        for words in word_groups(batch.column(1), ALPHANUMERIC, LOWER_ASCII):
            rows, hashes, first, counts = counted(*shingles_of(words))
            repeat = np.arange(len(rows)) - np.repeat(first, counts)
            elements = np.where(repeat, mix(hashes + repeat.astype(np.uint64)), hashes)
            bounds = np.searchsorted(rows, np.arange(words.n_rows + 1))
            sets = [np.sort(elements[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            part = batch.slice(words.first_row, words.n_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(bounds)), pa.array(sets, pa.binary())], _SHINGLES.names)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Row by row, how many elements each set of ``left`` shares with every set of ``right``.

    Elements in one set only are left out; the others are columns of two 0/1 matrices, whose product is
    taken in pieces of bounded size.
    """
    sets = left + right
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count >= 2
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    use = shared[column]
    owner, column, width = owner[use], place[column[use]], int(shared.sum())
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for first in range(0, len(left), STRIP):
        n = min(STRIP, len(left) - first)
        total = np.zeros((n, len(right)), dtype=np.float32)
        for low in range(0, width, COLUMNS):
            inside = slice(*np.searchsorted(column, [low, low + COLUMNS]))
            own, at = owner[inside], column[inside] - low
            mine = (own >= first) & (own < first + n)
            if mine.any():
                a = np.zeros((n, COLUMNS), dtype=np.float32)
                a[own[mine] - first, at[mine]] = 1
                b = np.zeros((COLUMNS, len(right)), dtype=np.float32)
                theirs = own >= len(left)
                b[at[theirs], own[theirs] - len(left)] = 1
                total += a @ b
        for i in range(n):
            yield first + i, total[i]


def _compare(block: pd.DataFrame) -> list[tuple[int, int]]:
    """Links of one block: own members of part i against all members of part j, and the reverse if i < j.

    (member, least member of its component inside the block), for all but the least ones.
    """
    i, j = int(block["i"].iloc[0]), int(block["j"].iloc[0])
    node = block["node"].to_numpy()
    size = block["n"].to_numpy()
    label = np.arange(len(block))
    sets = [np.frombuffer(x, dtype=np.uint64) for x in block["shingles"]]
    part, own = block["part"].to_numpy(), block["own"].to_numpy()
    for x, y in {(i, j), (j, i)}:
        rows, columns = np.flatnonzero((part == x) & own), np.flatnonzero(part == y)
        if not len(rows) or not len(columns):
            continue
        for k, common in overlaps([sets[r] for r in rows], [sets[c] for c in columns]):
            r = rows[k]
            near = columns[(10 * common >= SIMILARITY_TENTHS * (size[r] + size[columns] - common)) & (columns != r)]
            for other in np.unique(label[near]):
                if other != label[r]:
                    label[label == other] = label[r]
    # Each component of the block becomes a star around its least node.
    least = np.full(len(block), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    root = least[label]
    return [(int(a), int(b)) for a, b in zip(node, root) if a != b]


def _compare_blocks(group: pd.DataFrame) -> pd.DataFrame:
    links = [x for _, block in group.groupby(["family", "size_class", "i", "j"]) for x in _compare(block)]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that join the members of each family (node, family) wherever they are similar enough.

    A member of size n belongs to the class floor(log n / log 1.25) as its own and is also seen by the
    class above, so that any two sets whose sizes differ by a quarter at most meet.
    """
    sizes = sets.select("node", "n")
    level = F.floor(F.log("n") / F.log(F.lit(10.0 / SIMILARITY_TENTHS)) + F.lit(1e-9)).cast("int")
    seen = F.explode(F.array(
        F.struct(level.alias("size_class"), F.lit(True).alias("own")), F.struct((level + 1).alias("size_class"), F.lit(False).alias("own"))))
    placed = members.hint("merge").join(sizes, "node").select("node", "n", "family", seen.alias("s")).select("node", "n", "family", "s.*")
    # Groups with something to compare, and the number of parts of each.
    groups = placed.groupBy("family", "size_class").agg(
        F.count("*").alias("members"), F.count_if("own").alias("owners")).where("owners > 0 AND members > 1").select(
        "family", "size_class", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts"))
    dealt = cut_lineage(salted_join(placed.hint("merge"), groups, ["family", "size_class"], ["node"]))
    tasks = dealt.count() // TASK_MEMBERS + 1
    parted = (
        dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("part", "_other"), "j": F.greatest("part", "_other")}))
    group = F.when(F.col("parts") > 1, F.xxhash64("family", "size_class", "i", "j")).otherwise(
        F.pmod(F.xxhash64("family", "size_class"), F.lit(tasks)))
    return (
        parted.withColumn("_group", group).hint("merge").join(sets.select("node", "shingles"), "node")
        .groupBy("_group").applyInPandas(_compare_blocks, _PAIR))


def near_duplicate_classes(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``class_id``, ``class_size``, ``keep`` and ``_digest``: one row per row of ``documents``.

    Documents with equal texts, or whose five-word shingles (with multiplicity) have a weighted Jaccard
    similarity of 0.8 or more, are linked; classes are the connected components.  Words are runs of digits,
    letters and non-ASCII characters, A-Z lower-cased.
    ``class_id`` is the least doc_id of the class, ``keep`` marks the rows with the class's first doc_id and
    its text (several if a row is repeated).  Texts of fewer than five words are one shingle.  Null texts and
    texts without words are linked to nothing, each such row is a class of its own and kept; null doc_ids
    come last in a class.  Other columns are not read.

    Runs jobs and writes tables to the checkpoint folder: nodes, shingle sets of candidates, components.
    """
    given = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), F.col(text).alias("text"))
    signed = given.mapInArrow(_sign, _SIGNED)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    nodes = cut_lineage(
        signed.where(F.col("signature").isNotNull()).groupBy("digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()))

    members = nodes.select("node", "signature").mapInArrow(_band_keys, "bucket long, node long")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("b")).where("size > 1")
    # A node is tied to the least of its buckets' least members (BANDS at most), and those to each other, so that the
    # ties of a large family are about as many as its members.
    least = (
        members.hint("merge").join(buckets, "bucket").where("node <> b").groupBy("node").agg(F.collect_set("b").alias("_all"))
        .withColumn("b", F.array_min("_all")))
    ties = least.select(F.explode(F.array_append("_all", F.col("node"))).alias("a"), "b").where("a <> b").distinct()
    families = components(ties).select("node", F.col("label").alias("family"))

    # The text of a node comes from its first document alone, so copies do not meet in the join.
    wanted = families.hint("merge").join(nodes, "node").select(F.col("digest").alias("_digest"), F.col("first.id").alias("_id"), "node")
    one = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    sets = cut_lineage(
        given.join(wanted, one).select("node", "text").mapInArrow(_shingle_sets, _SHINGLES)
        .groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    labels = components(_links(families, sets))

    classed = nodes.select("node", "digest", "first", "n").hint("merge").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    heads = classed.groupBy("label").agg(
        F.min(F.struct("first", "digest")).alias("head"), F.sum("n").alias("class_size"))
    classed = salted_join(classed.hint("merge"), heads, ["label"], ["node"]).select(
        "digest", F.col("head.first.id").alias("class_id"), F.col("head.digest").alias("head"), "class_size")
    out = given.select("doc_id", "digest").join(classed, "digest", "left")
    alone = F.col("head").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | ((F.col("head") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("keep"),
        F.col("digest").alias("_digest"))


def drop_near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``documents`` with one document of each class: the one with the least doc_id.

    Rows that are repeated as a whole (equal id and text) stay once.  Columns are those of ``documents``.
    """
    kept = (
        near_duplicate_classes(documents, text, doc_id).where("keep")
        .groupBy(F.col("doc_id").alias("_kdoc"), F.col("_digest").alias("_kdigest")).agg(F.count("*").alias("_rows")))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_kdoc")) & F.unhex(F.md5(text)).eqNullSafe(F.col("_kdigest"))
    found = documents.join(kept, same)
    names = documents.columns
    # Only rows that come several times meet in a shuffle; rows without words stay as often as they come.
    single = F.col("_rows") == 1
    wordless = ~F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    repeated = found.where(~single & ~wordless).dropDuplicates(["_kdoc", "_kdigest"])
    return found.where(single | wordless).select(*names).unionByName(repeated.select(*names))
