"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured once (built-in column functions).  Measures of the documents that pass
the fixed base rules enter a sketch per (language, source, measure): counts of buckets whose width
is at most 1/32 of the value, the layout of high-dynamic-range histograms.  Sketches merge by adding
counts, so they do not depend on partitioning, and a small group takes the merged sketch of its
language or of all documents.  A document is rejected if a measure lies above its group's fence.

Measures are ratios of counts, so fences are set on square roots, where chance alone moves any count
by about one half.  A fence is the group's upper quartile plus FENCE times a spread that comes from
the sketches alone: the quartile distance of the group, or, where its quartiles are equal, of its
language (there, and then for all documents, the distance from the upper quartile to the quantile
TAIL takes its place if the quartiles are equal again: small groups do not say where a tail ends).
Where all these are equal the measure is constant but for outliers, and only chance is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.operators.ordering import salted_join
from sightline.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHINGLE = 5
# Base rules: fixed limits that the thresholds below come on top of.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# Bits of a value that its sketch bucket keeps.
SKETCH_BITS = 6
# Least number of documents for a group to have a fence of its own.
MIN_GROUP = 50
# Fence: upper quartile plus so many times the spread, on square roots.
FENCE = 3
# Upper quantile, in tenths, that gives a merged sketch its spread where its quartiles are equal.
TAIL = 9
# Chance moves the square root of a count by about 1/2; three times that are allowed.
CHANCE = 1.5
# measure -> (numerator, denominator, scale)
MEASURES = {
    "symbols": ("n_symbols", "word_chars", 10_000),
    "capitals": ("n_capitals", "word_chars", 10_000),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000),
    "repeats": ("n_repeat_words", "n_words", 10_000),
    "word_length": ("word_chars", "n_words", 100),
}


def _removed(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def repeated_words(words: Column, n: Column) -> Column:
    """Words of ``words`` inside a window of five words that occurs twice or more, first included.

    Window hashes are sorted inside the row, neighbours with equal hashes are repeats, and each
    repeated start adds the words that the start before it did not cover.
    """
    hashed = F.when(n >= SHINGLE, F.transform(
        F.sequence(F.lit(1), (n - (SHINGLE - 1)).cast("int")),
        lambda i: F.struct(F.xxhash64(F.slice(words, i, SHINGLE)).alias("h"), i.alias("i"))))

    def repeats(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            left, right = F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"]
            return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))
        return F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"]))

    # The sorted array is bound to a lambda variable so that it is made once, not per element.
    starts = F.transform(F.array(F.array_sort(hashed)), repeats)[0]
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-SHINGLE).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, x: F.struct(
            x.alias("last"), (acc["sum"] + F.least(F.lit(SHINGLE), x - acc["last"])).alias("sum")),
        lambda acc: acc["sum"])
    return F.coalesce(covered, F.lit(0)).cast("long")


def measured(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of each document.

    Null text has no words.  ``n_dup_lines`` counts lines with a word that equal an earlier line.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = (
        documents.select("doc_id", "lang", "source", whole.alias("_text"))
        .withColumn("_words", F.filter(F.split("_text", SPACE, -1), lambda x: x != ""))
        .withColumn("_lines", lines))
    n = F.size("_words")
    return base.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        _removed(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), n).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def value_of(measure: str) -> Column:
    top, bottom, scale = MEASURES[measure]
    return F.when(F.col(bottom) > 0, F.floor(F.col(top) * scale / F.col(bottom))).otherwise(F.lit(0)).cast("long")


def bucket_floor(value: Column) -> Column:
    """Lower edge of the sketch bucket of a non-negative integer."""
    digits = F.length(F.bin(value))
    width = F.pow(F.lit(2.0), F.greatest(digits - SKETCH_BITS, F.lit(0))).cast("long")
    return (value - F.pmod(value, width)).cast("long")


def sketches(counts: DataFrame) -> DataFrame:
    """Bucket counts by level, language, source and measure.

    Level 0 is (language, source), level 1 merges the sources of a language, level 2 everything.
    """
    values = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket_floor(value_of(m)).alias("bucket")) for m in MEASURES]))
    cells = (
        counts.where(~base_failed()).select("lang", "source", values.alias("v"))
        .groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count("*").alias("n")))
    nothing = F.lit(None).cast("string")
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), nothing.alias("source")),
        F.struct(F.lit(2).alias("level"), nothing.alias("lang"), nothing.alias("source"))))
    return (
        cells.select(levels.alias("g"), "measure", "bucket", "n")
        .groupBy("g.level", "g.lang", "g.source", "measure", "bucket").agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """Square roots of the upper quartile and of the spread of each group, per measure (``<measure>_q3``, ``_spread``).

    Quantiles are the buckets that hold ranks ceil(n/4), ceil(3n/4) and ceil(TAIL n/10).  A spread of 0 says
    that the sketch has none to give.
    """
    group = Window.partitionBy("level", "lang", "source", "measure")
    at = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))

    def root(of: int, share: int) -> Column:
        return F.sqrt(F.min(F.when(of * F.col("upto") >= share * F.col("total"), F.col("bucket"))))

    quantiles = at.groupBy("level", "lang", "source", "measure", "total").agg(
        root(4, 1).alias("q1"), root(4, 3).alias("q3"), root(10, TAIL).alias("tail"))
    middle = F.col("q3") - F.col("q1")
    spread = F.when((F.col("level") == 0) | (middle > 0), middle).otherwise(F.col("tail") - F.col("q3"))
    return quantiles.withColumn("spread", spread).groupBy("level", "lang", "source", "total").pivot(
        "measure", list(MEASURES)).agg(F.first("q3").alias("q3"), F.first("spread").alias("spread"))


def thresholds(counts: DataFrame) -> DataFrame:
    """One row per (language, source): per measure the fence's square root and the level that set its spread.

    Quartile and spread come from the finest level with enough documents, the spread from the finest one
    that has any; ``level_<measure>`` is null where no level has.
    """
    levels = fences(sketches(counts)).where((F.col("total") >= MIN_GROUP) | (F.col("level") == 2))
    names = list(MEASURES)
    nothing = F.lit(None).cast("string")
    wanted = counts.select("lang", "source").distinct().select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
            F.struct(F.lit(1).alias("level"), F.col("lang"), nothing.alias("source")),
            F.struct(F.lit(2).alias("level"), nothing.alias("lang"), nothing.alias("source")))).alias("w"))
    found = wanted.join(
        levels,
        (F.col("w.level") == levels["level"]) & F.col("w.lang").eqNullSafe(levels["lang"])
        & F.col("w.source").eqNullSafe(levels["source"]))
    finest = found.groupBy("_lang", "_source").agg(
        F.min(F.struct(levels["level"], *[F.col(f"{m}_q3") for m in names])).alias("f"),
        *[F.min(F.when(F.col(f"{m}_spread") > 0, F.struct(levels["level"], F.col(f"{m}_spread").alias("spread")))).alias(m)
          for m in names])
    return finest.select(
        F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        *[(F.col(f"f.{m}_q3") + FENCE * F.coalesce(F.col(f"{m}.spread"), F.lit(0.0))).alias(f"max_{m}") for m in names],
        *[F.col(f"{m}.level").alias(f"level_{m}") for m in names])


def beyond(measure: str) -> Column:
    """Whether a count lies above what the fence and chance allow for its document; null without a fence."""
    top, bottom, scale = MEASURES[measure]
    return F.sqrt(F.col(top)) > F.col(f"max_{measure}") * F.sqrt(F.col(bottom) / F.lit(float(scale))) + F.lit(CHANCE)


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def judge_quality(documents: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each document, one row per row of ``documents``.

    ``documents`` has doc_id, text, lang and source; other columns are not read.  Null lang or source
    form groups of their own; null and empty texts fail the base rules; repeated rows are judged alike;
    an empty table gives an empty result.  The counts are written once (``cut_lineage``) because both
    the sketches and the verdicts need them.
    """
    counts = cut_lineage(measured(documents))
    # Null keys become text, as the salted join is a plain equality.
    limits = thresholds(counts).select(
        _key("lang").alias("_lang"), _key("source").alias("_source"), *[f"max_{m}" for m in MEASURES])
    keyed = counts.withColumns({"_lang": _key("lang"), "_source": _key("source")})
    judged = salted_join(keyed, limits, ["_lang", "_source"], ["doc_id"], "left")
    above = F.lit(False)
    for m in MEASURES:
        above = above | F.coalesce(beyond(m), F.lit(False))
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines",
        "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~above).alias("kept"))
