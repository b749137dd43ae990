"""URL filter: host-suffix and path-prefix expressions, short-hash join, full digest, precedence.

Every URL is expanded into (host suffix, path prefix) expressions.  An expression meets the rules
on a short prefix of its digest, the full digest confirms the meeting, and the longest rule wins.
Built-in column functions only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Hex digits of the digest that the join uses: 32 bits, as in published safe-browsing lists.
SHORT_DIGITS = 8
# Copies of each rule, so that URLs of one hot host spread over as many tasks.
RULE_COPIES = 8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def expression_digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with their digests; of contradicting actions, block wins."""
    one = (
        rules.where(F.col("host").isNotNull())
        .select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path").agg(F.max("action").alias("action")))
    return one.withColumn("digest", expression_digest(F.col("host"), F.col("path")))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    keys: Sequence[str] = ("page_id",),
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: its keys, ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block).  A rule fits its host and all
    subdomains if the URL's path starts with the rule's path.  The longest rule (host and path
    together) wins, then the longer host.  Without a rule the verdict is ``default`` and ``rule`` is
    null.  Null or malformed URLs have an empty host, which fits no rule but one for the empty host;
    repeated rows are returned as often as they come; other columns of ``pages`` are not read; an
    empty rule table gives the default everywhere.

    Runs one small job: the longest rule host and the distinct lengths of rule paths, whose number is
    bounded by the longest path.  They spare expressions that no rule can meet.
    """
    fixed = prepared_rules(rules)
    limits = fixed.agg(
        F.coalesce(F.max(F.length("host")), F.lit(0)).alias("host"),
        F.sort_array(F.collect_set(F.length("path"))).alias("paths")).first()

    host, path = host_and_path(F.col("_url"))
    given = pages.select(*[F.col(k) for k in keys], F.col(url).alias("_url"))
    spread = F.pmod(F.xxhash64(*keys, "_url"), F.lit(RULE_COPIES)).cast("int")
    # Suffixes longer than every rule host are left out by looking at the tail of the host only.
    tail = F.when(F.length("_host") > limits["host"], F.expr(f"right(_host, {limits['host'] + 1})")).otherwise(
        F.concat(F.lit("."), F.col("_host")))
    labels = F.col("_labels")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in limits["paths"]]).cast("array<int>"), lambda n: n <= F.length("_path")),
        lambda n: F.substr(F.col("_path"), F.lit(1), n))
    # The first element of a row's expressions stands for the row itself and meets no rule.
    own = F.array(F.struct(F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("prefix")))
    pairs = F.flatten(F.transform(
        F.col("_suffixes"),
        lambda s: F.transform(F.col("_prefixes"), lambda p: F.struct(s.alias("suffix"), p.alias("prefix")))))
    expressions = (
        given.select("*", host.alias("_host"), path.alias("_path"), spread.alias("_copy"))
        .withColumn("_labels", F.split(tail, r"\."))
        .withColumn("_suffixes", F.when(F.size("_labels") >= 2, suffixes).otherwise(F.array().cast("array<string>")))
        .withColumn("_prefixes", prefixes)
        .select(*keys, "_url", "_copy", F.explode(F.concat(own, pairs)).alias("_e"))
        .withColumn("_digest", expression_digest(F.col("_e.suffix"), F.col("_e.prefix")))
        .withColumn("_short", F.substring("_digest", 1, SHORT_DIGITS)))

    copies = F.explode(F.sequence(F.lit(0), F.lit(RULE_COPIES - 1)))
    table = fixed.select(
        F.substring("digest", 1, SHORT_DIGITS).alias("_short"),
        copies.alias("_copy"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            "action", F.concat("host", "path").alias("rule"), "digest").alias("_rule"))
    met = expressions.join(table, ["_short", "_copy"], "left")
    confirmed = F.when(F.col("_rule.digest") == F.col("_digest"), F.col("_rule"))
    # The row itself, counted once a join partner of its (null) digest cannot exist.
    best = met.groupBy(*keys, "_url").agg(
        F.max(confirmed).alias("_best"), F.count(F.when(F.col("_digest").isNull(), 1)).alias("_rows"))
    return (
        best.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_rows"))))
        .select(
            *keys, host.alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"),
            F.coalesce("_best.action", F.lit(default)).alias("verdict")))
