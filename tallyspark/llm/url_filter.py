"""Operator 6, URL filters: rules first, else gradient-boosted trees on lexical features (DataFrame functions only).

Rules (a host and a path's beginning) decide the URLs they fit; the longest
wins.  The URLs that rules decide are the labelled ones: trees learn from them
(``max_rows`` at most, picked by a hash) and judge all others by length, depth,
digit ratio, entropy, parameter counts and the block share of their suffix.  The
suffix statistics come from all URLs that rules decide, one stored row for each
suffix, and are joined to the rows; the trees are part of the expression.

Defined cases: a null url or one without ``://`` has an empty host and path and
fits no rule; without labelled URLs of both kinds every other URL is allowed;
repeated rows and extra columns are untouched; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.boosted import BoostedTrees, train
from tallyspark.session import drop_scratch, store

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty where it is null or has no ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, begin = text.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + begin)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _count(text: Column, letters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("double")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text).cast("double")

    def add(total: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.array_distinct(F.array_remove(F.split(text, ""), "")), F.lit(0.0), add))


def suffix(host: Column) -> Column:
    """The host's last two labels."""
    return F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features that are read off a URL."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    first = F.substring_index(host, ".", 1)
    return [F.length(u).cast("double"), F.length(host).cast("double"), F.length(path).cast("double"),
            _count(path, "/"), _count(host, "."), _count(host, "-"), _count(u, "0123456789") / n,
            _count(host, "0123456789"), entropy(u), entropy(host), _count(u, "&") + _count(u, "?"), _count(u, "="),
            _count(u, "#"), _count(u, "%"), u.startswith("https").cast("double"),
            F.length(first).cast("double")]


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url",
               max_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability of every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})

    rows = rows.withColumn("suffix", suffix(F.col("host")))

    labelled = rows.filter(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == BLOCK).cast("int"))
    rates, _ = store(labelled.groupBy("suffix").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")), "suffixes")
    total, blocked = rates.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    prior = (blocked + 1) / (total + 2)
    rates = rates.select(F.col("suffix").alias("_s"), F.col("b").alias("_b"), F.col("n").alias("_n"))

    def rated(some: DataFrame, own: Column | None = None) -> DataFrame:
        """The block share of each row's suffix; a training row's own label (``own``) is left out of it."""
        joined = some.join(rates, F.col("suffix") == F.col("_s"), "left")
        b, n = (F.col("_b"), F.col("_n")) if own is None else (F.col("_b") - own, F.col("_n") - 1)
        return joined.withColumn("rate", F.coalesce((b + prior * 5) / (n + 5), F.lit(prior)))

    # rows are picked by their ids, so a url in a third of all rows is sampled like any other, and stored from the full scan
    share = min(1.0, max_rows / max(1, total))
    hashed = F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    x = [*lexical(F.col("url"), F.col("host"), F.col("path")), F.col("rate")]
    sample, sample_path = store(rated(labelled.filter(hashed), F.col("label")).select(F.array(*x).alias("x"), "label"), "sample")
    trees = train(sample)
    drop_scratch(pages.sparkSession, sample_path)
    chance = _chance(trees, F.array(*x))
    out = rated(rows).withColumn("block_probability", chance)
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("block_probability") >= threshold, BLOCK).otherwise(ALLOW)).alias("verdict"),
        "block_probability")


def _chance(trees: BoostedTrees | None, x: Column) -> Column:
    if trees is None:
        return F.lit(0.0)
    return F.get(F.transform(F.array(x), lambda f: trees.probability(lambda i: F.get(f, F.lit(i)))), F.lit(0))
