"""Operator 1, exact dedup: two-pass Bloom filtering.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became
one space (null counts as empty).  Pass one folds the hashes of all texts into
a bounded seen/seen-again filter; pass two tests every row.  Rows whose hash is
certainly unique pass straight through; only the possibly repeated ones shuffle.

Defined cases: of equal texts the row with the smallest id stays (null ids come
last; of rows that share id and text, exactly one stays); other columns, of any
type or name, are untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import repeats
from tallyspark.llm.hot import lookup
from tallyspark.llm.text import SPACE
from tallyspark.session import drop_scratch, store


def text_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def _keys(batch):
    yield np.asarray(batch.column("key"))


def _flag(df: DataFrame, seen: repeats.RepeatFilter) -> DataFrame:
    """``df`` (with a long column ``key``) plus a boolean column ``maybe``."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("maybe", T.BooleanType())])

    def test(batches):
        import pyarrow as pa

        for b in batches:
            hit = pa.array(seen.maybe_repeated(np.asarray(b.column("key"))))
            yield pa.RecordBatch.from_arrays([*b.columns, hit], names=[*b.schema.names, "maybe"])

    return df.mapInArrow(test, schema)


def dedup_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 28) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The text is read once; the hashes are stored in shared scratch and both
    Bloom passes run over them.  Copies meet in partial counts first, so a group
    of a third of all rows shuffles one row per map task, and its verdict is
    handed back where its rows are.
    """
    hashed, path = store(
        docs.select(F.col(doc_id).alias("doc_id"), text_sha256(F.col(text)).alias("text_sha256"))
        .withColumns({"key": F.xxhash64("text_sha256"), "row": F.monotonically_increasing_id()}), "hashes")
    seen = repeats.build(hashed.select("key"), _keys, hashed.count(), max_bits)
    flagged, _ = store(_flag(hashed, seen), "flagged")
    drop_scratch(docs.sparkSession, path)

    unique = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    again = flagged.filter("maybe")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups, _ = store(again.groupBy("text_sha256").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    counts = groups.select("text_sha256", F.col("group_size").alias("count"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    judged = lookup(again, groups, "text_sha256", counts, total).select(
        "doc_id", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return unique.unionByName(judged)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 28) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Possibly repeated rows meet by hash; each map task sends at most one row of
    a group on.  All others keep their place without a shuffle.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    tagged = docs.select(row.alias("row"), F.col(doc_id).alias("id"), text_sha256(F.col(text)).alias("sha"))
    tagged = tagged.withColumn("key", F.xxhash64("sha"))
    hashes, path = store(tagged.select("key"), "hashes")
    seen = repeats.build(hashes, _keys, hashes.count(), max_bits)
    drop_scratch(docs.sparkSession, path)
    flagged = _flag(tagged, seen)
    unique = flagged.filter(~F.col("maybe")).select("row")
    # rows with equal ids are told apart by a hash, where their columns can be hashed
    tie = [] if "map<" in tagged.schema["row"].dataType.simpleString() else [F.xxhash64("row")]
    again = flagged.filter("maybe").groupBy("sha").agg(
        F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), *tie)).alias("row")).select("row")
    both = unique.unionByName(again)
    return both.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
