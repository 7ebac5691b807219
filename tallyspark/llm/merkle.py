"""Operator 11, Merkle dataset manifest: a hash tree over all rows, with proofs by pointer jumping.

Every row is a leaf; the leaves of a group stand in order, and while a tree has
several nodes each eight consecutive ones (the last run: what is left) become
one.  The groups' roots, in the order of the groups' names (null first), are the
leaves of the tree above them, whose root stands for the whole table.

A node's *segment* is what stands before and after it in its run.  Proofs come
from pointer jumping: every node knows an ancestor and the segments up to it;
a self-join on that ancestor doubles the distance and appends its segments, until
every leaf has reached the root.  A run has eight nodes at most; the rows that
share a far ancestor meet it by ``hot.lookup``, which gathers no large key.

Defined cases: a null value is ``-`` in a leaf, so null and empty differ; texts
are hashed whole; rows with one id and group stand in order of their leaf hashes
(equal rows are equal leaves, each with its place); null ids come first; extra
columns are neither hashed nor returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.hot import lookup
from tallyspark.session import drop_scratch, store

ARITY = 8
#: Name of the tree above the groups; a group's tree is named "" (null) or "=" and its value.
TOP = "^"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts' UTF-8 bytes, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(*fields: Column) -> Column:
    """H of the fields as ``byte count:value``, ``-`` for null."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def _placed(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str]:
    """``nodes`` with ``idx``, the place (from 0) in its tree by ``order``, stored.

    Rows are range-partitioned by tree and order and numbered inside a
    partition; the pieces that a tree has in partitions are few rows, whose
    running counts are added.
    """
    spark = nodes.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ranged = nodes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    numbered, path = store(ranged.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
                           .withColumn("piece", F.concat_ws("/", F.spark_partition_id(), "tree")), "placed")
    pieces = numbered.groupBy("piece").agg(F.min("tree").alias("t"), F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("t").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("piece", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    done = store(numbered.join(offsets, "piece").withColumn("idx", F.col("at") + F.col("shift")).drop("at", "piece", "shift"),
                 "places")
    drop_scratch(spark, path)
    return done


def _grow(nodes: DataFrame, most: int, paths: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level (tree, up, size, kids, parent), lowest first, and the roots of all trees (tree, h, id, row).

    ``nodes``: tree, idx, size (nodes of its tree at this level), h, id, row; ``most``: the greatest size.
    """
    levels, roots, k = [], nodes.filter("size = 1").select("tree", "h", "id", "row"), 0
    row_type = nodes.schema["row"].dataType
    while most > 1:
        k += 1
        runs = nodes.filter("size > 1").groupBy("tree", F.expr(f"idx div {ARITY}").alias("up")).agg(
            F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "h", "id", "row"))).alias("kids"))
        runs, path = store(runs.withColumn("parent", F.concat_ws("/", F.lit(str(k)), F.col("up").cast("string"), "tree")), "runs")
        paths.append(path)
        levels.append(runs)
        nodes = runs.select("tree", F.col("up").alias("idx"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"),
                            digest(F.array_join("kids.h", "")).alias("h"), F.col("parent").alias("id"),
                            F.lit(None).cast(row_type).alias("row"))
        roots = roots.unionByName(nodes.filter("size = 1").select("tree", "h", "id", "row"))
        most = -(-most // ARITY)
    return levels, roots


def _steps(runs: DataFrame) -> DataFrame:
    """(id, row, up, segments) of the nodes in ``runs``: the parent, and the one segment on the way to it."""
    def packed(part: Column) -> Column:
        return F.unhex(F.array_join(part, ""))

    kid = runs.select("parent", F.col("kids.h").alias("hs"), F.posexplode("kids").alias("i", "kid"))
    segment = F.struct(packed(F.slice("hs", F.lit(1), F.col("i"))).alias("before"),
                       packed(F.slice("hs", F.col("i") + 2, F.lit(ARITY))).alias("after"))
    return kid.select("kid.id", "kid.row", F.col("parent").alias("up"), F.array(segment).alias("segments"))


def _jump(jumped: DataFrame, root_id: str) -> DataFrame:
    """Every node's ancestor replaced by that ancestor's own one, its segments appended; nodes at the root stay."""
    spark = jumped.sparkSession
    onward = jumped.filter(F.col("up") != F.lit(root_id))
    far = jumped.filter("row IS NULL").select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("segments").alias("more"))
    counts, path = store(onward.groupBy("up").count(), "counts")
    met = lookup(onward, far, "up", counts, counts.agg(F.sum("count")).first()[0] or 0)
    drop_scratch(spark, path)
    return met.select("id", "row", F.col("next").alias("up"), F.concat("segments", "more").alias("segments")).unionByName(
        jumped.filter(F.col("up") == F.lit(root_id)))


def manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, keep: Sequence[Column] = ()) -> DataFrame:
    """One row per row: order key ``key``, ``keep`` columns (short ones), ``leaf``, ``subroot``, ``root`` and ``segments``.

    The segments are the proof: an array, from leaf to root, of the packed
    binary digests before and after the path in each run.
    """
    spark = rows.sparkSession
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    given, given_path = store(rows.select(tree.alias("tree"), order.alias("key"), leaf.alias("h"),
                                          F.struct(F.lit(True).alias("is_leaf"), *keep).alias("kept")), "leaves")
    placed, placed_path = _placed(given, ["key", "h"])
    drop_scratch(spark, given_path)
    sizes, _ = store(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("count")), "sizes")
    n_trees, total, most = sizes.agg(F.count(F.lit(1)), F.sum("count"), F.max("count")).first()
    sized = lookup(placed, sizes.select("tree", F.col("count").alias("size")), "tree", sizes, total or 0)
    nodes = sized.select("tree", "idx", "size", "h", F.concat_ws("/", F.lit("0"), F.col("idx").cast("string"), "tree").alias("id"),
                         F.struct("key", "h", "tree", "kept").alias("row"))
    paths = [placed_path]
    levels, roots = _grow(nodes, most or 0, paths)
    subroots, _ = store(roots, "subroots")

    top, top_path = _placed(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "h", "id", "row"), ["name"])
    paths.append(top_path)
    above, root = _grow(top.select("tree", "idx", F.lit(n_trees).cast("long").alias("size"), "h", "id", "row"), n_trees, paths)
    root_hash, root_id, root_row = root.select("h", "id", "row").first() or (None, "", None)

    height = len(levels) + len(above)
    if height:
        steps = [_steps(runs) for runs in (*levels, *above)]
        jumped = steps[0]
        for s in steps[1:]:
            jumped = jumped.unionByName(s)
    else:  # one row at most: it is the root
        none = F.array().cast("array<struct<before: binary, after: binary>>")
        jumped = root.select("id", "row", F.col("id").alias("up"), none.alias("segments"))
    jumped, jumped_path = store(jumped, "jumps")
    distance = 1
    while distance < height:
        further, path = store(_jump(jumped, root_id), "jumps")
        drop_scratch(spark, jumped_path)
        jumped, jumped_path, distance = further, path, 2 * distance
    for path in paths:
        drop_scratch(spark, path)

    leaves = jumped.filter("row IS NOT NULL").select(
        F.col("row.tree").alias("tree"), F.col("row.key").alias("key"), F.col("row.h").alias("leaf"),
        F.col("row.kept").alias("kept"), "segments")
    out = lookup(leaves, subroots.select("tree", F.col("h").alias("subroot")), "tree", sizes, total or 0)
    return out.select("key", "leaf", "subroot", F.lit(root_hash).alias("root"), "segments",
                      *[F.col("kept").getField(f.name).alias(f.name) for f in given.schema["kept"].dataType.fields[1:]])


def _hex(part: Column) -> Column:
    return F.lower(F.hex(part))


def proof_hash(segments: Column) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(segments, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""))


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(segments, leaf, lambda h, s: digest(_hex(s["before"]), h, _hex(s["after"])))


#: The columns of a leaf, in order (fixed by the manifest's format).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, and whether each row proves itself after the tampering that is tried on it.

    Where 3 divides the CRC-32 of the decimal doc_id, the text's A-Z are
    lower-cased before the leaf is folded with its original siblings.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fields = [F.col(c) for c in FIELDS]
    tampered = leaf_hash(*fields[:-1], F.translate(fields[-1], upper, lower))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(docs, F.col("lang"), F.col("doc_id"), leaf_hash(*fields), [F.when(hit, tampered).alias("tampered")])
    out = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("segments")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("segments")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
