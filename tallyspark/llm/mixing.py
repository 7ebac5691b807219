"""Operator 4, mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of ``block_words`` words.  Each source's blocks
are numbered densely, and a keyed permutation orders them; a source's quota is
the first so many blocks of that order (a second pass through the order once
all are taken), the last one trimmed, so the words taken are the rounded target.
Where the order ends is found by counting: each round sums the words in ``FAN``
parts of the range that holds the end, until a part is one block.  The quotas
are split among the output shards by a tree whose nodes draw multivariate
hypergeometric vectors, so every shard has its exact number of blocks and every
source its exact quota.  A shard's blocks are disjoint ranges of the permuted
order; within a shard they are shuffled by a hash.  Counts and texts both come
from the blocks so dealt to shards.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share
``ratio`` times all words; no target exceeds twice its source's words, and the
excess is shared again by weight.

Spark does the counting, numbering and drawing.  Rows are numbered inside
buckets of a hash of id and text, and buckets inside groups of them, so a source
with a third of all rows is spread over many tasks and no window sees more than
a few thousand rows of it; only sums by source and shard quotas (``MAX_QUOTAS``
at most) reach the driver.

Defined cases: null texts have no words and are never drawn; a null source is a
source of its own; null and repeated ids are numbered like all others; extra
columns stay; an empty table gives an empty result.  Reruns draw the same blocks
whatever the partitions of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.text import WORD, mix, pieces, texts_of, word_spans
from tallyspark.session import drop_scratch, store

WEIGHTS = (5.0, 2.0, 1.0)
#: Parts in which a round sums a source's words to find where its quota ends.
FAN = 1 << 10
#: Rows of a bucket (about), and buckets of a group: what one window sees of a source.
BUCKET_ROWS = 4096
#: Bound on the table of quotas by source and shard that is broadcast.
MAX_QUOTAS = 1 << 23


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, ...) plus ``sid`` (its rank), ``weight`` and ``target``.

    Sharing the excess again and again ends where every uncapped target is the
    same multiple of its weight; each round is one sum over the sources.
    """
    names = sources.select("source").orderBy(F.col("source").asc_nulls_last())
    ranked = names.rdd.map(lambda r: r.source).zipWithIndex().toDF(
        T.StructType([T.StructField("r_source", T.StringType()), T.StructField("sid", T.LongType())]))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    table, _ = store(sources.join(ranked, F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source")
                     .withColumn("weight", weight), "sources")
    most, level, capped = F.col("source_size") * cap, None, -1
    while True:
        over = F.lit(False) if level is None else most < F.col("weight") * level
        free, fixed, n, total = table.agg(
            F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, most)),
            F.count(F.when(over, 1)), F.sum("source_size")).first()
        if not free or n == capped:
            break
        level, capped = (ratio * total - (fixed or 0.0)) / free, n
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level or 0.0), most))


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Each index's place in a keyed permutation of 0..size-1 (a Feistel network with cycle walking)."""
    half = np.zeros(len(index), dtype=np.uint64)
    for bits in range(1, 32):
        half[(size > (1 << 2 * (bits - 1))) & (size <= (1 << 2 * bits))] = bits
    half = np.maximum(half, np.uint64(1))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    limit, key = size.astype(np.uint64), seed.astype(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix(right + k + np.uint64((r * 0x9E3779B97F4A7C15) & (2**64 - 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= limit[todo]]
    return out.astype(np.int64)


def _blocks(sid, size, first, total, block_words: int, seed: int):
    """All blocks of an Arrow batch's documents: row, number in the document, words and permuted rank."""
    count = -(-size // block_words)
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    words = np.minimum(block_words, size[row] - number * block_words)
    key = mix(sid.astype(np.uint64) + np.uint64(seed))[row]
    return row, number, words, permuted(first[row] + number, total[row], key)


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


@dataclass
class MixPlan:
    """What a mix draws: the sources with their targets, counts and cuts, and the shard quotas."""

    sources: DataFrame
    offsets: DataFrame
    buckets: int
    block_words: int
    seed: int
    shards: int
    quota_ends: dict[int, np.ndarray]


def _numbered(docs: DataFrame, sources: DataFrame, offsets: DataFrame | None, buckets: int, block_words: int,
              seed: int) -> DataFrame:
    """``docs`` (with size, source and id) plus the number of each document's first block in its source."""
    names = sources.withColumnRenamed("source", "s_source")
    rows = docs.join(names, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("id", "mark", F.lit(seed)), F.lit(buckets)),
                             "n_blocks": F.ceil(F.col("size") / block_words).cast("long")})
    if offsets is None:
        return rows
    before = (Window.partitionBy("sid", "bucket").orderBy("id", "size", "mark")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.coalesce(F.sum("n_blocks").over(before), F.lit(0)))
    rows = rows.join(offsets, ["sid", "bucket"])
    return rows.withColumn("first", F.col("first") + F.col("offset"))


def _earlier(parts: DataFrame) -> DataFrame:
    """sid, bucket and ``offset``: the sum of n in the source's earlier buckets, by groups of buckets and inside them."""
    grouped = parts.withColumn("high", F.floor(F.col("bucket") / BUCKET_ROWS))

    def before(order: str, *keys: str) -> Column:
        run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(run), F.lit(0))

    groups = grouped.groupBy("sid", "high").agg(F.sum("n").alias("n")).select("sid", "high", before("high", "sid").alias("base"))
    inside = grouped.select("sid", "high", "bucket", before("bucket", "sid", "high").alias("inner"))
    return inside.join(groups, ["sid", "high"]).select("sid", "bucket", (F.col("base") + F.col("inner")).alias("offset"))


def _cuts(numbered: DataFrame, sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """``sources`` plus ``full`` (whole passes), ``cut`` and ``last``: the rank of a quota's last block, and its words."""
    whole = (F.col("target") >= F.col("source_size")) & (F.col("source_size") > 0)
    wanted = F.round("target").cast("long") - F.when(whole, F.col("source_size")).otherwise(F.lit(0))
    # the end lies in the ranks lo .. lo + span - 1; the words of ranks below lo are ``before``
    state, path = store(sources.select("sid", whole.cast("int").alias("full"), wanted.alias("wanted"), "blocks",
                                       F.lit(0).cast("long").alias("lo"), F.col("blocks").alias("span"),
                                       F.lit(0).cast("long").alias("before")), "range")
    step = F.greatest(F.lit(1), F.ceil(F.col("span") / FAN)).cast("long")

    def summed(batches):
        import pyarrow as pa

        for b in batches:
            sid, lo, span, width = (_column(b, c) for c in ("sid", "lo", "span", "step"))
            row, _, words, rank = _blocks(sid, _column(b, "size"), _column(b, "first"), _column(b, "blocks"), block_words, seed)
            at = rank - lo[row]
            hit = np.flatnonzero((at >= 0) & (at < span[row]))
            if not len(hit):
                continue
            both, inverse = np.unique(sid[row[hit]] * FAN + at[hit] // width[row[hit]], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"sid": both // FAN, "at": both % FAN,
                                              "words": np.bincount(inverse, words[hit]).astype(np.int64)})

    upto = Window.partitionBy("sid").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        wide = state.agg(F.max(step)).first()[0] or 1
        place = state.select("sid", "lo", "span", step.alias("step"))
        hist = (numbered.join(place, "sid").select("sid", "size", "first", "blocks", "lo", "span", "step")
                .mapInArrow(summed, "sid long, at long, words long").groupBy("sid", "at").agg(F.sum("words").alias("words")))
        hist = hist.withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        ends = (hist.join(state.select("sid", "wanted", "before"), "sid")
                .filter((F.col("before") + F.col("below") < F.col("wanted"))
                        & (F.col("wanted") <= F.col("before") + F.col("below") + F.col("words")))
                .select("sid", "at", "below"))
        lo = F.col("lo") + F.coalesce("at", F.lit(0)) * step
        new, new_path = store(state.join(ends, "sid", "left").select(
            "sid", "full", "wanted", "blocks", lo.alias("lo"), F.least(step, F.col("blocks") - lo).alias("span"),
            (F.col("before") + F.coalesce("below", F.lit(0))).alias("before")), "range")
        drop_scratch(sources.sparkSession, path)
        state, path = new, new_path
        if wide == 1:
            break
    ends = state.select("sid", "full", F.col("lo").alias("cut"), (F.col("wanted") - F.col("before")).alias("last"))
    cuts, _ = store(sources.join(ends, "sid"), "cuts")
    drop_scratch(sources.sparkSession, path)
    return cuts


def plan_mix(sizes: DataFrame, block_words: int = 512, seed: int = 1, ratio: float = 1.5,
             shard_words: int = 1 << 26, min_shards: int = 8) -> MixPlan:
    """The plan of a mix of ``sizes``: a stored table of id, source, size and mark (a hash that orders ties).

    There are as many shards as the mix holds ``shard_words``, at least ``min_shards``.
    """
    spark = sizes.sparkSession
    buckets = sizes.count() // BUCKET_ROWS + 1
    sums = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / block_words)).cast("long").alias("blocks"))
    sources, _ = store(source_targets(sums, ratio), "targets")

    # dense numbers: the blocks of earlier buckets of the same source
    parts, path = store(_numbered(sizes, sources, None, buckets, block_words, seed).groupBy("sid", "bucket").agg(
        F.sum("n_blocks").alias("n")), "buckets")
    offsets, _ = store(_earlier(parts), "offsets")
    drop_scratch(spark, path)

    numbered, path = store(_numbered(sizes, sources, offsets, buckets, block_words, seed).select(
        "sid", "size", "first", "blocks"), "numbered")
    cuts = _cuts(numbered, sources, block_words, seed)
    drop_scratch(spark, path)

    # blocks drawn, the trimmed one included, and the tree that splits them among the shards
    totals = cuts.select("sid", (F.col("full") * F.col("blocks") + F.when(F.col("last") > 0, F.col("cut") + 1).otherwise(0)).alias("n"),
                         "target")
    words, n_sources = totals.agg(F.sum("target"), F.count(F.lit(1))).first()
    if n_sources > MAX_QUOTAS:
        raise ValueError(f"{n_sources} sources: at most {MAX_QUOTAS} can be mixed")
    shards = int(max(1, min(max(min_shards, -(-(words or 0.0) // shard_words)), MAX_QUOTAS // max(1, n_sources))))
    order = totals.orderBy("sid").collect()
    table = split_quotas(np.array([r.n for r in order], dtype=np.int64), shards, seed)
    quota_ends = {r.sid: np.cumsum(table[:, i]) for i, r in enumerate(order)}
    return MixPlan(cuts, offsets, buckets, block_words, seed, shards, quota_ends)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Blocks of one kind among n drawn; beyond numpy's 10**9 the rounded normal law, inside its exact bounds."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if n and good and bad else min(n, good) if not bad else 0
    total = good + bad
    mean = n * (good / total)
    spread = (mean * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    return int(min(min(good, n), max(0, n - bad, round(rng.normal(mean, spread)))))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks by shard and source: row sums are even, column sums are the quotas, both exactly."""
    total = int(quotas.sum())
    ends = [total * j // shards for j in range(shards + 1)]
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, [int(q) for q in quotas])]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        room, rest, left = ends[mid] - ends[a], sum(have), []
        for q in have:
            rest -= q
            left.append(_hypergeometric(rng, q, rest, room))
            room -= left[-1]
        todo += [(a, mid, left), (mid, b, [q - x for q, x in zip(have, left, strict=True)])]
    return out


def _draws(batch, block_words: int, seed: int, quota_ends: dict[int, np.ndarray]):
    """(row, number, words taken, pass, place in the source's drawn order, shard) of the drawn blocks of a batch.

    A block belongs to the shard whose part of its source's quota holds its place.
    """
    sid, total, full, cut, last = (_column(batch, c) for c in ("sid", "blocks", "full", "cut", "last"))
    row, number, words, rank = _blocks(sid, _column(batch, "size"), _column(batch, "first"), total, block_words, seed)
    some = np.where(rank < cut[row], words, np.where(rank == cut[row], last[row], 0))
    out = []
    for p in (0, 1):
        taken = np.where(full[row] > p, words, np.where(full[row] == p, some, 0))
        hit = np.flatnonzero(taken)
        out.append((row[hit], number[hit], taken[hit], np.full(len(hit), p), p * total[row[hit]] + rank[hit]))
    where, number, taken, turn, place = (np.concatenate(x) for x in zip(*out, strict=True))
    shard = np.empty(len(where), dtype=np.int64)
    for s in np.unique(sid[where]):
        own = sid[where] == s
        shard[own] = np.searchsorted(quota_ends[int(s)], place[own], side="right")
    return where, number, taken, turn, place, shard


def _sizes(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"),
                       n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("mark"))


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (its words in the mix) and shards.

    ``taken`` sums the blocks that the tree dealt to the shards; ``shards``
    lists those that hold some, ascending and comma-joined (null: none).
    """
    sizes, _ = store(_sizes(docs, doc_id, source, text), "sizes")
    plan = plan_mix(sizes, **options)
    rows = _numbered(sizes, plan.sources, plan.offsets, plan.buckets, plan.block_words, plan.seed)
    block_words, seed = plan.block_words, plan.seed
    ends = docs.sparkSession.sparkContext.broadcast(plan.quota_ends)
    rows = rows.select("id", "source", "size", "source_size", "target", "sid", "first", "blocks", "full", "cut", "last")
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        for b in batches:
            row, _, taken, _, _, shard = _draws(b, block_words, seed, ends.value)
            sums = np.bincount(row, taken, minlength=b.num_rows).astype(np.int64)
            lists: list = [None] * b.num_rows
            for r, s in np.unique(np.stack([row, shard], axis=1), axis=0).tolist():
                lists[r] = str(s) if lists[r] is None else f"{lists[r]},{s}"
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sums), pa.array(lists, pa.string())], names=[
                "doc_id", "source", "size", "source_size", "target", "taken", "shards"])

    return rows.mapInArrow(count, f"doc_id {kind}, source string, size long, source_size long, target double, taken long, "
                                  "shards string")


def draw(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix: a row for each document, pass and shard with drawn blocks.

    Columns: those of ``docs`` as they were (struct ``row``), ``shard``, ``pass``,
    ``place`` (a hash: the order inside the shard), ``words`` and ``part``: the
    drawn text.  A wholly drawn document keeps its text; of others, runs of
    neighbouring blocks are cut out and joined by line feeds.
    """
    sizes, _ = store(_sizes(docs, doc_id, source, text), "sizes")
    plan = plan_mix(sizes, **options)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    field = docs.columns.index(text)  # the text travels once, inside the row
    full = docs.select(row, F.col(doc_id).alias("id"),
                       F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
                       F.xxhash64(F.col(text)).alias("mark"))
    rows = _numbered(full, plan.sources, plan.offsets, plan.buckets, plan.block_words, plan.seed).select(
        "row", "mark", "size", "sid", "first", "blocks", "full", "cut", "last")
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(
        "shard int, pass int, place long, words long, part string").fields])
    block_words, seed = plan.block_words, plan.seed
    ends = docs.sparkSession.sparkContext.broadcast(plan.quota_ends)

    def cut(batches):
        import pyarrow as pa

        for b in pieces(batches):
            texts, size = texts_of(b.column("row").field(field)), _column(b, "size")
            where, number, taken, turn, place, shard = _draws(b, block_words, seed, ends.value)
            order = np.lexsort((number, shard, turn, where))
            groups = np.stack([where, turn, shard])[:, order]
            edges = np.flatnonzero(np.any(np.diff(groups, axis=1) != 0, axis=0)) + 1
            rows_, out = [], {"shard": [], "pass": [], "place": [], "words": [], "part": []}
            for own in np.split(order, edges) if len(order) else ():
                r = int(where[own[0]])
                rows_.append(r)
                out["shard"].append(int(shard[own[0]]))
                out["pass"].append(int(turn[own[0]]))
                out["place"].append(int(place[own[0]]))
                out["words"].append(int(taken[own].sum()))
                out["part"].append(texts[r].decode() if out["words"][-1] == size[r] else
                                   _cut_out(texts[r], number[own] * block_words, taken[own]))
            hashed = mix(np.array(out["place"], dtype=np.uint64) + np.uint64(seed)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pa.array(rows_, pa.int64())), pa.array(out["shard"], pa.int32()),
                 pa.array(out["pass"], pa.int32()), pa.array(hashed), pa.array(out["words"], pa.int64()),
                 pa.array(out["part"], pa.string())], names=["row", *out])

    return rows.mapInArrow(cut, schema)


def _cut_out(text: bytes, begins: np.ndarray, counts: np.ndarray) -> str:
    """The text of word ranges; neighbouring ranges stay joined as in the text."""
    start, end = word_spans(np.frombuffer(text, dtype=np.uint8))
    runs: list[list[int]] = []
    for a, n in zip(begins.tolist(), counts.tolist(), strict=True):
        if runs and runs[-1][1] == a:
            runs[-1][1] = a + n
        else:
            runs.append([a, a + n])
    return b"\n".join(text[start[a]:end[z - 1]] for a, z in runs).decode()


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                  n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents, in shards: rows of ``docs`` whose text is the drawn text (repeats are rows of their own).

    Every shard is one partition's range, shuffled inside by the drawn places.
    """
    drawn = draw(docs, doc_id, source, text, **options)
    columns = []
    for i, c in enumerate(docs.columns):
        value = F.col(f"row.c{i}")
        if c == text:
            value = F.col("part")
        elif c == n_chars:
            value = F.length("part").cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    spread = F.pmod(F.col("place"), F.lit(16))
    return (drawn.repartition(F.col("shard"), spread).sortWithinPartitions("shard", "place").select(*columns))
