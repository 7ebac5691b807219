"""Operator 12, near-dedup by MinHash: universal hash minima, banding, verification, alternating stars.

A document's set holds the 64-bit hashes of its distinct four-word shingles (A-Z
folded; a shorter text is one shingle).  Its signature is the minima of 160
multiply-add-shift functions (a strongly universal family), in 40 bands of four.
Two sets of similarity 0.8 share a band but for a chance of 7 in 10**10, and
agree in fewer than 92 minima with about the same chance; less similar pairs are
sorted out by the signatures, and what remains is counted on the full sets.

Documents with equal sets are one class.  Within a bucket (band and value) not
all pairs are formed: each class meets the most central one, verified links make
components (alternating large-star and small-star), and buckets whose classes
are in one component are closed.  When such rounds gain little any more, the
classes of the buckets still open are compared block by block inside tasks, so
that every pair of different components is tested.  Bit maps of the sets, eight
to sixteen bits a shingle, bound the overlap from above there; only pairs that
can still reach 0.8 leave a task, to be verified like all others.

Defined cases: null or blank texts have no shingles and are linked with nothing;
texts are taken whole at any length; repeated rows are copies; of rows with one
id and several texts each follows its own text; rows with a null id follow the
class of their set and never name a component (a set that only such rows have is
linked with nothing, and its rows stay); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import repeats
from tallyspark.llm.hot import lookup, salted
from tallyspark.llm.star_components import star_components
from tallyspark.llm.text import mix, pieces, shingles, texts_of
from tallyspark.session import drop_scratch, store

BANDS, ROWS = 40, 4
MINIMA = BANDS * ROWS
#: Minima in which two sets of similarity 0.8 agree but for a chance of 8 in 10**10.
AGREE = 92
#: Members of a block of an open bucket, and their shingles; the work of one task is a pair of blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 22
#: After so many, star rounds end when no more open pairs than this remain for each class, or fewer than a tenth went.
STAR_ROUNDS, OPEN_PAIRS = 2, 8

_NUMBERS = mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR, _SHIFTED = _NUMBERS[:MINIMA], _NUMBERS[MINIMA:]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The signatures, shape (sets, 160), of non-empty arrays of 64-bit shingle hashes.

    Function i maps the 32-bit key x to the high half of a_i x + b_i modulo 2**64.
    """
    out = np.empty((len(sets), MINIMA), dtype=np.uint32)
    if not sets:
        return out
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    keys = np.concatenate(sets) & np.uint64(0xFFFFFFFF)
    for i in range(MINIMA):
        out[:, i] = np.minimum.reduceat((keys * _FACTOR[i] + _SHIFTED[i]) >> np.uint64(32), starts)
    return out


def _groups(sets: list[np.ndarray], most: int = 1 << 17):
    """Runs of sets of about ``most`` shingles, so that working copies stay small."""
    run, size = [], 0
    for s in sets:
        run.append(s)
        size += len(s)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _long_minima(s: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """One set's signature, in pieces."""
    return np.min([minima([s[i:i + most]])[0] for i in range(0, len(s), most)], axis=0)


def signatures(sets: list[np.ndarray]) -> list[bytes | None]:
    """Signatures as bytes (little-endian unsigned 32-bit), none for an empty set."""
    out: list[bytes | None] = [None] * len(sets)
    short = [i for i, s in enumerate(sets) if 0 < len(s) <= 1 << 20]
    at = iter(short)
    for run in _groups([sets[i] for i in short]):
        for row in minima(run).astype("<u4"):
            out[next(at)] = row.tobytes()
    for i, s in enumerate(sets):
        if len(s) > 1 << 20:
            out[i] = _long_minima(s).astype("<u4").tobytes()
    return out


def _name(s: np.ndarray) -> bytes | None:
    """A set's 128-bit name."""
    return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None


def bit_map(s: np.ndarray) -> np.ndarray:
    """A set's bit map as 64-bit words: the cells of its shingles' low bits, a power of two of them, 8 to 16 a shingle."""
    cells = max(64, 1 << (8 * len(s) - 1).bit_length())
    bits = np.zeros(cells, dtype=bool)
    bits[(s & np.uint64(cells - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(maps: np.ndarray) -> np.ndarray:
    """Bit maps (one a row) over half as many cells."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


def most_shared(x: np.ndarray, n: int, maps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of a set of size n and map x with others: shingles in a cell the other lacks are not shared."""
    alone = np.bitwise_count(x & ~maps).sum(axis=1, dtype=np.int64)
    others = np.bitwise_count(maps & ~x).sum(axis=1, dtype=np.int64)
    return np.minimum(n - alone, sizes - others)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, e, sig) of each document: size, name and signature of its set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches, 256):
            sets = [shingles(t, width) for t in texts_of(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_name(s) for s in sets], pa.binary()), pa.array(signatures(sets), pa.binary())],
                names=["doc_id", "n", "e", "sig"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, e binary, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, MINIMA)


def _buckets(classes: DataFrame, wanted=None) -> DataFrame:
    """(bucket, e, n): a class's 40 buckets, hashes of a band's number and its four minima.

    With ``wanted``, a bounded map of buckets, few others than those in it.
    """
    def run(batches):
        import pyarrow as pa

        for b in pieces(batches, 1024):
            if not b.num_rows:
                continue
            bands = _matrix(b.column("sig")).astype(np.uint64).reshape(-1, BANDS, ROWS)
            total = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2]).copy()
            for j in range(ROWS):
                total = mix(total + bands[:, :, j])
            total, each = total.view(np.int64).ravel(), np.repeat(np.arange(b.num_rows), BANDS)
            if wanted is not None:
                seen = wanted.maybe_seen(total)
                total, each = total[seen], each[seen]
            each = pa.array(each)
            yield pa.RecordBatch.from_arrays([pa.array(total), b.column("e").take(each),
                                              b.column("n").take(each)], names=["bucket", "e", "n"])

    return classes.select("e", "n", "sig").mapInArrow(run, "bucket long, e binary, n long")


def _near(rows: DataFrame, column: str, seen) -> DataFrame:
    """The rows whose ``column`` is in a bounded map, and few others: most wide rows then need no shuffle."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            near = seen.maybe_seen(b.column("key").to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(near)).select(names)

    return rows.withColumn("key", F.xxhash64(column)).mapInArrow(run, rows.schema)


def _id_keys(batch):
    yield batch.column("key").to_numpy(zero_copy_only=False)


def _sets_of(rows: DataFrame, ids, width: int) -> DataFrame:
    """(e, tokens, bits) of the documents in a bounded map of ids, and of few others, where their texts are read.

    Of documents with one set, one row stays; bits is the bit map.
    """
    def run(batches):
        import pyarrow as pa

        for b in pieces(batches, 256):
            es, sets, bits = [], [], []
            near = b.filter(pa.array(ids.maybe_seen(b.column("key").to_numpy(zero_copy_only=False))))
            for t in texts_of(near.column("text")):
                s = shingles(t, width)
                if len(s):
                    es.append(_name(s))
                    sets.append(s.view(np.int64))
                    bits.append(bit_map(s).tobytes())
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(es, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.array(bits, pa.binary())], names=["e", "tokens", "bits"])

    texts = rows.select("text", F.xxhash64("doc_id").alias("key"))
    return texts.mapInArrow(run, "e binary, tokens array<long>, bits binary").dropDuplicates(["e"])


def _similar(n1: Column, n2: Column) -> Column:
    """Sizes of two sets that can reach a similarity of 0.8."""
    return (5 * n1 >= 4 * n2) & (5 * n2 >= 4 * n1)


def _with_first(pairs: DataFrame, table: DataFrame, total: int, once: bool) -> DataFrame:
    """``pairs`` with the columns of ``table`` for a; ``once`` says that no a occurs twice."""
    return pairs.join(table, "a") if once else salted(pairs, table, "a", "b", total, pairs)


def _agreeing(pairs: DataFrame, sigs: DataFrame, once: bool) -> DataFrame:
    """The pairs (a, b, na, nb) whose signatures agree in ``AGREE`` minima at least."""
    def run(batches):
        import pyarrow as pa

        for b in pieces(batches, 4096):
            if b.num_rows:
                agree = (_matrix(b.column("sa")) == _matrix(b.column("sb"))).sum(axis=1)
                yield b.filter(pa.array(agree >= AGREE)).select(["a", "b", "na", "nb"])

    total = pairs.count()
    half = _with_first(pairs, sigs.select(F.col("e").alias("a"), F.col("sig").alias("sa")), total, once)
    both = salted(half, sigs.select(F.col("e").alias("b"), F.col("sig").alias("sb")), "b", "a", total, pairs)
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a binary, b binary, na long, nb long")


def _linked(pairs: DataFrame, sets: DataFrame, total: int, once: bool) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 80 * union."""
    half = _with_first(pairs, sets.select(F.col("e").alias("a"), F.col("tokens").alias("ta")), total, once)
    both = salted(half, sets.select(F.col("e").alias("b"), F.col("tokens").alias("tb")), "b", "a", total, pairs)
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.filter(9 * shared >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _open(lists: DataFrame) -> tuple[DataFrame, str]:
    """The rows of the buckets whose classes are not all in one component, stored."""
    sizes, path = store(lists.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                                    F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles")), "sizes")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    mixed = sizes.filter("lo <> hi").select("bucket", F.col("count").alias("members"), "shingles")
    out = store(lookup(lists.drop("members", "shingles"), mixed, "bucket", sizes, total), "lists")
    drop_scratch(lists.sparkSession, path)
    return out


def _open_pairs(lists: DataFrame) -> int:
    """How many pairs of classes of different components share a bucket (a pair counts once a bucket)."""
    per = lists.groupBy("bucket", "c").agg(F.count(F.lit(1)).cast("double").alias("k"))
    sums = per.groupBy("bucket").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("p"))
    return int((sums.agg(F.sum("p")).first()[0] or 0) / 2)


def _star_pairs(lists: DataFrame, tested: DataFrame | None) -> DataFrame:
    """An untested pair (a, b, na, nb) of each class: with the most central of the centres of its buckets.

    The other centres matter only if that pair does not join their components.
    A bucket's centre is the class that was no centre yet and meets most others
    in all its buckets: it links to more of a group of near copies than one at
    the rim.
    """
    central = lists.groupBy("e").agg(F.sum("members").alias("meets"))
    fresh = lists if tested is None else lists.join(tested.select(F.col("b").alias("e")).distinct(), "e", "left_anti")
    first = F.struct(F.col("meets").alias("meets"), F.xxhash64("e").alias("h"), F.col("e").alias("b"),
                     F.col("n").alias("nb"), F.col("c").alias("cb"))
    centres = fresh.join(central, "e").groupBy("bucket").agg(F.max(first).alias("x")).select(
        "bucket", "x.meets", "x.b", "x.nb", "x.cb")
    counts = lists.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))
    pairs = lookup(lists, centres, "bucket", counts, lists.count()).filter(
        (F.col("c") != F.col("cb")) & _similar(F.col("n"), F.col("nb")))
    pairs = pairs.select(F.col("e").alias("a"), "b", F.col("n").alias("na"), "nb", F.col("meets")).distinct()
    pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
    best = F.max(F.struct("meets", F.xxhash64("b").alias("h"), "b", "na", "nb")).alias("x")
    return pairs.groupBy("a").agg(best).select("a", "x.b", "x.na", "x.nb")


def _rest_pairs(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) between components of open buckets that their bit maps leave possible, block by block."""
    def compare(table):
        import pyarrow as pa

        e, n, block = table.column("e").to_pylist(), table.column("n").to_numpy(), table.column("block").to_numpy()
        _, c = np.unique(np.array([x.hex() for x in table.column("c").to_pylist()]), return_inverse=True)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        maps: dict[int, list] = {}
        for row, m in enumerate(table.column("bits").to_pylist()):
            maps.setdefault(len(m), []).append((row, m))
        by_size = {k: (np.array([r for r, _ in v]), np.frombuffer(b"".join(m for _, m in v), dtype=np.uint64).reshape(len(v), -1))
                   for k, v in maps.items()}
        found = []
        for k, (rows, own) in by_size.items():
            for other in (k, 2 * k):
                if other not in by_size:
                    continue
                others, theirs = by_size[other] if other == k else (by_size[other][0], _folded(by_size[other][1]))
                for at, x in enumerate(rows.tolist()):
                    fit = (c[others] != c[x]) & (5 * n[others] >= 4 * n[x]) & (5 * n[x] >= 4 * n[others])
                    if i != j:
                        fit &= block[others] != block[x]
                    if other == k:
                        fit &= others > x
                    ys = np.flatnonzero(fit)
                    if len(ys):
                        most = most_shared(own[at], int(n[x]), theirs[ys], n[others[ys]])
                        found += [(x, y) for y in others[ys[9 * most >= 4 * (n[x] + n[others[ys]])]].tolist()]
        found = [(x, y) if e[x] < e[y] else (y, x) for x, y in found]
        return pa.table({"a": pa.array([e[x] for x, _ in found], pa.binary()),
                         "b": pa.array([e[y] for _, y in found], pa.binary()),
                         "na": pa.array([int(n[x]) for x, _ in found], pa.int64()),
                         "nb": pa.array([int(n[y]) for _, y in found], pa.int64())})

    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
    rows = lists.join(sets.select("e", "bits"), "e").withColumn("block", F.pmod(F.xxhash64("e"), blocks))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block",
                       "e", "n", "c", "bits")
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary, na long, nb long").distinct()


def minhash_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed, signed_path = store(_signed(rows, width), "signed")
    classes, classes_path = store(signed.filter("n > 0").groupBy("e").agg(
        F.min("doc_id").alias("low"), F.min("n").alias("n"), F.min("sig").alias("sig"),
        F.count(F.lit(1)).alias("count")).filter("low IS NOT NULL"), "classes")
    members, members_path = store(signed.select("doc_id", "n", "e"), "members")
    drop_scratch(spark, signed_path)
    counts, counts_path = store(_buckets(classes).groupBy("bucket").count().filter("count > 1"), "buckets")
    n_buckets, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    seen = repeats.build(counts.select(F.col("bucket").alias("key")), _id_keys, n_buckets, keep_seen=True)
    lists, lists_path = store(lookup(_buckets(classes, seen), counts.select("bucket", F.col("count").alias("members")), "bucket",
                                     counts, total), "lists")
    seen.drop()
    drop_scratch(spark, counts_path)
    met, met_path = store(lists.select("e").distinct(), "met")
    n_classes = met.count()
    seen = repeats.build(met.select(F.xxhash64("e").alias("key")), _id_keys, n_classes, keep_seen=True)
    found, found_path = store(_near(classes.select("e", "low", "sig"), "e", seen).join(met, "e"), "found")
    seen.drop()
    sigs = found.select("e", "sig")
    ids = repeats.build(found.select(F.xxhash64("low").alias("key")), _id_keys, n_classes, keep_seen=True)
    sets, sets_path = store(_sets_of(rows, ids, width), "sets")
    ids.drop()
    sizes, sizes_path = store(classes.select("e", "count"), "sizes")
    drop_scratch(spark, classes_path)
    drop_scratch(spark, met_path)
    paths = [members_path, found_path, sets_path, sizes_path]
    tested, names = None, None

    def verify(pairs: DataFrame, once: bool) -> bool:
        """Whether there are links among the pairs, which join the components known so far (stars of their smallest nodes)."""
        nonlocal names
        likely, path = store(_agreeing(pairs, sigs, once), "likely")
        links, link_path = store(_linked(likely, sets, likely.count(), once), "links")
        drop_scratch(spark, path)
        paths.append(link_path)
        if links.isEmpty():
            return False
        if names is not None:
            links = links.unionByName(names.select(F.col("node").alias("a"), F.col("component").alias("b")))
        names, name_path = star_components(links)
        paths.append(name_path)
        return True

    now, now_path = lists.withColumn("c", F.col("e")), lists_path
    left, before = _open_pairs(now), None
    rounds = 0
    while left and (rounds < STAR_ROUNDS or (left > OPEN_PAIRS * n_classes and left < 0.9 * before)):
        rounds += 1
        pairs, path = store(_star_pairs(now, tested), "pairs")
        paths.append(path)
        joined = verify(pairs, once=True)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        before = left
        if not joined:
            continue
        named = now.drop("c").join(names.withColumnRenamed("node", "e"), "e", "left")
        opened, path = _open(named.withColumn("c", F.coalesce("component", "e")).drop("component"))
        drop_scratch(spark, now_path)
        now, now_path = opened, path
        left = _open_pairs(now)
    if left:
        pairs, path = store(_rest_pairs(now, sets), "pairs")
        paths.append(path)
        verify(pairs, once=False)
    paths.append(now_path)

    if names is not None:
        members = lookup(members, names.withColumnRenamed("node", "e"), "e", sizes, sizes.agg(F.sum("count")).first()[0] or 0,
                         "left").withColumn("c", F.coalesce("component", "e"))
    else:
        members = members.withColumn("c", F.col("e"))
    members, _ = store(members.select("doc_id", "n", "c"), "labelled")
    for path in paths:
        drop_scratch(spark, path)
    lows, _ = store(members.filter("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("low"),
                                                                     F.count(F.lit(1)).alias("count")), "lows")
    total = lows.agg(F.sum("count")).first()[0] or 0
    out = lookup(members, lows.select("c", "low"), "c", lows, total, "left")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
