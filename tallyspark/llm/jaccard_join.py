"""Operator 2, n-gram Jaccard join: vertical partitioning.

A document's set holds the hashes of its distinct five-word shingles (A-Z
folded; a shorter text is one shingle).  All shingles have one global order:
rare before frequent, then by hash.  Frequent is a shingle whose count stands
out from the mean load of ``2**SKETCH_BITS`` sketch cells: the sketch names the
cells that may hold one, only their shingles are counted, exactly, and of these
the most frequent, ``2**FREQUENT_BITS`` at most at any size of the input, are
kept.  Two sets
with a Jaccard similarity of 0.8 or more share a shingle among the first fifth
of either (prefix filter), so only those prefixes meet; a pair's overlap is then
counted by vertical partitioning: the global order is cut into fragments, the
overlaps of every fragment are counted separately, and summed by pair.

Documents with equal sets become one class first.  Of the classes that share a
prefix shingle not all pairs are formed: each is verified against one class of
its list, links make components, and only pairs between different components
are left for the next round; the last round verifies all that remain, so no
link between different components is lost.

Defined cases: null or blank texts have no shingles and are linked with nothing;
repeated rows are copies; rows with a null id follow the class of their set and
never name a component (a set that only such rows have is linked with nothing);
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import repeats
from tallyspark.llm.components import components
from tallyspark.llm.hot import lookup, salted
from tallyspark.llm.text import mix, pieces, shingles, texts_of
from tallyspark.session import drop_scratch, store

SKETCH_BITS, CHUNK = 24, 1 << 16
FREQUENT_BITS = 20
#: Counts of the sketch are summed in groups of at most about this many tasks.
SUMMED = 256
FRAGMENTS = 4
#: Ranges of the hash in which a set's tokens are counted to bound overlaps (a power of two).
RANGES = 64
#: Star rounds go on while more open pairs than this remain for each class.
OPEN_PAIRS = 8


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _set_id(tokens: np.ndarray) -> int:
    """The set's 64-bit name, mixed with its size."""
    with np.errstate(over="ignore"):
        total = mix(tokens + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _add_cells(counts: np.ndarray, tokens: np.ndarray) -> None:
    """Adds a set's sorted tokens to 16-bit counts, which stop at their largest value."""
    cells = _cells(tokens)
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    cell = cells[first]
    more = np.diff(np.append(first, len(cells)))
    counts[cell] = np.minimum(counts[cell] + more, np.iinfo(counts.dtype).max)


def _packed(counts: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(counts.astype("<u4" if counts.max() > 255 else "u1").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, form: str) -> np.ndarray:
    import pyarrow as pa

    size = CHUNK * np.dtype(form).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), dtype=form)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """One pass over the texts: (doc_id, n, e, ranges) of each document, and each task's shingle counts by sketch cell."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
        names = ["doc_id", "n", "e", "ranges", "chunk", "form", "counts"]
        shift = np.uint64(64 - (RANGES - 1).bit_length())
        id_type = None

        def by_range(sets):
            flat = np.zeros(len(sets) * RANGES, dtype=np.int32)
            for i, s in enumerate(sets):
                flat[i * RANGES:(i + 1) * RANGES] = np.bincount((s >> shift).astype(np.int64), minlength=RANGES)
            return flat

        for b in pieces(batches):
            sets = [shingles(t, width) for t in texts_of(b.column("text"))]
            for s in sets:
                _add_cells(counts, s)
            id_type = b.schema.field("doc_id").type
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([_set_id(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * RANGES, by_range(sets)),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names=names)
        for i in range(0, len(counts), CHUNK):
            part = counts[i:i + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, id_type), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
                     pa.array([i // CHUNK], pa.int32()), pa.array(["<u4" if part.max() > 255 else "u1"]),
                     pa.array([_packed(part)], pa.binary())], names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, n int, e long, ranges array<int>, chunk int, form string, counts binary")


class GlobalOrder:
    """Shingles that are not frequent first, frequent ones by powers of two of their counts, then by hash.

    Cut into fragments of about equal mass.  ``frequent`` (sorted) and ``counts``
    are the exactly counted shingles, ``cells`` marks the sketch cells that may hold one, a bit each.
    """

    def __init__(self, cells: np.ndarray, frequent: np.ndarray, counts: np.ndarray, total: int):
        self.cells, self.frequent = cells, frequent
        self.levels = (np.log2(counts) + 1).astype(np.uint8)
        mass = np.bincount(self.levels, counts, minlength=64).astype(float)
        mass[0] = total - mass.sum()
        upto, cuts = np.cumsum(mass), []
        for f in range(1, FRAGMENTS):
            goal = upto[-1] * f / FRAGMENTS
            at = min(int(np.searchsorted(upto, goal)), 63)
            part = (goal - (upto[at] - mass[at])) / max(mass[at], 1.0)
            cuts.append((at << 58) + int(min(max(part, 0.0), 0.999999) * (1 << 58)))
        self.cuts = np.array(cuts, dtype=np.uint64)

    def level(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=np.uint8)
        if len(self.frequent):
            at = np.flatnonzero(_marked(self.cells, tokens))
            place = np.minimum(np.searchsorted(self.frequent, tokens[at]), len(self.frequent) - 1)
            known = self.frequent[place] == tokens[at]
            out[at[known]] = self.levels[place[known]]
        return out

    def first(self, tokens: np.ndarray, k: int) -> np.ndarray:
        """The first k of a set's sorted tokens in global order."""
        level = self.level(tokens)
        rare = tokens[level == 0]
        return rare[:k] if len(rare) >= k else tokens[np.argsort(level, kind="stable")[:k]]

    def ordered(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set's sorted tokens in global order, and the fragment of each."""
        level = self.level(tokens)
        order = np.argsort(level, kind="stable")
        tokens = tokens[order]
        keys = (level[order].astype(np.uint64) << np.uint64(58)) | (tokens >> np.uint64(6))
        return tokens, np.searchsorted(self.cuts, keys, side="right")


def _marked(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether the bit of each token's cell is set."""
    cells = _cells(tokens)
    return ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)


def _likely_cells(stored: DataFrame, least: int) -> np.ndarray:
    """The sketch cells, a bit each, into which ``least`` shingles or more of all documents fall.

    Sums run by chunk of the sketch; with many tasks, first by groups of them.
    """
    def summed(table):
        import pyarrow as pa

        total = np.zeros(CHUNK, dtype=np.int64)
        for form, data in zip(table.column("form").to_pylist(), table.column("counts").to_pylist(), strict=True):
            total += _unpacked(data, form)
        return table.column("chunk")[0].as_py(), np.minimum(total, np.iinfo(np.uint32).max)

    def partial(table):
        import pyarrow as pa

        chunk, total = summed(table)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "form": ["<u4" if total.max() > 255 else "u1"],
                         "counts": pa.array([_packed(total)], pa.binary())})

    def marked(table):
        import pyarrow as pa

        chunk, total = summed(table)
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()])})

    rows = stored.filter("chunk IS NOT NULL").select("chunk", "form", "counts")
    tasks = rows.count() * CHUNK >> SKETCH_BITS
    if tasks > SUMMED:
        salt = F.pmod(F.xxhash64("counts"), F.lit(tasks // SUMMED + 1))
        rows = rows.withColumn("salt", salt).groupBy("chunk", "salt").applyInArrow(partial, "chunk int, form string, counts binary")
    bits = np.zeros((1 << SKETCH_BITS) // 8, dtype=np.uint8)
    for chunk, part in rows.groupBy("chunk").applyInArrow(marked, "chunk int, bits binary").collect():  # 2 MB in all
        bits[chunk * CHUNK // 8:(chunk + 1) * CHUNK // 8] = np.frombuffer(part, dtype=np.uint8)
    return bits


def _least_count(total: int) -> int:
    """A count that the cells of ``total`` shingles which are all rare hardly reach: six deviations above the mean load."""
    load = total / (1 << SKETCH_BITS)
    return max(2, int(np.ceil(load + 6 * np.sqrt(load))))


def _global_order(rows: DataFrame, stored: DataFrame, width: int) -> GlobalOrder:
    """The order of all shingles of ``rows``; a cell with too few of them in all holds no frequent one."""
    spark = rows.sparkSession
    total = int(stored.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0)
    least = _least_count(total)
    cells = _likely_cells(stored, least)
    likely = spark.sparkContext.broadcast(cells)  # 2 MB

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def counted():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"token": token.view(np.int64), "n": n.astype(np.int64)})

        for b in pieces(batches):
            for t in texts_of(b.column("text")):
                s = shingles(t, width)
                held.append(s[_marked(likely.value, s)])
                size += len(held[-1])
                if size >= 1 << 20:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = rows.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted, path = store(counts.filter(F.col("n") >= least), "frequent")
    likely.destroy()
    level = F.floor(8 * F.log2("n"))
    room, lowest = 1 << FREQUENT_BITS, 8 * 64
    for at, k in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 8 * 64 rows
        if k > room:
            break
        room, lowest = room - k, at
    found = counted.filter(level >= lowest).toArrow()  # at most 2**FREQUENT_BITS rows
    drop_scratch(spark, path)
    tokens = found.column("token").to_numpy().view(np.uint64)
    by_hash = np.argsort(tokens)
    return GlobalOrder(cells, tokens[by_hash], found.column("n").to_numpy()[by_hash], total)


def _prefixes(docs: DataFrame, width: int, order) -> DataFrame:
    """(token, e, n, pos): each document's prefix, the first n - ceil(0.8 n) + 1 shingles of its set."""
    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for t in texts_of(b.column("text")):
                s = shingles(t, width)
                if len(s):
                    n = len(s)
                    first = order.value.first(s, n - (4 * n + 4) // 5 + 1)
                    out.append((first.view(np.int64), _set_id(s), n))
            if out:
                sizes = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_pydict({
                    "token": np.concatenate([x[0] for x in out]),
                    "e": np.repeat(np.array([x[1] for x in out], dtype=np.int64), sizes),
                    "n": np.repeat(np.array([x[2] for x in out], dtype=np.int32), sizes),
                    "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])})

    return docs.mapInArrow(run, "token long, e long, n int, pos int")


def _segments(rows: DataFrame, width: int, order, ids) -> DataFrame:
    """(e, frag, tokens, copy): the sets of the documents in a bounded map of ids, and of few others, cut into fragments."""
    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            es, frags, parts, copies = [], [], [], []
            near = b.filter(pa.array(ids.maybe_seen(b.column("key").to_numpy(zero_copy_only=False))))
            for t in texts_of(near.column("text")):
                s = shingles(t, width)
                if not len(s):
                    continue
                tokens, frag = order.value.ordered(s)
                for part in np.split(tokens, np.flatnonzero(np.diff(frag)) + 1):
                    parts.append(np.sort(part).view(np.int64))
                fs = frag[np.r_[0, np.flatnonzero(np.diff(frag)) + 1]]
                es += [_set_id(s)] * len(fs)
                copies += [uuid.uuid4().int >> 65] * len(fs)
                frags += fs.tolist()
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(es, pa.int64()), pa.array(frags, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(copies, pa.int64())],
                names=["e", "frag", "tokens", "copy"])

    return rows.select("text", F.xxhash64("doc_id").alias("key")).mapInArrow(
        run, "e long, frag int, tokens array<long>, copy long")


def _similar(n1: Column, n2: Column) -> Column:
    """Sizes of two sets that can reach a similarity of 0.8."""
    return (5 * n1 >= 4 * n2) & (5 * n2 >= 4 * n1)


def _room(n1: str, p1: str, n2: str, p2: str) -> Column:
    """Whether two sets whose first common token stands at these places can still reach a similarity of 0.8.

    A pair that can is let through at its first common token at least.
    """
    return 9 * F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= 4 * (F.col(n1) + F.col(n2))


def _only(df: DataFrame, column: str, test) -> DataFrame:
    """Rows of ``df`` whose long ``column`` passes a vectorised test."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(test(b.column(column).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(run, df.schema)


def _column_keys(column: str):
    def keys(batch):
        yield batch.column(column).to_numpy(zero_copy_only=False)

    return keys


def _sets_of(pairs: DataFrame, rows: DataFrame, prefixes: DataFrame, width: int, order) -> tuple[DataFrame, list[str]]:
    """The stored segments of the classes in ``pairs``, from the text of each one's first document, where it is read.

    A bounded map of the first documents' ids leaves nearly all other texts out;
    the few others are of classes that no pair has, or copies.  Of several
    documents with one set the segments of one copy count; the table of such
    classes is stored, so that the segments meet it unmoved while it is small.
    """
    es = pairs.select(F.explode(F.array("a", "b")).alias("e")).distinct()
    wanted, path = store(prefixes.select("e", F.xxhash64("doc_id").alias("key")).join(es, "e").select("key"), "wanted")
    ids = repeats.build(wanted, _column_keys("key"), wanted.count(), keep_seen=True)
    segments, segment_path = store(_segments(rows, width, order, ids), "segments")
    drop_scratch(rows.sparkSession, path)
    ids.drop()
    repeated, repeated_path = store(segments.groupBy("e").agg(F.min("copy").alias("first"), F.max("copy").alias("last"))
                                    .filter("first <> last").select("e", "first"), "copies")
    one = segments.join(repeated, "e", "left").filter("first IS NULL OR copy = first").drop("copy", "first")
    return one, [segment_path, repeated_path]


def _possible(pairs: DataFrame, prefixes: DataFrame, n_pairs: int) -> tuple[DataFrame, str]:
    """The pairs that the overlap of their prefixes and the counts of their tokens by range leave possible, stored; and the path.

    A bounded map of the pairs' classes keeps nearly all other prefixes out of
    the shuffles.  In no range can two sets share more tokens than the smaller count.

    Of two sets, let x be the one whose prefix ends first.  All common tokens up
    to there are in both prefixes (k of them); behind it x has ceil(0.8 n) - 1
    tokens left, so the overlap is at most k + ceil(0.8 n) - 1.
    """
    ids = repeats.build(pairs.select(F.explode(F.array("a", "b")).alias("e")), _column_keys("e"), 2 * n_pairs, keep_seen=True)
    near = _only(prefixes, "e", ids.maybe_seen)
    left = pairs.join(near.select(F.col("e").alias("a"), F.col("tokens").alias("ta"), F.col("ranges").alias("ra")), "a")
    right = near.select(F.col("e").alias("b"), F.col("tokens").alias("tb"), F.col("ranges").alias("rb"))
    both = salted(left, right, "b", "a", n_pairs, pairs)
    behind = F.floor((4 * F.greatest("na", "nb") + 4) / 5) - 1
    shared = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    most = F.least(F.size(F.array_intersect("ta", "tb")) + behind, shared)
    out = store(both.filter(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb"), "pairs")
    ids.drop()
    return out


def _verified(pairs: DataFrame, segments: DataFrame, n_pairs: int) -> DataFrame:
    """Links among ``pairs`` (a, b, na, nb): overlaps by fragment, summed by pair; 9 o >= 4 (na + nb).

    A hub that meets a large part of all classes is sent to many tasks.
    """
    left = pairs.join(segments.select(F.col("e").alias("a"), "frag", F.col("tokens").alias("ta")), "a")
    right = segments.select(F.col("e").alias("b"), "frag", F.col("tokens").alias("tb"))
    partial = salted(left, right, "b", "a", n_pairs, pairs, ("frag",)).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("o"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return sums.filter(9 * F.col("o") >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _labelled(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """``lists`` plus each class's component c and each token's count, without the tokens whose classes are all in one.

    Also the tokens' counts, and the paths of both stored tables.
    """
    c = components(links).select(F.col("node").alias("e"), "component")
    rows = lists.join(c, "e", "left").withColumn("c", F.coalesce("component", "e")).drop("component")
    mixed, mixed_path = store(rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                                        F.count(F.lit(1)).alias("count")).filter("lo <> hi"), "mixed")
    total = mixed.agg(F.sum("count")).first()[0] or 0
    open_lists, path = store(lookup(rows, mixed.select("token", "count"), "token", mixed, total), "lists")
    return open_lists, mixed, [mixed_path, path]


def _star_pairs(lists: DataFrame, tested: DataFrame | None, sizes: DataFrame) -> tuple[DataFrame, str]:
    """The untested pairs of each class with the hubs of its lists; ``sizes`` has the count of each token.

    Also the path of the hubs, which are stored: the lists of hot tokens and all others meet them apart.

    The hub of a list (in a band of sizes) is the most central of the classes
    that were no hub yet, the one that meets most others in all its lists: it
    links to more of a group of near copies than a class that lies at the rim.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.25)))
    total = sizes.agg(F.sum("count")).first()[0] or 0
    met = lists if "count" in lists.columns else lookup(lists, sizes.select("token", "count"), "token", sizes, total)
    central = met.groupBy("e").agg(F.sum("count").alias("meets"))
    lists = lists.drop("count").withColumn("band", band)
    fresh = lists.join(central, "e")
    fresh = fresh if tested is None else fresh.join(tested.select(F.col("b").alias("e")).distinct(), "e", "left_anti")
    first = F.struct(F.col("meets").alias("meets"), F.xxhash64("e").alias("h"), F.col("e").alias("e"), F.col("n").alias("n"),
                     F.col("c").alias("c"), F.col("pos").alias("pos"))
    hubs, path = store(fresh.groupBy("token", "band").agg(F.max(first).alias("hub")).groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("band", "hub"))).alias("hubs")), "hubs")  # a few dozen bands
    at = F.col("hubs")[F.col("band")]
    pairs = (lookup(lists, hubs, "token", sizes, total)
             .select("e", "n", "c", "pos", at["e"].alias("b"), at["n"].alias("nb"), at["c"].alias("cb"), at["pos"].alias("pb"))
             .filter((F.col("c") != F.col("cb")) & _similar(F.col("n"), F.col("nb")) & _room("n", "pos", "nb", "pb"))
             .select(F.col("e").alias("a"), F.col("n").alias("na"), "b", "nb").distinct())
    return (pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")), path


def _open_pairs(lists: DataFrame) -> int:
    """How many pairs of classes from different components share a list."""
    per = lists.groupBy("token", "c").agg(F.count(F.lit(1)).cast("double").alias("k"))
    sums = per.groupBy("token").agg((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))).alias("p"))
    return int((sums.agg(F.sum("p")).first()[0] or 0) / 2)


def _rest_pairs(lists: DataFrame, tested: DataFrame) -> DataFrame:
    """All pairs between components that the size and position of a shared token leave possible."""
    a = lists.select("token", F.col("e").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ca"))
    b = lists.select("token", F.col("e").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"))
    pairs = a.join(b, "token").filter(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _similar(F.col("na"), F.col("nb"))
        & _room("na", "pa", "nb", "pb")).select("a", "b", "na", "nb").distinct()
    done = tested.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                         .alias("p")).select("p.*")
    return pairs.join(done, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    with_class: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    ``with_class`` adds ``e``, the name of the document's set.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stored, sets_path = store(_sets(rows, width), "sets")
    order = spark.sparkContext.broadcast(_global_order(rows, stored, width))
    members = stored.filter("chunk IS NULL").select("doc_id", "n", "e")

    # lists of classes that share a prefix token; tokens that certainly occur once are not shuffled
    index, index_path = store(_prefixes(rows, width, order), "prefixes")
    again = repeats.build(index.select("token"), _column_keys("token"), index.count())
    met, met_path = store(_only(index, "token", again.maybe_repeated), "met")
    drop_scratch(spark, index_path)
    again.drop()
    shared = met.groupBy("token").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).filter("lo <> hi").select("token")
    lists, lists_path = store(met.join(shared, "token").distinct(), "lists")
    drop_scratch(spark, met_path)
    n_classes = lists.agg(F.approx_count_distinct("e")).first()[0]
    firsts = stored.filter("chunk IS NULL AND doc_id IS NOT NULL").groupBy("e").agg(
        F.min("doc_id").alias("doc_id"), F.max("ranges").alias("ranges"))

    own = lists.groupBy("e").agg(F.collect_list("token").alias("tokens"))
    prefixes, prefix_path = store(own.join(firsts, "e"), "tokens")
    paths, links, tested, before = [sets_path, lists_path, prefix_path], None, None, None
    open_lists = lists.withColumn("c", F.col("e"))
    sizes, size_path = store(lists.groupBy("token").agg(F.count(F.lit(1)).alias("count")), "sizes")
    paths.append(size_path)

    def verify(pairs: DataFrame) -> None:
        nonlocal links, tested
        pairs, pair_path = store(pairs, "pairs")
        likely, likely_path = _possible(pairs, prefixes, pairs.count())
        segments, segment_paths = _sets_of(likely, rows, prefixes, width, order)
        found, link_path = store(_verified(likely, segments, FRAGMENTS * likely.count()), "links")
        for path in segment_paths:
            drop_scratch(spark, path)
        paths.extend([pair_path, likely_path, link_path])
        done = pairs.select("a", "b")
        tested = done if tested is None else tested.unionByName(done)
        links = found if links is None else links.unionByName(found)

    while n_classes:
        if tested is None:  # every class is a component
            k = F.col("count").cast("double")
            left = int((sizes.agg(F.sum(k * (k - 1))).first()[0] or 0) / 2)
        else:
            left = _open_pairs(open_lists)
        if tested is not None and (left <= OPEN_PAIRS * n_classes or left > 0.9 * before):
            break
        before = left
        star_pairs, hub_path = _star_pairs(open_lists, tested, sizes)
        verify(star_pairs)
        drop_scratch(spark, hub_path)
        # a list whose classes are all in one component stays so
        open_lists, sizes, new_paths = _labelled(open_lists.drop("c", "count"), links)
        paths.extend(new_paths)
    if n_classes:
        verify(_rest_pairs(open_lists, tested))
        named = components(links).select(F.col("node").alias("e"), "component")
        labelled = members.join(named, "e", "left")
    else:
        labelled = members.withColumn("component", F.lit(None).cast("long"))
    labelled, _ = store(labelled, "labelled")
    order.destroy()
    for path in paths:
        drop_scratch(spark, path)

    filled = F.when(F.col("n") > 0, F.coalesce("component", "e"))
    labelled = labelled.withColumn("c", filled)
    lowest, _ = store(labelled.filter("c IS NOT NULL").groupBy("c").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("count")), "lowest")
    total = lowest.agg(F.sum("count")).first()[0] or 0
    out = lookup(labelled, lowest.select("c", "low"), "c", lowest, total, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("low", "doc_id").alias("component_id"), *(["e"] if with_class else []))


def _named(rows: DataFrame, text: str, width: int) -> DataFrame:
    """``rows`` with ``_set``, the name of each row's set."""
    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            names = [_set_id(shingles(t, width)) for t in texts_of(b.column(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], names=[*b.schema.names, "_set"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_set", T.LongType())]))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` that are the first of their component (rows with a null id stay).

    Of rows that share an id but not their set, each follows its own set.
    """
    spark = docs.sparkSession
    verdicts, path = store(near_duplicates(docs, doc_id, text, width, with_class=True).filter("doc_id IS NOT NULL"), "verdicts")
    gone = F.col("doc_id") != F.col("component_id")
    ids, _ = store(verdicts.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(gone).alias("_gone")).filter("_gone > 0"), "gone")
    out = docs.join(ids, docs[doc_id] == F.col("_id"), "left_anti")
    mixed = ids.filter("_gone < _rows")
    if mixed.isEmpty():
        drop_scratch(spark, path)
        return out
    some = _named(docs.join(mixed, docs[doc_id] == F.col("_id"), "left_semi"), text, width)
    sets = verdicts.filter(gone).select(F.col("doc_id").alias("_id"), F.col("e").alias("_e")).distinct()
    stay = some.join(sets, (some[doc_id] == F.col("_id")) & (F.col("_set") == F.col("_e")), "left_anti")
    return out.unionByName(stay.drop("_set"))
