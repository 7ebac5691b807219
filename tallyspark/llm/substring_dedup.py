"""Operator 10, substring dedup: block anchors.

A word is removed when it lies in a window of 13 consecutive words whose word
sequence also starts in a document with a smaller id.  Any 13 words hold seven
7-word blocks; the block with the smallest hash is the window's anchor, so equal
windows have equal anchors wherever they stand.  Every window of every document
is dealt to a bucket by its anchor; windows that follow each other mostly share
it and travel as one run.  In a bucket windows meet by hash, and those whose
smallest document precedes their own are repeats.  Overlapping repeats together
are the maximal exact repeats, which are cut out.

Nothing is held of all documents at once: a piece of some MB of text settles its
own repeats and sends every hash on once, so a window spread over a third of all
documents is one entry a piece, and buckets grow in number with the words.  An
anchor that many different windows share (a line that all documents end with)
gives way to the windows' own hashes, so that it fills no bucket.

Defined cases: null texts have no words; documents of fewer than 13 words lose
none; null ids come after all others and never precede one; rows that share
their id are told apart by 31 bits of a hash of their text and remove nothing
from each other;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import repeats
from tallyspark.llm.text import pieces, texts_of, window_hashes, word_hashes, word_starts
from tallyspark.session import drop_scratch, store

WINDOW, BLOCK = 13, 7
MARK = 0x7FFFFFFF
#: Bytes of text whose windows are sorted together in a task.
PIECE = 4 << 20
#: A run of windows: its row's mark, the first one's begin, how many there are. ``ALSO`` is set in the begin of a window
#: (then a run of its own) that stands elsewhere in the same text too.
RUN, ALSO = np.dtype([("mark", "<i4"), ("at", "<u4"), ("n", "u1")]), 1 << 31
#: The rank of a null id.
NONE = np.iinfo(np.int64).max
#: Documents from which common anchors are told; the dealing alone depends on them, never the result.
PROBE = 20_000


def _pieces(batches):
    """The rows of ``batches`` in tables of about ``PIECE`` bytes."""
    import pyarrow as pa

    held, size = [], 0
    for b in pieces(batches, 64):
        held.append(b)
        size += b.nbytes
        if size >= PIECE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin, hash and anchor of all windows, in order."""
    data = b" ".join(texts)
    words = word_hashes(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(word_starts(np.frombuffer(data, dtype=np.uint8)), np.r_[0, ends])
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(texts)), n)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begin + first[row]
    low = window_hashes(words, BLOCK)
    for step in (1, 2, 3):  # the least of 2, of 4, of 7 blocks
        low = np.minimum(low[:-step], low[step:])
    return row, begin, window_hashes(words, WINDOW)[at], low[at]


def _ranks(ids) -> np.ndarray:
    """Numbers in the order of the ids, ``NONE`` for null ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    out = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    out[ids.is_null().to_numpy(zero_copy_only=False)] = NONE
    return out


def _meet(g: np.ndarray, rank: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows with hashes that come twice: those after the smallest ``rank[of]`` of their hash, and those that have it."""
    order = np.argsort(g)
    same = np.diff(g[order]) == 0
    some = order[np.r_[same, False] | np.r_[False, same]] if len(g) else order
    if not len(some):
        return some, some
    hashes, r = g[some], rank[of[some]]
    begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    low = np.repeat(np.minimum.reduceat(r, begin), np.diff(np.r_[begin, len(r)]))
    return some[r > low], some[r == low]


def _settled(g: np.ndarray, rank: np.ndarray, row: np.ndarray):
    """A piece's repeats; the windows to send on, one of each hash and row; those of them that their row has again."""
    later, least = _meet(g, rank, row)
    least = least[np.lexsort((least, g[least]))]
    twin = np.zeros(len(least), dtype=bool)
    twin[1:] = (g[least[1:]] == g[least[:-1]]) & (row[least[1:]] == row[least[:-1]])
    sent, also = np.ones(len(g), dtype=bool), np.zeros(len(g), dtype=bool)
    sent[later] = sent[least[twin]] = False
    also[least[:-1][~twin[:-1] & twin[1:]]] = True
    return np.sort(later), np.flatnonzero(sent), also


def _runs(key: np.ndarray, row: np.ndarray, at: np.ndarray, also: np.ndarray, marks: np.ndarray):
    """First windows of the runs (same key and row, following begins, at most 128), and the runs themselves."""
    cut = (at & 127 == 0) | also
    cut[1:] |= (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | also[:-1]
    cut[:1] = True
    first = np.flatnonzero(cut)
    runs = np.empty(len(first), dtype=RUN)
    runs["mark"], runs["at"] = marks[row[first]], at[first] | also[first] * ALSO
    runs["n"] = np.diff(np.r_[first, len(at)])
    return first, runs


def _begins(runs: np.ndarray) -> np.ndarray:
    n = runs["n"].astype(np.int64)
    return np.repeat((runs["at"] & MARK) - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _packed(cuts: np.ndarray, items: np.ndarray):
    """A binary array of the items between the cuts."""
    import pyarrow as pa

    offsets = pa.py_buffer((cuts * items.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(items))])


def _dealt(docs: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """A row for each piece and bucket: the runs of its windows with their ids and hashes; below 0 a piece's own repeats."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for table in _pieces(batches):
            row, at, g, anchor = _windows(texts_of(table.column("text")))
            if not len(g):
                continue
            ids, marks = table.column("doc_id").combine_chunks(), table.column("mark").to_numpy()
            later, sent, also = _settled(g, _ranks(ids), row)
            deal = anchor[sent]
            if len(common):
                near = np.minimum(np.searchsorted(common, deal), len(common) - 1)
                deal = np.where(common[near] == deal, g[sent], deal)
            deal = (deal % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.argsort(deal, kind="stable")
            sent, own = sent[order], -1 - int(marks.sum(dtype=np.int64) % buckets)
            key = np.r_[np.full(len(later), own), deal[order]]
            every = np.r_[later, sent]
            first, runs = _runs(key, row[every], at[every], np.r_[np.zeros(len(later), dtype=bool), also[sent]], marks)
            part = np.flatnonzero(np.r_[True, key[first[1:]] != key[first[:-1]]])
            upto = np.r_[part, len(first)]
            ends = np.maximum(np.r_[first[part], len(every)] - len(later), 0)  # a piece's own repeats need no hashes
            listed = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), ids.take(pa.array(row[every[first]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first[part]], pa.int32()), listed, _packed(upto, runs), _packed(ends, g[sent])],
                names=["bucket", "ids", "runs", "hashes"])

    return docs.mapInArrow(run, f"bucket int, ids array<{kind}>, runs binary, hashes binary")


def _repeated(dealt: DataFrame, kind: str) -> DataFrame:
    """doc_id, mark and runs of windows that also start in a document with a smaller id."""
    def run(key, table):
        import pyarrow as pa

        runs = np.frombuffer(b"".join(table.column("runs").to_pylist()), dtype=RUN)
        ids = pa.concat_arrays([c.flatten() for c in table.column("ids").chunks])
        rank = _ranks(ids)
        if key[0].as_py() >= 0:
            g = np.frombuffer(b"".join(table.column("hashes").to_pylist()), dtype="<u8")
            of = np.repeat(np.arange(len(runs)), runs["n"])
            later = np.sort(_meet(g, rank, of)[0])
            at = _begins(runs)[later]
            of, also = of[later], runs["at"][of[later]] >= ALSO
            # runs of one row follow each other; any others with its id and mark may join them
            doc = np.cumsum(np.r_[False, (rank[1:] != rank[:-1]) | (runs["mark"][1:] != runs["mark"][:-1])])
            first, found = _runs(of * 0, doc[of], at, also, runs["mark"][np.r_[True, np.diff(doc) > 0]])
            of = of[first]
        else:
            of, found = np.arange(len(runs)), runs
            doc = np.cumsum(np.r_[False, (rank[1:] != rank[:-1]) | (runs["mark"][1:] != runs["mark"][:-1])])
        part = np.flatnonzero(np.r_[True, np.diff(doc[of]) != 0]) if len(of) else of
        return pa.Table.from_arrays(
            [ids.take(pa.array(of[part])), pa.array(found["mark"][part], pa.int32()),
             _packed(np.r_[part, len(of)], found)], names=["doc_id", "mark", "runs"])

    return dealt.groupBy("bucket").applyInArrow(run, f"doc_id {kind}, mark int, runs binary")


def _common(docs: DataFrame, n_docs: int, buckets: int) -> np.ndarray:
    """Anchors of more than a quarter of a bucket's windows (so at most four a bucket), ascending."""
    def run(batches):
        import pyarrow as pa

        for table in _pieces(batches):
            _, _, g, anchor = _windows(texts_of(table.column("text")))
            found, n = np.unique(anchor[np.unique(g, return_index=True)[1]], return_counts=True)
            some = n > WINDOW
            yield pa.RecordBatch.from_arrays([pa.array([None, *found[some].view(np.int64).tolist()], pa.int64()),
                                              pa.array([len(g), *n[some].tolist()], pa.int64())], names=["anchor", "n"])

    probe = docs.sample(min(1.0, PROBE / n_docs), seed=10).mapInArrow(run, "anchor long, n long")
    counts, path = store(probe.groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counts.filter("anchor IS NULL").select("n").first()
    least = (total[0] if total else 0) // (4 * buckets)
    common = [r[0] for r in counts.filter(F.col("anchor").isNotNull() & (F.col("n") > least)).select("anchor").collect()]
    drop_scratch(docs.sparkSession, path)
    return np.sort(np.array(common, dtype=np.int64).view(np.uint64))


def _cut(rows: DataFrame, ids: repeats.RepeatFilter | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words outside the windows of ``runs``.

    With ``ids`` only the rows whose ``key`` is certainly not among these, whole.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def left(words: list[bytes], text: bytes, parts) -> list[bytes]:
        runs = np.frombuffer(b"".join(parts.as_py()), dtype=RUN)
        at = _begins(runs)
        also = runs["at"][runs["at"] >= ALSO] & MARK
        if len(also):
            g = window_hashes(word_hashes(text), WINDOW)
            at = np.r_[at, np.flatnonzero(np.isin(g, g[also]))]
        size = len(words) + 1
        inside = np.bincount(at, minlength=size) - np.bincount(at + WINDOW, minlength=size)
        return list(compress(words, (np.cumsum(inside[:-1]) == 0).tolist()))

    def run(batches):
        import pyarrow as pa

        for b in batches if ids is None else _outside(batches, ids):
            for b in pieces([b]):
                n, gone, kept = [], [], []
                parts = [None] * b.num_rows if ids else b.column("runs")
                for t, p in zip(texts_of(b.column("text")), parts, strict=True):
                    words = t.split()  # bytes split at exactly the six white-space bytes
                    n.append(len(words))
                    if p is not None and p.is_valid:
                        words = left(words, t, p)
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def _outside(batches, ids: repeats.RepeatFilter, inside: bool = False):
    """The rows whose ``key`` is certainly not (or may be) among the ids."""
    import pyarrow as pa

    for b in batches:
        hit = ids.maybe_seen(b.column("key").to_numpy(zero_copy_only=False))
        yield b.filter(pa.array(hit if inside else ~hit))


def _key_array(batch):
    yield batch.column("key").to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = 28) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (its remaining words, joined by one space)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       (F.xxhash64(F.col(text)).bitwiseAND(MARK)).cast("int").alias("mark"))
    n_docs, n_chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(F.col(text)))).first()
    n_words = (n_chars or 0) // 6
    # of some 2**18 windows, on large inputs of up to 2**21; on small ones some for every task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(n_words >> 12, 4 * tasks), min(n_words >> 18, max(1 << 14, n_words >> 21)))
    common = _common(rows, n_docs, buckets) if buckets > 1 else np.empty(0, dtype=np.uint64)
    found = _repeated(_dealt(rows, buckets, common), rows.schema["doc_id"].dataType.simpleString())
    spans, _ = store(found.groupBy("doc_id", "mark").agg(F.collect_list("runs").alias("runs"))
                     .withColumn("key", F.xxhash64("doc_id", "mark")), "spans")

    # only the texts that lose words meet their spans; all others are done where they are read
    ids = repeats.build(spans.select("key"), _key_array, spans.count(), max_bits, keep_seen=True)
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "mark"))
    s = spans.select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), "runs")
    joined = keyed.mapInArrow(lambda batches: _outside(batches, ids, inside=True), keyed.schema).join(
        s, F.col("doc_id").eqNullSafe(F.col("s_id")) & F.col("mark").eqNullSafe(F.col("s_mark")), "left")
    return _cut(joined.select("doc_id", "text", "runs")).unionByName(_cut(keyed, ids))
