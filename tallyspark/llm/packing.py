"""Operator 3, token ids in packed binary form: best-fit-decreasing packing.

Documents are encoded, an end id is appended, and pieces of at most ``length``
ids are packed into rows of an id matrix.  Longer documents are split without
loss: their full pieces fill rows of their own and the rest is packed like a
short document.  Within a bounded group of pieces the longest comes first and
goes to the fullest row that still has room; a segment tree over the rooms finds
it.  Rows come with cumulative segment lengths and with positions that start
again at each segment, so attention can keep documents apart.

Each task packs its own documents in groups of ``group_ids`` ids, so nothing is
shuffled and a task holds one group at a time; a hot source or a very long
document only means more groups.

Defined cases: null and empty texts have only the end id; null and repeated ids
are packed like others; without documents there are no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallyspark.llm.bpe import codec, default_path
from tallyspark.llm.text import pieces, texts_of

LENGTH, GROUP_IDS = 2048, 1 << 20


class RoomTree:
    """A segment tree over room sizes 0..length; it counts the rows that have each room."""

    def __init__(self, length: int):
        self.size = 1 << int(length).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least ``need``, taken out; None if no row has it."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: no row exceeds ``length``; pieces of a row in the order they were put there."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[piece])
        if found is None:
            rows.append([piece])
            room, row = length, len(rows) - 1
        else:
            room, row = found
            rows[row].append(piece)
        tree.add(room - sizes[piece], row)
    return rows


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH,
         group_ids: int = GROUP_IDS, end_token: str = "<|endoftext|>") -> DataFrame:
    """One row per matrix row.

    Every document ends with the id of ``end_token``, which the vocabulary file
    names; a vocabulary without it is refused.

    task, row: which row it is; ids: ``length`` little-endian unsigned 32-bit
    integers, padded with the end id; cu_seqlens: cumulative segment lengths from
    0; positions: the same shape as ids, starting again at each segment (and at
    the padding); doc_ids, starts: each segment's document and its place there.
    """
    path = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, made, own = TaskContext.get().partitionId(), 0, codec(path)
        if end_token not in own.added:
            raise ValueError(f"the vocabulary has no token {end_token!r}")
        end = own.added[end_token]
        id_type = pa.int64()
        held: list[tuple] = []
        total = 0

        def emit():
            nonlocal made, held, total
            rows = best_fit_decreasing([len(h[2]) // 4 for h in held], length)
            for at in range(0, len(rows), 256):
                out: dict[str, list] = {k: [] for k in ("ids", "cu_seqlens", "positions", "doc_ids", "starts")}
                for row in rows[at:at + 256]:
                    sizes = [len(held[i][2]) // 4 for i in row]
                    pad = length - sum(sizes)
                    out["ids"].append(b"".join(held[i][2] for i in row) + end * pad)
                    out["cu_seqlens"].append([0, *np.cumsum(sizes).tolist()])
                    out["positions"].append(np.concatenate([np.arange(n, dtype="<u4") for n in (*sizes, pad)]).tobytes())
                    out["doc_ids"].append([held[i][0] for i in row])
                    out["starts"].append([held[i][1] for i in row])
                n = len(out["ids"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int32()), pa.array(range(made, made + n), pa.int64()),
                     pa.array(out["ids"], pa.binary()), pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                     pa.array(out["positions"], pa.binary()), pa.array(out["doc_ids"], pa.list_(id_type)),
                     pa.array(out["starts"], pa.list_(pa.int64()))],
                    names=["task", "row", *out])
                made += n
            held, total = [], 0

        for b in pieces(batches):
            id_type = b.schema.field(doc_id).type
            for i, t in zip(b.column(doc_id).to_pylist(), texts_of(b.column(text)), strict=True):
                ids = own.encode(t.decode()) + end
                for at in range(0, len(ids), 4 * length):
                    part = ids[at:at + 4 * length]
                    held.append((i, at // 4, part))
                    total += len(part) // 4
                    if total >= group_ids:
                        yield from emit()
        if held:
            yield from emit()

    return docs.select(doc_id, text).mapInArrow(
        run, f"task int, row long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, "
             "starts array<long>")


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write the packed rows as files of binary columns, one file for each task's rows."""
    packed.write.parquet(path)
