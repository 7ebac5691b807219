"""Operator 13, centroid clustering (exact k-means) with heap-ordered bounds.

Vectors are kept in blocks, each block with one heap per cluster.  A heap orders
the cluster's vectors by their gap (distance to the second nearest centroid less
that to the nearest, when last computed) plus the drift that the cluster had
accumulated by then.  Each round adds to a cluster's drift how far its own
centroid and the farthest moving other one went; only vectors whose key is
reached are popped and rescanned against all centroids, in exact integers.  All
others are certain to stay, so results equal those of the plain algorithm.

The blocks' vectors are written once, in a table bucketed by block; the small
state (clusters, heaps, exact sums) is written each round, bucketed alike, so
that the two meet without a shuffle.  A lost executor's tasks start again from
these tables.  Only the sums by cluster and component reach the driver.

Defined cases: a vector that is null, has another number of components, or a
null or non-finite one is left out; components are floor(1024 x), held within
+-2**26 so that squared distances fit a long; repeated rows count each; a null
id comes last among the seeds; fewer vectors than clusters give as many
clusters; sums beyond a long are held at its limit; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.text import small_batches
from tallyspark.session import drop_scratch, scratch_dir, store

BLOCK = 4096
LIMIT = 1 << 26
_LONG = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    """Components as integers floor(1024 x), held within the limit."""
    return np.clip(np.floor(values.astype(np.float64) * 1024), -LIMIT, LIMIT).astype(np.int32)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number), exact squared distance, and a safe lower bound of the gap."""
    who = np.empty(len(vectors), dtype=np.int32)
    dist = np.empty(len(vectors), dtype=np.int64)
    gap = np.empty(len(vectors))
    for at in range(0, len(vectors), 512):
        d = np.empty((len(vectors[at:at + 512]), len(centroids)), dtype=np.int64)
        for c, centre in enumerate(centroids):
            diff = vectors[at:at + 512].astype(np.int64) - centre
            d[:, c] = (diff * diff).sum(axis=1)
        first = d.argmin(axis=1)
        who[at:at + 512] = first
        dist[at:at + 512] = d[np.arange(len(d)), first]
        d[np.arange(len(d)), first] = _LONG
        second = np.sqrt(d.min(axis=1).astype(np.float64))
        gap[at:at + 512] = np.inf if len(centroids) == 1 else (
            second - np.sqrt(dist[at:at + 512].astype(np.float64)) - 1e-9 * (1 + second))
    return who, dist, gap


class Block:
    """One block's clusters, heaps of (key, vector) and exact sums (k rows of components and count)."""

    def __init__(self, vectors: np.ndarray, centroids: np.ndarray):
        self.vectors = vectors
        self.cluster = np.full(len(vectors), -1, dtype=np.int32)
        self.heaps: list[list] = [[] for _ in centroids]
        self.sums = np.zeros((len(centroids), vectors.shape[1] + 1), dtype=np.int64)

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pops the vectors whose gap has been used up."""
        out = []
        for heap, d in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= d:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, dtype=np.int64)

    def place(self, rows: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Rescans ``rows`` and puts them into their clusters' heaps."""
        who, _, gap = nearest(self.vectors[rows], centroids)
        full = np.c_[self.vectors[rows].astype(np.int64), np.ones(len(rows), dtype=np.int64)]
        was = self.cluster[rows]
        np.subtract.at(self.sums, was[was >= 0], full[was >= 0])
        np.add.at(self.sums, who, full)
        self.cluster[rows] = who
        keys = gap + drift[who]
        for c in range(len(self.heaps)):
            new = np.flatnonzero(who == c)
            items = list(zip(keys[new].tolist(), rows[new].tolist(), strict=True))
            if len(items) > len(self.heaps[c]):
                self.heaps[c] += items
                heapq.heapify(self.heaps[c])
            else:
                for item in items:
                    heapq.heappush(self.heaps[c], item)


STATE = ("block long, cluster binary, key array<binary>, member array<binary>, sums array<long>, scanned long")


def _state_batch(ids: list, blocks: list[Block], scanned: list[int]):
    import pyarrow as pa

    def lists(kind: str, at: int):
        return pa.array([[np.array([x[at] for x in h], dtype=kind).tobytes() for h in b.heaps] for b in blocks],
                        pa.list_(pa.binary()))

    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([b.cluster.tobytes() for b in blocks], pa.binary()), lists("<f8", 0),
         lists("<i4", 1), pa.array([b.sums.ravel() for b in blocks], pa.list_(pa.int64())), pa.array(scanned, pa.int64())],
        names=["block", "cluster", "key", "member", "sums", "scanned"])


def _rows(batch):
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


class Clustering:
    """The tables of one run: blocks of vectors, and the state after each assignment."""

    def __init__(self, vectors: DataFrame, vec_id: str, vector: str, dim: int, k: int, salt: str):
        self.spark, self.dim = vectors.sparkSession, dim
        kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).filter(
            (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
        name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
        seeds = kept.orderBy(name.asc_nulls_last(), F.col("v")).limit(k).select("v").collect()
        self.centroids = np.array([whole(np.array(r.v)) for r in seeds], dtype=np.int64)
        self.drift = np.zeros(len(seeds))
        self.id_type = kept.schema["vec_id"].dataType.simpleString()
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        self.state = None
        if len(seeds):
            self.blocks = self._bucketed(self._blocked(kept), "vectors")

    def _bucketed(self, df: DataFrame, kind: str) -> str:
        name, path = f"tallyspark_{kind}_{uuid.uuid4().hex[:12]}", scratch_dir(self.spark, kind)
        df.write.bucketBy(self.buckets, "block").option("path", path).format("parquet").saveAsTable(name)
        self.tables[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_scratch(self.spark, self.tables.pop(name))

    def _blocked(self, kept: DataFrame) -> DataFrame:
        """(block, ids, vectors): each task packs its vectors into blocks, which are then dealt by their numbers."""
        dim, id_type = self.dim, self.id_type

        def pack(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            n_blocks = 0

            def block(ids, parts):
                nonlocal n_blocks
                number = (TaskContext.get().partitionId() << 32) + n_blocks
                n_blocks += 1
                return pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_kind)),
                     pa.array([np.concatenate(parts).astype("<i4").tobytes()], pa.binary())], names=["block", "ids", "vectors"])

            ids, parts, id_kind = [], [], None
            for b in batches:
                id_kind = b.schema.field("vec_id").type
                for at in range(0, b.num_rows, 512):
                    piece = b.slice(at, 512)
                    ids += piece.column("vec_id").to_pylist()
                    parts.append(whole(piece.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)))
                    if len(ids) >= BLOCK:
                        yield block(ids, parts)
                        ids, parts = [], []
            if ids:
                yield block(ids, parts)

        return kept.mapInArrow(pack, f"block long, ids array<{id_type}>, vectors binary").repartition(self.buckets, "block")

    def assign(self) -> None:
        """Every vector to its nearest centroid: all at first, later those whose gap expired."""
        centroids, drift, dim = self.centroids, self.drift.copy(), self.dim

        def run(batches):
            for b in batches:
                for r in _rows(b):
                    block = Block(np.frombuffer(r["vectors"], dtype="<i4").reshape(-1, dim), centroids)
                    if r.get("cluster") is None:
                        rows = np.arange(len(block.vectors))
                    else:
                        block.cluster = np.frombuffer(r["cluster"], dtype=np.int32).copy()
                        block.heaps = [list(zip(np.frombuffer(k, dtype="<f8").tolist(), np.frombuffer(m, dtype="<i4").tolist(),
                                                strict=True)) for k, m in zip(r["key"], r["member"], strict=True)]
                        block.sums = np.array(r["sums"], dtype=np.int64).reshape(len(centroids), dim + 1)
                        rows = block.expired(drift)
                    block.place(rows, centroids, drift)
                    yield _state_batch([r["block"]], [block], [len(rows)])

        given = self.spark.table(self.blocks).select("block", "vectors")
        if self.state:
            given = given.join(self.spark.table(self.state).drop("scanned").hint("shuffle_hash"), "block")
        new = self._bucketed(given.mapInArrow(run, STATE), "state")
        if self.state:
            self.drop(self.state)
        self.state = new

    def update(self) -> None:
        """Each non-empty centroid becomes the exact floor of its vectors' mean; drifts grow by the moves."""
        k, width = len(self.centroids), self.dim + 1
        sums = np.array([[0] * width for _ in range(k)], dtype=object)
        state = self.spark.table(self.state).select(F.posexplode("sums").alias("i", "s"))
        for i, s in state.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():  # k * (dim + 1) rows
            sums[i // width, i % width] = int(s)
        new = self.centroids.copy()
        for c in range(k):
            if sums[c, -1]:
                new[c] = [int(s // sums[c, -1]) for s in sums[c, :-1]]
        moves = np.sqrt(((new - self.centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
        for c in range(k):
            self.drift[c] += moves[c] + max([moves[j] for j in range(k) if j != c], default=0.0) + 1e-9
        self.centroids = new

    def result(self) -> DataFrame:
        """(vec_id, cluster, distance) of every vector, from the last assignment."""
        centroids, dim = self.centroids, self.dim

        def run(batches):
            import pyarrow as pa

            for b in batches:
                ids = b.column("ids")
                for i, r in enumerate(_rows(b.select(["vectors", "cluster"]))):
                    cluster = np.frombuffer(r["cluster"], dtype=np.int32)
                    diff = np.frombuffer(r["vectors"], dtype="<i4").reshape(-1, dim).astype(np.int64) - centroids[cluster]
                    yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(cluster), pa.array((diff * diff).sum(axis=1))],
                                                     names=["vec_id", "cluster", "distance"])

        both = self.spark.table(self.blocks).join(
            self.spark.table(self.state).select("block", "cluster").hint("shuffle_hash"), "block")
        return both.select("ids", "vectors", "cluster").mapInArrow(run, f"vec_id {self.id_type}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 8,
                    rounds: int = 10, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Seeds are the k vectors with the smallest SHA-256 of ``salt`` and their id.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    run = Clustering(vectors, vec_id, vector, dim, k, salt)
    if not len(run.centroids):
        return spark.createDataFrame([], f"vec_id {run.id_type}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    for _ in range(rounds):
        run.assign()
        run.update()
    run.assign()
    found, _ = store(run.result(), "clustered")
    for name in list(run.tables):
        run.drop(name)
    sums = {c: int(s) for c, s in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = min(sum(sums.values()), _LONG)
    facts = [(c, min(sums.get(c, 0), _LONG), total, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest())
             for c, v in enumerate(run.centroids)]  # k rows
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                            "centroid_sha256")
