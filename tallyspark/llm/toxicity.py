"""Operator 8, toxicity: a string-kernel support vector machine with Nystroem landmarks.

A text's units are its lower-cased words and their beginnings (runs of three or
more one-letter words count as one unit, long words are cut into overlapping
pieces).  The gapped
subsequence kernel compares a unit with landmark words: it sums, with a decay
for every character spanned, the subsequences they share, so insults with
inserted or missing characters stay close to their plain form.  The Nystroem
map turns a text's best values at the landmarks into a vector, and a linear
support vector machine with an isotonic calibration, fitted on a third of the training rows,
gives the score.

Training reads at most ``max_rows`` labelled rows of each class (a documented
bound; a hash of the row picks the share).  Landmarks are picked greedily: of the
units that are significantly more frequent under label 1, always the one that
stands in most rows of that label which the landmarks so far leave unexplained,
so a vocabulary that only few of these rows use gets its landmarks too.  Scoring
reads every whole text in one pass without a shuffle.

Defined cases: null and empty texts have no units and score the same low value;
null labels are left out; without both labels every score is 0; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.text import pieces, texts_of
from tallyspark.session import drop_scratch, store

ORDER, DECAY, POWER = 3, 0.7, 6
LONGEST, STEP = 24, 12
CACHE_UNITS = 1 << 18
#: Lengths of the beginnings of longer words that are units too.
BEGINNINGS = (4, 6)
#: A row with as many landmarks counts as explained.
EXPLAINED = 3


def units_of(text: bytes) -> set[str]:
    """The distinct units of a text."""
    words = text.decode().lower().split()
    out = set(words)
    run: list[str] = []
    for w in [w for w in out if len(w) > BEGINNINGS[0] + 1]:
        out.add(w[:BEGINNINGS[0]])
        if len(w) > BEGINNINGS[1] + 1:
            out.add(w[:BEGINNINGS[1]])
    if any(len(w) == 1 for w in out):
        for w in [*words, ""]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= ORDER:
                    out.add("".join(run))
                run = []
    long = [u for u in out if len(u) > LONGEST]
    for u in long:
        out.discard(u)
        out.update(u[i:i + LONGEST] for i in range(0, len(u) - STEP, STEP))
    return out


def _codes(units: list[str]) -> np.ndarray:
    """Code points, zero beyond a unit's end."""
    width = max(map(len, units))
    return np.array(units, dtype=f"<U{width}").view(np.int32).reshape(len(units), width)


def _run(values: np.ndarray, axis: int) -> np.ndarray:
    """Decayed sums of all earlier entries along an axis."""
    out = np.zeros_like(values)
    acc = np.zeros_like(np.take(values, 0, axis=axis))
    for i in range(1, values.shape[axis]):
        acc = acc * DECAY + np.take(values, i - 1, axis=axis)
        at = [slice(None)] * values.ndim
        at[axis] = i
        out[tuple(at)] = acc
    return out


def _kernel(same: np.ndarray) -> np.ndarray:
    """The kernel of orders 1 to ORDER from match matrices (..., |s|, |t|): longer subsequences weigh more."""
    step = same * np.float32(DECAY * DECAY)
    now, total = step, step.sum((-1, -2)) * np.float32(1e-3)
    for _ in range(1, ORDER):
        now = step * _run(_run(now, -1), -2)
        total = total + now.sum((-1, -2))
    return total


def self_kernel(units: list[str]) -> np.ndarray:
    c = _codes(units)
    return _kernel(((c[:, :, None] == c[:, None, :]) & (c[:, :, None] > 0)).astype(np.float32))


class Landmarks:
    """Landmark units and the kernel of other units with them.

    The normalised kernel is taken to the power ``POWER`` (again a kernel), and
    is zero for a unit that lacks more than a quarter of a landmark's letters in
    their order.  Common subsequences are counted first, for all units and
    landmarks at once in bit vectors; the kernel then runs on the few pairs left.
    """

    def __init__(self, units: list[str]):
        self.units, self.codes, self.norm = units, _codes(units), np.sqrt(self_kernel(units))
        self.length = np.array([len(u) for u in units])
        self.needed = -(-3 * self.length // 4)
        letters = sorted(set("".join(units)))
        self.letter = np.array([ord(c) for c in letters], dtype=np.int32)
        self.masks = np.zeros((len(letters) + 1, len(units)), dtype=np.uint32)  # the last row: any other letter
        for j, u in enumerate(units):
            for i, c in enumerate(u):
                self.masks[letters.index(c), j] |= np.uint32(1 << i)

    def common(self, codes: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of units (rows of codes) with the landmarks."""
        at = np.searchsorted(self.letter, codes)
        at[self.letter[np.minimum(at, len(self.letter) - 1)] != codes] = len(self.letter)
        full = ((np.uint64(1) << self.length.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        v = np.broadcast_to(full, (len(codes), len(self.units))).copy()
        for i in range(codes.shape[1]):
            both = v & self.masks[at[:, i]]
            v = ((v + both) | (v - both)) & full
        return np.bitwise_count(~v & full)

    def kernel(self, units: list[str], all_pairs: bool = False) -> np.ndarray:
        out = np.zeros((len(units), len(self.units)), dtype=np.float32)
        for at in range(0, len(units), 4096):
            part = units[at:at + 4096]
            codes = _codes(part)
            some = np.ones((len(part), len(self.units)), dtype=bool) if all_pairs else self.common(codes) >= self.needed
            row, col = np.nonzero(some)
            for i in range(0, len(row), 2048):
                r, c = row[i:i + 2048], col[i:i + 2048]
                own, mark = codes[r], self.codes[c]
                same = (own[:, :, None] == mark[:, None, :]) & (own[:, :, None] > 0)
                norm = np.sqrt(_kernel(((own[:, :, None] == own[:, None, :]) & (own[:, :, None] > 0)).astype(np.float32)))
                out[at + r, c] = (_kernel(same.astype(np.float32)) / (norm * self.norm[c])) ** POWER
        return out


class Pooled:
    """Texts -> best kernel value at each landmark; known units are remembered, a bounded number of them."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.far, self.near = landmarks, set(), {}

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.landmarks.units)), dtype=np.float32)
        for at in range(0, len(texts), 256):
            sets = [units_of(t) for t in texts[at:at + 256]]
            if len(self.far) + len(self.near) > CACHE_UNITS:
                self.far, self.near = set(), {}
            new = [u for u in set().union(*sets).difference(self.far) if u not in self.near]
            if new:
                values = self.landmarks.kernel(new)
                some = values.any(1)
                self.near.update((new[i], values[i]) for i in np.flatnonzero(some))
                self.far.update(u for u, k in zip(new, some.tolist(), strict=True) if not k)
            for i, s in enumerate(sets):
                hits = self.near.keys() & s
                if hits:
                    out[at + i] = np.max([self.near[u] for u in hits], 0)
        return out


@dataclass
class ToxicityModel:
    landmarks: list[str]
    project: np.ndarray
    weights: np.ndarray
    bias: float
    at: np.ndarray
    share: np.ndarray

    def score(self, pooled: np.ndarray) -> np.ndarray:
        """The calibrated share of label 1; a hundredth of it follows the margin, so that ties stay rare."""
        margin = pooled @ self.project @ self.weights + self.bias
        return 0.99 * np.interp(margin, self.at, self.share) + 0.01 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss and balanced classes, by Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    s = np.where(y > 0, 1.0, -1.0)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, ridge = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        inside = s * (z @ w) < 1
        a, b = z[inside], (c * s)[inside]
        new = np.linalg.solve((a * c[inside, None]).T @ a + ridge, a.T @ b)
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new) if _ > rounds // 2 else new
    return w[:-1], float(w[-1])


def _rising_shares(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic calibration: margins and the rising shares of label 1 there (adjacent violators are pooled)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # lowest margin, highest margin, rows, ones
    for m, one in zip(np.round(margin[order], 6).tolist(), y[order].tolist(), strict=True):
        blocks.append([m, m, 1.0, float(one)])
        while len(blocks) > 1 and (blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]
                                   or blocks[-2][1] == blocks[-1][0]):
            _, high, n, ones = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + n, blocks[-1][3] + ones]
    share = np.maximum.accumulate([(k + 0.5) / (n + 1) for *_, n, k in blocks])
    return np.array([m for low, high, *_ in blocks for m in (low, high)]), np.repeat(share, 2)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(rows: DataFrame) -> dict[int, int]:
    return {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def sampled(rows: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of each label at most, by a hash of ``fold`` (rows with other labels are left out)."""
    rows = rows.filter("label IN (0, 1)")
    have = _counts(rows)
    h = F.pmod(F.xxhash64("fold", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("label") == 1, F.lit(max_rows / have.get(1, 1))).otherwise(F.lit(max_rows / have.get(0, 1)))
    return rows.filter(h < share)


def pick_landmarks(rows_of: dict[str, set], n_landmarks: int) -> list[str]:
    """Units (unit -> its rows of label 1), each the one in most rows not yet explained (ties: more rows, then by name)."""
    times: dict = {}
    best: list[str] = []
    left = dict(rows_of)
    while left and len(best) < n_landmarks:
        gain, _, unit = max((sum(times.get(r, 0) < EXPLAINED for r in have), len(have), u) for u, have in left.items())
        if gain < 2:
            break
        best.append(unit)
        for r in left.pop(unit):
            times[r] = times.get(r, 0) + 1
    return best


def train(rows: DataFrame, n_landmarks: int = 64, max_rows: int = 3000, min_rows: int = 4, min_z: float = 5.0,
          min_ratio: float = 10.0, candidates: int = 2000) -> ToxicityModel | None:
    """A model from ``rows`` (text, label 0/1, fold: any long); None without both labels.

    A unit is a candidate if it stands in ``min_rows`` rows of label 1, its
    shares of the two labels differ by ``min_z`` standard errors and by the
    factor ``min_ratio``; the ``candidates`` most significant ones are looked at.
    """
    rows = sampled(rows, max_rows)
    have = _counts(rows)
    if len(have) < 2:
        return None

    def list_units(batches):
        import pyarrow as pa

        for b in pieces(batches, 64):
            sets = [[u for u in units_of(t) if 3 <= len(u) <= 16] for t in texts_of(b.column("text"))]
            each = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array([u for s in sets for u in s], pa.string()), b.column("label").take(each),
                                              b.column("fold").take(each)], names=["unit", "label", "fold"])

    n1, n0 = (float(have[k]) for k in (1, 0))
    listed = rows.select("text", F.col("label").cast("int").alias("label"), "fold").mapInArrow(
        list_units, "unit string, label int, fold long")
    units = listed.groupBy("unit").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    p = (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    telling = units.filter((F.col("a") >= min_rows) & (z >= min_z) & (F.col("a") / n1 >= min_ratio * F.col("b") / n0)).select(
        "unit", z.alias("z")).orderBy(F.desc("z"), "unit").limit(candidates).select("unit")
    # at most ``candidates`` units with at most 2 * max_rows row numbers each
    found = listed.filter("label = 1").join(F.broadcast(telling), "unit").groupBy("unit").agg(F.collect_set("fold").alias("rows"))
    best = pick_landmarks({r.unit: set(r.rows) for r in found.collect()}, n_landmarks)
    if not best:
        return None
    marks = Landmarks(best)

    def pool(batches):
        import pyarrow as pa

        pooled = Pooled(marks)
        for b in pieces(batches):
            v = pooled(texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(v.astype("<f4").tobytes()[i * 4 * v.shape[1]:(i + 1) * 4 * v.shape[1]]
                                                       for i in range(len(v))), b.column("label"), b.column("fold")],
                                             names=["v", "label", "fold"])

    # at most 2 * max_rows vectors of n_landmarks floats
    got = rows.select("text", F.col("label").cast("int").alias("label"), "fold").mapInArrow(
        pool, "v binary, label int, fold long").orderBy("fold", "v").collect()
    x = np.frombuffer(b"".join(bytes(r.v) for r in got), dtype="<f4").reshape(len(got), -1).astype(float)
    y = np.array([r.label for r in got])
    k = marks.kernel(marks.units, all_pairs=True).astype(float)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    project = vector / np.sqrt(np.maximum(value, 1e-3))
    x = x @ project
    part = np.arange(len(x)) % 3 == 0
    if len(set(y[~part])) < 2 or len(set(y[part])) < 2:
        part = np.zeros(len(x), dtype=bool)
        weights, bias = _svm(x, y)
        at, share = _rising_shares(x @ weights + bias, y)
    else:
        weights, bias = _svm(x[~part], y[~part])
        at, share = _rising_shares(x[part] @ weights + bias, y[part])
    return ToxicityModel(marks.units, project, weights, bias, at, share)


def score(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        pooled = Pooled(Landmarks(model.landmarks))
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(pooled(texts_of(b.column("text")))))],
                                             names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity_verdicts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      threshold: float = 0.7, max_rows: int = 3000, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; learned from labels of rows not held out."""
    known = labels.select(F.col(doc_id).alias("l_id"), F.col("toxic").cast("int").alias("label")).filter(
        ~held_out(F.col("l_id")))
    # the bounded sample of labels is stored first: a small table finds its texts without moving the others
    sample, path = store(sampled(known.withColumn("fold", F.xxhash64("l_id")), max_rows), "labels")
    rows, text_path = store(docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text")).join(
        sample, F.col("d_id") == F.col("l_id")).select("text", "label", "fold"), "labelled")
    drop_scratch(docs.sparkSession, path)
    model = train(rows, max_rows=max_rows, **options)
    drop_scratch(docs.sparkSession, text_path)
    scored = score(docs, model, doc_id, text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
