"""Operator 5, BPE encoding and decoding.

Encoding cuts a text at the added tokens and then into pre-tokens, and merges
each pre-token's byte symbols: a priority queue of merge ranks over a doubly
linked symbol list, where entries whose pair has changed since are skipped as
stale.  Decoding concatenates the vocabulary's byte strings.  The vocabulary is
a file of a public tokenizer in the ``tokenizers`` JSON form (byte-level BPE);
its path is a parameter and is read on the executors.

Defined cases: null counts as the empty text, which has no ids; other columns
stay as they are, and a column named like one the operator adds is replaced; an
empty table gives an empty result; a pre-token of any length is merged in
O(n log n).
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.text import pieces, texts_of

_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens remembered by a task (in each of two generations), and the longest one remembered.
CACHE_WORDS, CACHE_LENGTH = 1 << 19, 64


@functools.cache
def _edges(initial: str) -> tuple[tuple[int, int], ...]:
    """First and last code points of the ranges whose Unicode category begins with ``initial``."""
    import unicodedata

    inside = [unicodedata.category(chr(c))[0] == initial for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(len(inside)) if inside[c] != (c > 0 and inside[c - 1])]
    return tuple((a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True))


def _category(initial: str, upto: int) -> str:
    """A character class's ranges: the code points up to ``upto`` whose Unicode category begins with ``initial``."""
    return "".join(f"\\U{a:08x}-\\U{min(b, upto):08x}" for a, b in _edges(initial) if a <= upto)


@functools.cache
def pre_token_pattern(upto: int = sys.maxunicode) -> re.Pattern:
    """The byte-level pre-tokeniser's pattern (fixed by the vocabulary files), with ``\\p{L}``, ``\\p{N}`` and
    white space written out as ranges, for texts without code points above ``upto``.

    At any place at most one of letters, digits and contractions fits, so their order is free.
    """
    letters, digits = _category("L", upto), _category("N", upto)
    return re.compile(rf" ?[{letters}]+| ?[{digits}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{_BLANKS}{letters}{digits}]+"
                      rf"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")


#: A code point above the basic plane.
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, by the pattern with the fewest ranges to try."""
    upto = 0x7F if text.isascii() else sys.maxunicode if _ASTRAL.search(text) else 0xFFFF
    return pre_token_pattern(upto).findall(text)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as itself, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class _PreTokens(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes, merged when first asked for.

    When full, its content becomes the old generation, from which those asked
    for again return; so memory is bounded and frequent pre-tokens stay.
    """

    def __init__(self, merge, most: int = CACHE_WORDS):
        super().__init__()
        self.merge, self.most, self.old = merge, most, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class BytePairCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = [vocab.get(c) for c in letters]
        #: pair of ids (the first << id_bits | the second) -> its rank; rank -> the id of the joined symbol
        self.id_bits = max(vocab.values()).bit_length()
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[a] << self.id_bits | vocab[b], rank)
            self.joined.append(vocab[a + b])
        #: two bytes (the first << 8 | the second) -> the rank of their pair, -1 if it does not merge
        self.byte_ranks = [-1 if a is None or b is None else self.ranks.get(a << self.id_bits | b, -1)
                           for a in self.byte_ids for b in self.byte_ids]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {t: np.asarray([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        code = {c: bytes([b]) for b, c in enumerate(letters)}
        strings = {i: t for t, i in (vocab | added).items()}
        self.strings = [b"".join(code.get(c, c.encode()) for c in strings.get(i, "")) for i in range(max(strings) + 1)]
        self.cache = _PreTokens(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbol = list(map(self.byte_ids.__getitem__, word))
        n, bits, rank_of, joined_by, pop, push = (
            len(symbol), self.id_bits, self.ranks.get, self.joined, heapq.heappop, heapq.heappush)
        if n < 2:
            return symbol
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank << shift | position, so the queue gives the lowest rank and of these the leftmost
        shift = n.bit_length()
        mask = (1 << shift) - 1
        #: the entry of the pair that begins at each position, -1 if it does not merge
        first = self.byte_ranks
        entry = [r << shift | i if (r := first[a << 8 | b]) >= 0 else -1
                 for i, (a, b) in enumerate(zip(word, word[1:], strict=False))]
        entry.append(-1)
        queue = [e for e in entry if e >= 0]
        heapq.heapify(queue)
        while queue:
            top = pop(queue)
            i = top & mask
            if entry[i] != top:
                continue  # stale: what stands here is no longer the pair of this entry
            new = symbol[i] = joined_by[top >> shift]
            j = after[i]
            symbol[j] = entry[j] = entry[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << bits | symbol[k])) is not None:
                    entry[i] = e = r << shift | i
                    push(queue, e)
            h = before[i]
            if h >= 0:
                entry[h] = -1
                if (r := rank_of(symbol[h] << bits | new)) is not None:
                    entry[h] = e = r << shift | h
                    push(queue, e)
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, at, get = [], 0, self.cache.__getitem__
        for m in self.cut.finditer(text) if self.cut else ():
            out.extend(map(get, pre_tokens(text[at:m.start()])))
            out.append(self.added[m.group()])
            at = m.end()
        out.extend(map(get, pre_tokens(text[at:] if at else text)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the vocabulary strings of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    """One codec per Python worker and file."""
    return BytePairCodec(path)


def _with_columns(batch, added: dict):
    import pyarrow as pa

    keep = [i for i, n in enumerate(batch.schema.names) if n not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added.values()],
                                      names=[*(batch.schema.names[i] for i in keep), *added])


def _schema(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def bpe_encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` plus ``n_tokens`` (long) and ``ids`` (binary: little-endian unsigned 32-bit integers)."""
    path = path or default_path()
    schema = _schema(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for b in pieces(batches):
            ids = [own.encode(t.decode()) for t in texts_of(b.column(text))]
            yield _with_columns(b, {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                    "ids": pa.array(ids, pa.binary())})

    return docs.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` plus ``decoded``: the text of the ids, with U+FFFD where bytes are no UTF-8 (null ids: null)."""
    path = path or default_path()
    schema = _schema(df, [T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        for b in pieces(batches):
            texts = [None if x is None else own.decode(x).decode("utf-8", "replace")
                     for x in b.column(ids).to_pylist()]
            yield _with_columns(b, {"decoded": pa.array(texts, pa.string())})

    return df.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, text: str = "text", path: str | None = None, cache_words: int = 1 << 17) -> DataFrame:
    """``docs`` without the text, plus ``n_tokens``, ``ids`` and ``decoded`` as by bpe_encode and bpe_decode.

    One Python step with one codec, so that a core holds one cache of pre-tokens;
    ``cache_words`` bounds it (a smaller one costs time, not results).
    """
    path = path or default_path()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    schema = _schema(docs, added)
    schema = T.StructType([f for f in schema.fields if f.name != text])

    def run(batches):
        import pyarrow as pa

        own = codec(path)
        own.cache.most = cache_words
        for b in pieces(batches, 128):
            ids = [own.encode(t.decode()) for t in texts_of(b.column(text))]
            rest = b.select([n for n in b.schema.names if n != text])
            yield _with_columns(rest, {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                       "ids": pa.array(ids, pa.binary()),
                                       "decoded": pa.array([own.decode(x).decode("utf-8", "replace") for x in ids], pa.string())})

    return docs.mapInArrow(run, schema)
