"""Operators 3, 4 and 5: packing, mixing and BPE."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm.bpe import BytePairCodec, bpe_decode, bpe_encode, default_path, pre_token_pattern, pre_tokens
from tallyspark.llm.mixing import draw, mix_counts, mix_documents, permuted, split_quotas
from tallyspark.llm.packing import best_fit_decreasing, pack


@pytest.fixture(scope="module")
def own():
    return BytePairCodec(default_path())


def test_bpe_equals_the_tokenizers_library(own):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x1F600, 0x85, 0x1C, 0xFEFF, 0x660, 0x4E00]]
    letters += ["  ", "\n", "'s", "'LL", "<|endoftext|>", "<|endoftext|", "1", "word", " word"] * 30
    texts = ["", " ", "a" * 5000, "ab" * 4000, "<|endoftext|>" * 3, "x<|endoftext|>", "²Ⅷ ́e"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert own.decode(got).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)
    part = np.frombuffer(own.encode("é€"), "<u4")[:1]
    assert own.decode(part.tobytes()).decode("utf-8", "replace") == library.decode(part.tolist(), skip_special_tokens=False)


def test_pre_tokens_try_only_the_ranges_a_text_needs():
    """The patterns of ASCII texts and of the basic plane cut like the whole one, and have no ranges beyond."""
    rng = random.Random(2)
    plain = [*map(chr, range(128)), "'s", "'ll", "  ", " a", " 1", "\n\n"]
    kinds = {0x7F: plain, 0xFFFF: [*plain, "é", " ñ", "²", "Ⅷ", "\u3000", "\x85", "ก", "一"],
             0x10FFFF: [*plain, "é", "\U0001F600", "\U00010400", "\U0001D7D8", "\U00020000"]}
    for upto, letters in kinds.items():
        for _ in range(400):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            want = pre_token_pattern().findall(text)
            assert pre_tokens(text) == want and "".join(want) == text
            if all(ord(c) <= upto for c in text):
                assert pre_token_pattern(upto).findall(text) == want
    sizes = [len(pre_token_pattern(upto).pattern) for upto in kinds]
    assert sizes == sorted(sizes) and 10 * sizes[0] < sizes[1] < sizes[2]


def test_bpe_tables(spark, documents, own):
    docs = documents([(1, "Hello world"), (2, None), (3, ""), (None, "x" * 100_000), (1, "Hello world")])
    both = bpe_decode(bpe_encode(docs))
    assert both.columns == [*docs.columns, "n_tokens", "ids", "decoded"]
    for r in both.collect():
        assert r.decoded == (r.text or "") and r.n_tokens == len(r.ids) // 4 and bytes(r.ids) == own.encode(r.text or "")
    clash = bpe_encode(docs.withColumn("ids", F.lit(1)))
    assert clash.schema["ids"].dataType.simpleString() == "binary"
    assert bpe_decode(bpe_encode(documents([]))).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(1, 40)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        plain = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [(length - sum(sizes[j] for j in r) - sizes[i], k) for k, r in enumerate(plain)]
            fits = [f for f in fits if f[0] >= 0]
            if fits:
                plain[min(fits)[1]].append(i)
            else:
                plain.append([i])
        got = best_fit_decreasing(sizes, length)
        total = lambda rows: sorted(sum(sizes[j] for j in r) for r in rows)
        assert total(got) == total(plain) and sorted(sum(got, [])) == list(range(len(sizes)))


def test_packing_is_lossless(spark, documents, own):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x", "Zürich"]) for _ in range(rng.randint(0, 120)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "long " * 5000)]
    packed = pack(documents(rows).repartition(3), length=64, group_ids=2000).collect()
    parts = {}
    for r in packed:
        ids, cu, pos = np.frombuffer(r.ids, "<u4"), r.cu_seqlens, np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(pos) == 64 and cu[0] == 0 and cu[-1] <= 64 and (ids[cu[-1]:] == 50256).all()
        for d, s, a, z in zip(r.doc_ids, r.starts, cu, cu[1:]):
            parts[d, s] = ids[a:z].tolist()
            assert pos[a:z].tolist() == list(range(z - a))
    for d, t in rows:
        joined = [x for (i, s) in sorted(p for p in parts if p[0] == d) for x in parts[i, s]]
        assert joined == [*np.frombuffer(own.encode(t or ""), "<u4").tolist(), 50256]
    assert len({(r.task, r.row) for r in packed}) == len(packed)
    assert pack(documents([])).count() == 0


def test_permuted_is_a_permutation():
    for n in (1, 2, 3, 4, 5, 17, 64, 1000, 4097):
        got = permuted(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_split_quotas_are_exact():
    quotas = np.array([1000, 0, 7, 333, 5])
    table = split_quotas(quotas, 13, 1)
    assert (table.sum(0) == quotas).all() and np.ptp(table.sum(1)) <= 1 and (table >= 0).all()
    big = split_quotas(np.array([3 * 10**9, 10**9, 11]), 7, 1)
    assert (big.sum(0) == [3 * 10**9, 10**9, 11]).all() and np.ptp(big.sum(1)) <= 1
    assert split_quotas(np.array([], dtype=np.int64), 2, 1).shape == (2, 0)


def targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, left, free = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in list(free):
            out[s] += share[s]
            if out[s] >= 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                free.discard(s)
    return out


def test_mixing_meets_the_targets(spark, documents):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        source = rng.choice(["hot"] * 6 + ["a", "b", "ü", "Z", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 3, 40, 700]))), "en", source))
    rows += [(None, "w " * 30, "en", "a"), (5, "w " * 9, "en", "b"), (5, "w " * 9, "en", "b"), (900, None, "en", "none"),
             (901, "w " * 200_000, "en", "long")]
    docs = documents(rows)
    got = mix_counts(docs.repartition(7)).collect()
    again = mix_counts(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        assert (r.shards is None) == (r.taken == 0)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert {x for r in got if r.shards for x in r.shards.split(",")} == {str(j) for j in range(8)}
    drawn = draw(docs, shard_words=50_000).collect()
    by_shard = {}
    for r in drawn:
        assert len(r.part.split()) == r.words
        by_shard[r.shard] = by_shard.get(r.shard, 0) + r.words
    assert sum(by_shard.values()) == sum(taken.values()) and len(by_shard) > 2
    by_doc = {}
    for r in drawn:
        by_doc[r.row.c0, r.row.c1] = by_doc.get((r.row.c0, r.row.c1), 0) + r.words
    twice = {}
    for r, (i, t, *_) in ((r, x) for r in got for x in rows if r.doc_id == x[0] and r.size == len((x[1] or "").split())):
        if i not in (None, 5):
            assert by_doc.get((i, t), 0) == r.taken
            twice[i] = twice.get(i, 0) + 1
    assert len(twice) == len({x[0] for x in rows}) - 2
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())
    assert mix_counts(documents([])).count() == 0 and mix_documents(documents([])).count() == 0


def test_quota_ends_are_found_in_several_rounds(spark, documents, monkeypatch):
    """With few parts a round, many rounds end at the same block as one round over all blocks."""
    from tallyspark.llm import mixing

    docs = documents([(i, "w " * (1 + i * 7 % 300), "en", "ab"[i % 5 == 0]) for i in range(300)])
    one = sorted(map(str, mix_counts(docs, block_words=16).collect()))
    monkeypatch.setattr(mixing, "FAN", 7)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4096)
    assert sorted(map(str, mix_counts(docs, block_words=16).collect())) == one


def test_offsets_of_buckets_are_the_sums_of_earlier_ones(spark, monkeypatch):
    from tallyspark.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rng = random.Random(2)
    rows = [(s, b, rng.randint(0, 9)) for s in range(3) for b in range(40) if rng.random() < 0.6]
    got = {(r.sid, r.bucket): r.offset for r in mixing._earlier(spark.createDataFrame(rows, "sid long, bucket long, n long")).collect()}
    assert got == {(s, b): sum(n for t, c, n in rows if t == s and c < b) for s, b, _ in rows}
