"""Operators 11, 12 and 13 against brute force: nulls, ties, repeated rows, long texts, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import heap_kmeans, hot, minhash
from tallyspark.llm.heap_kmeans import Clustering, cluster_vectors
from tallyspark.llm.hot import lookup, salted
from tallyspark.llm.merkle import document_manifest
from tallyspark.llm.minhash import minhash_duplicates
from tallyspark.llm.star_components import star_components
from tallyspark.llm.text import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- operator 11

def brute_tree(hashes):
    """(root, proof parts of each leaf) of a list of digests, runs of eight."""
    nodes = [(h, [i]) for i, h in enumerate(hashes)]
    proofs = [[] for _ in hashes]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for i, (_, members) in enumerate(run):
                for m in members:
                    proofs[m].append(("".join(h for h, _ in run[:i]), "".join(h for h, _ in run[i + 1:])))
            up.append((sha("".join(h for h, _ in run)), [m for _, ms in run for m in ms]))
        nodes = up
    return nodes[0][0], proofs


def brute_manifest(rows):
    def leaf(r, text):
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == x),
                     key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for x in langs]
    trees = [brute_tree([leaf(r, r["text"]) for r in g]) for g in groups]
    root, tops = brute_tree([t[0] for t in trees])
    out = []
    for g, (sub, proofs), top in zip(groups, trees, tops):
        for r, proof in zip(g, proofs):
            path = proof + top
            text, own = r["text"], leaf(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            h = leaf(r, text)
            for before, after in path:
                h = sha(before + h + after)
            out.append((r["doc_id"], own, sub, root, sha("".join(b + a for b, a in path)), h, h == root))
    return out


def check_manifest(docs):
    got = [tuple(r) for r in document_manifest(docs).collect()]
    want = brute_manifest([r.asDict() for r in docs.collect()])
    def key(x):
        return tuple(str(v) for v in x)

    assert sorted(got, key=key) == sorted(want, key=key)


def test_manifest_equals_brute_force(spark, documents):
    rng = random.Random(5)
    rows = [(i, f"Text {rng.random()} É" if i % 7 else None, ["en", "de", None, "", "日本"][min(i % 11, 4)], None if i % 5 else "s")
            for i in range(150)]
    rows += [(3, "again", "en", "s"), (3, "again", "en", "s"), (None, "no id", "en", "s"), (900, "", "lone", "s"),
             (901, "X" * 300_000, "de", "s")]
    check_manifest(documents(rows).repartition(5))


def test_manifest_of_hot_groups_equals_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(hot, "SHARE", 4)
    check_manifest(documents([(i, f"T{i}", f"l{i}" if i % 3 else "hot") for i in range(130)]).repartition(7))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_small_manifests(spark, documents, n):
    docs = documents([(i, f"Text {i}", "en") for i in range(n)])
    if n:
        check_manifest(docs)
    else:
        assert document_manifest(docs).count() == 0


# ---- joins and components

def test_lookup_and_salted_equal_plain_joins(spark, monkeypatch):
    monkeypatch.setattr(hot, "SHARE", 8)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 300, 2)] + [(1, "one")], "k int, t string")
    counts = rows.groupBy("k").count()
    for how in ("inner", "left"):
        assert sorted(map(str, lookup(rows, table, "k", counts, 301, how).collect())) == sorted(
            map(str, rows.join(table, "k", how).select("k", "v", "t").collect()))
    got = salted(rows, table, "k", "v", 5000).select("k", "v", "t").collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.join(table, "k").select("k", "v", "t").collect()))


def test_star_components_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(hot, "SHARE", 16)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(500, 500 + i) for i in range(1, 200)]
    links += [(1000 + rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(90)] + [(7, 3), (None, 4), (5, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got, _ = star_components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in parent)
    assert star_components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


# ---- operator 12

def brute_duplicates(rows, width=4):
    sets = []
    for _, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            o = len(sets[x] & sets[y])
            if o and 100 * o >= 80 * (len(sets[x]) + len(sets[y]) - o):
                comp[find(x)] = find(y)
    lows = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            lows[find(x)] = min(lows.get(find(x), i), i)
    return sorted((i, len(sets[x]), lows.get(find(x), i)) for x, (i, _) in enumerate(rows) if i is not None)


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def checked(spark, documents, rows):
    got = minhash_duplicates(documents(rows).repartition(4)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_duplicates(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return got


def test_minhash_equals_brute_force(spark, documents):
    rng = random.Random(11)
    texts = near_copies(rng, 60, 150, 9) + near_copies(rng, 25, 30, 2) + near_copies(rng, 30, 400, 30) + near_copies(rng, 6, 9000, 300)
    rows = list(enumerate(texts, 10))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "É two"), (7, "é two"), (10, texts[0]),
             (10, texts[0]), (11, "an id with a second text that stands alone"), (None, texts[3]), (None, None)]
    got = checked(spark, documents, rows)
    assert {r.component_id for r in got if r.doc_id is None} == {None, brute_duplicates(rows)[[
        i for i, _, _ in brute_duplicates(rows)].index(13)][2]}


def test_minhash_of_open_buckets_equals_brute_force(spark, documents, monkeypatch):
    """Near copies at the rim of each other: star rounds leave pairs, which small blocks compare."""
    monkeypatch.setattr(minhash, "OPEN_PAIRS", 10**9)  # one star round, then blocks
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(hot, "SHARE", 8)
    rng = random.Random(3)
    texts = near_copies(rng, 150, 120, 12) + near_copies(rng, 40, 66, 6)
    checked(spark, documents, list(enumerate(texts)))


def test_minhash_of_empty_and_lone_tables(spark, documents):
    assert minhash_duplicates(documents([])).count() == 0
    assert [tuple(r) for r in minhash_duplicates(documents([(4, "a b c")])).collect()] == [(4, 1, 4, True)]
    assert [tuple(r) for r in minhash_duplicates(documents([(4, None)])).collect()] == [(4, 0, 4, True)]


def test_bit_maps_bound_overlaps_from_above():
    rng = np.random.default_rng(4)
    for n in (1, 7, 100, 5000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for part in (0.0, 0.5, 0.79, 0.9, 1.0):
            y = np.unique(np.r_[x[:int(len(x) * part)], rng.integers(0, 2**63, int(len(x) * (1 - part)), dtype=np.uint64)])
            if not len(y):
                continue
            mx, my = minhash.bit_map(x), minhash.bit_map(y)
            while len(my) > len(mx):
                my = minhash._folded(my[None])[0]
            while len(mx) > len(my):
                mx = minhash._folded(mx[None])[0]
            most = int(minhash.most_shared(mx, len(x), my[None], np.array([len(y)]))[0])
            assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))


def test_signatures_estimate_the_similarity_and_long_sets_equal_short_ones():
    rng = random.Random(1)
    a, b = near_copies(rng, 2, 2000, 80)
    sets = [shingles(t.encode(), 4) for t in (a, b)]
    o = len(np.intersect1d(*sets))
    true = o / (len(sets[0]) + len(sets[1]) - o)
    sig = minhash.minima(sets)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    assert (minhash._long_minima(sets[0], 100) == sig[0]).all()
    assert minhash.signatures([np.empty(0, dtype=np.uint64), sets[0]])[0] is None


# ---- operator 13

def brute_kmeans(rows, dim, k, rounds):
    kept = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]
    centres = [v for _, v in seeds]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        who = [c for _, c, _ in assign()]
        for c in range(len(centres)):
            own = [v for (_, v), w in zip(kept, who) if w == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    last = assign()
    total = sum(d for _, _, d in last)
    return sorted(((i, c, d, sum(x for _, e, x in last if e == c), total, sha(",".join(map(str, centres[c])))) for i, c, d in last),
                  key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, block string")


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(heap_kmeans, "BLOCK", 30)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(0, 4, 6) + rng.normal(0, 0.2, 6)).tolist()) for i in range(200)]
    rows += [(i, [1.0] * 6) for i in range(200, 230)] + [(7, rows[7][1]), (7, rows[7][1]), (300, None), (301, [1.0] * 5), (302, []),
             (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [2.0] * 6), (306, [-0.0001] * 6)]
    got = cluster_vectors(vectors(spark, rows).repartition(3), dim=6, k=5, rounds=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute_kmeans(rows, 6, 5, 6)


def test_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5] * 4)], [(i, [0.25] * 4) for i in range(20)], [(1, [0.5] * 4), (2, [9.0] * 4)]):
        got = cluster_vectors(vectors(spark, rows), dim=4, k=8, rounds=3)
        assert sorted(map(tuple, got.collect()), key=str) == brute_kmeans(rows, 4, 8, 3)
    assert cluster_vectors(vectors(spark, []), dim=4).count() == 0
    assert cluster_vectors(vectors(spark, [(1, [1e300] * 4)]), dim=4).first().distance == 0


def test_only_expired_vectors_are_rescanned_without_a_shuffle(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (10 * (i % 4) + rng.normal(0, 0.5, 4)).tolist()) for i in range(800)]
    run = Clustering(vectors(spark, rows), "vec_id", "embedding", 4, 4, "3:")
    scanned = []
    for _ in range(5):
        run.assign()
        scanned.append(spark.table(run.state).agg(F.sum("scanned")).first()[0])
        run.update()
    assert scanned[0] == 800 and scanned[-1] < 100
    both = spark.table(run.blocks).join(spark.table(run.state).hint("shuffle_hash"), "block")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    for name in list(run.tables):
        run.drop(name)
    assert not run.tables
