"""Operators 1, 2 and 10 against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import jaccard_join, repeats, substring_dedup
from tallyspark.llm.components import components
from tallyspark.llm.exact_dedup import dedup_verdicts, exact_dedup
from tallyspark.llm.hot import salted
from tallyspark.llm.jaccard_join import keep_one, near_duplicates
from tallyspark.llm.substring_dedup import remove_repeats
from tallyspark.llm.text import shingles, window_hashes, word_hashes, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_word_hashes_split_like_the_pattern():
    text = "A b\tc\x0bd\x1ce  f g  h\r\n" + "x" * 3_000_000 + " end " + "y z " * 400_000
    data = text.encode()
    words = WORD.findall(text)
    start, end = word_spans(np.frombuffer(data, dtype=np.uint8))
    assert [data[a:b].decode() for a, b in zip(start, end)] == words
    hashes = word_hashes(data)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert (word_hashes(b"ABC \xc3\x89", fold=True) == word_hashes(b"abc \xc3\x89", fold=True)).all()
    assert len(word_hashes(b"")) == 0 and len(window_hashes(hashes[:3], 5)) == 0
    assert len(shingles(b"one two")) == 1 and len(shingles(None)) == 0 and len(shingles(b" \n")) == 0


def test_repeat_filter_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**62, 2**62, 6000)
    df = spark.createDataFrame([(int(k),) for k in [*keys, *keys[:500], *keys[:5]]], "key long").repartition(5)

    def arrays(batch):
        yield np.asarray(batch.column("key"))

    found = repeats.build(df, arrays, 6505, keep_seen=True)
    assert found.maybe_repeated(keys[:500]).all() and found.maybe_seen(keys).all()
    assert found.maybe_repeated(keys[500:]).mean() < 0.05
    assert found.maybe_seen(rng.integers(-2**62, 2**62, 5000)).mean() < 0.05
    assert not repeats.build(df.limit(0), arrays, 0).maybe_repeated(keys).any()


def test_exact_dedup_verdicts(spark, documents):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "a b "), (2, None), (4, ""), (6, "solo"), (None, "a b"),
            (7, "twin"), (7, "twin"), (8, "x" * 200_000), (10, "É"), (11, "é")]
    got = dedup_verdicts(documents(rows).repartition(4)).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    assert len(got) == len(rows)
    for r in got:
        group = [(i, t) for (i, _), t in zip(rows, norm) if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        ids = sorted(i for i, _ in group if i is not None)
        assert r.keep_id == ids[0] and r.group_size == len(group)
        assert not r.kept or r.doc_id == ids[0]
    assert sum(r.kept for r in got) == len(set(norm))
    kept = exact_dedup(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6, 7, 8, 10, 11]
    assert dedup_verdicts(documents([])).count() == 0 and exact_dedup(documents([])).count() == 0


def jaccard_components(rows):
    sets = {}
    for i, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, len(sets[i]), low.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark, documents):
    rng = random.Random(4)
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, " \n"), (1005, "a b c d e"),
            (1006, "a b c d e f"), (None, "one two"), (1007, prose(rng, 9000))]
    shared = prose(rng, 60)
    for g in range(12):
        base = prose(rng, rng.randint(20, 150)).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(400)}"
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * 0.9)]
            text = " ".join(copy)
            rows.append((len(rows) * 7 % 997, text if rng.random() < 0.8 else text + " " + shared))
    got = near_duplicates(documents(rows).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(jaccard_components(rows), key=key)
    empty = keep_one(documents([]))
    assert empty.columns == documents([]).columns and empty.count() == 0


def test_global_order_counts_all_that_stand_out(spark, documents):
    """A phrase shared by a few dozen of many texts comes last, however small its part of all shingles is."""
    rng = random.Random(6)
    shared = prose(rng, 30)
    rows = [(i, prose(rng, 400, 10**6) + (" " + shared if i < 40 else "")) for i in range(400)]
    docs = documents(rows).select("doc_id", "text").repartition(3)
    stored, _ = jaccard_join.store(jaccard_join._sets(docs, 5), "sets")
    sets = [set(jaccard_join.shingles(t.encode(), 5).tolist()) for _, t in rows]
    counts = {}
    for s in sets:
        for t in s:
            counts[t] = counts.get(t, 0) + 1
    order = jaccard_join._global_order(docs, stored, 5)
    least = jaccard_join._least_count(sum(counts.values()))
    assert dict(zip(order.frequent.tolist(), order.levels.tolist())) == {
        t: n.bit_length() for t, n in counts.items() if n >= least}
    # 100 billion shingles: a count of 7,000 is no 2**-20th of them, but stands out
    assert least == 2 and jaccard_join._least_count(10**11) < 7000 < 10**11 >> 20
    first = order.ordered(np.sort(np.array(list(sets[0]), dtype=np.uint64)))[0][:80].tolist()
    assert {counts[t] for t in first} == {1}


def test_sketch_sums_by_groups_of_tasks(spark, documents, monkeypatch):
    rng = random.Random(7)
    docs = documents([(i, prose(rng, 60, 300)) for i in range(60)]).select("doc_id", "text").repartition(6)
    stored, _ = jaccard_join.store(jaccard_join._sets(docs, 5), "sets")
    once = jaccard_join._likely_cells(stored, 2)
    monkeypatch.setattr(jaccard_join, "SUMMED", 2)
    assert (jaccard_join._likely_cells(stored, 2) == once).all()
    counts = np.zeros(1 << jaccard_join.SKETCH_BITS, dtype=np.uint16)
    for r in docs.collect():
        jaccard_join._add_cells(counts, jaccard_join.shingles(r.text.encode(), 5))
    assert (np.unpackbits(once) == (counts >= 2)).all()
    full = np.array([65534, 0], dtype=np.uint16)
    monkeypatch.setattr(jaccard_join, "_cells", lambda tokens: np.zeros(len(tokens), dtype=np.int64))
    jaccard_join._add_cells(full, np.arange(5, dtype=np.uint64))
    assert full.tolist() == [65535, 0]


def test_salted_does_not_make_its_rows_twice(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(50) for b in (1, 2)] + [(99, 7)], "a long, b long")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            made.add(x.num_rows)
            yield x

    rows = pairs.withColumn("frag", F.lit(0)).mapInArrow(count, "a long, b long, frag int")
    table = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "b long, frag int, v string")
    got = salted(rows, table, "b", "a", 5000, pairs, ("frag",)).select("a", "b", "v").collect()
    assert sorted(map(tuple, got)) == sorted((a, b, "xz"[b - 1]) for a in range(50) for b in (1, 2))
    assert made.value == 101


def test_near_duplicates_of_a_large_group(spark, documents):
    """One group holds most rows: every copy differs from the base in one place, so all reach it."""
    rng = random.Random(9)
    base = prose(rng, 120, 5000).split()
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, prose(rng, 80, 5000)) for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(rows)).collect()}
    assert got == {d: c for d, _, c in jaccard_components(rows)}


def test_near_duplicates_of_repeated_rows(spark, documents):
    """Rows that occur twice, with one id and text, count once: pairs at about 0.7 stay apart, one at 0.9 links.

    The ends occur in further texts, so what a pair shares is rare and passes the bounds before it is verified.
    """
    rng = random.Random(12)
    rows = []
    for g in range(4):
        shared, ends = prose(rng, 328 if g else 380, 5000), [prose(rng, 72 if g else 20, 5000) for _ in range(2)]
        for k, end in enumerate(ends):
            rows += [(100 * g + k, f"{shared} {end}")] * 2 + [(100 * g + k, f"{shared}  {end}".upper())]
            rows += [(100 * g + 10 * (k + 1) + m, f"{end} {prose(rng, 300, 5000)}") for m in range(3)]
    got = sorted(map(tuple, near_duplicates(documents(rows).repartition(3)).select(
        "doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted(jaccard_components(rows))
    assert [c for d, _, c in got if d % 100 == 1] == [0, 0, 0, 101, 101, 101, 201, 201, 201, 301, 301, 301]


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (None, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60)) and got[300] == 200
    assert components(df.limit(0)).count() == 0


def cut_repeats(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    low = {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            if d is not None:
                low[g] = min(d, low.get(g, d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - 12):
            first = low.get(tuple(w[k:k + 13]))
            if first is not None and (d is None or first < d):
                gone.update(range(k, k + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substring_dedup_matches_brute_force(spark, documents):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (13, 14, 20, 55, 12)]
    rows = [(500, None), (501, ""), (502, passages[0]), (400, passages[0]), (503, passages[4]), (3, passages[4]),
            (504, "same " * 40), (None, passages[3]), (505, " ".join([passages[2]] * 3))]
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 40))]
        rows.append((rng.randrange(10_000) + 1000 * (i % 2), "\n ".join(parts)))
    rows.append((20_000, prose(rng, 30_000)))
    got = sorted(map(tuple, remove_repeats(documents(rows).repartition(4)).collect()), key=str)
    assert got == sorted(cut_repeats(rows), key=str)
    assert remove_repeats(documents([])).count() == 0


def test_keep_one_follows_each_text_of_a_repeated_id(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text), (2, "another text of its own with enough words"), (3, text + " tail"), (None, text)]
    kept = keep_one(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([
        (1, text), (2, "another text of its own with enough words"), (0, text)])


def test_substring_dedup_holds_no_map_of_all_words(spark, documents, monkeypatch):
    rng = random.Random(7)
    rows = [(i, prose(rng, 700, 10**9)) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 40, 10**9)} {rows[i][1]}") for i in range(4)]
    sizes, build = [], repeats.build
    monkeypatch.setattr(repeats, "build", lambda df, keys, n, *args, **named: sizes.append(n) or build(df, keys, n, *args, **named))
    got = sorted(map(tuple, remove_repeats(documents(rows).repartition(3)).collect()))
    assert got == sorted(cut_repeats(rows))
    assert sizes and max(sizes) <= 4  # of the rows that lose words, however many words there are


def test_substring_dedup_deals_windows_in_packed_rows(spark, documents):
    rng = random.Random(8)
    rows = [(i, prose(rng, 500, 10**9)) for i in range(50)]
    # the same passage in all of one task's rows, and a text that repeats itself, are sent on once
    rows += [(100 + i, rows[0][1]) for i in range(10)] + [(200, "same " * 3000)]
    marked = documents(rows).coalesce(1).select("doc_id", "text", F.lit(1).alias("mark"))
    dealt = substring_dedup._dealt(marked, 16, np.empty(0, dtype=np.uint64)).collect()
    assert len(dealt) <= 17
    assert sum(len(r.hashes) for r in dealt) == 8 * (50 * 488 + 1)
    own = [r for r in dealt if r.bucket < 0]
    assert len(own) == 1 and set(own[0].ids) == {100 + i for i in range(10)} and not own[0].hashes


def test_substring_dedup_spreads_a_common_anchor(spark, documents):
    rng = random.Random(9)
    line = prose(rng, 9, 10**9)
    rows = [(i, f"{prose(rng, 12, 10**9)} {line} {prose(rng, 12, 10**9)}") for i in range(600)]
    marked = documents(rows).repartition(2).select("doc_id", "text", F.lit(1).alias("mark"))
    common = substring_dedup._common(marked, 600, 40)
    assert 0 < len(common) <= 3

    def largest(anchors):
        sizes = [0] * 40
        for r in substring_dedup._dealt(marked, 40, anchors).collect():
            sizes[r.bucket] += len(r.hashes) // 8
        assert sum(sizes) == 600 * 21
        return max(sizes) * 40 / sum(sizes)

    assert largest(np.empty(0, dtype=np.uint64)) > 5 and largest(common) < 2


def test_substring_dedup_of_odd_rows_in_many_buckets(spark, documents):
    rng = random.Random(10)
    line, passage = prose(rng, 20, 10**9), prose(rng, 40, 10**9)
    rows = [(i, f"{prose(rng, 60)} {line} {prose(rng, 60)}") for i in range(300)]
    rows += [(None, f"{passage} {prose(rng, 20)} {passage}"), (None, passage), (None, "same " * 200),
             (900, f"{passage} {passage} {prose(rng, 20)} {passage}"), (901, f"x {passage} y {passage}"),
             (900, f"{passage} again {prose(rng, 400)}"), (900, f"{passage} again"), (902, "same " * 300), (902, "same " * 300),
             (903, "same " * 20), (904, " ".join([line] * 30)), (2**63 - 1, passage), (-5, prose(rng, 300) + " " + "same " * 14)]
    for _ in range(2):
        rng.shuffle(rows)
        df = documents(rows).repartition(5)
        assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == sorted(cut_repeats(rows), key=str)
    named = [(None if d is None else f"{d + 6:020d}", t) for d, t in rows]
    df = spark.createDataFrame(named, "id string, body string").repartition(5)
    assert sorted(map(tuple, remove_repeats(df, "id", "body").collect()), key=str) == sorted(cut_repeats(named), key=str)
