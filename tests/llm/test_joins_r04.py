"""The n-gram Jaccard join: what is sent to more than one task, the order of sets, and where sets are made."""

import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import hot, jaccard_join, repeats
from tallyspark.llm.text import shingles, sorted_distinct


def test_salted_sends_the_table_row_of_a_cold_key_once(spark, monkeypatch):
    """Before, each key's row went to every salt that its rows had."""
    monkeypatch.setattr(hot, "SHARE", 4)
    monkeypatch.setattr(hot, "DEALT", 10)
    rows = spark.createDataFrame([(k, 100 * k + i) for k in range(20) for i in range(9)]
                                 + [(77, i) for i in range(120)] + [(None, 5)], "k int, v int")
    table = spark.createDataFrame([(k, f"t{k}") for k in [*range(20), 77, 99]], "k int, t string")
    sent = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            sent.add(b.num_rows)
            yield b

    plain = sorted(map(tuple, rows.join(table, "k").select("k", "v", "t").collect()))
    joined = hot.salted(rows, table, "k", "v", 301, rows)
    assert sorted(map(tuple, joined.select("k", "v", "t").collect())) == plain
    plan = spark._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert plan.count("Join") == 1  # the places are not joined to the table any more
    cold = hot.salted(rows.filter("k < 20"), table.mapInArrow(count, table.schema), "k", "v", 180, rows.filter("k < 20"))
    assert "salt" not in spark._jvm.PythonSQLUtils.explainString(cold._jdf.queryExecution(), "simple")
    assert sorted(map(tuple, cold.select("k", "v", "t").collect())) == [x for x in plain if x[0] < 20]
    assert sent.value == 22


def test_order_of_sets_equals_a_plain_sort():
    rng = np.random.default_rng(5)
    tokens = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
    frequent, counts = tokens[::3], rng.integers(2, 5000, 1000)
    cells = np.zeros((1 << jaccard_join.SKETCH_BITS) // 8, dtype=np.uint8)
    for c in jaccard_join._cells(frequent).tolist():
        cells[c >> 3] |= 1 << (7 - (c & 7))
    order = jaccard_join.GlobalOrder(cells, frequent, counts, 10**6)
    level = dict(zip(frequent.tolist(), counts.tolist(), strict=True))
    want = sorted(tokens.tolist(), key=lambda t: (level.get(t, 0).bit_length(), t))
    assert order.ordered(tokens)[0].tolist() == want
    for k in (1, 600, 2000, 2001, 2900, 3000):
        assert order.first(tokens, k).tolist() == want[:k]
    assert (np.diff(order.ordered(tokens)[1]) >= 0).all()


def test_sorted_distinct_equals_unique():
    rng = random.Random(1)
    for n in (0, 1, 2, 50, 700):
        values = np.array([rng.randrange(1 << 64) if rng.random() < 0.5 else rng.randrange(9) for _ in range(n)], dtype=np.uint64)
        assert sorted_distinct(values).tolist() == sorted(set(values.tolist()))
    assert len(shingles(b"a b a b a b a b a b a b")) == 2


def test_sets_of_pairs_come_without_a_shuffle_of_texts(spark, documents):
    """The texts of wanted classes were shuffled to meet their ids."""
    rows = documents([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)] + [(3, " ".join(f"w3x{j}" for j in range(40)))]
                     ).select("doc_id", "text")
    stored, _ = jaccard_join.store(jaccard_join._sets(rows, 5), "sets")
    order = spark.sparkContext.broadcast(jaccard_join._global_order(rows, stored, 5))
    ids = repeats.build(rows.filter("doc_id < 6").select(F.xxhash64("doc_id").alias("key")), jaccard_join._column_keys("key"), 6,
                        keep_seen=True)
    made = jaccard_join._segments(rows, 5, order, ids)
    assert "Exchange" not in spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    es = {r.e for r in stored.filter("doc_id < 6").collect()}
    got = {}
    for r in made.collect():
        got.setdefault((r.e, r.copy), []).extend(r.tokens)
    assert es <= {e for e, _ in got} and len(got) < 15
    assert all(len(t) == len(set(t)) == 36 for t in got.values())
    pairs = stored.filter("doc_id IN (3, 4)").select("e").distinct().selectExpr("min(e) AS a", "max(e) AS b")
    prefixes = stored.filter("chunk IS NULL").groupBy("e").agg(F.min("doc_id").alias("doc_id"))
    sets, _ = jaccard_join._sets_of(pairs, rows, prefixes, 5, order)
    p = pairs.first()
    found = sets.filter(F.col("e").isin(p.a, p.b)).groupBy("e").agg(F.sum(F.size("tokens"))).collect()
    assert sorted(map(tuple, found)) == sorted([(p.a, 36), (p.b, 36)])
